"""Best-fit packing of token sequences into rows of fixed capacity.

The rule is sequential, so it runs inside pack groups. A group takes the place of
one reading rank: rows belong to it by a hash of their id, and groups are independent.
A task reads the (id, length) rows of its groups in order and answers with placements
as they come, so it holds one buffer of waiting sequences and not a group; token
arrays stay in the JVM and are joined to the placements.

Planning can stop and go on. The state of a group before a step (cursor, epoch,
sequences placed, sequences waiting) is a row of the plan; ``plan_steps`` given such
rows reads on from the cursor and places what the uninterrupted plan would place. Both sides carry ``pack_group``, so where the session lets a join use
partitioning on some of its keys (session.RECOMMENDED), tokens are shuffled once.
"""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomwork.functions.text import hash60
from loomwork.operators.running import running

PLACEMENT = (
    "pack_group int, row_in_group int, pos int, doc_id bigint, start_at int, take int, n_tokens bigint"
)


STATE = "pack_group int, step int, epoch int, cursor bigint, consumed bigint, waiting array<struct<doc_id: bigint, n_tokens: bigint, epoch: int>>"
_STEPS = f"{PLACEMENT}, epoch int, step int, cursor bigint, consumed bigint, waiting array<struct<doc_id: bigint, n_tokens: bigint, epoch: int>>"
# Placements a task holds before it hands them on.
_BATCH = 20_000


class _Buffer:
    """Waiting sequences by length; equal lengths leave in order of arrival."""

    def __init__(self) -> None:
        self.lengths: list[int] = []
        self.waiting: dict[int, deque] = {}
        self.size = self.arrived = 0

    def add(self, length: int, item) -> None:
        if length not in self.waiting:
            bisect.insort(self.lengths, length)
            self.waiting[length] = deque()
        self.waiting[length].append((self.arrived, item))
        self.arrived += 1
        self.size += 1

    def _take(self, index: int):
        length = self.lengths[index]
        queue = self.waiting[length]
        _, item = queue.popleft()
        if not queue:
            del self.waiting[length]
            del self.lengths[index]
        self.size -= 1
        return length, item

    def longest_within(self, limit: int):
        index = bisect.bisect_right(self.lengths, limit) - 1
        return self._take(index) if index >= 0 else None

    def shortest(self):
        return self._take(0)

    def in_order(self) -> list[tuple[object, int]]:
        """(item, length) of all that wait, as they arrived."""
        held = [(at, item, n) for n, queue in self.waiting.items() for at, item in queue]
        return [(item, n) for _, item, n in sorted(held, key=lambda h: h[0])]


@dataclass
class Packer:
    """The packing rule of one group, fed one sequence at a time.

    Each step takes the longest waiting sequence that still fits the row. When
    none fits, the shortest is cropped to fill it (``crop``) or the row is closed
    to be padded. No step is taken before ``buffer_size`` sequences wait, until
    ``drain`` says that no more will come; so only the last row can stay short in crop mode.
    """

    capacity: int
    buffer_size: int
    crop: bool
    rows_per_step: int = 0  # states are told before every so many rows; none if 0
    row: int = 0
    filled: int = 0
    pos: int = 0
    consumed: int = 0
    told: int = -1
    buffer: _Buffer = field(default_factory=_Buffer)

    def feed(self, item, length: int) -> Iterator[tuple]:
        if length:
            self.buffer.add(length, item)
            yield from self.resumed()

    def resumed(self) -> Iterator[tuple]:
        while self.buffer.size >= self.buffer_size:
            yield from self._step()

    def drain(self) -> Iterator[tuple]:
        while self.buffer.size:
            yield from self._step()

    def _step(self) -> Iterator[tuple]:
        """A placement (row, pos, item, start_at, take, length), or a state (step, consumed, waiting) before it."""
        if self.pos == 0 and self.rows_per_step and self.row % self.rows_per_step == 0 and self.told < self.row:
            self.told = self.row
            yield self.row // self.rows_per_step, self.consumed, self.buffer.in_order()
        found = self.buffer.longest_within(self.capacity - self.filled)
        if found is None and not self.crop:
            self.row, self.filled, self.pos = self.row + 1, 0, 0
            return
        length, item = found or self.buffer.shortest()
        take = min(length, self.capacity - self.filled)
        placed = self.row, self.pos, item, self.filled, take, length
        self.consumed += 1
        self.filled, self.pos = self.filled + take, self.pos + 1
        if self.filled == self.capacity:
            self.row, self.filled, self.pos = self.row + 1, 0, 0
        yield placed


def place(
    sequences: Iterable[tuple[object, int]], capacity: int, buffer_size: int, crop: bool
) -> Iterator[tuple[int, int, object, int, int, int]]:
    """Yield (row, pos, item, start_at, take, length) for a finite input."""
    packer = Packer(capacity, buffer_size, crop)
    for item, length in sequences:
        yield from packer.feed(item, length)
    yield from packer.drain()


def with_pack_group(rows: DataFrame, n_groups: int, key: str = "doc_id") -> DataFrame:
    """Append ``pack_group``, one of ``n_groups``, by hash of the id.

    The number of groups stands for the number of reading ranks: it is chosen and kept
    with the data, so that more rows never move a row to another group.
    """
    if n_groups < 1:
        raise ValueError("need one group at least")
    return rows.withColumn("pack_group", F.pmod(hash60(F.col(key).cast("string")), F.lit(n_groups)).cast("int"))


def plan(
    rows: DataFrame, capacity: int, crop: bool, buffer_size: int, key: str = "doc_id", length: str = "n_tokens"
) -> DataFrame:
    """Placement table of rows that carry ``pack_group``; ids in order within a group."""
    steps = plan_steps(rows, capacity, crop, buffer_size, 0, key=key, length=length)
    return steps.select(*[c.split()[0] for c in PLACEMENT.split(", ")])


def plan_steps(
    rows: DataFrame,
    capacity: int,
    crop: bool,
    buffer_size: int,
    rows_per_step: int,
    epochs: int = 1,
    state: DataFrame | None = None,
    key: str = "doc_id",
    length: str = "n_tokens",
) -> DataFrame:
    """Placements with their epoch, and states: the rows with a ``step`` and no ``row_in_group``.

    The input is read ``epochs`` times over, each time in order of ``key`` within a
    group. A state (``saved_states``) holds before its step, with the buffer full: the epoch
    and key read last, the number of sequences placed, and those waiting as they came.
    With ``state``, one row per group to go on with, only rows after the cursor are read,
    and row numbers go on; ``rows_per_step`` must be the one the state was saved with.
    Keys are unique; a null one stands first in its group. Sequences without tokens are
    passed over. Store the result before reading it twice.
    """
    narrow = rows.select(
        "pack_group",
        F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"),
        F.col(key).cast("bigint").alias("doc_id"),
        F.col(length).cast("bigint").alias("n_tokens"),
    )
    none = F.lit(None)
    kind = "array<struct<doc_id: bigint, n_tokens: bigint, epoch: int>>"
    fed = narrow.select(
        "pack_group", F.lit(1).alias("kind"), "epoch", "doc_id", "n_tokens",
        none.cast("int").alias("step"), none.cast("bigint").alias("consumed"), none.cast(kind).alias("waiting"),
    )
    if state is not None:
        cursor = state.select("pack_group", F.col("epoch").alias("__epoch"), F.col("cursor").alias("__cursor"))
        after = (F.col("epoch") > F.col("__epoch")) | (
            (F.col("epoch") == F.col("__epoch"))
            & F.col("doc_id").isNotNull()
            & (F.col("__cursor").isNull() | (F.col("doc_id") > F.col("__cursor")))
        )
        fed = fed.join(cursor, "pack_group").filter(after).drop("__epoch", "__cursor")
        fed = fed.unionByName(
            state.select(
                "pack_group", F.lit(0).alias("kind"), "epoch", F.col("cursor").alias("doc_id"),
                none.cast("bigint").alias("n_tokens"), "step", "consumed", "waiting",
            )
        )

    def run(batches):
        out: list[tuple] = []
        group, packer, epoch, cursor = None, None, None, None

        def told(events):
            for e in events:
                if len(e) == 3:
                    waiting = [{"doc_id": doc, "n_tokens": n, "epoch": of} for (doc, of), n in e[2]]
                    out.append((group, None, None, None, None, None, None, epoch, e[0], cursor, e[1], waiting))
                else:
                    row, pos, (doc, of), start, take, n = e
                    out.append((group, row, pos, doc, start, take, n, of, None, None, None, None))

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for now, what, in_epoch, doc, n, step, consumed, waiting in zip(*columns):
                if packer is None or now != group:
                    if packer is not None:
                        told(packer.drain())
                    group, packer = now, Packer(capacity, buffer_size, crop, rows_per_step)
                epoch, cursor = in_epoch, doc
                if what == 0:
                    packer.row, packer.consumed = step * rows_per_step, consumed
                    for w in waiting:
                        packer.buffer.add(w["n_tokens"], (w["doc_id"], w["epoch"]))
                    told(packer.resumed())
                else:
                    told(packer.feed((doc, in_epoch), n if crop or n is None else min(n, capacity)))
                if len(out) >= _BATCH:
                    yield _events(out)
                    out = []
        if packer is not None:
            told(packer.drain())
        yield _events(out)

    placed = fed.repartition("pack_group").sortWithinPartitions("pack_group", "kind", "epoch", "doc_id")
    return placed.select("pack_group", "kind", "epoch", "doc_id", "n_tokens", "step", "consumed", "waiting").mapInArrow(run, _STEPS)


def saved_states(steps: DataFrame) -> DataFrame:
    """The states of ``plan_steps``, one row per group and step."""
    return steps.filter("step IS NOT NULL").select("pack_group", "step", "epoch", "cursor", "consumed", "waiting")


_EVENTS = pa.schema(
    [
        ("pack_group", pa.int32()), ("row_in_group", pa.int32()), ("pos", pa.int32()), ("doc_id", pa.int64()),
        ("start_at", pa.int32()), ("take", pa.int32()), ("n_tokens", pa.int64()), ("epoch", pa.int32()), ("step", pa.int32()),
        ("cursor", pa.int64()), ("consumed", pa.int64()),
        ("waiting", pa.list_(pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("epoch", pa.int32())]))),
    ]
)


def _events(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_EVENTS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _EVENTS)], schema=_EVENTS)


def number_rows(placements: DataFrame) -> DataFrame:
    """(pack_group, row_in_group, content_len, n_docs, row_id): rows numbered across groups.

    Give a materialised placement table: it is read twice.
    """
    rows = placements.groupBy("pack_group", "row_in_group").agg(
        F.sum("take").alias("content_len"), F.count(F.lit(1)).alias("n_docs")
    )
    sizes = placements.groupBy("pack_group").agg((F.max("row_in_group") + 1).cast("bigint").alias("n_rows"))
    firsts = running(sizes, "pack_group", {"first_row": ("sum", F.col("n_rows"))}, inclusive=False)
    return rows.join(firsts.select("pack_group", "first_row"), "pack_group").select(
        "pack_group", "row_in_group", "content_len", "n_docs",
        (F.col("first_row") + F.col("row_in_group")).alias("row_id"),
    )


def fill_rows(tokens: DataFrame, placements: DataFrame, arrays: dict[str, int | None], capacity: int) -> DataFrame:
    """(pack_group, row_in_group, content_len, arrays): packed rows.

    ``arrays`` maps an array column to its padding value, or None for no padding.
    A row gathers at most ``capacity`` elements.
    """
    names = list(arrays)
    # Only the first ``capacity`` elements of a sequence can ever be placed.
    wide = tokens.select("pack_group", "doc_id", *[F.slice(n, 1, capacity).alias(n) for n in names])
    spots = placements.drop("n_tokens")
    if tokens.sparkSession.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "false":
        # Placed by group alone, both sides serve the join and the row assembly below.
        spots, wide = spots.repartition("pack_group"), wide.repartition("pack_group")
    joined = spots.join(wide, ["pack_group", "doc_id"])
    piece = F.struct("pos", *[F.slice(F.col(n), F.lit(1), F.col("take")).alias(n) for n in names])
    rows = joined.groupBy("pack_group", "row_in_group").agg(
        F.sum("take").cast("int").alias("content_len"), F.array_sort(F.collect_list(piece)).alias("pieces")
    )
    filled = []
    for name, pad in arrays.items():
        flat = F.flatten(F.col(f"pieces.{name}"))
        if pad is not None:
            flat = F.concat(flat, F.array_repeat(F.lit(pad).cast("int"), F.lit(capacity) - F.col("content_len")))
        filled.append(flat.alias(name))
    return rows.select("pack_group", "row_in_group", "content_len", *filled)


def masked_targets(rows: DataFrame, capacity: int) -> DataFrame:
    """Append ``inputs`` and ``targets`` of padded rows.

    A target is -1 where its mask is 0 and from the last content token on.
    """
    size = capacity - 1
    targets = F.transform(
        F.arrays_zip(F.slice("tokens", 2, size).alias("t"), F.slice("mask", 2, size).alias("m")),
        lambda p, i: F.when(
            (p["m"] == 0) | ((F.col("content_len") < capacity) & (i >= F.col("content_len") - 1)), F.lit(-1)
        ).otherwise(p["t"]),
    )
    return rows.withColumn("inputs", F.slice("tokens", 1, size)).withColumn("targets", targets)


def quality(placements: DataFrame, capacity: int) -> DataFrame:
    """One row: rows, utilisation, cropped and padded share."""
    rows = F.count_distinct("pack_group", "row_in_group")
    placed = F.sum("take")
    return placements.agg(
        rows.alias("n_rows"),
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("n_tokens").alias("n_tokens"),
        placed.alias("placed_tokens"),
        (placed / (rows * capacity)).alias("utilisation"),
        (1 - placed / F.sum("n_tokens")).alias("cropped_share"),
        (1 - placed / (rows * capacity)).alias("padded_share"),
    )


def steps(numbered: DataFrame, batch_size: int, dataset_size: int, num_iterations: int = -1) -> DataFrame:
    """(step, n_rows, consumed, progress, last_step) for batches of ``batch_size`` rows.

    Packed rows are stored and numbered, so resuming after step s is the filter
    ``step > s``: the same rows follow, whatever the cluster.
    """
    batches = numbered.groupBy(F.floor(F.col("row_id") / batch_size).alias("step")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n_docs").alias("docs")
    )
    walked = running(batches, "step", {"consumed": ("sum", F.col("docs"))})
    done = F.col("consumed") >= dataset_size
    if num_iterations > 0:
        progress = (F.col("step") + 1) / num_iterations
        done |= F.col("step") + 1 >= num_iterations
    else:
        progress = F.col("consumed") / dataset_size
    return walked.select("step", "n_rows", "consumed", progress.alias("progress"), done.alias("last_step"))


def resume(numbered: DataFrame, batch_size: int, saved_step: int) -> DataFrame:
    """Rows of the steps after a saved one."""
    return numbered.filter(F.floor(F.col("row_id") / batch_size) > saved_step)
