"""Best-fit packing of token pieces by linear grouping.

Sequences hold at most ``capacity`` tokens, so all that a plan needs is how many
pieces there are of each length: at most ``capacity`` numbers, whatever the size of
the corpus. On them:

1. Large lengths (above ``small`` of the capacity) are sorted and cut into groups of
   equal cardinality; each is rounded up to its group's longest.
2. Configurations of the few rounded sizes are optimised as a linear programme by
   column generation (a small dense simplex; new columns from a knapsack table) and
   rounded down to whole sequences; what is left over is placed by best fit.
3. Actual lengths take the places of the rounded ones. Room gained is real room.
4. Small lengths, longest first, go where they leave the least room.

The plan speaks of runs: "the next m pieces of length L go to sequences s, s+1, ...
at offset o". Pieces find their place by their rank within their length; ranks come
from counts per (length, salt), so a hot length is spread over many tasks.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from loomwork.llm.arrowtext import text_slices
from loomwork.llm.tokenids import TokenizerFile, shared_encoder
from loomwork.session import default_blocks, stored

CAPACITY = 4096
GROUPS = 40
SMALL = 1 / 8


@dataclass
class Run:
    """``count`` equal sequences from number ``first``; ``items`` are (length, first rank, offset)."""

    first: int
    count: int
    used: int = 0
    items: list = field(default_factory=list)

    def split(self, count: int) -> Run:
        """Cut off all but the first ``count`` sequences."""
        rest = Run(self.first + count, self.count - count, self.used, [(n, r + count, o) for n, r, o in self.items])
        self.count = count
        return rest


def configurations(sizes: Sequence[int], demand: Sequence[int], capacity: int, rounds: int = 400) -> list[tuple[int, tuple[int, ...]]]:
    """(whole sequences, pieces of each size) of the optimal fractional plan, rounded down.

    Column generation: a basis of one column per size, new columns by the unbounded
    knapsack over the duals.
    """
    m = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, dtype=float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        amount = np.maximum(inverse @ need, 0.0)
        dual = inverse.sum(axis=0)  # every sequence costs one
        # value[k][r]: best dual worth of at most k pieces in room r.
        value, choices = np.zeros(capacity + 1), []
        for _ in range(capacity // min(sizes)):
            best, choice = value.copy(), np.full(capacity + 1, -1)
            for i, s in enumerate(sizes):
                offer = value[: capacity + 1 - s] + dual[i]
                better = offer > best[s:] + 1e-12
                best[s:][better] = offer[better]
                choice[s:][better] = i
            value = best
            choices.append(choice)
        if value[capacity] <= 1 + 1e-9:
            break
        column, room = np.zeros(m), capacity
        for choice in reversed(choices):
            if choice[room] >= 0:
                column[choice[room]] += 1
                room -= sizes[choice[room]]
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, amount / np.where(direction > 1e-9, direction, 1.0), np.inf)
        leave = int(ratio.argmin())
        basis[:, leave] = column
    amount = np.maximum(np.linalg.inv(basis) @ need, 0.0)
    whole = np.floor(amount + 1e-6).astype(np.int64)
    return [(int(w), tuple(int(c) for c in basis[:, k])) for k, w in enumerate(whole) if w]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> list[Run]:
    """Runs that hold ``histogram[length]`` pieces of each length (1 to ``capacity``)."""
    rank = dict.fromkeys(histogram, 0)
    runs: list[Run] = []
    total = 0

    def take(length: int, run: Run) -> None:
        run.items.append((length, rank[length], run.used))
        run.used += length
        rank[length] += run.count

    # Full pieces are sequences already; large ones are grouped.
    large = sorted((n for n in histogram if capacity * small < n < capacity), reverse=True)
    if histogram.get(capacity):
        runs.append(Run(0, histogram[capacity]))
        take(capacity, runs[0])
        total = histogram[capacity]
    amount = sum(histogram[n] for n in large)
    members: list[list[list[int]]] = []  # per group: [length, how many], longest first
    share, room = -(-amount // groups) if amount else 0, 0
    for n in large:
        left = histogram[n]
        while left:
            if room == 0:
                members.append([])
                room = share
            part = min(left, room)
            members[-1].append([n, part])
            left, room = left - part, room - part
    sizes = [g[0][0] for g in members]
    # Equal sizes of neighbouring groups are one size.
    for i in range(len(sizes) - 1, 0, -1):
        if sizes[i] == sizes[i - 1]:
            members[i - 1] += members.pop(i)
            sizes.pop(i)
    demand = [sum(c for _, c in g) for g in members]

    def fill(count: int, pattern: Sequence[int]) -> None:
        """``count`` sequences of a configuration, with actual lengths in the places of the rounded."""
        nonlocal total
        slots = [g for g, times in enumerate(pattern) for _ in range(times)]
        open_ = [Run(total, count)]
        total += count
        for g in slots:
            done = []
            for run in open_:
                while run is not None:
                    length, left = members[g][0]
                    rest = run.split(left) if left < run.count else None
                    take(length, run)
                    members[g][0][1] -= run.count
                    if not members[g][0][1]:
                        members[g].pop(0)
                    done.append(run)
                    run = rest
            open_ = done
        runs.extend(open_)

    if sizes:
        for count, pattern in configurations(sizes, demand, capacity):
            # Rounding and degenerate columns never ask for more than there is.
            for i, times in enumerate(pattern):
                if times:
                    count = min(count, demand[i] // times)
            for i, times in enumerate(pattern):
                demand[i] -= count * times
            if count:
                fill(count, pattern)

    # Left-over large pieces and the small ones: best fit, longest first.
    rest: dict[int, int] = {}
    for group in members:
        for n, c in group:
            rest[n] = rest.get(n, 0) + c
    for n, c in histogram.items():
        if n <= capacity * small and n < capacity:
            rest[n] = rest.get(n, 0) + c
    by_room: dict[int, list[Run]] = {}
    for run in runs:
        if run.used < capacity:
            by_room.setdefault(capacity - run.used, []).append(run)
    rooms = sorted(by_room)
    heap = [-n for n in rest]
    heapq.heapify(heap)
    while heap:
        n = -heapq.heappop(heap)
        left = rest[n]
        while left:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                run = Run(total, -(-left // (capacity // n)))
                total += run.count
                runs.append(run)
                have = capacity
            else:
                have = rooms[at]
                run = by_room[have].pop()
                if not by_room[have]:
                    del by_room[have]
                    rooms.pop(at)
            if left < run.count:
                other = run.split(left)
                runs.append(other)
                by_room.setdefault(have, []).append(other)
                if len(by_room[have]) == 1:
                    insort(rooms, have)
            take(n, run)
            left -= run.count
            have -= n
            if have:
                by_room.setdefault(have, []).append(run)
                if len(by_room[have]) == 1:
                    insort(rooms, have)
    return runs


def pieces(
    docs: DataFrame, key: str, text: str, tokenizer: TokenizerFile, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """Per piece: ``key``, piece, start, length, ids_crc32 and, on request, ids."""
    type_of = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {type_of}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def run(batches):
        encoder = shared_encoder(tokenizer)
        for part, texts in text_slices(batches, "__text"):
            flat, counts = encoder.encode(texts)
            ends = np.cumsum(counts)
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, (stop, n) in enumerate(zip(ends.tolist(), counts.tolist())):
                whole = np.append(flat[stop - n : stop], np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, n + 1, capacity)):
                    cut = whole[at : at + capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(cut))
                    crc.append(zlib.crc32(cut.tobytes()))
                    if with_ids:
                        ids.append(cut.astype(np.int32))
            columns = [
                part.column(0).take(pa.array(row, pa.int64())),
                pa.array(piece, pa.int32()),
                *(pa.array(c, pa.int64()) for c in (start, length, crc)),
            ]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(key, F.col(text).alias("__text")).mapInArrow(run, schema)


def _place(length_of: DataFrame, key: str, runs: list[Run], salts: int) -> DataFrame:
    """Append sequence_id and offset to rows (key, piece, start, length, ids_crc32)."""
    by_length: dict[int, list] = {}
    for r in runs:
        for n, first, offset in r.items:
            by_length.setdefault(n, []).append((first, r.first, offset))
    tables = {n: tuple(np.array(c, dtype=np.int64) for c in zip(*sorted(v))) for n, v in by_length.items()}

    salted = length_of.withColumn("__salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)))
    totals = salted.groupBy("length", "__salt").count()
    earlier = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        "length", "__salt", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy("length", "__salt").orderBy(key, "piece", "ids_crc32")
    ranked = salted.join(before, ["length", "__salt"]).withColumn("__rank", F.col("__before") + F.row_number().over(inside) - 1)

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def where(length, rank):
        import pandas as pd

        sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for n in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == n)
            first, base, at = tables[n]
            k = np.searchsorted(first, ranks[rows], side="right") - 1
            sequence[rows] = base[k] + ranks[rows] - first[k]
            offset[rows] = at[k]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("__w", where("length", "__rank"))
    return placed.select(key, "piece", "start", "length", "ids_crc32", "__w.sequence_id", "__w.offset")


def pack(
    docs: DataFrame, tokenizer: TokenizerFile, key: str = "doc_id", text: str = "text", end_id: int = 1, capacity: int = CAPACITY
) -> DataFrame:
    """Per piece: ``key``, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids and one ``end_id`` are cut into pieces of ``capacity``; the last
    may be shorter. A null or empty text is the end id alone. Null keys and repeated
    rows are packed like any other, each row as its own pieces; an empty table gives
    an empty result. Other columns are not carried, so their names cannot clash.
    """
    found = stored(pieces(docs, key, text, tokenizer, end_id, capacity), "pieces")
    counts = found.groupBy("length").count().collect()  # at most ``capacity`` rows
    runs = plan({r["length"]: r["count"] for r in counts}, capacity)
    return _place(found, key, runs, default_blocks(docs.sparkSession))


def sequences(with_ids: DataFrame, placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (sequence_id, ids) from pieces with ids and their places; ``key`` is unique here."""
    joined = placed.select(key, "piece", "sequence_id", "offset").join(with_ids.select(key, "piece", "ids"), [key, "piece"])
    packed = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("__p"))
    return packed.select("sequence_id", F.flatten("__p.ids").alias("ids"))
