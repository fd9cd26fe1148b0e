"""Packing that keeps every window at the target mixture of its sources.

Each source's documents are a queue of tokens. Deficit round-robin serves the queues
in rounds of one window: every round credits a queue with its share of the window, the
queue spends the whole tokens of its credit, and the fraction it cannot spend is its
deficit, carried to the next round. A queue that is empty gets nothing more and the
others share its room by their targets. Served tokens, round after round, are one
stream, and windows are its consecutive stretches of ``capacity`` tokens. A window's
tokens of one source therefore differ from the target by less than the number of queues
(what rounds before it are behind) plus one (its own fraction).

Because credits are fixed shares, a queue's credit after r rounds is a number known
beforehand, ``r * share`` rounded down, and its deficit is what was rounded off. So tasks need not
wait for one another: a document that knows the place of its first token in its queue
finds its windows by arithmetic. Places come from totals per chunk (what one scan task
read) and source: the carry from chunk to chunk is the only thing that crosses tasks.

The stream fills all windows but the last. What is left for that one is cut into
sequences of powers of two, which need no padding, so nothing is padded at all.

Targets are the corpus's own shares of tokens unless given. Sources below ``MIN_SHARE``
(or not named among the targets) share one queue, so that there are at most
1 / MIN_SHARE + 1 queues, whatever the number of sources.

Shuffles: totals per chunk and source; the carries, joined to the stored ids, which
Catalyst broadcasts below its threshold and otherwise meets by moving the ids once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from loomwork.llm.arrowtext import text_slices
from loomwork.llm.byteids import shared_byte_encoder
from loomwork.llm.tokenids import TokenizerFile
from loomwork.operators.running import running
from loomwork.session import stored

CAPACITY = 1024
END_ID = 0
MIN_SHARE = 1 / 64
#: Queue that the sources without one of their own share.
REST = "*"
# Weights of the queues sum to UNIT; a round credits a queue with capacity * weight / UNIT tokens.
UNIT = 1 << 24
#: Tokens that a task lays out at a time (at least one document).
SLICE_TOKENS = 1 << 20


class Schedule:
    """Deficit round-robin over queues of ``totals`` tokens with relative ``targets``.

    A phase is a run of rounds with the same queues; it ends where a queue empties, and
    a round in which one does is a phase of its own. There are at most two per queue.
    """

    def __init__(self, totals: list[int], targets: list[float], capacity: int = CAPACITY):
        self.capacity, self.total = capacity, sum(totals)
        served = [0] * len(totals)
        start, base, rate, rounds = [], [], [], 0
        while any(s < t for s, t in zip(served, totals)):
            left = [t - s for s, t in zip(served, totals)]
            weights = _weights([x if n else 0 for x, n in zip(targets, left)], capacity)
            whole = min(n * UNIT // (w * capacity) for n, w in zip(left, weights) if n)
            start.append(rounds)
            base.append(list(served))
            rate.append([w * capacity for w in weights])
            run = max(whole, 1)
            served = [min(t, s + run * w * capacity // UNIT) for s, t, w in zip(served, totals, weights)]
            rounds += run
        self.start = np.array([*start, rounds], dtype=np.int64)
        self.base = np.array([*base, served], dtype=np.int64).reshape(len(start) + 1, len(totals))
        self.rate = np.array(rate, dtype=np.int64).reshape(len(start), len(totals))
        # The last window, if short, falls into sequences of powers of two.
        self.full = self.total // capacity
        rest = self.total - self.full * capacity
        bits = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.tail = np.cumsum([self.full * capacity, *bits])

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens of each queue (columns) that the first ``rounds`` rounds serve."""
        phase = np.minimum(np.searchsorted(self.start, rounds, side="right") - 1, len(self.rate) - 1)
        many, few = np.divmod((rounds - self.start[phase])[:, None], UNIT)
        credit = many * self.rate[phase] + few * self.rate[phase] // UNIT
        return np.minimum(self.base[phase] + credit, self.base[phase + 1])

    def rounds_before(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Number of rounds before the one that serves ``token`` of ``queue``."""
        phase = (self.base[1:, queue] <= token).sum(axis=0)
        due, rate = token + 1 - self.base[phase, queue], self.rate[phase, queue]
        # The least r with r * rate >= due * UNIT, less one.
        whole, part = np.divmod(due, rate)
        within = whole * UNIT - (-part * UNIT // rate) - 1
        return np.minimum(self.start[phase] + within, self.start[phase + 1] - 1)

    def window(self, place: np.ndarray) -> np.ndarray:
        """Sequence that holds the token at ``place`` of the stream."""
        return np.where(
            place < self.full * self.capacity, place // self.capacity, self.full + np.searchsorted(self.tail, place, side="right") - 1
        )

    def window_start(self, window: np.ndarray) -> np.ndarray:
        return np.where(window < self.full, window * self.capacity, self.tail[np.clip(window - self.full, 0, len(self.tail) - 1)])

    def pieces(self, queue: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start in the row, length, sequence, offset) of all pieces of stretches of the queues."""
        before = self.rounds_before(queue, first)
        count = self.rounds_before(queue, first + length - 1) - before + 1
        row = np.repeat(np.arange(len(queue)), count)
        done = before[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        q, served, after = queue[row], self.served(done), self.served(done + 1)
        at = np.arange(len(row))
        # In a round, the queues before this one are served first.
        base = served.sum(axis=1) + np.cumsum(after - served, axis=1)[at, q] - after[at, q]
        begin = np.maximum(first[row], served[at, q])
        size = np.minimum(first[row] + length[row], after[at, q]) - begin
        some = size > 0
        row, begin, size, place = row[some], begin[some], size[some], (base + begin)[some]
        low = self.window(place)
        count = self.window(place + size - 1) - low + 1
        part = np.repeat(np.arange(len(row)), count)
        window = low[part] + np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count)
        opens = self.window_start(window)
        start = np.maximum(place[part], opens)
        stop = np.minimum((place + size)[part], self.window_start(window + 1))
        within = begin[part] - first[row[part]] + start - place[part]
        return row[part], within, stop - start, window, start - opens


def _weights(targets: list[float], capacity: int) -> list[int]:
    """Integers that sum to UNIT, zero where the target is; others give a token a round at least."""
    total = sum(targets)
    least = UNIT // capacity + 1
    weights = [max(least, int(UNIT * (t / total))) if t else 0 for t in targets]
    most = max(range(len(weights)), key=weights.__getitem__)
    weights[most] += UNIT - sum(weights)
    return weights


def encoded(docs: DataFrame, key: str, text: str, source: str | None, tokenizer: TokenizerFile, end_id: int) -> DataFrame:
    """Per row: ``key``, source label, chunk, place in the chunk's tokens of that source, n, ids."""
    type_of = docs.schema[key].dataType.simpleString()
    label = F.lit("") if source is None else F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))

    def run(batches):
        encoder = shared_byte_encoder(tokenizer)
        width = np.dtype("<u2" if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        chunk, places = TaskContext.get().partitionId(), {}
        for part, texts in text_slices(batches, "__text"):
            flat, counts = encoder.encode(texts)
            ends = np.cumsum(counts)
            flat = np.insert(flat, ends, end_id).astype(width)
            counts = counts + 1
            at = []
            for label, n in zip(part.column(1).to_pylist(), counts.tolist()):
                at.append(places.get(label, 0))
                places[label] = at[-1] + n
            offsets = np.concatenate([[0], np.cumsum(counts)]) * width.itemsize
            ids = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)])
            columns = [part.column(0), part.column(1), pa.array([chunk] * len(at), pa.int32())]
            columns += [pa.array(at, pa.int64()), pa.array(counts, pa.int64()), ids]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "label", "chunk", "place", "n", "ids"])

    rows = docs.select(key, label.alias("label"), F.col(text).alias("__text"))
    return rows.mapInArrow(run, f"`{key}` {type_of}, label string, chunk int, place bigint, n bigint, ids binary")


def pack(
    docs: DataFrame,
    tokenizer: TokenizerFile,
    targets: dict[str | None, float] | None = None,
    key: str = "doc_id",
    text: str = "text",
    source: str | None = "source",
    end_id: int = END_ID,
    capacity: int = CAPACITY,
) -> DataFrame:
    """Per piece: ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``targets`` maps sources to relative shares of a window; a source's own share of all
    tokens stands where none is given. A null or empty text is the end id alone; null
    keys, null sources and repeated rows are packed like any other, each row as its own
    document; an empty table gives an empty result. Other columns are not carried, so
    their names cannot clash. Order in a queue is that of the scan.
    """
    found = stored(encoded(docs, key, text, source, tokenizer, end_id), "ids")
    totals = stored(found.groupBy("chunk", "label").agg(F.sum("n").alias("tokens")), "totals")
    by_label = totals.groupBy("label").agg(F.sum("tokens").alias("tokens"))
    total = by_label.agg(F.sum("tokens")).first()[0] or 0
    named = {"" if s is None else f"={s}": share for s, share in (targets or {}).items()}
    # At most 1 / MIN_SHARE sources and those named.
    wanted = by_label.filter(F.col("label").isin(list(named)) if named else F.col("tokens") >= total * MIN_SHARE)
    queues = {r["label"]: r["tokens"] for r in wanted.orderBy(F.desc("tokens"), "label").collect()}
    rest = total - sum(queues.values())
    if rest:
        queues[REST] = rest
    plan = Schedule(list(queues.values()), [named.get(q, n / total) for q, n in queues.items()], capacity)
    number = {q: i for i, q in enumerate(queues)}

    queue_of = F.coalesce(*[F.when(F.col("label") == q, F.lit(i)) for q, i in number.items() if q != REST], F.lit(number.get(REST, 0)))
    carried = running(
        totals.withColumn("queue", queue_of), "chunk", {"carry": ("sum", F.col("tokens"))}, ["queue"], inclusive=False, ties=["label"]
    )
    rows = found.join(stored(carried.select("chunk", "label", "queue", "carry"), "carries"), ["chunk", "label"])
    type_of = docs.schema[key].dataType.simpleString()

    def lay_out(batches):
        for batch in batches:
            n = batch.column(4).to_numpy(zero_copy_only=False)
            ends, at = np.cumsum(n), 0
            while at < batch.num_rows:
                limit = (ends[at - 1] if at else 0) + SLICE_TOKENS
                stop = max(at + 1, int(np.searchsorted(ends, limit, side="right")))
                yield _placed(plan, key, batch.slice(at, stop - at))
                at = stop

    laid = rows.select(key, "queue", "carry", "place", "n", "ids").mapInArrow(
        lay_out,
        f"`{key}` {type_of}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    )
    return laid


def _placed(plan: Schedule, key: str, batch: pa.RecordBatch) -> pa.RecordBatch:
    queue, carry, place, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3, 4))
    row, start, length, window, offset = plan.pieces(queue, carry + place, n)
    ids = batch.column(5).to_pylist()
    crc = []
    for i, a, k in zip(row.tolist(), start.tolist(), length.tolist()):
        width = len(ids[i]) // int(n[i])
        cut = ids[i][a * width : (a + k) * width]
        crc.append(zlib.crc32(np.frombuffer(cut, "<u2").astype("<u4") if width == 2 else cut))
    columns = [start, length, np.array(crc, dtype=np.int64), n[row], window, offset]
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(row)), *(pa.array(c, pa.int64()) for c in columns)],
        names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    )
