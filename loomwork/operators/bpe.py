"""Byte-pair training as a sequence of Spark jobs whose cost follows what a merge changes.

Pre-tokens are counted once. From then on two tables are kept, and no round reads all
pre-tokens again:

* postings (pair, pre-token, its count): where each pair of neighbouring symbols stands.
  A pair comes into being only in the round that makes the later of its two symbols, so
  each round's new postings are a table of their own that holds its pairs completely;
  a merge looks into one such table. The first, of byte pairs, is sorted by pair, and
  Parquet's statistics leave all but a few of its row groups unread.
* counts: those of byte pairs, and each round's differences, summed up from time to time.

A round takes the pre-tokens that hold its pairs, cuts each anew with the merges before
and after the round, and writes the difference: changed counts and new postings. What a
pre-token was cut into is never stored, so a posting may be out of date; it then changes
nothing. After its own round a pair can only lose, so the driver keeps the leading pairs
with their exact counts and a floor that no other pair exceeds, and counts all pairs
only when the lead is used up. It sees nothing else.

One round performs every merge that greedy training would perform next and
whose counts cannot have changed in between: pairs are taken in order while they
share no symbol with an earlier one of the round. A new pair made by a merge is
at most as frequent as some pair touching the merged symbols, so all taken pairs
above the first touching pair's count are final. The result equals one merge per
round.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomwork.functions.text import adjacent_pairs, byte_text, pretokens
from loomwork.session import cut_lineage, stored

# The special tokens, in id order after the merges.
SPECIAL_TOKENS = [
    "<|bos|>",
    "<|user_start|>",
    "<|user_end|>",
    "<|assistant_start|>",
    "<|assistant_end|>",
    "<|python_start|>",
    "<|python_end|>",
    "<|output_start|>",
    "<|output_end|>",
]

BYTE_IDS = 256
_SURROGATES = (0xD800, 0xE000)


def symbol(token_id: int) -> str:
    """Character standing for a token id; the surrogate range is skipped."""
    return chr(token_id if token_id < _SURROGATES[0] else token_id + 0x800)


def token_id(char: str) -> int:
    point = ord(char)
    return point if point < _SURROGATES[0] else point - 0x800


@dataclass(frozen=True)
class Merge:
    left: int
    right: int
    token: int
    count: int


@dataclass(frozen=True)
class Vocabulary:
    """Merges in rank order; bytes per token follow from them."""

    merges: tuple[Merge, ...]

    def token_bytes(self) -> list[bytes]:
        out = [bytes([b]) for b in range(BYTE_IDS)]
        for merge in self.merges:
            out.append(out[merge.left] + out[merge.right])
        return out

    def fingerprint(self) -> str:
        ids = ",".join(f"{m.left}+{m.right}" for m in self.merges)
        return hashlib.md5(ids.encode()).hexdigest()

    @property
    def specials(self) -> dict[str, int]:
        base = BYTE_IDS + len(self.merges)
        return {name: base + i for i, name in enumerate(SPECIAL_TOKENS)}

    @property
    def size(self) -> int:
        return BYTE_IDS + len(self.merges) + len(SPECIAL_TOKENS)

    def special(self, name: str) -> int:
        return self.specials[name]

    def bos(self) -> int:
        """``<|bos|>``, or ``<|endoftext|>`` where a vocabulary has only that."""
        return self.specials.get("<|bos|>", self.specials.get("<|endoftext|>"))

    def table(self, spark: SparkSession) -> DataFrame:
        """(token_id, bytes, n_bytes, is_special); as small as the vocabulary."""
        rows = [(i, bytearray(b), len(b), False) for i, b in enumerate(self.token_bytes())]
        rows += [(i, bytearray(n.encode()), 0, True) for n, i in self.specials.items()]
        return spark.createDataFrame(rows, "token_id int, bytes binary, n_bytes int, is_special boolean")


def merge_piece(piece: bytes, ranks: dict[tuple[int, int], int]) -> list[int]:
    """Ids of one piece: the earliest merge that applies, everywhere, until none does.

    Symbols are a linked list and the pairs that can merge wait in a heap by (merge,
    place). A merge looks at its two neighbours only, so a piece of n bytes takes
    n log n steps. A new pair holds the new id and so comes later than its merge; equal
    pairs leave from left to right, as overlapping ones must.
    """
    ids: list[int | None] = list(piece)
    waiting = [(token, i) for i, pair in enumerate(zip(ids, ids[1:])) if (token := ranks.get(pair)) is not None]
    if not waiting:
        return ids
    heapq.heapify(waiting)
    end = len(ids)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    while waiting:
        token, i = heapq.heappop(waiting)
        j = after[i]
        # Either symbol may have gone into another merge since.
        if ids[i] is None or j == end or ranks.get((ids[i], ids[j])) != token:
            continue
        ids[i], ids[j] = token, None
        after[i] = k = after[j]
        if k < end:
            before[k] = i
            if (later := ranks.get((token, ids[k]))) is not None:
                heapq.heappush(waiting, (later, i))
        if (h := before[i]) >= 0 and (later := ranks.get((ids[h], token))) is not None:
            heapq.heappush(waiting, (later, h))
    return [t for t in ids if t is not None]


# Longer pieces are merged one by one with a heap.
_LONG_PIECE = 64
# Ids up to which pairs are looked up in a square table.
_TABLE_IDS = 1024
_NO_MERGE = np.iinfo(np.int32).max


def merge_pieces(data: np.ndarray, lengths: np.ndarray, ranks: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces one after the other, their number per piece), each piece as ``merge_piece``.

    ``data`` holds the bytes of all pieces. In every pass each piece performs its
    earliest merge everywhere; pieces without one are left out of the next pass, so a
    piece of n bytes takes part in n - 1 passes at most.
    """
    ids = data.astype(np.int32)
    starts = np.cumsum(lengths) - lengths
    piece = np.repeat(np.arange(len(lengths)), lengths)
    for p in np.flatnonzero(lengths > _LONG_PIECE):
        low, high = starts[p], starts[p] + lengths[p]
        merged = merge_piece(data[low:high].tobytes(), ranks)
        ids[low:high] = -1
        ids[low : low + len(merged)] = merged
    size = max(ranks.values(), default=0) + 1
    table = None
    if size <= _TABLE_IDS:
        table = np.full((max(size, BYTE_IDS),) * 2, _NO_MERGE, dtype=np.int32)
        for pair, token in ranks.items():
            table[pair] = token
    keys = np.array([left << 32 | right for left, right in ranks], dtype=np.int64)
    order = np.argsort(keys)
    keys, tokens = np.append(keys[order], -1), np.append(np.array(list(ranks.values()), dtype=np.int32)[order], _NO_MERGE)

    def lookup(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if table is not None:
            return table[left, right]
        pairs = left.astype(np.int64) << 32 | right
        found = np.searchsorted(keys[:-1], pairs)
        return np.where(keys[found] == pairs, tokens[found], _NO_MERGE)

    at = np.flatnonzero((lengths <= _LONG_PIECE)[piece])
    while len(at):
        here, own = ids[at], piece[at]
        token = lookup(here[:-1], here[1:])
        # Places in ``at`` whose symbol can merge with the next one of the same piece.
        able = np.flatnonzero((token < _NO_MERGE) & (own[1:] == own[:-1]))
        if not len(able):
            break
        token, of = token[able], own[able]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        counts = np.diff(np.append(first, len(able)))
        earliest = token == np.repeat(np.minimum.reduceat(token, first), counts)
        hits, token = able[earliest], token[earliest]
        # Of overlapping pairs (a run of one symbol) every second one goes, from the left.
        run = np.concatenate([[True], np.diff(hits) != 1])
        free = (hits - hits[np.flatnonzero(run)][np.cumsum(run) - 1]) % 2 == 0
        hits = hits[free]
        ids[at[hits]] = token[free]
        ids[at[hits + 1]] = -1
        active = np.zeros(len(lengths), dtype=bool)
        active[of[first]] = True
        at = at[active[own] & (ids[at] >= 0)]
    kept = ids >= 0
    return ids[kept], np.bincount(piece[kept], minlength=len(lengths))


def pretoken_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """(piece, n): one pass with map-side combining."""
    return (
        texts.select(F.explode(pretokens(F.col(column))).alias("piece"))
        .groupBy("piece")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def initial_state(counts: DataFrame) -> DataFrame:
    return counts.select(byte_text(F.col("piece")).alias("symbols"), "n")


def pair_counts(state: DataFrame) -> DataFrame:
    """(pair, n): occurrences of each two neighbouring symbols over the corpus."""
    return (
        state.filter(F.length("symbols") > 1)
        .select(F.explode(adjacent_pairs(F.col("symbols"))).alias("pair"), "n")
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
    )


def final_prefix(leading: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The leading pairs that can be merged in one round without changing the result."""
    taken: list[tuple[str, int]] = []
    used: set[str] = set()
    for pair, count in leading:
        if used & set(pair):
            # Merges so far may create pairs up to this count; ties are undecided.
            return taken[:1] + [t for t in taken[1:] if t[1] > count]
        taken.append((pair, count))
        used |= set(pair)
        if pair[0] == pair[1]:
            # A run of one symbol makes new pairs of up to its own count.
            return taken
    return taken


def _order(entry: tuple[str, int]) -> tuple:
    return -entry[1], entry[0]


class _Lead:
    """The leading pairs with exact counts; no other pair has more than ``floor``."""

    def __init__(self, size: int):
        self.size, self.floor, self.fresh = size, 0, False
        self.counts: dict[str, int] = {}

    def scan(self, counts: DataFrame) -> None:
        totals = counts.groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 0")
        # Symbols compare by code point, here and in Python, which is the order of their ids.
        top = totals.orderBy(F.desc("n"), "pair").limit(self.size).collect()
        self.counts = {r["pair"]: r["n"] for r in top}
        self.floor = top[-1]["n"] if len(top) == self.size else 0
        self.fresh = True

    def batch(self) -> list[tuple[str, int]]:
        """The next merges that are certain. Just after a scan the first one always is."""
        taken = final_prefix(sorted(self.counts.items(), key=_order))
        return [t for i, t in enumerate(taken) if t[1] > self.floor or (i == 0 and self.fresh)]

    def change(self, differences: dict[str, int]) -> None:
        self.fresh = False
        for pair, d in differences.items():
            # Pairs not in the lead are new ones, whose count is the difference.
            self.counts[pair] = self.counts.get(pair, 0) + d
        if len(self.counts) > 4 * self.size:
            ordered = sorted(self.counts.items(), key=_order)
            self.counts, self.floor = dict(ordered[: self.size]), max(self.floor, ordered[self.size][1])
        self.counts = {p: n for p, n in self.counts.items() if n > self.floor}


def train(
    texts: DataFrame,
    vocab_size: int,
    column: str = "text",
    lookahead: int = 1024,
    rounds_per_checkpoint: int = 32,
) -> Vocabulary:
    """Learn merges until bytes + merges + specials reach ``vocab_size``.

    Ties between equally frequent pairs go to the smaller (left, right) ids.
    ``lookahead`` is the number of leading pairs the driver keeps; the differences of
    ``rounds_per_checkpoint`` rounds are summed into one table.
    """
    wanted = vocab_size - len(SPECIAL_TOKENS) - BYTE_IDS
    if wanted < 0:
        raise ValueError(f"vocab_size must be at least {BYTE_IDS + len(SPECIAL_TOKENS)}")
    spark = texts.sparkSession
    state = initial_state(pretoken_counts(texts, column)).filter(F.length("symbols") > 1)
    first = state.select("symbols", "n", F.explode(adjacent_pairs(F.col("symbols"))).alias("pair"))
    tables = [stored(first.repartitionByRange("pair", "symbols").sortWithinPartitions("pair"), "postings")]
    made_in: dict[str, int] = {}  # symbol -> the round's table of its pairs; bytes are in the first
    counts = stored(tables[0].groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    differences: list[DataFrame] = []
    merges: list[Merge] = []
    lead = _Lead(lookahead)
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    while len(merges) < wanted:
        batch = lead.batch()[: wanted - len(merges)]
        if not batch:
            if lead.fresh or (lead.floor == 0 and merges):
                break
            counts, differences = _summed(counts, differences), []
            lead.scan(counts)
            continue
        ranks = {(m.left, m.right): m.token for m in merges}
        where: dict[int, list[str]] = {}
        for pair, count in batch:
            new = BYTE_IDS + len(merges)
            where.setdefault(max(made_in.get(c, 0) for c in pair), []).append(pair)
            merges.append(Merge(token_id(pair[0]), token_id(pair[1]), new, count))
            made_in[symbol(new)] = len(tables)
        if len(merges) == wanted:
            break
        parts = [tables[t].filter(F.col("pair").isin(pairs)).select("symbols", "n") for t, pairs in where.items()]
        # A number of partitions of its own, so that few rows with much work are not merged into one task.
        dealt = functools.reduce(DataFrame.unionAll, parts).repartition(width, "symbols")
        pieces = dealt.groupBy("symbols").agg(F.max("n").alias("n"))
        after = {(m.left, m.right): m.token for m in merges}
        recut = _recut(ranks, after, frozenset(lead.counts))
        changed = stored(pieces.mapInArrow(recut, "symbols string, pair string, n bigint, d bigint, led boolean"), "postings")
        tables.append(changed.filter(F.col("symbols").isNotNull()))
        differences.append(changed.select("pair", F.col("d").alias("n")))
        moved = changed.groupBy("pair").agg(F.sum("d").alias("n"), F.bool_or("led").alias("led"))
        moved = moved.filter(F.col("led") | (F.col("n") > lead.floor))
        lead.change({r["pair"]: r["n"] for r in moved.collect()})
        if len(differences) >= rounds_per_checkpoint:
            counts, differences = _summed(counts, differences), []
    return Vocabulary(tuple(merges))


def _summed(counts: DataFrame, differences: list[DataFrame]) -> DataFrame:
    if not differences:
        return counts
    every = functools.reduce(DataFrame.unionAll, differences, counts)
    return stored(every.groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 0"), "pairs")


def _pairs(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, pair) of every two neighbouring ids; a pair is one number."""
    piece = np.repeat(np.arange(len(sizes)), sizes)
    inside = piece[1:] == piece[:-1]
    return piece[:-1][inside], (ids[:-1].astype(np.int64) << 32 | ids[1:])[inside]


def _recut(before: dict[tuple[int, int], int], after: dict[tuple[int, int], int], lead: frozenset[str]):
    """From (symbols, n) to (symbols or null, pair, n, d, led): the pairs whose count in a pre-token
    changed by d / n, and whether they lead; ``symbols`` stands with pairs that it did not hold before."""

    def run(batches):
        for batch in batches:
            symbols, n = batch.column(0), batch.column(1).to_numpy()
            raw = np.frombuffer("".join(symbols.to_pylist()).encode("latin-1"), dtype=np.uint8)
            lengths = pc.utf8_length(symbols).to_numpy()
            old, new = (_pairs(*merge_pieces(raw, lengths, ranks)) for ranks in (before, after))
            pairs, code = np.unique(np.concatenate([old[1], new[1]]), return_inverse=True)
            held, at = np.unique(np.concatenate([old[0], new[0]]) * max(len(pairs), 1) + code, return_inverse=True)
            was = np.bincount(at[: len(old[0])], minlength=len(held))
            now = np.bincount(at[len(old[0]) :], minlength=len(held))
            moved = was != now
            piece, code = np.divmod(held[moved], max(len(pairs), 1))
            was, now = was[moved], now[moved]
            names = [symbol(p >> 32) + symbol(p & 0xFFFFFFFF) for p in pairs.tolist()]
            columns = [
                symbols.take(pa.array(piece, mask=was > 0)),
                pa.array(names, pa.string()).take(pa.array(code)),
                pa.array(n[piece]),
                pa.array((now - was) * n[piece]),
                pa.array([p in lead for p in names], pa.bool_()).take(pa.array(code)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["symbols", "pair", "n", "d", "led"])

    return run


def segmentation(counts: DataFrame, vocabulary: Vocabulary, per_step: int = 64) -> DataFrame:
    """Apply all merges to distinct pre-tokens, giving (piece, symbols, n)."""
    state = counts.select("piece", byte_text(F.col("piece")).alias("symbols"), "n")
    for start in range(0, len(vocabulary.merges), per_step):
        merged = F.col("symbols")
        for m in vocabulary.merges[start : start + per_step]:
            merged = F.replace(merged, F.lit(symbol(m.left) + symbol(m.right)), F.lit(symbol(m.token)))
        state = cut_lineage(state.select("piece", merged.alias("symbols"), "n"))
    return state
