"""Hashed maximum-entropy language model with class-factored softmax.

A token is a word (white-space run, A-Z lower-cased) or the end of a text. Its
probability is factored as

    p(class | history) * p(subclass | class, history) * p(word | class, subclass)

The first two are softmaxes over ``CLASSES`` outcomes each, with hashed features of the
history: the previous word, the one before it (skip), both together, and none. The
last is add-one over the training counts of the leaf, with one place for all unknown
words, so every text has a probability. A word's class comes from its last letters and
its subclass from the whole word, both by hash, so unknown words have them too.

Training rounds each take another part of the training texts: tasks start from the
round's weights, make sparse numpy gradient steps over their texts, and Spark adds up
the changes weighted by tokens. Weights have a fixed size. Counts cover all training
texts and stay a table: the vocabulary never meets in one place. Texts are cut into
chunks of bounded size and stored once, bucketed by chunk, so they are never shuffled.
Each chunk's distinct words, as 64-bit hashes, meet those of the other chunks in one
shuffle by word for their counts and return to their chunk, which is scored with them.

Defined cases: a null or empty text is one end token. A null key counts as the empty
text for the fold. Without training texts N and V are zero. Repeated rows are scored
alike, each counted; an empty table gives an empty result; other columns are not
carried, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from loomwork.llm.arrowtext import ranges, split_words, text_slices
from loomwork.llm.toxicity import fold
from loomwork.session import scratch_path, stored

CLASSES = 16
ROW_BITS = 14
ROUNDS = 3
#: Not a word: words hold no white space.
END = "\n"
_BATCH = 1 << 15
# Rows of a run that are added one after the other.
_SHORT_RUN = 8
#: Rows of a weight table: hashed ones, then one per class for the feature without history.
ROWS = (1 << ROW_BITS) + CLASSES
_START = np.uint32(1)
_MIX = [np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]


def word_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, leaf) per word; the leaf is class * CLASSES + subclass."""
    whole = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
    ending = np.array([xxhash.xxh32_intdigest(w.rstrip(".,;:!?")[-2:]) for w in words], dtype=np.uint64)
    n = np.uint64(CLASSES)
    return whole, ((ending % n) * n + (whole >> np.uint64(20)) % n).astype(np.int64)


def _row(hashes: np.ndarray, number: int) -> np.ndarray:
    """Hashed row of feature ``number``."""
    with np.errstate(over="ignore"):
        h = hashes * _MIX[number]
        h = (h ^ (h >> np.uint32(15))) * _MIX[4]
    return (h >> np.uint32(32 - ROW_BITS)).astype(np.int32)


def _sub_row(row: np.ndarray, first: np.ndarray, number: int) -> np.ndarray:
    """Row of the same feature for the subclass, given the class."""
    return _row(row.astype(np.uint32) * np.uint32(CLASSES) + first.astype(np.uint32), number)


@dataclass
class Tokens:
    """Texts as arrays: word, leaf and feature rows per token, tokens per text."""

    codes: np.ndarray
    words: list[str]
    hashes: np.ndarray
    leaf: np.ndarray
    rows: list
    sub_rows: list
    counts: np.ndarray


def tokens_of(texts: pa.Array) -> Tokens:
    codes, words, counts = split_words(texts)
    # The end follows each text's words as one more token.
    end = len(words)
    total = counts + 1
    stop = np.cumsum(total)
    at = np.full(int(stop[-1]) if len(stop) else 0, end, dtype=np.int64)
    at[ranges(stop - total, counts)] = codes
    words = [*words, END]
    hashes, leaves = word_hashes(words)
    h, leaf = hashes.astype(np.uint32)[at], leaves.astype(np.int32)[at]
    begin = stop - total
    one = np.empty_like(h)
    one[1:] = h[:-1]
    one[begin] = _START
    two = np.empty_like(h)
    two[1:] = one[:-1]
    two[begin] = _START
    with np.errstate(over="ignore"):
        both = (one * _MIX[3]) ^ (two + _MIX[2])
    first = leaf // CLASSES
    hashed = [_row(one, 0), _row(two, 1), _row(both, 2)]
    rows = [1 << ROW_BITS, *hashed]
    sub_rows = [(1 << ROW_BITS) + first, *(_sub_row(r, first, k) for k, r in enumerate(hashed))]
    return Tokens(at, words, hashes, leaf, rows, sub_rows, total)


def _softmax(weights: np.ndarray, rows: list) -> np.ndarray:
    """Probabilities (token, class). ``rows`` are arrays, or one number for all tokens."""
    z = np.take(weights, rows[-1], axis=0)
    for r in rows[:-1]:
        z += weights[r] if isinstance(r, int) else np.take(weights, r, axis=0)
    # Far beyond any trained weight; keeps the exponential finite.
    np.minimum(z, 60, out=z)
    np.exp(z, out=z)
    z /= np.maximum(np.einsum("ij->i", z), np.float32(1e-30))[:, None]
    return z


def _run_sums(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``p`` from each of ``first`` up to the next one, as ``np.add.reduceat``
    to the last bit.

    That spends more on a run's call than on its numbers, so short runs are added
    together: all second rows, all third rows and so on, and the first ones to these.
    """
    size = np.diff(np.append(first, len(p)))
    out = np.take(p, first, axis=0)
    short = np.flatnonzero((size > 1) & (size <= _SHORT_RUN))
    rest = np.take(p, first[short] + 1, axis=0)
    more = np.flatnonzero(size[short] > 2)
    for k in range(2, _SHORT_RUN):
        rest[more] += np.take(p, first[short[more]] + k, axis=0)
        more = more[size[short[more]] > k + 1]
    out[short] += rest
    long = size > _SHORT_RUN
    if long.any():
        ends = np.cumsum(size[long])
        out[long] = np.add.reduceat(p[np.repeat(long, size)], ends - size[long], axis=0)
    return out


def _step(weights, energy, rows, target, rate: float) -> None:
    """One AdaGrad step over a batch of tokens, feature by feature, on the rows it uses."""
    p = _softmax(weights, rows)
    p[np.arange(len(target)), target] -= 1
    for r in rows:
        if isinstance(r, int):
            used, g = np.array([r]), p.sum(axis=0, keepdims=True)
        else:
            # Rows are numbers of 16 bits, which sort in linear time.
            order = np.argsort(r.astype(np.uint16), kind="stable")
            ranked = r[order]
            first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            used, g = ranked[first], _run_sums(np.take(p, order, axis=0), first)
        energy[used] += np.einsum("ij,ij->i", g, g)
        weights[used] -= rate * g / np.sqrt(energy[used] + 1.0)[:, None]


def _part(rows: list, part: slice) -> list:
    return [r if isinstance(r, int) else r[part] for r in rows]


def local_training(weights: np.ndarray, energy: np.ndarray, tokens: Tokens, rate: float) -> None:
    """Steps over all tokens in order; ``weights`` is (2, rows, CLASSES) and changes in place."""
    for low in range(0, len(tokens.leaf), _BATCH):
        part = slice(low, low + _BATCH)
        leaf = tokens.leaf[part]
        _step(weights[0], energy[0], _part(tokens.rows, part), leaf // CLASSES, rate)
        _step(weights[1], energy[1], _part(tokens.sub_rows, part), leaf % CLASSES, rate)


def history_log10(weights: np.ndarray, tokens: Tokens) -> np.ndarray:
    """log10 of p(class) * p(subclass) per token."""
    out = np.empty(len(tokens.leaf))
    for low in range(0, len(out), _BATCH):
        part = slice(low, low + _BATCH)
        leaf = tokens.leaf[part]
        pick = np.arange(len(leaf))
        a = _softmax(weights[0], _part(tokens.rows, part))[pick, leaf // CLASSES]
        b = _softmax(weights[1], _part(tokens.sub_rows, part))[pick, leaf % CLASSES]
        out[part] = np.log10(np.maximum(a, 1e-30)) + np.log10(np.maximum(b, 1e-30))
    return out


def in_chunks(docs: DataFrame, key: str, text: str, learn) -> DataFrame:
    """Rows (key, held_out, chunk, text) of a table in the shared folder, bucketed by chunk.

    A chunk is one bounded slice of one task. Each task writes the files of its own
    chunks, so no text moves, neither now nor where chunks are grouped.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        for n, (part, texts) in enumerate(text_slices(batches, "__text")):
            chunk = pa.array(np.full(part.num_rows, base + n, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), chunk, texts], names=[key, "held_out", "chunk", "text"])

    rows = docs.select(key, (~learn).alias("held_out"), F.col(text).alias("__text"))
    path = scratch_path(spark, "chunks")
    name = "loomwork_" + path.rsplit("/", 1)[-1].replace("-", "_")
    writer = rows.mapInArrow(run, f"`{key}` {kind}, held_out boolean, chunk bigint, text string").write
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer.bucketBy(buckets, "chunk").format("parquet").option("path", path).saveAsTable(name)
    return spark.table(name)


def chunk_words(chunked: DataFrame) -> DataFrame:
    """Stored (chunk, word, leaf, n, c, first): distinct word hashes of every chunk, with
    their training occurrences there and in all; ``first`` marks one row per word."""

    def run(batches):
        for batch in batches:
            chunk = batch.column(1).to_numpy()
            for c in np.unique(chunk).tolist():
                part = batch.filter(pa.array(chunk == c))
                learn = ~part.column(0).to_numpy(zero_copy_only=False)
                codes, words, counts = split_words(part.column(2))
                hashes, leaf = word_hashes(words)
                n = np.bincount(codes[np.repeat(learn, counts)], minlength=len(words))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(words), c)),
                        pa.array(hashes.view(np.int64)),
                        pa.array(leaf.astype(np.int16)),
                        pa.array(n.astype(np.int64)),
                    ],
                    names=["chunk", "word", "leaf", "n"],
                )

    found = chunked.select("held_out", "chunk", "text").mapInArrow(run, "chunk bigint, word bigint, leaf smallint, n bigint")
    # A word has a row per chunk (or batch of one) here, never one per occurrence.
    of_word = Window.partitionBy("word")
    counted = found.withColumn("c", F.sum("n").over(of_word)).withColumn(
        "first", F.row_number().over(of_word.orderBy("chunk")) == 1
    )
    return stored(counted, "words")


def leaf_totals(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, distinct words) per leaf; as many rows as there are leaves reach the driver."""
    found = counted.groupBy("leaf").agg(F.sum("n").alias("c"), F.count_if(F.col("first") & (F.col("c") > 0)).alias("v"))
    tokens, words = np.zeros(CLASSES * CLASSES, dtype=np.int64), np.zeros(CLASSES * CLASSES, dtype=np.int64)
    for r in found.collect():
        tokens[r.leaf], words[r.leaf] = r.c, r.v
    return tokens, words


def train(chunked: DataFrame, rounds: int = ROUNDS, rate: float = 0.5) -> np.ndarray:
    """Weights (2, rows, CLASSES) after one pass over the training rows, a part per round."""
    weights = np.zeros((2, ROWS, CLASSES), dtype=np.float32)
    texts = chunked.filter(~F.col("held_out"))
    for number in range(rounds):

        def run(batches, weights=weights):
            mine, energy, seen = weights.copy(), np.zeros(weights.shape[:2], dtype=np.float32), 0
            for _, part in text_slices(batches, "text"):
                tokens = tokens_of(part)
                local_training(mine, energy, tokens, rate)
                seen += len(tokens.leaf)
            if seen:
                change = ((mine - weights) * seen).reshape(-1, CLASSES)
                at = np.flatnonzero(change.any(axis=1))
                columns = [pa.array(change[at, k]) for k in range(CLASSES)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), *columns, pa.array(np.full(len(at), seen, dtype=np.int64))], names=names
                )

        names = ["at", *[f"c{k}" for k in range(CLASSES)], "seen"]
        schema = "at bigint, " + ", ".join(f"c{k} float" for k in range(CLASSES)) + ", seen bigint"
        part = texts.filter(F.pmod(F.xxhash64("text", "chunk"), F.lit(rounds)) == number).select("text")
        # A row is averaged over the tasks that moved it.
        summed = part.mapInArrow(run, schema).groupBy("at").agg(*[F.sum(c).alias(c) for c in names[1:]])
        found = summed.toPandas()
        if len(found):
            flat = weights.copy().reshape(-1, CLASSES)
            flat[found["at"].to_numpy()] += (found[names[1:-1]].to_numpy() / found[["seen"]].to_numpy()).astype(np.float32)
            weights = flat.reshape(weights.shape)
    return weights


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out: int = 7, rest: int = 2, rounds: int = ROUNDS) -> DataFrame:
    """``key``, held_out, n_tokens, n_known, train_tokens, base_score and score per row.

    ``base_score`` is the add-one unigram log10 probability, ``score`` the model's.
    """
    chunked = in_chunks(docs, key, text, fold(key, held_out) != rest)
    counted = chunk_words(chunked)
    ends = chunked.filter(~F.col("held_out")).count()
    leaf_n, leaf_v = leaf_totals(counted)
    if ends:
        (end_leaf,) = word_hashes([END])[1].tolist()
        leaf_n[end_leaf] += ends
        leaf_v[end_leaf] += 1
    n, v = int(leaf_n.sum()), int(leaf_v.sum())
    weights = train(chunked, rounds)
    kind = docs.schema[key].dataType.simpleString()
    known = counted.filter("c > 0").select("chunk", "word", "c")

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        names = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        tokens = tokens_of(texts.column("text").combine_chunks() if texts.num_rows else pa.array([], pa.string()))
        # A word may come once per batch of its chunk, each time with the same count.
        place = pc.index_in(pa.array(tokens.hashes.view(np.int64)), words.column("word").combine_chunks())
        found = pc.fill_null(pc.take(words.column("c").combine_chunks(), place), 0).to_numpy(zero_copy_only=False).copy()
        found[-1] = ends
        c = found[tokens.codes]
        base = np.log10((c + 1) / (n + v + 1))
        within = np.log10((c + 1) / (leaf_n[tokens.leaf] + leaf_v[tokens.leaf] + 1))
        whole = history_log10(weights, tokens) + within
        owner = np.repeat(np.arange(len(tokens.counts)), tokens.counts)
        total = [np.bincount(owner, weights=x, minlength=len(tokens.counts)) for x in (c > 0, base, whole)]
        return pa.Table.from_arrays(
            [
                texts.column(key),
                texts.column("held_out"),
                pa.array(tokens.counts),
                pa.array(total[0].astype(np.int64)),
                pa.array(np.full(len(tokens.counts), n, dtype=np.int64)),
                pa.array(total[1]),
                pa.array(total[2]),
            ],
            names=names,
        )

    schema = f"`{key}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return chunked.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(run, schema)
