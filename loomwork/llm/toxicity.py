"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic examples carry information; every other text is unlabelled, not
clean. With class prior ``p`` the risk of a classifier ``f`` is

    p * E_toxic[loss(f, 1)] + max(0, E_all[loss(f, 0)] - p * E_toxic[loss(f, 0)])

whose second part is the risk on clean texts, which is never negative; where a step's
estimate of it is below zero the step undoes the overfit instead. ``p`` is the share of
toxic rows among the labelled training rows.

A few linear classifiers over the presence of hashed words and
stems, those whose counts depart clearly, are trained in numpy with the sigmoid loss
(a bounded one: texts already clear of the margin neither pull nor undo) on a
bounded sample: at most ``max_positive`` confirmed and ``max_unlabelled`` other texts,
and fewer where texts are long, so that the sample holds about ``max_chars`` characters.
The sample follows a hash of the id and takes one row per id. Scores are the mean
probability of the members, moved so that 0.5 is the lowest cut at which the estimated
share of clean texts above it, again all less ``p`` times toxic, is at most
``FALSE_ALARMS``; the estimate is made on the sample. Every text is scored whole, in
slices, with weights of fixed size.

Defined cases: a null or empty text has no words and scores by the members' intercepts.
Without any confirmed example all scores are zero. A null key counts as the empty text
for the fold. Repeated rows score alike; an empty table gives an empty result; other
columns are not carried, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from loomwork.llm.arrowtext import ranges, text_slices
from loomwork.llm.decontaminate import word_symbols

BITS = 18
MEMBERS = 3
STEMS = (4, 6)
#: Least departure, in standard deviations, of a feature's count in toxic texts from that in all.
MIN_DEPARTURE = 4.0
EPOCHS = 60
#: Share of clean texts that may lie above the cut, as estimated from unlabelled and toxic ones.
FALSE_ALARMS = 0.01


def fold(key: str, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % of


def _hashed(words: pa.Array) -> np.ndarray:
    """(word, feature): the hashes of the word and of its first letters."""
    bits = 64 - BITS
    whole = xxhash.xxh64_intdigest
    return np.array(
        [[whole(w) >> bits, *(whole(w[:n], n) >> bits for n in STEMS)] for w in words.to_pylist()], dtype=np.int64
    ).reshape(-1, 1 + len(STEMS))


def _features(texts: pa.Array) -> list[np.ndarray]:
    """Distinct hashed words and stems of every text."""
    codes, words, counts = word_symbols(texts)
    hashed = _hashed(words)[codes]
    return [np.unique(part) for part in np.split(hashed, np.cumsum(counts)[:-1])] if len(counts) else []


@dataclass
class Model:
    """One row of ``weights`` and one intercept per member; ``None`` weights score zero.

    ``cut`` is the members' mean probability that becomes a score of 0.5.
    """

    weights: np.ndarray | None
    intercepts: np.ndarray
    cut: float = 0.5

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        codes, words, counts = word_symbols(texts)
        total = np.tile(self.intercepts[:, None], (1, len(texts)))
        if len(codes):
            hashed = _hashed(words)
            used = (self.weights[:, hashed] != 0).any(axis=0)
            useful = used.any(axis=1)[codes]
            owner = np.repeat(np.arange(len(counts)), counts)[useful]
            of = codes[useful]
            # A feature counts once per text.
            pair = np.unique((np.repeat(owner, hashed.shape[1]) << BITS) | hashed[of].ravel())
            owner, word = pair >> BITS, pair & ((1 << BITS) - 1)
            for m, weights in enumerate(self.weights):
                total[m] += np.bincount(owner, weights=weights[word], minlength=len(texts))
        mean = (1 / (1 + np.exp(-np.clip(total, -60, 60)))).mean(axis=0)
        return mean * (1 - self.cut) / (mean * (1 - self.cut) + self.cut * (1 - mean))


class _Rows:
    """Sparse 0/1 rows."""

    def __init__(self, index: np.ndarray, sizes: np.ndarray):
        self.index, self.sizes = index, sizes
        self.starts = np.cumsum(sizes) - sizes

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.index[ranges(self.starts[rows], self.sizes[rows])], np.repeat(np.arange(len(rows)), self.sizes[rows])


def train_member(positive: _Rows, unlabelled: _Rows, width: int, prior: float, seed: int, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    rng = np.random.default_rng(seed)
    weights = np.zeros(width + 1)
    weights[-1] = np.log(prior / (1 - prior))
    mean, square, step = np.zeros(width + 1), np.zeros(width + 1), 0
    n_p, n_u = len(positive.sizes), len(unlabelled.sizes)

    def outputs(rows: _Rows, chosen: np.ndarray):
        index, owner = rows.take(chosen)
        f = np.bincount(owner, weights=weights[index], minlength=len(chosen)) + weights[-1]
        return index, owner, 1 / (1 + np.exp(-np.clip(f, -60, 60)))

    def gradient(index, owner, slope) -> np.ndarray:
        g = np.bincount(index, weights=slope[owner], minlength=width + 1).astype(float)
        g[-1] += slope.sum()
        return g

    for _ in range(epochs):
        for chosen in np.array_split(rng.permutation(n_u), max(1, n_u // 1024)):
            some = rng.integers(0, n_p, min(n_p, 512))
            pi, po, pp = outputs(positive, some)
            ui, uo, up = outputs(unlabelled, chosen)
            clean = up.mean() - prior * pp.mean()
            # Slopes of the sigmoid loss: p (1 - p), up for clean and down for toxic.
            toxic = gradient(pi, po, prior * pp * (1 - pp) / len(pp))
            as_clean = gradient(ui, uo, up * (1 - up) / len(up)) - toxic
            g = -as_clean if clean < 0 else as_clean - toxic
            g[:-1] += 2e-5 * weights[:-1]
            step += 1
            mean = 0.9 * mean + 0.1 * g
            square = 0.999 * square + 0.001 * g * g
            weights -= 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return weights[:-1], float(weights[-1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    held_out: int = 5,
    max_positive: int = 4_000,
    max_unlabelled: int = 8_000,
    max_chars: int = 40_000_000,
) -> Model:
    """Learns from rows outside the fold 0 of ``held_out`` only."""
    learn = fold(key, held_out) != 0
    marked = labels.filter(learn & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("__toxic"))
    n, toxic = marked.agg(F.count("*"), F.sum(F.col("__toxic").cast("long"))).first()
    size = docs.filter(learn).agg(F.avg(F.length(text))).first()[0] or 1.0
    if not toxic:
        return Model(None, np.zeros(1))
    prior = min(max(toxic / n, 1e-4), 0.5)
    share = min(1.0, max_chars / max(size, 1.0) / (max_positive + max_unlabelled))
    order = F.xxhash64(key, F.lit("sample"))
    # Ids only, as many as the bound says.
    chosen = (
        marked.filter("__toxic = 1").orderBy(order).limit(max(1, int(share * max_positive))).select(key, F.lit(True).alias("__p"))
    ).unionAll(
        docs.filter(learn).select(key).distinct().orderBy(order).limit(max(1, int(share * max_unlabelled))).select(key, F.lit(False).alias("__p"))
    )

    def run(batches):
        for part, texts in text_slices(batches, "__text"):
            rows = pa.array([f.astype(np.int32) for f in _features(texts)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), rows], names=["p", "words"])

    drawn = docs.select(key, F.col(text).alias("__text")).join(F.broadcast(chosen), key)
    sample = drawn.groupBy(key, "__p").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text")).select("__p", "__text")
    found = sample.mapInArrow(run, "p boolean, words array<int>").toArrow()
    is_positive = found.column("p").to_numpy()
    lists = found.column("words").combine_chunks()
    sizes, words = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    n_positive, n_unlabelled = int(is_positive.sum()), int((~is_positive).sum())
    if not n_positive or not n_unlabelled:
        return Model(None, np.zeros(1))
    of_positive = np.repeat(is_positive, sizes)
    in_p = np.bincount(words[of_positive], minlength=1 << BITS)
    expected = np.bincount(words[~of_positive], minlength=1 << BITS) * (n_positive / n_unlabelled)
    useful = np.flatnonzero(np.abs(in_p - expected) >= MIN_DEPARTURE * np.sqrt(expected + 1))
    column = np.full(1 << BITS, -1, dtype=np.int32)
    column[useful] = np.arange(len(useful), dtype=np.int32)
    index, owner = column[words], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    index, owner = index[index >= 0], owner[index >= 0]
    kept = np.bincount(owner, minlength=len(sizes))
    p_rows = _Rows(index[is_positive[owner]], kept[is_positive])
    u_rows = _Rows(index[~is_positive[owner]], kept[~is_positive])
    weights, intercepts = np.zeros((MEMBERS, 1 << BITS), dtype=np.float32), np.zeros(MEMBERS)
    for m in range(MEMBERS):
        weights[m, useful], intercepts[m] = train_member(p_rows, u_rows, len(useful), prior, m)
    return Model(weights, intercepts, _cut(weights[:, useful], intercepts, p_rows, u_rows, prior))


def _cut(weights: np.ndarray, intercepts: np.ndarray, positive: _Rows, unlabelled: _Rows, prior: float) -> float:
    """The lowest probability, 0.5 at most, above which few enough clean texts are estimated to lie."""

    def scores(rows: _Rows) -> np.ndarray:
        owner = np.repeat(np.arange(len(rows.sizes)), rows.sizes)
        f = np.array([np.bincount(owner, weights=w[rows.index], minlength=len(rows.sizes)) + b for w, b in zip(weights, intercepts)])
        return (1 / (1 + np.exp(-np.clip(f, -60, 60)))).mean(axis=0)

    toxic, every = scores(positive), scores(unlabelled)
    cut = 0.5
    for lower in np.arange(0.49, 0.04, -0.01):
        clean = ((every >= lower).mean() - prior * (toxic >= lower).mean()) / (1 - prior)
        if clean > FALSE_ALARMS:
            break
        cut = float(lower)
    return cut


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", held_out: int = 5) -> DataFrame:
    """``key``, held_out, score and predicted of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for part, texts in text_slices(batches, "__text"):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(model.score(texts))], names=[key, "held_out", "score"]
            )

    rows = docs.select(key, (fold(key, held_out) == 0).alias("held_out"), F.col(text).alias("__text"))
    scored = rows.mapInArrow(run, f"`{key}` {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs``, all columns, less the rows scored 0.5 or more."""

    def run(batches):
        for part, texts in text_slices(batches, text):
            yield part.filter(pa.array(model.score(texts) < 0.5))

    return docs.mapInArrow(run, docs.schema)
