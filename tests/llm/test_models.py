"""Toxicity, language ID and the language model."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomwork.llm import langid, maxent, toxicity
from tests.llm.helpers import WORDS, frame, odd_rows


def keys_of(rows):
    return sorted((r[0] for r in rows), key=repr)


def toxic_corpus(spark, n=600):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(n):
        words = [f"{w}{rng.integers(30)}" for w in rng.choice(WORDS, 30)]
        toxic = i % 6 == 0
        if toxic:
            words[3:3] = ["grumblor"] * int(rng.integers(1, 3))
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    return (
        spark.createDataFrame(rows, "doc_id bigint, text string"),
        spark.createDataFrame(labels, "doc_id bigint, toxic int"),
    )


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    docs, labels = toxic_corpus(spark)
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    out = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in got if got[i].held_out} == set(out)
    right = sum(got[i].predicted == (i % 6 == 0) for i in out)
    assert right >= 0.95 * len(out)
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got.values())


def test_toxicity_never_sees_held_out_labels(spark):
    docs, labels = toxic_corpus(spark, 120)
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(toxicity.fold("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.intercepts, b.intercepts)


def test_toxicity_catches_held_out_rows_at_its_own_cut(spark):
    """On the given tables, about seven of a hundred rows labelled toxic hold no toxic word at all."""
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.train(docs, labels)).filter("held_out").join(labels, "doc_id").collect()
    toxic, clean = ([r.predicted for r in got if r.toxic == t] for t in (1, 0))
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_toxicity_sample_takes_one_row_per_id(spark):
    docs, labels = toxic_corpus(spark, 120)
    hot = docs.unionAll(spark.range(500).selectExpr("6L AS doc_id", "'grumblor fox' || id AS text"))
    assert toxicity.train(hot, labels).weights is not None


def test_toxicity_on_odd_rows(spark):
    docs, labels = toxic_corpus(spark, 120)
    model = toxicity.train(docs, labels)
    got = toxicity.score(frame(spark), model).collect()
    assert keys_of((r.doc_id,) for r in got) == keys_of(odd_rows())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    none = toxicity.train(frame(spark), labels.filter("toxic = 0"))
    assert {r.score for r in toxicity.score(frame(spark), none).collect()} == {0.0}
    assert toxicity.score(frame(spark, []), toxicity.train(frame(spark, []), labels.limit(0))).count() == 0


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "aba"]
    lattice = langid.Lattice(pieces)
    p = np.random.default_rng(1).random((2, len(pieces) + 1))
    p /= p.sum(axis=1, keepdims=True)
    words = ["a", "ab", "aba", "abab", "xa", "ba"]
    got = lattice.likelihoods(words, np.log(p))
    for word, row in zip(words, got):
        text = "▁" + word
        for language in range(2):
            total = 0.0
            for cuts in itertools.product([0, 1], repeat=len(text) - 1):
                parts, at = [], 0
                for i, c in enumerate(cuts, 1):
                    if c:
                        parts.append(text[at:i])
                        at = i
                parts.append(text[at:])
                value = 1.0
                for part in parts:
                    known = pieces.index(part) if part in pieces else (len(pieces) if len(part) == 1 else None)
                    value *= 0.0 if known is None else p[language, known]
                total += value
            assert row[language] == pytest.approx(math.log(total))
    # Expected counts: every character is covered once.
    counts = lattice.expected(words, np.zeros(len(words), dtype=np.int64), np.ones(len(words)), np.log(p))
    sizes = np.array([len(x) for x in pieces] + [1])
    assert (counts[0] * sizes).sum() == pytest.approx(sum(len(w) + 1 for w in words)) and counts[1].sum() == 0


def test_language_is_told(spark):
    rng = np.random.default_rng(2)
    letters = {"aa": "abcde", "bb": "defgh"}
    rows = []
    for i in range(200):
        lang = "aa" if i % 2 else "bb"
        words = ["".join(rng.choice(list(letters[lang]), 4)) for _ in range(12)]
        rows.append((i, " ".join(words), lang if i % 7 else None))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    pieces = ["▁", *"abcdefgh", *(a + b for a in "abcdefgh" for b in "abcdefgh")]
    model = langid.train(docs, pieces)
    got = langid.predict(docs, model).collect()
    assert all(r.lang_pred == ("aa" if r.doc_id % 2 else "bb") and 0.5 < r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.held_out} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}
    odd = langid.predict(frame(spark), model).collect()
    assert keys_of((r.doc_id,) for r in odd) == keys_of(odd_rows())
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == {3, 4, 5, 9}
    nothing = langid.train(frame(spark, []), pieces)
    assert {r.lang_pred for r in langid.predict(frame(spark), nothing).collect()} == {"und"}
    assert langid.predict(frame(spark, []), model).count() == 0


def test_base_score_and_counts(spark):
    rows = odd_rows()
    got = maxent.score(frame(spark)).collect()
    assert keys_of((r.doc_id,) for r in got) == keys_of(rows)

    def tokens(text):
        return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) + ["\n"]

    def learns(key):
        return zlib.crc32(b"" if key is None else str(key).encode()) % 7 != 2

    c = Counter(w for r in rows if learns(r[0]) for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in got:
        assert r.train_tokens == n and r.score < 0
        if r.doc_id is not None:
            words = tokens(texts[r.doc_id])
            assert r.held_out == (not learns(r.doc_id))
            assert (r.n_tokens, r.n_known) == (len(words), sum(c[w] > 0 for w in words))
            assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words))
    assert maxent.score(frame(spark, [])).count() == 0


def test_probabilities_of_the_next_token_sum_to_one():
    words = ["alpha", "beta.", "gamma", "delta", "x"]
    weights = np.random.default_rng(0).normal(size=(2, maxent.ROWS, maxent.CLASSES)).astype(np.float32)
    history = "alpha x"
    tokens = maxent.tokens_of(pa.array([history]))
    first = maxent._softmax(weights[0], maxent._part(tokens.rows, slice(-1, None)))[0]
    total = 0.0
    for k in range(maxent.CLASSES):
        part = np.array([k], dtype=np.int32)
        hashed = [maxent._sub_row(r[-1:], part, j) for j, r in enumerate(tokens.rows[1:])]
        total += first[k] * maxent._softmax(weights[1], [(1 << maxent.ROW_BITS) + part, *hashed])[0].sum()
    assert total == pytest.approx(1.0, abs=1e-5)
    _, leaves = maxent.word_hashes([*words, maxent.END])
    counts = np.array([5, 3, 2, 1, 1, 4])
    for leaf in set(leaves.tolist()):
        inside = counts[leaves == leaf]
        known = ((inside + 1) / (inside.sum() + len(inside) + 1)).sum()
        assert known + 1 / (inside.sum() + len(inside) + 1) == pytest.approx(1.0)


def test_training_raises_the_likelihood():
    text = " ".join(["one two three four five six seven eight nine ten"] * 400)
    tokens = maxent.tokens_of(pa.array([text]))
    weights = np.zeros((2, maxent.ROWS, maxent.CLASSES), dtype=np.float32)
    before = maxent.history_log10(weights, tokens).sum()
    energy = np.zeros(weights.shape[:2], dtype=np.float32)
    for _ in range(20):
        maxent.local_training(weights, energy, tokens, 0.5)
    assert maxent.history_log10(weights, tokens).sum() > 0.5 * before
