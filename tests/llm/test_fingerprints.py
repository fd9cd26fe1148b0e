import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomwork.llm import fingerprints as fp
from tests.llm.helpers import frame, odd_rows


def vector(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.vector for r in fp.vectors(rows, ["i"], "t").orderBy("i").collect()]


def test_order_does_not_matter_and_count_does(spark):
    a, b, c, d = vector(spark, "one\ntwo\nthree", "three\none\n\ntwo", "one\ntwo\ntwo\nthree", None)
    assert a == b and a != c and a[0] == 3 and c[0] == 4 and set(d) == {0}


def test_paragraphs_come_and_go(spark):
    whole, part, rest = vector(spark, "a b.\nc\nd", "a b.\nd", "c")
    row = spark.createDataFrame([(whole, part, rest)], "w array<bigint>, p array<bigint>, r array<bigint>")
    out = row.select(fp.insert(F.col("p"), F.col("r")).alias("i"), fp.delete(F.col("w"), F.col("r")).alias("d")).first()
    assert out.i == whole and out.d == part


def test_likeness_follows_the_shared_part(spark):
    rng = random.Random(4)
    names = [f"p{i}" for i in range(400)]
    pairs = []
    for share in (0.0, 0.25, 0.5, 0.75, 1.0):
        own = rng.sample(names[:200], 60)
        other = own[: int(60 * share)] + rng.sample(names[200:], 60 - int(60 * share))
        pairs.append((share, "\n".join(own), "\n".join(other)))
    vectors = vector(spark, *(t for _, a, b in pairs for t in (a, b)))
    rows = [(s, vectors[2 * i], vectors[2 * i + 1]) for i, (s, _, _) in enumerate(pairs)]
    frame = spark.createDataFrame(rows, "s double, a array<bigint>, b array<bigint>")
    for r in frame.select("s", fp.likeness(F.col("a"), F.col("b")).alias("l")).collect():
        assert r.l == pytest.approx(r.s, abs=0.25) and 0 <= r.l <= 1
        assert r.l == 1.0 if r.s == 1 else r.l < 1


def plain_paragraphs(text):
    return Counter(p for p in (q.strip(" ") for q in re.split(r"\s*[\r\n]+\s*|(?<=[.!?;:,|])\s+", text)) if p)


@pytest.mark.parametrize("blocks", [1, 3, 8])
def test_edited_texts_on_odd_rows(spark, blocks):
    rows = [r for r in odd_rows() if r[0] is not None]
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(r[1] or "")
    ordered = [(k, t) for k in sorted(texts) for t in texts[k]]
    got = fp.edited_fingerprints(frame(spark, rows), blocks=blocks).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [k for k, _ in ordered]
    prints = {}
    for i, ((key, text), r) in enumerate(zip(ordered, got)):
        after = ordered[(i + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        prints.setdefault(r.fingerprint, []).append(plain_paragraphs(text))
        prints.setdefault(r.edited_fingerprint, []).append(plain_paragraphs(edited))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_next == 1.0) == (plain_paragraphs(text) == plain_paragraphs(after))
    for same in prints.values():
        assert all(p == same[0] for p in same)
    assert len(prints) == len({tuple(sorted(p.items())) for same in prints.values() for p in same})


def test_null_keys_and_empty_tables(spark):
    got = fp.edited_fingerprints(frame(spark)).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((r[0] for r in odd_rows()), key=repr)
    assert fp.edited_fingerprints(frame(spark, [])).count() == 0
