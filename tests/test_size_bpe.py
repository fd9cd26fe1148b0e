"""Byte-pair work on many pieces at once, in slices of bounded size."""

import random

import numpy as np
import pyarrow as pa
import pytest

from loomwork.operators import bpe, encode


@pytest.mark.parametrize("table_ids", [0, 1024])
def test_pieces_merged_together_are_as_merged_one_by_one(monkeypatch, table_ids):
    monkeypatch.setattr(bpe, "_TABLE_IDS", table_ids)
    draw = random.Random(7)
    for merges in (0, 1, 5, 24, 200):
        ids, ranks = list(b"abc"), {}
        while len(ranks) < merges:
            pair = draw.choice(ids), draw.choice(ids)
            if pair not in ranks:
                ids.append(256 + len(ranks))
                ranks[pair] = ids[-1]
        pieces = [bytes(draw.choices(b"abc", k=draw.choice([0, 1, 2, 3, 9, 64, 65, 200]))) for _ in range(60)]
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        got, sizes = bpe.merge_pieces(data, np.array([len(p) for p in pieces]), ranks)
        assert [p.tolist() for p in np.split(got, np.cumsum(sizes)[:-1])] == [bpe.merge_piece(p, ranks) for p in pieces]


def test_a_batch_is_worked_in_slices(monkeypatch):
    monkeypatch.setattr(encode, "_SLICE", 4)
    rows = pa.array([["a"] * 3, None, ["b"] * 9, [], ["c"], ["d"] * 3], pa.list_(pa.string()))
    parts = list(encode._sliced(rows))
    assert [sum(sizes.tolist()) for _, _, sizes in parts] == [3, 9, 4]
    assert [row for part, _, _ in parts for row in part.to_pylist()] == rows.to_pylist()


def test_texts_come_back_from_small_slices(spark, monkeypatch):
    monkeypatch.setattr(encode, "_SLICE", 3)
    texts = ["low lower lowest", None, "", "é ünï", "low " * 20]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(1)
    vocabulary = bpe.train(docs, bpe.BYTE_IDS + 6 + len(bpe.SPECIAL_TOKENS))
    ids = encode.encoder_function(spark, vocabulary)("text")
    back = encode.decoder_function(spark, vocabulary)(ids)
    assert [r[0] for r in docs.orderBy("doc_id").select(back).collect()] == texts
