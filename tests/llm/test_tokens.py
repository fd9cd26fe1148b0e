"""Token ids, packing and token files against the library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from loomwork.llm import bestfit, tokenfiles
from loomwork.llm.queries import word_tokenizer
from loomwork.llm.tokenids import WordEncoder
from tests.llm.helpers import frame, odd_rows

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_encoder_agrees_with_the_library():
    rng = random.Random(3)
    pieces = list("aAbzZ éÉßİıŉſJ\u030c\u0331\u0301\u0307's't're'D .,;:!?*<|>|0 9\n\t\x1c\x85\u00a0\u3000日本Σσς🙂")
    pieces += ["<|endoftext|>", "<|ENDOFTEXT|>", "it's", "end.", "***.", "don't", "ab, ", "É. "]
    encoder = WordEncoder(word_tokenizer())
    for _ in range(400):
        texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(4)]
        flat, counts = encoder.encode(pa.array(texts))
        assert [p.tolist() for p in np.split(flat, np.cumsum(counts)[:-1])] == [ids_of(t) for t in texts]


@pytest.mark.parametrize(
    "lengths",
    [
        [], [1], [4096], [4096, 1, 2049, 2047], [2049] * 7, [100] * 1000, list(range(1, 4097)),
        [int(x) for x in np.clip(np.random.default_rng(0).lognormal(6.2, 1.1, 20000), 1, 4096)],
    ],
)
def test_plan_places_every_piece_once(lengths):
    histogram = dict(Counter(lengths))
    runs = bestfit.plan(histogram)
    placed = Counter()
    for run in runs:
        offset = 0
        for n, _, at in run.items:
            assert at == offset
            offset += n
            placed[n] += run.count
        assert run.count > 0 and offset == run.used <= 4096
    assert placed == histogram
    for n, count in histogram.items():
        ranks = sorted((first, first + r.count) for r in runs for m, first, _ in r.items if m == n)
        assert ranks[0][0] == 0 and ranks[-1][1] == count and all(a[1] == b[0] for a, b in zip(ranks, ranks[1:]))
    numbers = sorted((r.first, r.first + r.count) for r in runs)
    assert all(a[1] == b[0] for a, b in zip(numbers, numbers[1:]))
    bound = -(-sum(lengths) // 4096)
    if len(lengths) == 20000:
        assert sum(r.count for r in runs) <= bound * 1.005 + 1


def test_pack_and_assemble(spark):
    docs = frame(spark)
    placed = bestfit.pack(docs, word_tokenizer())
    rows = placed.collect()
    sequences, ends = defaultdict(list), []
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        if r.piece == 0:
            ends.append(r.doc_id)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert sorted(ends, key=repr) == sorted((r[0] for r in odd_rows()), key=repr)
    whole = ids_of(dict((r[0], r[1]) for r in odd_rows())[6]) + [1]
    assert len(whole) > 4096
    pieces = sorted((r for r in rows if r.doc_id == 6), key=lambda r: r.piece)
    for r in pieces:
        cut = np.array(whole[r.start : r.start + r.length], dtype="<u4")
        assert r.start == r.piece * 4096 and r.ids_crc32 == zlib.crc32(cut.tobytes())
    assert bestfit.pack(frame(spark, []), word_tokenizer()).count() == 0

    once = docs.filter("doc_id in (1, 6, 7, 8)")
    placed = bestfit.pack(once, word_tokenizer()).persist()
    packed = bestfit.sequences(bestfit.pieces(once, "doc_id", "text", word_tokenizer(), with_ids=True), placed).collect()
    texts = {r[0]: r[1] for r in odd_rows()}
    assert sum(len(r.ids) for r in packed) == sum(len(ids_of(texts[i])) + 1 for i in (1, 6, 7, 8))


def test_files_round_trip(spark):
    rows = odd_rows()
    got = tokenfiles.round_trip(frame(spark), word_tokenizer()).orderBy("start").collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in ordered]
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    for r in got:
        if r.doc_id is not None:
            text = next(x[1] for x in rows if x[0] == r.doc_id)
            ids = np.array(ids_of(text) + [2], dtype="<u4")
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    assert tokenfiles.round_trip(frame(spark, []), word_tokenizer()).count() == 0


def test_random_access_and_checksums(tmp_path):
    path = str(tmp_path / "a.zst")
    documents = [np.arange(n, dtype=np.uint32) for n in (0, 5, 40_000, 3, 0, 17_000, 1)]
    with open(path, "wb") as out:
        writer = tokenfiles.FrameWriter(out)
        for key, ids in zip([None, 1, 2, 3, 3, 9, 12], documents):
            writer.add(key, ids)
        writer.close()
    file = tokenfiles.FrameFile(path)
    assert [ids.tolist() for ids in file.find(3)] == [[0, 1, 2], []]
    assert [len(i) for i in file.find(None)] == [0] and file.find(4) == []
    assert len(file.find(9)[0]) == 17_000
    # A plain reader sees one stream of ids.
    with open(path, "rb") as raw:
        stream = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert stream == b"".join(d.tobytes() for d in documents)
    data = bytearray(open(path, "rb").read())
    data[int(file.offsets[1]) + 30] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception):
        list(tokenfiles.FrameFile(path).documents(0, 99))


def test_reading_and_hot_keys_are_spread(spark, tmp_path):
    """Reading tasks are not merged, and one key's rows fall into several files."""
    rows = [(7, f"word{i} " * 30) for i in range(400)] + [(None, "x"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one file
    try:
        manifest = tokenfiles.write(docs, str(tmp_path / "files"), word_tokenizer())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert manifest.filter("docs > 1").count() > 1 and manifest.agg({"docs": "sum"}).first()[0] == 402
    read = tokenfiles.read(spark, str(tmp_path / "files"), manifest)
    from pyspark.sql import functions as F

    assert read.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    got = sorted((r.start, r.n_tokens) for r in read.collect())
    assert got[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:])) and len(got) == 402
