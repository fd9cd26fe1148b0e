"""Mixture-controlled packing: ids against the library, places by brute force, shares of windows."""

import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loomwork.llm import mixpack
from loomwork.llm.byteids import ByteEncoder
from loomwork.llm.queries import byte_tokenizer
from tests.llm.helpers import frame, odd_rows

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
NAMES = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_encoder_agrees_with_the_library():
    rng = random.Random(4)
    parts = list("aAbzZ éß日本語 .,;:!?'\"0 9\n\t\r\x0b\x1c\x85  　​﻿🙂") + [" "] * 12
    parts += ["<|endoftext|>", "<|endo", "it's", " the", "  ", "\n\n", " \n ", "don't", " 's"]
    encoder = ByteEncoder(byte_tokenizer())
    for _ in range(500):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(4)]
        flat, counts = encoder.encode(pa.array(texts))
        assert [p.tolist() for p in np.split(flat, np.cumsum(counts)[:-1])] == [ids_of(t) for t in texts]


def served_one_by_one(totals, targets, capacity):
    """The stream of (queue, token) by rounds with credits kept as fractions of UNIT."""
    left, stream = list(totals), []
    weights, credit, active = None, None, None
    while any(left):
        if active != [n > 0 for n in left]:
            active = [n > 0 for n in left]
            weights = mixpack._weights([t if a else 0 for t, a in zip(targets, active)], capacity)
            credit = [Fraction(0)] * len(totals)
        for q, w in enumerate(weights):
            credit[q] += Fraction(w * capacity, mixpack.UNIT)
            take = min(int(credit[q]), left[q])
            credit[q] -= take
            stream += [(q, totals[q] - left[q] + i) for i in range(take)]
            left[q] -= take
    return stream


@pytest.mark.parametrize("totals, targets", [
    ([500, 300, 200], [0.5, 0.3, 0.2]), ([1000], [1.0]), ([10, 900, 33], [1, 1, 1]), ([7, 1, 1], [0.9, 0.01, 0.09]), ([64, 64], [3, 1]),
])
def test_schedule_is_round_robin_with_deficits(totals, targets):
    capacity = 64
    plan = mixpack.Schedule(totals, targets, capacity)
    stream = {t: i for i, t in enumerate(served_one_by_one(totals, targets, capacity))}
    cuts = [(q, a, min(17, n - a)) for q, n in enumerate(totals) for a in range(0, n, 17)]
    queue, first, length = (np.array(c) for c in zip(*cuts))
    total = sum(totals)
    full = total // capacity * capacity
    seen = Counter()
    for row, start, n, window, offset in zip(*(c.tolist() for c in plan.pieces(queue, first, length))):
        for i in range(n):
            place = stream[int(queue[row]), int(first[row]) + start + i]
            assert plan.window_start(np.array([window]))[0] + offset + i == place
            assert (place < full) == (window < full // capacity)
            seen[place] += 1
    assert seen == Counter(range(total))


def check_whole(rows, texts_of_key):
    """All ids lie in gapless pieces; sequences are full, or powers of two."""
    by_window, by_key = defaultdict(list), defaultdict(list)
    for key, *rest in rows:
        start, length, crc, doc_tokens, window, offset = rest
        assert length > 0
        by_window[window].append((offset, length))
        by_key[key].append((start, length, crc, doc_tokens))
    sizes = []
    for found in by_window.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        sizes.append(at)
    assert all(n == 1024 or (n < 1024 and n & (n - 1) == 0) for n in sizes)
    assert sum(n == 1024 for n in sizes) >= len(sizes) - 10 and len(set(n for n in sizes if n < 1024)) == sum(n < 1024 for n in sizes)
    for key, texts in texts_of_key.items():
        want = Counter()
        pieces = Counter(by_key[key])
        for text in texts:
            ids = [*ids_of(text), 0]
            for (start, length, crc, n), _ in list(pieces.items()):
                if n == len(ids) and zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc:
                    want[start, length, crc, n] += 1
        assert set(want) == set(pieces)
        assert sum(n for (_, n, _, _), c in pieces.items() for _ in range(c)) == sum(len(ids_of(t)) + 1 for t in texts)


def test_odd_rows(spark):
    rows = [tuple(r[c] for c in ["doc_id", *NAMES]) for r in mixpack.pack(frame(spark).repartition(4), byte_tokenizer()).collect()]
    texts = defaultdict(list)
    for key, text, *_ in odd_rows():
        texts[key].append(text)
    check_whole(rows, texts)
    assert mixpack.pack(frame(spark, []), byte_tokenizer()).collect() == []


def made_up(seed=2, count=700):
    rng = random.Random(seed)
    shares = ["hot"] * 6 + ["b"] * 3 + [None] * 2 + [f"tiny{i}" for i in range(3)]
    return [(i, " ".join(rng.choice(["word", "Wort", "mot", "x1", "日本"]) for _ in range(rng.randrange(200))), rng.choice(shares)) for i in range(count)]


@pytest.mark.parametrize("targets", [None, {"hot": 1.0, "b": 1.0}])
def test_windows_keep_the_targets(spark, targets):
    docs = made_up()
    table = spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(7)
    rows = [tuple(r[c] for c in ["doc_id", *NAMES]) for r in mixpack.pack(table, byte_tokenizer(), targets).collect()]
    check_whole(rows, {i: [t] for i, t, _ in docs})
    named = {"hot", "b"} if targets else {s for _, _, s in docs}
    source = {i: s if s in named else "*" for i, _, s in docs}
    totals = Counter()
    for i, text, _ in docs:
        totals[source[i]] += len(ids_of(text)) + 1
    windows = defaultdict(Counter)
    for key, _, length, _, _, window, _ in rows:
        windows[window][source[key]] += length
    weights = {q: (targets or {}).get(q, n / sum(totals.values())) for q, n in totals.items()}
    # Until the first queue is empty.
    ends = min(totals[q] / w for q, w in weights.items()) * sum(weights.values())
    for window, found in windows.items():
        if (window + 2) * 1024 < ends:
            for q, w in weights.items():
                assert abs(found[q] - 1024 * w / sum(weights.values())) <= len(weights) + 1
