import random

import pytest

from loomwork.functions.text import SPLIT_PATTERN
from loomwork.operators import bpe, encode


def greedy(words, n_merges):
    """One merge per round over a dict of words; ties go to the smaller pair."""
    state = {tuple(w.encode()): c for w, c in words.items()}
    merges = []
    while len(merges) < n_merges:
        counts = {}
        for symbols, c in state.items():
            for pair in zip(symbols, symbols[1:]):
                counts[pair] = counts.get(pair, 0) + c
        if not counts:
            break
        pair = min(counts, key=lambda p: (-counts[p], p))
        new = 256 + len(merges)
        merges.append((*pair, counts[pair]))
        merged = {}
        for symbols, c in state.items():
            out, i = [], 0
            while i < len(symbols):
                if symbols[i : i + 2] == pair:
                    out.append(new)
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            merged[tuple(out)] = merged.get(tuple(out), 0) + c
        state = merged
    return merges


def corpus(seed, alphabet, n=300):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9))) for _ in range(n)]


@pytest.mark.parametrize("seed,alphabet", [(1, "ab"), (2, "aab"), (3, "abcdé"), (4, "a"), (5, "abcdefghij")])
def test_rounds_equal_one_merge_at_a_time(spark, seed, alphabet):
    import collections

    import regex

    texts = [" ".join(corpus(seed, alphabet)[i : i + 10]) for i in range(0, 300, 10)]
    words = collections.Counter(p for t in texts for p in regex.findall(SPLIT_PATTERN, t))
    want = greedy(words, 40)
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = bpe.train(frame, 256 + 40 + len(bpe.SPECIAL_TOKENS), rounds_per_checkpoint=3)
    assert [(m.left, m.right, m.count) for m in got.merges] == want


def test_small_lookahead_gives_the_same_merges(spark):
    frame = spark.createDataFrame([(" ".join(corpus(9, "abcdef")),)], "text string")
    size = 256 + 25 + len(bpe.SPECIAL_TOKENS)
    assert bpe.train(frame, size, lookahead=2).merges == bpe.train(frame, size).merges


def test_final_prefix_stops_at_shared_symbols_and_ties():
    assert bpe.final_prefix([("ab", 9), ("cd", 8), ("be", 7), ("fg", 6)]) == [("ab", 9), ("cd", 8)]
    assert bpe.final_prefix([("ab", 9), ("cd", 7), ("be", 7)]) == [("ab", 9)]
    assert bpe.final_prefix([("aa", 9), ("cd", 8)]) == [("aa", 9)]


def test_symbols_skip_surrogates():
    ids = [0, 255, 0xD7FF, 0xD800, 0xE000, 70_000]
    assert [bpe.token_id(bpe.symbol(i)) for i in ids] == ids
    assert not any(0xD800 <= ord(bpe.symbol(i)) < 0xE000 for i in ids)


def test_encoder_agrees_with_training(spark):
    texts = ["naïve cafés  cost 12345 €\n\n", "it's HE'LL \t tabs", "日本語 text 한국어", ""]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 20)], "id int, text string")
    vocabulary = bpe.train(frame, 256 + 60 + len(bpe.SPECIAL_TOKENS))
    encoded = encode.tokenize(frame, vocabulary, prepend=vocabulary.bos(), append=vocabulary.special("<|output_end|>"))
    decode = encode.decoder_function(spark, vocabulary)
    from pyspark.sql import functions as F

    inner = F.slice("tokens", F.lit(2), F.size("tokens") - 2)
    rows = encoded.withColumn("back", decode(inner)).collect()
    assert all(r["back"] == r["text"] for r in rows)
    assert all(r["tokens"][0] == vocabulary.bos() and r["tokens"][-1] == vocabulary.size - 1 for r in rows)

    # Pre-token by pre-token: trained segmentation and encoder give the same ids.
    pieces = bpe.segmentation(bpe.pretoken_counts(frame), vocabulary)
    ids = encode.encoder_function(spark, vocabulary)
    for r in pieces.withColumn("ids", ids("piece")).collect():
        assert [bpe.token_id(c) for c in r["symbols"]] == list(r["ids"])


def test_vocabulary_tables(spark):
    vocabulary = bpe.Vocabulary((bpe.Merge(97, 98, 256, 5), bpe.Merge(256, 99, 257, 3)))
    rows = {r["token_id"]: r for r in vocabulary.table(spark).collect()}
    assert bytes(rows[257]["bytes"]) == b"abc" and rows[257]["n_bytes"] == 3
    assert vocabulary.bos() == 258 and rows[258]["is_special"] and rows[258]["n_bytes"] == 0
    padded = encode.pad_vocabulary(vocabulary.table(spark), 300).collect()
    assert len(padded) == 300 and sum(r["n_bytes"] for r in padded) == 256 + 2 + 3


def test_lone_byte_measured_as_replacement(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(bytearray(b"\xe9"),), (bytearray(b"A"),)], "raw binary")
    got = frame.select(
        encode.decoded_bytes(F.col("raw")).alias("true"), encode.decoded_bytes(F.col("raw"), False).alias("shown")
    ).collect()
    assert [(r["true"], r["shown"]) for r in got] == [(1, 3), (1, 1)]


def test_vocab_too_small(spark):
    with pytest.raises(ValueError):
        bpe.train(spark.createDataFrame([("a",)], "text string"), 200)


def test_long_pieces_merge_like_short_ones():
    """The heap gives what scanning for the earliest merge gives; a million letters take seconds."""
    import random

    from loomwork.operators.encode import merge_piece

    def scanned(piece, ranks):
        ids = list(piece)
        while known := [(ranks[p], p) for p in zip(ids, ids[1:]) if p in ranks]:
            token, pair = min(known)
            out, i = [], 0
            while i < len(ids):
                hit = tuple(ids[i : i + 2]) == pair
                out.append(token if hit else ids[i])
                i += 1 + hit
            ids = out
        return ids

    rng = random.Random(1)
    for _ in range(400):
        ranks, symbols = {}, list(b"abc")
        for _ in range(rng.randrange(12)):
            pair = rng.choice(symbols), rng.choice(symbols)
            if pair not in ranks:
                ranks[pair] = 256 + len(ranks)
                symbols.append(ranks[pair])
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(30)))
        assert merge_piece(piece, ranks) == scanned(piece, ranks)
    assert len(merge_piece(b"ab" * 500_000, {(97, 98): 256, (256, 256): 257})) == 250_000


def test_decoding_odd_ids(spark):
    """Null and empty lists, bytes that are no text, and specials."""
    from loomwork.operators import encode

    vocabulary = bpe.Vocabulary((bpe.Merge(104, 105, 256, 1),))
    decode = encode.decoder_function(spark, vocabulary)
    rows = [([256, 33],), (None,), ([],), ([0xC3, 0xA9],), ([0xFF, 97],), ([257, 256],)]
    frame = spark.createDataFrame(rows, "ids array<int>").coalesce(1)
    assert [r[0] for r in frame.select(decode("ids")).collect()] == ["hi!", None, "", "é", "�a", "<|bos|>hi"]
