"""Phrases whose words stand together more often than their parts, per language.

Only windows of the longest order are counted: every word with the (up to) three
words that follow it in its piece, padded at the piece's end. Each shorter phrase is a
prefix of such windows, so Spark's ROLLUP over the window's columns gives the counts
of all orders at once and no order is exploded by itself.

Windows move once. A task sorts the windows of a slice of texts, counts equal ones and
sends each run of windows to the bucket of its language and first two words. In its
bucket every count of two words or more is whole, so a window is cut back to its
longest frequent prefix; what ROLLUP sums are cut windows, few of them, and its sums
for frequent phrases (and for single words) are exact. A pair that holds a large share
of all windows is dealt by all four words instead; its counts of two and three words
are then not whole in a bucket and are not used for cutting.

To keep the moved windows small, words that are common in a sample are written as one
character each until the end. The sample (``SAMPLE_ROWS`` texts, ``CODES`` words at
most) decides only how windows are written and dealt, never a result.

Scores follow on the table of frequent phrases, one row each. Shuffles: the windows,
the cut windows, and joins on the frequent phrases.

Null or empty texts have no words; a null language is ``und``; repeated rows count as
often as they stand; an empty table gives no rows. Other columns are not carried, so
their names cannot clash. A task's memory follows a slice of 6 MB, or the longest text.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from loomwork.llm.arrowtext import text_slices
from loomwork.operators.running import top_rows
from loomwork.session import stored

MIN_COUNT = 30
#: A phrase goes where a longer candidate has at least this share (per cent) of its count.
COVERED_PERCENT = 80
TOP = 2000
#: Bytes of text whose windows share a bucket on average.
BUCKET_BYTES = 16 << 20
SAMPLE_ROWS = 4000
CODES = 40_000
#: Longest common word, in bytes, that is written as one character.
CODED_BYTES = 48

# Code characters: three UTF-8 bytes each, and no surrogates among them.
_FIRST_CODE = 0x0800
# Written before a word that looks like a code; no word holds a line end.
_LITERAL = "\n"
# Between the windows of one pair, and before a window's count; no word holds either.
_NEXT, _TIMES = "\r", "\x0b"
#: Bytes of text that a task sorts at a time.
SLICE = 6 << 20
# Byte classes: part of a word, blank, end of a piece.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def split_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words of all texts one after the other, number of the piece and of the text of each)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(texts) == 0 or offsets[0] == offsets[-1]:
        return pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(0, np.int32)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = _CLASS[data]
    inside = kind == 0
    first = np.zeros(len(data), dtype=bool)  # first byte of a text
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(inside & (first | np.concatenate([[True], ~inside[:-1]])))
    lengths = np.add.reduceat(inside, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    words = _LOWER[data[inside]]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    out = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(words))
    # A slice has under 2^31 bytes.
    piece = np.cumsum((kind == 2) | first, dtype=np.int32)[starts]
    text = (np.searchsorted(offsets, starts, side="right") - 1).astype(np.int32)
    return out, piece, text


def _lead(codes: np.ndarray, piece: np.ndarray, by: int) -> np.ndarray:
    """The code ``by`` words later in the same piece, or -1."""
    out = np.full(len(codes), -1, dtype=codes.dtype)
    if len(codes) > by:
        out[:-by] = np.where(piece[by:] == piece[:-by], codes[by:], -1)
    return out


def _mixed(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), dtype=np.uint64)
    for p in parts:
        out = (out ^ p) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _hashes(words: list[str]) -> np.ndarray:
    """A hash of each word, and after them that of "no word", which index -1 finds."""
    return np.array([xxhash.xxh64_intdigest(w) for w in words] + [0], dtype=np.uint64)


def _written(words: pa.Array, common: pa.Array, codes: pa.Array) -> pa.Array:
    """Each word as its code, or as it is; one that looks like a code is marked."""
    at = pc.index_in(words, common)
    out = pc.if_else(pc.is_valid(at), codes.take(at), words)
    single = pc.and_(pc.equal(pc.utf8_length(words), 1), pc.is_null(at))
    return pc.if_else(single, pc.binary_join_element_wise(pa.scalar(_LITERAL, words.type), words, pa.scalar("", words.type)), out)


def _window_blocks(common: list[str], hot: set[tuple[str, str, str]], buckets: int):
    """A function for ``mapInArrow`` from (lang, __text) to blocks of counted windows.

    A block holds pairs of words, how often each stands, and per pair the two words
    after it: one entry for each kind, a count following where it is not one.
    """

    def blocks(part, texts, shared, codes, hot_words, place):
        words, piece, text = split_pieces(texts)
        if not len(words):
            return None
        coded = words.dictionary_encode()
        words = coded.dictionary
        code = coded.indices.to_numpy(zero_copy_only=False)
        langs = part.column(0).dictionary_encode()
        lang = langs.indices.to_numpy(zero_copy_only=False)[text]
        lang_names = langs.dictionary.to_pylist()
        size = len(words) + 1
        w = [code, *(_lead(code, piece, k) for k in (1, 2, 3))]
        del piece, text, coded
        pair = (lang.astype(np.int64) * size + w[0]) * size + w[1] + 1
        rest = (w[2].astype(np.int64) + 1) * size + w[3] + 1
        hashes = _hashes(words.to_pylist())
        bucket = _mixed(_hashes(lang_names)[lang], hashes[w[0]], hashes[w[1]])
        is_hot = np.zeros(len(code), dtype=bool)
        if hot:
            at = pc.index_in(hot_words, words).to_pylist()
            lang_at = {n: i for i, n in enumerate(lang_names)}
            found = [(lang_at.get(n), at[place[a]], at[place[b]]) for n, a, b in hot]
            is_hot = np.isin(pair, [(n * size + a) * size + b + 1 for n, a, b in found if None not in (n, a, b)])
            bucket = np.where(is_hot, _mixed(bucket, hashes[w[2]], hashes[w[3]]), bucket)
        bucket = (bucket % np.uint64(buckets)).astype(np.int32)

        order = np.lexsort((rest, pair, bucket))
        p, r = pair[order], rest[order]
        new_pair = np.concatenate([[True], p[1:] != p[:-1]])
        new = new_pair | np.concatenate([[True], r[1:] != r[:-1]])
        at = np.flatnonzero(new)
        kept, counts = order[at], np.diff(np.append(at, len(order)))
        pair_at = np.flatnonzero(new_pair[at])
        del p, r, new, new_pair, order, pair, rest
        spelled = _written(words, shared, codes).cast(pa.string())

        def column(k, rows):
            c = w[k][rows]
            return spelled.take(pa.array(np.maximum(c, 0), mask=c < 0))

        def two(a, b):  # the second word is null where the first is
            return pc.if_else(pc.is_null(b), pc.fill_null(a, ""), pc.binary_join_element_wise(a, b, " "))

        tail = two(column(2, kept), column(3, kept))
        times = pa.array(counts)
        tail = pc.if_else(pc.equal(times, 1), tail, pc.binary_join_element_wise(tail, times.cast(pa.string()), _TIMES))
        ends = pa.array(np.append(pair_at, len(kept)), pa.int32())
        tails = pc.binary_join(pa.ListArray.from_arrays(ends, tail), _NEXT)
        first = kept[pair_at]
        heads = two(column(0, first), column(1, first))
        n = pa.array(np.add.reduceat(counts, pair_at))
        # A block is a run of pairs of one bucket, language and kind.
        key = (bucket[first].astype(np.int64) * len(lang_names) + lang[first]) * 2 + is_hot[first]
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = pa.array(np.append(cuts, len(first)), pa.int32())
        first = first[cuts]
        columns = [
            pa.array(bucket[first]),
            langs.dictionary.take(pa.array(lang[first])),
            pa.array(is_hot[first]),
            *(pa.ListArray.from_arrays(ends, c) for c in (heads, n, tails)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "lang", "hot", "pair", "n", "tails"])

    def run(batches):
        shared = pa.array(common, pa.large_string())
        codes = pa.array([chr(_FIRST_CODE + i) for i in range(len(common))], pa.large_string())
        hot_words = pa.array(sorted({w for _, *pair in hot for w in pair}), pa.large_string())
        place = {w: i for i, w in enumerate(hot_words.to_pylist())}
        for part, texts in text_slices(batches, "__text", SLICE):
            # A function of its own: nothing but the blocks is left when the next slice begins.
            made = blocks(part, texts, shared, codes, hot_words, place)
            del part, texts
            # The allocator would keep a slice's memory beside the executor's heap.
            pa.default_memory_pool().release_unused()
            if made is not None:
                yield made
            del made

    return run


def _seen_in_sample(docs: DataFrame, share: float, buckets: int) -> tuple[list[str], set[tuple[str, str, str]]]:
    """(common words, most common first, hot pairs with their language) in about ``SAMPLE_ROWS`` texts.

    A hot pair holds over a quarter of a bucket's even share, so there are at most four per bucket.
    """

    def run(batches):
        words, pairs, total = Counter(), Counter(), 0
        for part, texts in text_slices(batches, "__text"):
            found, piece, text = split_pieces(texts)
            if not len(found):
                continue
            coded = found.dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            names, langs = coded.dictionary.to_pylist(), part.column(0).to_pylist()
            total += len(code)
            words.update(dict(zip(names, np.bincount(code).tolist())))
            after = _lead(code, piece, 1)
            key, n = np.unique(np.stack([text, code, after]), axis=1, return_counts=True)
            often = n > 1
            for (t, a, b), c in zip(key[:, often].T.tolist(), n[often].tolist()):
                if b >= 0:
                    pairs[(langs[t], names[a], names[b])] += c
        rows = [(None, w, None, c) for w, c in words.items() if c > 1 and len(w.encode()) <= CODED_BYTES]
        rows += [(*k, c) for k, c in pairs.items() if c > 1] + [(None, None, None, total)]
        yield pa.RecordBatch.from_pylist([dict(zip(("lang", "a", "b", "n"), r)) for r in rows], _SAMPLE)

    found = docs.sample(share, 1).mapInArrow(run, "lang string, a string, b string, n bigint")
    found = stored(found.groupBy("lang", "a", "b").agg(F.sum("n").alias("n")), "sample")
    total = found.filter("a IS NULL").agg(F.sum("n")).first()[0] or 0
    common = found.filter("a IS NOT NULL AND b IS NULL").orderBy(F.desc("n"), "a").limit(CODES).select("a").collect()
    pairs = found.filter((F.col("b").isNotNull()) & (F.col("n") >= MIN_COUNT) & (F.col("n") * 4 * buckets >= total)).collect()
    return [r["a"] for r in common], {(r["lang"], r["a"], r["b"]) for r in pairs}


_SAMPLE = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, words, f): phrases of 1 to 4 words that stand ``min_count`` times or more.

    ``words`` 0 with the empty phrase is the language's number of words.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("__text"))
    rows, size = narrow.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()
    buckets = max(spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))
    common, hot = _seen_in_sample(narrow, min(1.0, SAMPLE_ROWS / max(rows, 1)), buckets)

    blocks = narrow.mapInArrow(
        _window_blocks(common, hot, buckets),
        "bucket int, lang string, hot boolean, pair array<string>, n array<bigint>, tails array<string>",
    )
    # Pairs first: only those of a frequent pair are windows of more than two words.
    moved = blocks.repartitionById(buckets, F.col("bucket")).select("bucket", "lang", "hot", F.explode(F.arrays_zip("pair", "n", "tails")).alias("p"))
    key = ["pair", "lang", "bucket"]
    pairs = moved.select("bucket", "lang", "hot", "p.*").withColumn("n2", F.sum("n").over(Window.partitionBy(*key)))
    pairs = pairs.withColumn("keep2", F.col("hot") | (F.col("n2") >= min_count))
    window = F.when(F.col("keep2"), F.split("tails", _NEXT)).otherwise(F.array(F.lit(None).cast("string")))
    rows = pairs.select("bucket", "lang", "hot", "pair", "n", "keep2", F.explode(window).alias("window"))
    parts = F.split("window", _TIMES)
    rest = F.split(F.get(parts, F.lit(0)), " ")
    local = rows.select(
        "bucket", "lang", "hot", "keep2",
        F.when(F.col("keep2"), F.col("pair")).otherwise(F.substring_index("pair", " ", 1)).alias("pair"),
        F.nullif(F.get(rest, F.lit(0)), F.lit("")).alias("w3"), F.get(rest, F.lit(1)).alias("w4"),
        F.when(F.col("keep2"), F.coalesce(F.get(parts, F.lit(1)).cast("bigint"), F.lit(1))).otherwise(F.col("n")).alias("c"),
    )
    local = local.groupBy("bucket", "lang", "hot", "keep2", "pair", "w3", "w4").agg(F.sum("c").alias("c"))
    counted = local.withColumn("n3", F.sum("c").over(Window.partitionBy(*key, "keep2", "w3")))
    cut = counted.select(
        "lang", "c", F.col("pair").alias("head"),
        F.when(F.col("hot") | (F.col("n3") >= min_count), F.col("w3")).alias("w3"),
        F.when(F.col("c") >= min_count, F.col("w4")).alias("w4"),
    )
    # Summed over the buckets before ROLLUP makes five rows of each.
    cut = cut.groupBy("lang", "head", "w3", "w4").agg(F.sum("c").alias("c"))
    head = F.split("head", " ")
    cut = cut.select("lang", F.get(head, F.lit(0)).alias("w1"), F.get(head, F.lit(1)).alias("w2"), "w3", "w4", "c")
    rolled = spark.sql(
        "SELECT lang, w1, w2, w3, w4, sum(c) AS f, grouping_id() AS g FROM {cut} GROUP BY lang, ROLLUP (w1, w2, w3, w4)", cut=cut
    )
    # A grouping id has a set bit per column rolled up, the last column lowest; a null that is
    # no rolled-up column is padding or cut, and such a sum is of no phrase.
    words = sum((F.when(F.col("g").bitwiseAND(8 >> k) == 0, 1).otherwise(0) for k in range(4)), F.lit(0))
    present = sum((F.col(f"w{k + 1}").isNotNull().cast("int") for k in range(4)), F.lit(0))
    kept = rolled.withColumn("words", words).filter((F.col("words") == present) & ((F.col("words") == 0) | (F.col("f") >= min_count)))
    spelled = {chr(_FIRST_CODE + i): w for i, w in enumerate(common)}

    def spell(batches):
        for batch in batches:
            out = [
                " ".join(spelled.get(w, w.removeprefix(_LITERAL)) for w in p.split(" ")) if p else "" for p in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.string()), batch.column(2), batch.column(3)], names=["lang", "phrase", "words", "f"]
            )

    return kept.select("lang", F.concat_ws(" ", "w1", "w2", "w3", "w4").alias("phrase"), "words", "f").mapInArrow(
        spell, "lang string, phrase string, words int, f bigint"
    )


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_count: int = MIN_COUNT,
    covered_percent: int = COVERED_PERCENT,
    top: int = TOP,
) -> DataFrame:
    """Per language the ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A candidate is a phrase of two to four words that stands a >= ``min_count`` times.
    Its score is the lowest of floor(2000000 a / (l + r)) over its cuts into a first
    part with count l and a rest with count r; of equal cuts the first counts. One that
    lies in a longer candidate with at least ``covered_percent`` of its count is dropped.
    Order: score and a descending, phrase by its bytes.
    """
    counts = stored(phrase_counts(docs, text, lang, min_count), "phrases")
    word = F.split("phrase", " ")
    candidates = counts.filter("words >= 2").withColumnRenamed("f", "a")

    # Every cut of every candidate with the counts of both parts.
    cuts = candidates.select("lang", "phrase", "a", word.alias("ws"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("ws", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("ws", F.col("k") + 1, F.size("ws") - F.col("k")), " ").alias("rest"),
    )
    part = counts.filter("words >= 1")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("(cast(a AS decimal(20, 0)) * 2000000) div (l + r)")  # the product may pass 64 bits
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))

    # Contiguous shorter phrases of each candidate, with the largest count around them.
    inner = candidates.filter("words >= 3").select(
        "lang", F.col("a").alias("outer"), word.alias("ws"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("n")
    )
    inner = inner.select("lang", "outer", "ws", "n", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("n") + 1)).alias("at"))
    around = (
        inner.select("lang", F.array_join(F.slice("ws", F.col("at"), F.col("n")), " ").alias("phrase"), "outer")
        .groupBy("lang", "phrase")
        .agg(F.max("outer").alias("outer"))
    )
    left = best.join(around, ["lang", "phrase"], "left").filter(
        F.col("outer").isNull() | (F.col("outer") * 100 < F.col("a") * covered_percent)
    )
    total = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    scored = left.join(total, "lang").select("lang", "phrase", "a", "best.l", "best.r", "n", F.col("best.score").cast("long").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = top_rows(scored, ["lang"], order, top)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
