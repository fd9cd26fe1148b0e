"""Applying a vocabulary: encode, decode, byte lengths, compression.

Texts are cut into pieces by the same JVM expression as in training. Merging has no
built-in: it runs as an Arrow function over the arrays of pieces, next to the scan.
A batch is worked through in slices of bounded size, whatever its rows hold: a
slice's distinct pieces are merged together and the ids are laid out with array
operations. The merges travel as one broadcast of vocabulary size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from loomwork.functions.text import pretokens
from loomwork.operators.bpe import Vocabulary, merge_piece, merge_pieces  # noqa: F401

# Pieces, or ids, of a batch that a task works on at a time.
_SLICE = 1 << 20


def _sliced(rows: pa.ListArray) -> Iterator[tuple[pa.ListArray, np.ndarray, np.ndarray]]:
    """(rows, which are not null, their lengths) with at most ``_SLICE`` elements, one row at least."""
    valid = rows.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(valid, rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(rows):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + _SLICE, side="right")))
        yield rows.slice(start, stop - start), valid[start:stop], sizes[start:stop]
        start = stop


def encoder_function(
    spark: SparkSession, vocabulary: Vocabulary, prepend: int | None = None, append: int | None = None
):
    """Column function text -> array<int>, with optional ids before and after; null stays null."""
    shared = spark.sparkContext.broadcast({(m.left, m.right): m.token for m in vocabulary.merges})
    head = [] if prepend is None else [prepend]
    tail = [] if append is None else [append]

    def merged(rows: pa.ListArray, valid: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
        pieces = rows.flatten().dictionary_encode()
        distinct = pieces.dictionary
        raw = np.frombuffer(b"".join(distinct.cast(pa.binary()).to_pylist()), dtype=np.uint8)
        ids, n = merge_pieces(raw, pc.binary_length(distinct).to_numpy(), shared.value)
        places = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        lists = pa.ListArray.from_arrays(places, pa.array(ids, pa.int32())).take(pieces.indices)
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])]
        offsets = pa.array(ends.astype(np.int32), mask=np.append(~valid, False))
        return pa.ListArray.from_arrays(offsets, lists.flatten())

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def merge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        empty = pa.array([], pa.list_(pa.int32()))
        for rows in batches:
            yield pa.concat_arrays([empty, *(merged(*part) for part in _sliced(rows))])

    def encode(text: Column | str) -> Column:
        ids = merge(pretokens(F.col(text) if isinstance(text, str) else text))
        edges = [F.array(*[F.lit(i) for i in side]).cast("array<int>") for side in (head, tail) if side]
        if not edges:
            return ids
        return F.concat(*(edges[:1] if head else []), ids, *(edges[-1:] if tail else []))

    return encode


def decoder_function(spark: SparkSession, vocabulary: Vocabulary):
    """Column function array<int> -> text; bytes that are no text show as replacement characters."""
    names = [name.encode() for name, _ in sorted(vocabulary.specials.items(), key=lambda x: x[1])]
    shared = spark.sparkContext.broadcast([*vocabulary.token_bytes(), *names])

    def texts_of(table: pa.Array, rows: pa.ListArray, valid: np.ndarray, sizes: np.ndarray) -> pa.Array:
        # The bytes of all tokens one after the other; a row's text is a stretch of them.
        taken = table.take(rows.flatten())
        places = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset : taken.offset + len(taken) + 1]
        ends = places[np.concatenate([[0], np.cumsum(sizes)])] if len(taken) else np.zeros(len(rows) + 1, np.int64)
        data = taken.buffers()[2] or pa.py_buffer(b"")
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), data])
        try:
            texts = raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            texts = pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())
        return pc.if_else(pa.array(valid), texts, pa.scalar(None, pa.string()))

    @F.arrow_udf(T.StringType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = pa.array(shared.value, pa.large_binary())
        for rows in batches:
            yield pa.concat_arrays([pa.array([], pa.string()), *(texts_of(table, *part) for part in _sliced(rows))])

    return decode


def tokenize(
    df: DataFrame,
    vocabulary: Vocabulary,
    column: str = "text",
    prepend: int | None = None,
    append: int | None = None,
) -> DataFrame:
    """Append ``tokens`` and ``n_tokens``."""
    encode = encoder_function(df.sparkSession, vocabulary, prepend, append)
    return df.withColumn("tokens", encode(F.col(column))).withColumn("n_tokens", F.size("tokens"))


def decoded_bytes(raw: Column, true_bytes: bool = True) -> Column:
    """Byte length of a token; with ``true_bytes`` off, as its decoded text measures.

    A lone non-ASCII byte decodes to the replacement character (three bytes).
    """
    return F.octet_length(raw) if true_bytes else F.octet_length(F.make_valid_utf8(raw.cast("string")))


def pad_vocabulary(tokens: DataFrame, size: int) -> DataFrame:
    """(token_id, n_bytes) for 0..size-1, zero where the vocabulary has no token."""
    ids = tokens.sparkSession.range(size).select(F.col("id").cast("int").alias("token_id"))
    return ids.join(tokens.select("token_id", "n_bytes"), "token_id", "left").select(
        "token_id", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes")
    )


def byte_stats(tokens: DataFrame) -> DataFrame:
    """Spread of byte lengths over tokens that have any."""
    real = tokens.filter(F.col("n_bytes") > 0)
    return real.agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.min("n_bytes").cast("bigint").alias("bytes_min"),
        F.max("n_bytes").cast("bigint").alias("bytes_max"),
        F.round(F.avg("n_bytes"), 6).alias("bytes_mean"),
        F.round(F.stddev_samp("n_bytes"), 6).alias("bytes_std"),
    )


def compression(df: DataFrame, by: str, sizes: dict[str, Column], text: str = "text") -> DataFrame:
    """(class, tokenizer, n_bytes, n_tokens, ratio) in one pass over the texts."""
    totals = df.groupBy(by).agg(
        F.sum(F.octet_length(text)).alias("n_bytes"),
        *[F.sum(size.cast("bigint")).alias(f"__{name}") for name, size in sizes.items()],
    )
    entries = F.explode(
        F.array(*[F.struct(F.lit(n).alias("tokenizer"), F.col(f"__{n}").alias("n_tokens")) for n in sizes])
    )
    return totals.select(by, "n_bytes", entries.alias("e")).select(
        by,
        F.col("e.tokenizer").alias("tokenizer"),
        "n_bytes",
        F.col("e.n_tokens").alias("n_tokens"),
        (F.col("n_bytes") / F.col("e.n_tokens")).alias("ratio"),
    )


def compare(results: DataFrame, by: str, ours: str, baselines: Sequence[str]) -> DataFrame:
    """Token saving of ``ours`` in percent against each baseline, and the better one."""
    mine = results.filter(F.col("tokenizer") == ours).select(
        by, F.col("n_tokens").alias("our_tokens"), F.col("ratio").alias("our_ratio")
    )
    theirs = results.filter(F.col("tokenizer").isin(*baselines))
    saving = (F.col("n_tokens") - F.col("our_tokens")) / F.col("n_tokens") * 100
    better = (
        F.when(F.col("ratio") > F.col("our_ratio"), F.col("tokenizer"))
        .when(F.col("our_ratio") > F.col("ratio"), ours)
        .otherwise("Tie")
    )
    return theirs.join(mine, by).select(
        by,
        F.col("tokenizer").alias("baseline"),
        F.col("n_tokens").alias("baseline_tokens"),
        "our_tokens",
        saving.alias("saving_pct"),
        better.alias("better"),
    )


def inspect(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, pos, token, hex): one row per token with its bytes."""
    return df.select(key, F.posexplode(tokens).alias("pos", "token")).select(
        key,
        F.col("pos").cast("bigint").alias("pos"),
        "token",
        F.lower(F.hex(F.encode("token", "UTF-8"))).alias("hex"),
    )
