"""Fixed-size blocks and windows over one token stream, and padding of batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loomwork.operators.running import null_safe_join, running
from loomwork.session import stored


def stream_offsets(docs: DataFrame, key: str, length: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, key, n_tokens, start): where each document begins in the joined stream."""
    narrow = stored(docs.select(*by, key, length.cast("bigint").alias("n_tokens")), "lengths")
    return running(narrow, key, {"start": ("sum", F.col("n_tokens"))}, by, inclusive=False)


def fixed_blocks(
    docs: DataFrame,
    key: str,
    size: int,
    tokens: str = "tokens",
    by: Sequence[str] = (),
    keep_tail: bool = False,
) -> DataFrame:
    """(by, block_id, tokens): the stream cut every ``size`` tokens.

    The last, shorter block of a stream is dropped unless ``keep_tail``. Offsets
    are found on lengths alone; a block then gathers at most ``size`` tokens.
    """
    starts = stream_offsets(docs, key, F.size(tokens), by).select(*by, key, "n_tokens", "start")
    placed = null_safe_join(docs.select(*by, key, tokens), starts, [*by, key]).filter(F.col("n_tokens") > 0)
    first = F.floor(F.col("start") / size)
    last = F.floor((F.col("start") + F.col("n_tokens") - 1) / size)
    cut = placed.withColumn("block_id", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("block_id") * size - F.col("start"), F.lit(0))
    high = F.least((F.col("block_id") + 1) * size - F.col("start"), F.col("n_tokens"))
    pieces = cut.select(
        *by,
        "block_id",
        F.struct("start", F.slice(tokens, (low + 1).cast("int"), (high - low).cast("int")).alias("piece")).alias("p"),
    )
    blocks = pieces.groupBy(*by, "block_id").agg(F.array_sort(F.collect_list("p")).alias("p")).select(
        *by, "block_id", F.flatten("p.piece").alias("tokens")
    )
    return blocks if keep_tail else blocks.filter(F.size("tokens") == size)


def random_windows(
    blocks: DataFrame, block_size: int, windows: DataFrame, length: int, window: str = "window_id"
) -> DataFrame:
    """(window, x, y): ``length`` tokens from each ``start`` and the same moved by one.

    ``windows`` has (window, start). A window touches few blocks (two when blocks
    are at least as long), so the range lookup is an equi-join on block number.
    """
    ends = F.floor((F.col("start") + length) / block_size)
    wanted = windows.withColumn("block_id", F.explode(F.sequence(F.floor(F.col("start") / block_size), ends)))
    low = F.greatest(F.col("start") - F.col("block_id") * block_size, F.lit(0))
    high = F.least(F.col("start") + length + 1 - F.col("block_id") * block_size, F.size("tokens"))
    pieces = wanted.join(blocks, "block_id").select(
        window,
        F.struct(
            "block_id", F.slice("tokens", (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")).alias("piece")
        ).alias("p"),
    )
    whole = pieces.groupBy(window).agg(F.flatten(F.array_sort(F.collect_list("p"))["piece"]).alias("span"))
    return whole.select(
        window, F.slice("span", 1, length).alias("x"), F.slice("span", 2, length).alias("y")
    )


def shift(tokens: Column, length: int) -> tuple[Column, Column]:
    """Inputs and targets of a row of ``length + 1`` tokens."""
    return F.slice(tokens, 1, length), F.slice(tokens, 2, length)


def pad_to_longest(rows: DataFrame, group: str, pad: int, tokens: str = "tokens") -> DataFrame:
    """Right-pad each row to its group's longest; the real length is kept.

    The longest is a partial aggregate joined back, so a large group is never
    pulled into one window.
    """
    longest = rows.groupBy(group).agg(F.max(F.size(tokens)).alias("__longest"))
    missing = F.col("__longest") - F.size(tokens)
    return (
        null_safe_join(rows, longest, [group])
        .withColumn("n_real", F.size(tokens))
        .withColumn(tokens, F.concat(tokens, F.array_repeat(F.lit(pad).cast("int"), missing)))
        .drop("__longest")
    )
