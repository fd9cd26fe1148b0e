"""Shard plans, budgets, and restart by anti-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from loomwork.functions.text import strip
from loomwork.operators.running import take_until, with_ordinal
from loomwork.session import stored

# The two separators placed between texts of one shard.
END_OF_TEXT = "\n\n<|endoftext|>\n\n"
END_OF_FILE = "\n\n<|endoffile|>\n\n"


def non_empty(df: DataFrame, column: str = "text") -> DataFrame:
    """Drop null and empty texts; blanks stay."""
    return df.filter(F.col(column).isNotNull() & (F.col(column) != ""))


def stripped(df: DataFrame, column: str = "text") -> DataFrame:
    """Strip, then drop what became empty."""
    return non_empty(df.withColumn(column, strip(F.col(column))), column)


def text_shard_plan(
    df: DataFrame, key: str, rows_per_shard: int = 10_000, strip_text: bool = False, column: str = "text"
) -> DataFrame:
    """Append ``shard`` and ``row_in_shard`` to the texts that survive cleaning.

    The plan is made on a stored (key, length) table, so texts are read once for it.
    """
    clean = stripped(df, column) if strip_text else non_empty(df, column)
    narrow = stored(clean.select(key, F.length(column).cast("bigint").alias("n_chars")), "lengths")
    placed = with_ordinal(narrow, key)
    return placed.select(
        key,
        "n_chars",
        F.floor(F.col("ordinal") / rows_per_shard).alias("shard"),
        (F.col("ordinal") % rows_per_shard).alias("row_in_shard"),
    )


def shard_summary(plan: DataFrame, separator: str) -> DataFrame:
    """Rows and characters per shard, separators between rows included."""
    rows = F.count(F.lit(1))
    return plan.groupBy("shard").agg(
        rows.alias("n_rows"),
        (F.sum("n_chars") + (rows - 1) * len(separator)).alias("n_chars"),
    )


def contiguous_shards(df: DataFrame, key: str, rows_per_shard: int = 500_000) -> DataFrame:
    """``max(1, rows // rows_per_shard)`` shards whose sizes differ by at most one."""
    total = df.count()
    shards = max(1, total // rows_per_shard)
    small, longer = divmod(total, shards)
    edge = longer * (small + 1)
    place = F.col("ordinal")
    shard = F.when(place < edge, F.floor(place / (small + 1))).otherwise(
        longer + F.floor((place - edge) / max(small, 1))
    )
    return with_ordinal(df, key).withColumn("shard", shard.cast("bigint")).drop("ordinal")


def write_contiguous(df: DataFrame, key: str, path: str, rows_per_shard: int = 500_000) -> None:
    """Contiguous shards as Parquet, one folder each."""
    placed = contiguous_shards(df, key, rows_per_shard)
    placed.repartition("shard").sortWithinPartitions("shard", key).write.partitionBy("shard").parquet(path)


def pending(inputs: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inputs not yet recorded as finished."""
    return inputs.join(done, list(on), "left_anti")


def append_missing(existing: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """Existing rows plus the new rows whose key is not there yet, one per key."""
    return existing.unionByName(pending(new, existing.select(*on), on).dropDuplicates(list(on)))


def budgeted_text(
    df: DataFrame, key: str, by: str, max_chars: int, doc_cap: int, column: str = "text"
) -> DataFrame:
    """Crop each text, then take each dataset up to an equal share of the budget.

    The text that crosses the share is kept. The budget is found on
    (dataset, key, length); whole texts are only filtered, never shuffled.
    """
    cropped = df.withColumn(column, F.substring(column, 1, doc_cap))
    datasets = df.select(F.count_distinct(by)).first()[0]
    share = max_chars // max(datasets, 1)
    return take_until(cropped, key, F.length(column), share, [by])
