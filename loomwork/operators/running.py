"""Running totals, ordinals and budgets without a one-partition window.

A global (or hot-group) running sum written as a window sends everything to one
task. Here the order key is cut into value ranges ("blocks") first. Each block is
totalled by a partial aggregate, the small table of block totals is scanned in
order, and rows are then finished inside their own block only. A block is chosen
from the key's value, never from a partition number, so a recomputed task after
an executor loss lands in the same place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomwork.functions.text import HASH_BITS
from loomwork.session import default_blocks, stored

_KINDS = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def add_range_block(df: DataFrame, key: str, name: str = "__blk", blocks: int | None = None) -> DataFrame:
    """Append the block number of ``key``, cut at approximate quantiles.

    The cut points are the only thing collected; their number follows the
    shuffle width. Finding a row's block is a binary search inside the JVM.
    """
    blocks = blocks or default_blocks(df.sparkSession)
    if blocks == 1:
        return df.withColumn(name, F.lit(0))
    cuts = df.select(F.col(key).cast("double").alias(key)).approxQuantile(
        key, [i / blocks for i in range(1, blocks)], 1.0 / (4 * blocks)
    )
    if not cuts:
        return df.withColumn(name, F.lit(0))
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    bucketizer = Bucketizer(
        splits=splits, inputCol=f"{name}_key", outputCol=name, handleInvalid="keep"
    )
    located = bucketizer.transform(df.withColumn(f"{name}_key", F.col(key).cast("double")))
    return located.withColumn(name, F.col(name).cast("int")).drop(f"{name}_key")


def hash_block(spark, key: str) -> Column:
    """Block of a uniform 60-bit hash: its leading bits, with no pass over the data."""
    bits = max(3, (default_blocks(spark) - 1).bit_length())
    return F.shiftright(F.col(key), HASH_BITS - bits)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that keeps null keys; the key columns come from the left.

    Keys are compared as one struct, in which nulls are equal.
    """
    key = F.struct(*on)
    keyed = right.withColumn("__key", key).drop(*on)
    return left.withColumn("__key", key).join(keyed, "__key", how).drop("__key")


def running(
    df: DataFrame,
    key: str,
    measures: dict[str, tuple[str, Column]],
    by: Sequence[str] = (),
    block: Column | None = None,
    inclusive: bool = True,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Append running ``measures`` in order of the numeric ``key``.

    Where the key is not unique, as a hash may not be, ``ties`` settle the order.

    ``measures`` maps a new column to ``(kind, value)`` with kind sum, count, min
    or max. ``by`` restarts the totals per group. ``block`` may give a
    bounded-size range of the key where one is known (for example ``turn / 1024``).
    With ``inclusive=False`` a row sees only the rows before it.
    """
    by = list(by)
    staged = add_range_block(df, key) if block is None else df.withColumn("__blk", block)
    for name, (kind, value) in measures.items():
        staged = staged.withColumn(f"__v_{name}", F.lit(1) if kind == "count" else value)

    # One key column for aggregate, join and window, so rows are shuffled for it once.
    staged = staged.withColumn("__key", F.struct(*by, "__blk"))
    totals = staged.groupBy("__key").agg(
        *[_KINDS[kind](f"__v_{name}").alias(f"__t_{name}") for name, (kind, _) in measures.items()]
    )
    earlier = (
        Window.partitionBy(*[F.col(f"__key.{c}") for c in by])
        .orderBy("__key.__blk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        "__key",
        *[
            _KINDS[kind](f"__t_{name}").over(earlier).alias(f"__c_{name}")
            for name, (kind, _) in measures.items()
        ],
    )
    inside = Window.partitionBy("__key").orderBy(key, *ties).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    out = staged.join(carry, "__key")
    for name, (kind, _) in measures.items():
        here = _KINDS[kind](f"__v_{name}").over(inside)
        before = F.col(f"__c_{name}")
        if kind in ("sum", "count"):
            zero = F.lit(0)
            value = F.coalesce(before, zero) + F.coalesce(here, zero)
        elif kind == "min":
            value = F.least(before, here)
        else:
            value = F.greatest(before, here)
        out = out.withColumn(name, value)
    return out.drop(
        "__key", "__blk", *[f"__v_{n}" for n in measures], *[f"__c_{n}" for n in measures]
    )


def with_ordinal(
    df: DataFrame,
    key: str,
    name: str = "ordinal",
    by: Sequence[str] = (),
    block: Column | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Zero-based position in order of ``key``, per ``by`` group."""
    return running(df, key, {name: ("count", F.lit(1))}, by, block, ties=ties).withColumn(
        name, (F.col(name) - 1).cast("bigint")
    )


def take_until(
    df: DataFrame,
    key: str,
    weight: Column,
    budget: Column | int,
    by: Sequence[str] = (),
    keep_crossing: bool = True,
) -> DataFrame:
    """Rows per group, in key order, until the running weight passes ``budget``.

    With ``keep_crossing`` a row stays while the weight *before* it is at most
    the budget, so the row that crosses is kept; otherwise the weight including
    the row must fit. Only (group, key, weight) is shuffled: it yields the last
    key kept per group, and the wide rows are then filtered in place.
    """
    by = list(by)
    narrow = stored(df.select(*by, key, weight.cast("bigint").alias("__w")), "weights")
    before = running(narrow, key, {"__sum": ("sum", F.col("__w"))}, by, inclusive=not keep_crossing)
    budget = F.lit(budget) if isinstance(budget, int) else budget
    last = (
        before.filter(F.col("__sum") <= budget)
        .groupBy(*by)
        .agg(F.max(key).alias("__last"))
    )
    if not by:
        return df.filter(F.col(key) <= last.select("__last").scalar())
    return (
        null_safe_join(df, last, by)
        .filter(F.col(key) <= F.col("__last"))
        .drop("__last")
    )


def top_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per group. Spark trims each group before the shuffle."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(window)).filter(F.col("__rn") <= n).drop("__rn")
