"""Splits, strided views, seeded order and caps."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from loomwork.functions.text import hash60, unit_hash
from loomwork.operators.running import hash_block, null_safe_join, running, with_ordinal
from loomwork.session import stored

# Fixed value: seed of the ratio split.
RATIO_SPLIT_SEED = 2357


def last_shard_split(df: DataFrame, shard: str = "shard") -> DataFrame:
    """The highest shard is ``val``, all others ``train``."""
    newest = df.agg(F.max(shard)).scalar()
    return df.withColumn("split", F.when(F.col(shard) == newest, "val").otherwise("train"))


def rank_of(ordinal: Column, world: int) -> Column:
    """Worker that strided reading would give this ordinal to."""
    return F.pmod(ordinal, F.lit(world))


def hash_split(*parts: Column | str, ratio: float, seed: int | str = RATIO_SPLIT_SEED) -> Column:
    """``val`` for about ``ratio`` of the rows, decided by content alone."""
    return F.when(unit_hash(F.lit(str(seed)), *parts) < F.lit(ratio), "val").otherwise("train")


def exact_content_split(messages: Column, subset: Column, ratio: float) -> Column:
    """Split by the blake2b-64 digest of the sorted-key JSON of one conversation."""

    @F.pandas_udf(T.StringType())
    def split(rows: pd.Series, subsets: pd.Series) -> pd.Series:
        def one(turns, name):
            payload = json.dumps(
                {"subset": name, "messages": [dict(m) for m in json.loads(turns)]},
                ensure_ascii=False,
                sort_keys=True,
            )
            digest = hashlib.blake2b(payload.encode("utf-8"), digest_size=8).digest()
            return "val" if int.from_bytes(digest, "big") / 2**64 < ratio else "train"

        return pd.Series([one(m, s) for m, s in zip(rows, subsets)], dtype="object")

    return split(F.to_json(messages), subset)


def strided_view(
    df: DataFrame, key: str, start: int = 0, stop: int | None = None, step: int = 1
) -> DataFrame:
    """Rows start, start+step, ... before stop; ``view_index`` is the new position."""
    if start < 0 or step < 1 or (stop is not None and stop < start):
        raise ValueError("need start >= 0, step >= 1 and stop >= start")
    placed = with_ordinal(df, key)
    keep = (F.col("ordinal") >= start) & (F.pmod(F.col("ordinal") - start, F.lit(step)) == 0)
    if stop is not None:
        keep &= F.col("ordinal") < stop
    return placed.filter(keep).withColumn(
        "view_index", ((F.col("ordinal") - start) / step).cast("bigint")
    )


def hash_order(df: DataFrame, *parts: str, seed: int = 42) -> DataFrame:
    """Append ``order_key`` (seeded hash) and ``position`` in that order."""
    keyed = df.withColumn("order_key", hash60(F.lit(str(seed)), *parts))
    block = hash_block(df.sparkSession, "order_key")
    return with_ordinal(keyed, "order_key", "position", block=block, ties=parts)


def cap_after_shuffle(
    df: DataFrame, by: Sequence[str], parts: Sequence[str], n: int, seed: int = 1337
) -> DataFrame:
    """Deterministic subsample: exactly the first ``n`` of each group in seeded order.

    The order is the hash, then ``parts``. Counts per full key give each group's last
    key and how many of its rows are still in; only rows of that one key are numbered.
    """
    by = list(by)
    keyed = df.withColumn("order_key", hash60(F.lit(str(seed)), *parts))
    counts = stored(keyed.groupBy(*dict.fromkeys([*by, "order_key", *parts])).agg(F.count(F.lit(1)).alias("__w")), "counts")
    block = hash_block(df.sparkSession, "order_key")
    walked = running(counts, "order_key", {"__sum": ("sum", F.col("__w"))}, by, block=block, ties=list(parts))
    full = F.struct("order_key", *[F.col(p).alias(f"__p{i}") for i, p in enumerate(parts)])
    edge = walked.filter(F.col("__sum") >= n).select(*by, F.struct(full.alias("k"), (n - F.col("__sum") + F.col("__w")).alias("r")).alias("__e"))
    last = edge.groupBy(*by).agg(F.min("__e").alias("__last")) if by else edge.agg(F.min("__e").alias("__last"))
    marked = null_safe_join(keyed, last, by, "left") if by else keyed.crossJoin(F.broadcast(last))  # one row
    here = marked.withColumn("__k", full)
    inside = here.filter(F.col("__last").isNull() | (F.col("__k") < F.col("__last.k")))
    numbered = Window.partitionBy(*by, "__k").orderBy("order_key")
    at_edge = here.filter(F.col("__k") == F.col("__last.k")).withColumn("__n", F.row_number().over(numbered))
    kept = at_edge.filter(F.col("__n") <= F.col("__last.r")).drop("__n")
    return inside.unionByName(kept).drop("__k", "__last")


def preferred_split(
    df: DataFrame, by: Sequence[str], preference: Sequence[str], split: str = "split"
) -> DataFrame:
    """Keep, per group, the rows of the first split in ``preference`` that exists."""
    ranks = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col(split))
    ranked = df.withColumn("__rank", ranks).filter(F.col("__rank") > 0)
    best = ranked.groupBy(*by).agg(F.min("__rank").alias("__best"))
    return (
        null_safe_join(ranked, best, list(by))
        .filter(F.col("__rank") == F.col("__best"))
        .drop("__rank", "__best")
    )


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Raise instead of handing an empty split to a consumer that would wait forever."""
    if df.isEmpty():
        raise ValueError(f"no rows left in {what}")
    return df
