"""Mixtures (shuffled unions with oversampling) and sequences (curricula)."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from loomwork.functions.text import hash60
from loomwork.operators.running import hash_block, with_ordinal
from loomwork.session import stored


@dataclass(frozen=True)
class Ingredient:
    """One line of a recipe: a task, how often it repeats, and its slice."""

    name: str
    rows: DataFrame
    key: str
    repeats: int = 1
    start: int = 0
    stop: int | None = None


# How often each source of the chat mixture is repeated and where it stops.
TRAIN_REPEATS = {"smoltalk": 1, "identity": 2, "mmlu": 3, "gsm8k": 4, "spelling": 1, "letter_counting": 1}
VAL_STOPS = {"smoltalk": None, "mmlu": 5_200, "gsm8k": 420}


def chat_recipe(
    sources: dict[str, tuple[DataFrame, str]], split: str, repeats: dict[str, int] | None = None
) -> list[Ingredient]:
    """The standard chat mixture of a split from (rows, key) per source name."""
    if split == "train":
        times = {**TRAIN_REPEATS, **(repeats or {})}
        return [Ingredient(name, *sources[name], repeats=n) for name, n in times.items()]
    return [Ingredient(name, *sources[name], stop=stop) for name, stop in VAL_STOPS.items()]


def _indexed(task_idx: int, item: Ingredient) -> DataFrame:
    local = with_ordinal(item.rows.select(item.key), item.key, "local_idx")
    keep = F.col("local_idx") >= item.start
    if item.stop is not None:
        keep &= F.col("local_idx") < item.stop
    return local.filter(keep).select(
        F.lit(task_idx).cast("bigint").alias("task_idx"),
        F.lit(item.name).alias("task"),
        (F.col("local_idx") - item.start).alias("local_idx"),
        F.col(item.key).cast("string").alias("item"),
    )


def index_map(recipe: Sequence[Ingredient]) -> DataFrame:
    """One row per (task, copy, local index); texts are joined on later, by item."""
    parts = []
    for task_idx, item in enumerate(recipe):
        if item.repeats < 1:  # left out, with its place in the recipe kept
            continue
        copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(item.repeats).cast("bigint")))
        parts.append(_indexed(task_idx, item).withColumn("copy", copies))
    if not parts:
        raise ValueError("every line of the recipe is left out")
    return functools.reduce(DataFrame.unionByName, parts)


def mixture(recipe: Sequence[Ingredient], seed: int = 42) -> DataFrame:
    """Union of all copies in one seeded global order (``position``)."""
    key = hash60(F.lit(str(seed)), F.col("task_idx"), F.col("copy"), F.col("local_idx"))
    rows = stored(index_map(recipe).withColumn("order_key", key), "mixture")
    block = hash_block(rows.sparkSession, "order_key")
    return with_ordinal(
        rows, "order_key", "position", block=block, ties=("task_idx", "copy", "local_idx")
    )


def curriculum(recipe: Sequence[Ingredient]) -> DataFrame:
    """Tasks one after another; ``position`` = rows of earlier tasks + local index."""
    rows = stored(index_map(recipe), "curriculum")
    # One row per copy of a recipe line: the window below and the broadcast are recipe-sized.
    earlier = Window.orderBy("task_idx", "copy").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("task_idx", "copy").count().select(
        "task_idx", "copy", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset")
    )
    return (
        rows.join(F.broadcast(offsets), ["task_idx", "copy"])
        .withColumn("position", (F.col("local_idx") + F.col("offset")).cast("bigint"))
        .drop("offset")
    )


def composition(mixed: DataFrame) -> DataFrame:
    """Rows per task and in total."""
    return (
        mixed.rollup("task")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select(F.coalesce("task", F.lit("(all)")).alias("task"), "n_rows")
    )
