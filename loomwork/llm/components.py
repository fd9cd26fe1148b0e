"""Connected components of a large edge table by alternating large and small stars.

Each round is two aggregations and two joins on the edge table; nothing but two
numbers per round reaches the driver, and no node's neighbours are ever gathered
in one row. A hub with many neighbours is only ever reduced with ``min`` (partly
before the shuffle) or joined, which the engine may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomwork.session import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the component's smallest node.

    Loops and repeated edges are allowed. An empty table gives an empty result.
    """
    current = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(),
        "edges",
    )
    digest = None
    while True:
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == digest or now[0] == 0:
            break
        digest = now
        current = stored(_small_star(_large_star(current)), "edges")
    return current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionAll(
        current.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    )
