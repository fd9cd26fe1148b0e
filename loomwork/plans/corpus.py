"""Queries over documents: cleaning, splits, views, mixtures, shards, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions.text import hash60, strip, unit_hash
from loomwork.operators import mixture as mix
from loomwork.operators import shards, splits
from loomwork.operators.running import take_until, with_ordinal
from loomwork.plans.registry import query, table
from loomwork.plans.sqltext import h60, strip as sql_strip, unit
from loomwork.session import spread
from loomwork.sources import tables


@query(
    "corpus_clean",
    f"""
    SELECT doc_id, length(text)::BIGINT AS n_chars,
           length({sql_strip('text')})::BIGINT AS n_chars_stripped,
           length({sql_strip('text')}) > 0 AS kept_stripped,
           md5({sql_strip('text')}) AS stripped_md5
    FROM documents WHERE text IS NOT NULL AND text <> ''
    """,
)
def corpus_clean(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    kept = shards.non_empty(docs)
    clean = strip(F.col("text"))
    return kept.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.length(clean).cast("bigint").alias("n_chars_stripped"),
        (F.length(clean) > 0).alias("kept_stripped"),
        F.md5(clean).alias("stripped_md5"),
    )


@query(
    "shard_split_last_val",
    """
    WITH s AS (
      SELECT doc_id, n_chars, doc_id // 100 AS shard,
             row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1 AS rn
      FROM documents)
    SELECT CASE WHEN shard = (SELECT max(shard) FROM s) THEN 'val' ELSE 'train' END AS split,
           (rn % 4)::BIGINT AS rank, count(*)::BIGINT AS n_docs, sum(n_chars)::BIGINT AS n_chars
    FROM s GROUP BY ALL
    """,
)
def shard_split_last_val(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "n_chars", F.floor(F.col("doc_id") / 100).alias("shard")
    )
    # A shard is a bounded range of ids, so it doubles as the ordinal's block.
    placed = with_ordinal(docs, "doc_id", by=["shard"], block=F.lit(0))
    split = splits.last_shard_split(placed)
    return (
        split.withColumn("rank", splits.rank_of(F.col("ordinal"), 4))
        .groupBy("split", "rank")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))
    )


@query(
    "ratio_split",
    f"""
    SELECT CASE WHEN {unit("'2357'", "doc_id")} < 0.1 THEN 'val' ELSE 'train' END AS split,
           count(*)::BIGINT AS n_docs, sum(n_chars)::BIGINT AS n_chars
    FROM documents GROUP BY ALL
    """,
)
def ratio_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return (
        docs.groupBy(splits.hash_split("doc_id", ratio=0.1).alias("split"))
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))
    )


@query(
    "strided_view",
    """
    WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents)
    SELECT doc_id, ((rn - 5) // 3)::BIGINT AS view_index
    FROM r WHERE rn >= 5 AND (rn - 5) % 3 = 0
    """,
)
def strided_view(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return splits.strided_view(docs, "doc_id", start=5, step=3).select("doc_id", "view_index")


_SPLIT_NAMES = """
  CASE ({s}) WHEN 0 THEN CASE ({d}) WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END
             WHEN 1 THEN CASE ({d}) WHEN 0 THEN 'test' ELSE 'train' END
             ELSE 'train' END"""


@query(
    "val_fallback",
    f"""
    WITH named AS (
      SELECT doc_id, source, {_SPLIT_NAMES.format(s=h60('source') + ' % 3', d=h60('doc_id') + ' % 3')} AS split
      FROM documents),
    ranked AS (
      SELECT *, CASE split WHEN 'validation' THEN 1 WHEN 'test' THEN 2 ELSE 3 END AS rk FROM named)
    SELECT source, split AS used_split, count(*)::BIGINT AS n_docs
    FROM ranked r WHERE rk = (SELECT min(rk) FROM ranked q WHERE q.source = r.source)
    GROUP BY ALL
    """,
)
def val_fallback(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    kind, pick = hash60("source") % 3, hash60("doc_id") % 3
    split = (
        F.when((kind == 0) & (pick == 0), "validation")
        .when((kind == 0) & (pick == 1), "test")
        .when((kind == 1) & (pick == 0), "test")
        .otherwise("train")
    )
    chosen = splits.preferred_split(
        docs.withColumn("split", split), ["source"], ["validation", "test", "train"]
    )
    return chosen.groupBy("source", F.col("split").alias("used_split")).agg(
        F.count(F.lit(1)).alias("n_docs")
    )


@query(
    "hash_shuffle",
    f"""
    SELECT doc_id, (row_number() OVER (ORDER BY {h60("'42'", "doc_id")}) - 1)::BIGINT AS position
    FROM documents
    """,
)
def hash_shuffle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return splits.hash_order(docs, "doc_id").select("doc_id", "position")


@query(
    "hash_shuffle_cap",
    f"""
    SELECT lang, doc_id FROM documents
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {h60("'1337'", "doc_id")}) <= 50
    """,
)
def hash_shuffle_cap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return splits.cap_after_shuffle(docs, ["lang"], ["doc_id"], 50).select("lang", "doc_id")


def _recipe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    items = table(spark, sf_dir, "benchmark").select("item_id")
    chats = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return [
        mix.Ingredient("web", docs, "doc_id"),
        mix.Ingredient("quiz", items, "item_id", repeats=3),
        mix.Ingredient("chat", chats, "conv_id", repeats=2, start=10),
    ]


_RECIPE_SQL = """
    WITH base AS (
      SELECT 0 AS task_idx, 'web' AS task, row_number() OVER (ORDER BY doc_id) - 1 AS local_idx, doc_id AS item, 1 AS reps FROM documents
      UNION ALL
      SELECT 1, 'quiz', row_number() OVER (ORDER BY item_id) - 1, item_id, 3 FROM benchmark
      UNION ALL
      SELECT 2, 'chat', rn - 10, conv_id, 2 FROM (
        SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS rn
        FROM (SELECT DISTINCT conv_id FROM conversations)) WHERE rn >= 10),
    copies AS (
      SELECT task_idx, task, local_idx, item, unnest(range(1, reps + 1)) AS copy FROM base)
"""


@query(
    "mixture_oversample",
    _RECIPE_SQL
    + f"""
    SELECT task, copy::BIGINT AS copy, item::VARCHAR AS item,
           (row_number() OVER (ORDER BY {h60("'42'", 'task_idx', 'copy', 'local_idx')}) - 1)::BIGINT AS position
    FROM copies
    """,
)
def mixture_oversample(spark, sf_dir):
    return mix.mixture(_recipe(spark, sf_dir)).select("task", "copy", "item", "position")


@query(
    "sequence_order",
    _RECIPE_SQL
    + """
    SELECT task, copy::BIGINT AS copy, item::VARCHAR AS item,
           (row_number() OVER (ORDER BY task_idx, copy, local_idx) - 1)::BIGINT AS position
    FROM copies
    """,
)
def sequence_order(spark, sf_dir):
    return mix.curriculum(_recipe(spark, sf_dir)).select("task", "copy", "item", "position")


@query(
    "mixture_composition",
    _RECIPE_SQL
    + """
    SELECT coalesce(task, '(all)') AS task, count(*)::BIGINT AS n_rows
    FROM copies GROUP BY ROLLUP (task)
    """,
)
def mixture_composition(spark, sf_dir):
    return mix.composition(mix.index_map(_recipe(spark, sf_dir)))


@query(
    "text_shards",
    f"""
    WITH kept AS (
      SELECT doc_id, {sql_strip('text')} AS text FROM documents WHERE {sql_strip('text')} <> ''),
    placed AS (
      SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS shard FROM kept)
    SELECT shard::BIGINT AS shard, count(*)::BIGINT AS n_rows,
           (sum(length(text)) + (count(*) - 1) * length('\n\n<|endoftext|>\n\n'))::BIGINT AS n_chars
    FROM placed GROUP BY shard
    """,
)
def text_shards(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    plan = shards.text_shard_plan(docs, "doc_id", rows_per_shard=64, strip_text=True)
    return shards.shard_summary(plan, separator=shards.END_OF_TEXT)


@query(
    "contiguous_shards",
    """
    WITH n AS (SELECT count(*) AS total, greatest(1, count(*) // 70) AS k FROM documents),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents),
    p AS (
      SELECT doc_id, CASE WHEN rn < (total % k) * (total // k + 1) THEN rn // (total // k + 1)
             ELSE (total % k) + (rn - (total % k) * (total // k + 1)) // (total // k) END AS shard
      FROM r, n)
    SELECT shard::BIGINT AS shard, count(*)::BIGINT AS n_rows, min(doc_id) AS first_id, max(doc_id) AS last_id
    FROM p GROUP BY shard
    """,
)
def contiguous_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return (
        shards.contiguous_shards(docs, "doc_id", rows_per_shard=70)
        .groupBy("shard")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min("doc_id").alias("first_id"),
            F.max("doc_id").alias("last_id"),
        )
    )


@query(
    "pending_inputs",
    f"""
    WITH inputs AS (SELECT doc_id // 50 AS shard, sum(n_chars) AS n_chars FROM documents GROUP BY 1)
    SELECT shard::BIGINT AS shard, n_chars::BIGINT AS n_chars FROM inputs WHERE {h60('shard')} % 3 <> 0
    """,
)
def pending_inputs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    inputs = docs.groupBy(F.floor(F.col("doc_id") / 50).alias("shard")).agg(
        F.sum("n_chars").alias("n_chars")
    )
    done = inputs.filter(hash60("shard") % 3 == 0).select("shard")
    return shards.pending(inputs, done, ["shard"])


@query(
    "append_once",
    f"""
    WITH runs AS (SELECT lang, source, count(*)::BIGINT AS n_docs FROM documents GROUP BY ALL),
    existing AS (SELECT lang, source, -n_docs AS n_docs FROM runs WHERE {h60('lang', 'source')} % 2 = 0)
    SELECT * FROM existing
    UNION ALL
    SELECT * FROM runs r WHERE NOT EXISTS (
      SELECT 1 FROM existing e WHERE e.lang = r.lang AND e.source = r.source)
    """,
)
def append_once(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "source")
    runs = docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"))
    # The rows already recorded carry a negated count, to show which side won.
    existing = runs.filter(hash60("lang", "source") % 2 == 0).withColumn("n_docs", -F.col("n_docs"))
    return shards.append_missing(existing, runs, ["lang", "source"])


@query(
    "char_budget",
    """
    WITH capped AS (SELECT lang, doc_id, least(length(text), 4000) AS n FROM documents),
    running AS (
      SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY doc_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             300000 // (SELECT count(DISTINCT lang) FROM documents) AS share
      FROM capped)
    SELECT lang, doc_id, n::BIGINT AS n_chars FROM running WHERE before <= share
    """,
)
def char_budget(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    kept = shards.budgeted_text(docs, "doc_id", "lang", max_chars=300_000, doc_cap=4_000)
    return kept.select("lang", "doc_id", F.length("text").cast("bigint").alias("n_chars"))


@query(
    "subset_filter",
    """
    SELECT source, count(*)::BIGINT AS n_docs FROM documents
    WHERE source IN ('src1', 'src3', 'src5') GROUP BY source
    """,
)
def subset_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source")
    return (
        docs.filter(F.col("source").isin("src1", "src3", "src5"))
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_docs"))
    )


@query(
    "epoch_scan",
    """
    WITH placed AS (
      SELECT doc_id, n_chars, doc_id // 100 AS shard, (doc_id // 10) % 10 AS row_group FROM documents),
    all_epochs AS (SELECT *, e FROM placed, (SELECT unnest([1, 2]) AS e))
    SELECT e::BIGINT AS epoch, shard::BIGINT AS shard, row_group::BIGINT AS row_group,
           count(*)::BIGINT AS n_docs, sum(n_chars)::BIGINT AS n_chars
    FROM all_epochs WHERE (e, shard, row_group) > (1, 3, 4) GROUP BY ALL
    """,
)
def epoch_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "n_chars",
        F.floor(F.col("doc_id") / 100).alias("shard"),
        (F.floor(F.col("doc_id") / 10) % 10).alias("row_group"),
    )
    saved = {"epoch": 1, "shard": 3, "row_group": 4}
    rows = tables.resume_after(tables.epochs(docs, 2), saved)
    return rows.groupBy(F.col("epoch").cast("bigint").alias("epoch"), "shard", "row_group").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars")
    )


@query(
    "text_source",
    f"""
    WITH raw AS (
      SELECT doc_id, CASE WHEN {h60('doc_id')} % 10 = 0 THEN NULL ELSE text END AS content,
             row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents)
    SELECT doc_id, length(content)::BIGINT AS n_chars, (rn % 3)::BIGINT AS rank
    FROM raw WHERE content IS NOT NULL
    """,
)
def text_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(hash60("doc_id") % 10 != 0, F.col("text")).alias("content")
    )
    # Ordinals come from the id column alone; the texts are never shuffled for them.
    ranked = with_ordinal(docs.select("doc_id"), "doc_id").select(
        "doc_id", splits.rank_of(F.col("ordinal"), 3).alias("rank")
    )
    rows = tables.text_rows(docs, "content").select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars")
    )
    return rows.join(ranked, "doc_id")
