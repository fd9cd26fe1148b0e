"""Queries that write a format and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions.text import hash60, pretokens
from loomwork.operators import chatcheck, chatforms, shards
from loomwork.operators.chunking import fixed_blocks
from loomwork.plans import chats, evals as eval_plans
from loomwork.plans.registry import query, table
from loomwork.plans.sqltext import h60, pieces, strip as sql_strip, unit
from loomwork.schemas import CHAT_ROW
from loomwork.session import scratch_path, spread
from loomwork.sources import prepared, records, shardfiles


@query(
    "io_jsonl",
    chats._COERCED_SQL
    + """
    , n AS (SELECT count(*)::BIGINT AS n FROM c)
    SELECT md5(array_to_string(list_transform(messages, lambda m: m.role || ':' || m.content), '|')) AS messages_md5,
           n AS n_rejected_lines
    FROM c, n
    """,
)
def io_jsonl(spark, sf_dir):
    path = scratch_path(spark, "jsonl")
    good = chats.chat_rows(spark, sf_dir).select(F.to_json(F.struct(*CHAT_ROW.names)).alias("value"))
    # For each good line one that breaks off half way, and one blank.
    broken = good.select(F.expr("substring(value, 1, length(value) div 2)").alias("value"))
    blank = good.select(F.lit("  ").alias("value"))
    good.unionByName(broken).unionByName(blank).write.text(path)
    rows, rejects = records.jsonl(spark, path, CHAT_ROW)
    lines = F.transform("messages_out", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return chatforms.coerce_messages(rows).select(
        F.md5(F.array_join(lines, "|")).alias("messages_md5"),
        F.lit(rejects.agg(F.count(F.lit(1)).alias("n")).scalar()).alias("n_rejected_lines"),
    )


@query(
    "io_message_arrays",
    chats._judged("strict")
    + """
    , b AS (SELECT conv_id, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS messages_md5 FROM conversations GROUP BY conv_id)
    SELECT messages_md5, reject_reason FROM judged JOIN b USING (conv_id)
    """,
)
def io_message_arrays(spark, sf_dir):
    path = scratch_path(spark, "arrays")
    messages = chatforms.assemble(chats.turns_of(spark, sf_dir))
    messages.select(F.to_json("messages").alias("value")).write.text(path)
    rows, _ = records.message_arrays(spark, path)
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return rows.select(
        F.md5(F.array_join(lines, "|")).alias("messages_md5"),
        chatforms.reject_reason(F.col("messages"), chatcheck.STRICT).alias("reject_reason"),
    )


@query(
    "io_contiguous",
    """
    WITH n AS (SELECT count(*) AS total, greatest(1, count(*) // 90) AS k FROM documents),
    r AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents)
    SELECT doc_id, md5(text) AS text_md5,
           (CASE WHEN rn < (total % k) * (total // k + 1) THEN rn // (total // k + 1)
            ELSE (total % k) + (rn - (total % k) * (total // k + 1)) // (total // k) END)::BIGINT AS shard
    FROM r, n
    """,
)
def io_contiguous(spark, sf_dir):
    path = scratch_path(spark, "contiguous")
    shards.write_contiguous(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", path, 90)
    back = spark.read.parquet(path)
    return back.select("doc_id", F.md5("text").alias("text_md5"), F.col("shard").cast("bigint").alias("shard"))


@query(
    "io_records",
    """
    SELECT doc_id, 'Say ' || source AS instruction, '' AS input, md5(text) AS output_md5, true AS usable FROM documents
    """,
)
def io_records(spark, sf_dir):
    path = scratch_path(spark, "records")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("Say "), "source").alias("instruction"),
        F.lit("").alias("input"),
        F.col("text").alias("output"),
    )
    prepared.write_records(docs, path)
    usable = prepared.has_records(spark, path)
    back = spark.read.schema(docs.schema).json(path)
    return back.select(
        "doc_id", "instruction", "input", F.md5("output").alias("output_md5"), F.lit(usable).alias("usable")
    )


@query(
    "io_csv_baselines",
    f"""
    SELECT source AS task, ({h60('source')} % 400 / 8.0)::DOUBLE AS baseline FROM documents GROUP BY source
    """,
)
def io_csv_baselines(spark, sf_dir):
    path = scratch_path(spark, "baselines")
    tasks = table(spark, sf_dir, "documents").select("source").distinct()
    tasks.select(
        F.col("source").alias("Eval Task"), (hash60("source") % 400 / 8).alias("Random baseline")
    ).write.csv(path, header=True)
    return records.baselines(spark, path)


@query(
    "io_metrics_csv",
    eval_plans._CHOICE_SQL
    + f"""
    , acc AS (SELECT task, avg((predicted = gold)::INT) AS accuracy FROM chosen GROUP BY task),
    s AS (SELECT task, accuracy, (accuracy - 0.01 * ({h60('task')} % 30)) / (1 - 0.01 * ({h60('task')} % 30)) AS centred FROM acc)
    SELECT task, round(accuracy, 9) AS accuracy, round(centred, 9) AS centred FROM s
    UNION ALL SELECT 'CORE', NULL, round(avg(centred), 9) FROM s
    """,
)
def io_metrics_csv(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    whole = eval_plans.core_metric(spark, sf_dir)
    scores = whole.filter(F.col("task") != "CORE")
    core = whole.filter(F.col("task") == "CORE").select(F.col("centred").alias("metric"))
    prepared.write_metrics(scores, core, path)
    return spark.read.csv(path, header=True, schema="task string, accuracy double, centred double")


def _chat_table(spark, sf_dir):
    """Accepted conversations as prepared chat rows, split by content."""
    turns = chats.turns_of(spark, sf_dir)
    accepted = chatcheck.judge(turns).filter(F.col("reject_reason").isNull()).select("conv_id")
    subset = F.when(F.col("conv_id") % 2 == 0, "general").otherwise("math")
    return (
        chatforms.assemble(turns.join(accepted, "conv_id"))
        .join(chats._content_split(turns, 0.2), "conv_id")
        .withColumn("subset", subset)
        .withColumn("thinking", F.lit(False))
    )


_PREPARED_SQL = chats._judged("prepared") + f"""
    , {chats._DIGEST_SQL},
    rows AS (
      SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'general' ELSE 'math' END AS subset,
             CASE WHEN {unit("'2357'", 'digest')} < 0.2 THEN 'val' ELSE 'train' END AS split, n_messages
      FROM judged JOIN d USING (conv_id) WHERE reject_reason IS NULL)
"""


@query(
    "io_parquet_roll",
    _PREPARED_SQL + "SELECT conv_id, split, subset, n_messages, true AS small_files FROM rows",
)
def io_parquet_roll(spark, sf_dir):
    path = scratch_path(spark, "rolled")
    prepared.write_prepared(_chat_table(spark, sf_dir), path, {"val_ratio": 0.2}, rows_per_shard=8)
    back = spark.read.parquet(path)
    sizes = back.groupBy(F.input_file_name()).count().agg(F.max("count").alias("n")).scalar()
    return back.select(
        "conv_id", F.col("split").cast("string").alias("split"), "subset",
        F.size("messages").cast("bigint").alias("n_messages"), (sizes <= 8).alias("small_files"),
    )


@query(
    "prepared_scan",
    _PREPARED_SQL
    + f"""
    SELECT conv_id, subset, (row_number() OVER (ORDER BY {h60("'42'", 'conv_id')}) - 1)::BIGINT AS position
    FROM rows WHERE split = 'train' AND subset = 'math'
    """,
)
def prepared_scan(spark, sf_dir):
    path = scratch_path(spark, "prepared")
    prepared.write_prepared(_chat_table(spark, sf_dir), path, {"val_ratio": 0.2})
    rows = prepared.scan(spark, path, "train", "math", key="conv_id")
    return rows.select("conv_id", "subset", "position")


@query(
    "io_text_shards",
    f"""
    WITH kept AS (
      SELECT doc_id, {sql_strip('text')} AS text FROM documents WHERE {sql_strip('text')} <> ''),
    placed AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS shard FROM kept)
    SELECT printf('web_%05d.txt', shard) AS file,
           md5(string_agg(text, chr(10) || chr(10) || '<|endoftext|>' || chr(10) || chr(10) ORDER BY doc_id)) AS text_md5
    FROM placed GROUP BY shard
    """,
)
def io_text_shards(spark, sf_dir):
    path = scratch_path(spark, "shards")
    docs = shards.stripped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    plan = shards.text_shard_plan(docs, "doc_id", rows_per_shard=64)
    shardfiles.write_text_shards(docs.join(plan, "doc_id"), path, shards.END_OF_TEXT, "web")
    files = records.whole_texts(spark, f"{path}/*.txt")
    return files.select(
        F.element_at(F.split("file", "/"), -1).alias("file"), F.md5("text").alias("text_md5")
    )


@query(
    "io_token_binary",
    f"""
    WITH d AS (SELECT doc_id, {pieces('text')} AS p FROM documents),
    k AS (SELECT doc_id, list_append(list_transform(p, lambda x: {h60('x')} % 50256), 50256) AS ids FROM d),
    o AS (SELECT doc_id, ids, coalesce(sum(len(ids)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM k),
    s AS (SELECT start + unnest(range(0, len(ids))) AS i, unnest(ids) AS id FROM o)
    SELECT (i // 4096)::BIGINT AS block_id, md5(string_agg(id::VARCHAR, ',' ORDER BY i)) AS ids_md5 FROM s GROUP BY 1
    """,
)
def io_token_binary(spark, sf_dir):
    path = scratch_path(spark, "tokens")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    ids = F.transform(pretokens(F.col("text")), lambda t: (hash60(t) % 50_256).cast("int"))
    # The end-of-text id follows every document.
    tokens = docs.select("doc_id", F.concat(ids, F.array(F.lit(50_256))).alias("tokens"))
    shardfiles.write_tokens(tokens, "doc_id", path)
    blocks = fixed_blocks(shardfiles.read_tokens(spark, path, block=1000), "stream_offset", 4096, keep_tail=True)
    return blocks.select("block_id", F.md5(F.array_join("tokens", ",")).alias("ids_md5"))


@query(
    "io_wholetext",
    f"""
    SELECT lang || '_' || source AS name, md5({sql_strip("string_agg(text, chr(10) ORDER BY doc_id)")}) AS text_md5
    FROM documents GROUP BY lang, source
    """,
)
def io_wholetext(spark, sf_dir):
    path = scratch_path(spark, "whole")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    # One file per (lang, source), written in id order.
    (
        docs.select(F.concat_ws("_", "lang", "source").alias("name"), "doc_id", "text")
        .repartition("name")
        .sortWithinPartitions("name", "doc_id")
        .select("name", "text")
        .write.partitionBy("name")
        .text(path)
    )
    files = records.whole_texts(spark, f"{path}/*/*.txt")
    return files.select(
        F.regexp_extract("file", "name=([^/]+)/", 1).alias("name"), F.md5("text").alias("text_md5")
    )


@query(
    "word_list",
    "SELECT DISTINCT trim(unnest(string_split(p_name, ' '))) AS word FROM part",
)
def word_list(spark, sf_dir):
    path = scratch_path(spark, "words")
    names = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    names.distinct().select(F.concat(F.lit("  "), "word", F.lit(" ")).alias("value")).write.text(path)
    return records.words(spark, path)
