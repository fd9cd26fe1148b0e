"""Queries that run an incremental job over the tables and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions.text import pretokens
from loomwork.plans import chats, packs
from loomwork.plans.registry import query, table
from loomwork.plans.sqltext import strip as sql_strip, unit
from loomwork.session import scratch_path
from loomwork.streaming import jobs


def _n_files(scan, least=4):
    """As many files as the table's scan has tasks, so that a file stays as small as a task's share."""
    return max(least, scan.rdd.getNumPartitions())


def _landed(df, label, files):
    """The rows as a folder of files for a stream to pick up."""
    path = scratch_path(df.sparkSession, label)
    df.repartition(files).write.parquet(path)
    return path


@query(
    "stream_ingest",
    f"""
    SELECT doc_id, md5({sql_strip('text')}) AS text_md5 FROM documents WHERE {sql_strip('text')} <> ''
    """,
)
def stream_ingest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = _n_files(docs)
    landed = _landed(docs, "ingest-in", files)
    out, checkpoint = scratch_path(spark, "ingest-out"), scratch_path(spark, "ingest-progress")
    # Two runs with one checkpoint: the second finds nothing new to do.
    for _ in range(2):
        jobs.ingest_texts(jobs.source(spark, landed, docs.schema, -(-files // 2)), out, checkpoint)
    return spark.read.parquet(out).select("doc_id", F.md5("text").alias("text_md5"))


@query("stream_blocks", packs._blocks_sql(129))
def stream_blocks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Four arrivals in key order, a batch each, of as many files as their range has: blocks run
    # across batch edges. Rows without a key stand first.
    landed = scratch_path(spark, "blocks-in")
    edges = docs.approxQuantile("doc_id", [0.25, 0.5, 0.75], 0.01)
    out, checkpoint = scratch_path(spark, "blocks-out"), scratch_path(spark, "blocks-progress")
    bounds = [None, *edges, None]
    for low, high in zip(bounds, bounds[1:]):
        above = F.lit(True) if low is None else F.col("doc_id") > low
        below = F.lit(True) if high is None else F.col("doc_id") <= high
        part = docs.filter(F.coalesce(above & below, F.lit(low is None)))
        part.repartitionByRange("doc_id").write.mode("append").parquet(landed)
        jobs.block_texts(jobs.source(spark, landed, docs.schema), "doc_id", pretokens, 129, out, checkpoint)
    # A run that finds nothing new changes nothing.
    jobs.block_texts(jobs.source(spark, landed, docs.schema), "doc_id", pretokens, 129, out, checkpoint)
    return packs.block_digest(spark.read.parquet(out))


@query(
    "stream_chat_split",
    chats._COERCED_SQL
    + f"""
    , t AS (SELECT conv_id, messages, array_to_string(list_transform(messages, lambda m: m.role || ':' || m.content), '|') AS body FROM c),
    r AS (SELECT *, CASE WHEN len(messages) < 2 THEN 'too_few_messages'
                         WHEN messages[1].role = 'system' AND len(messages) < 3 THEN 'system_without_dialogue'
                         WHEN messages[-1].role <> 'assistant' THEN 'not_assistant_last' END AS reject_reason FROM t)
    SELECT conv_id, reject_reason, CASE WHEN reject_reason IS NOT NULL THEN 'rejected'
           WHEN {unit("'2357'", 'body')} < 0.2 THEN 'val' ELSE 'train' END AS split
    FROM r
    """,
)
def stream_chat_split(spark, sf_dir):
    rows = chats.chat_rows(spark, sf_dir)
    files = _n_files(table(spark, sf_dir, "conversations"))
    landed = _landed(rows, "chats-in", files)
    out = scratch_path(spark, "chats-out")
    jobs.prepare_chats(jobs.source(spark, landed, rows.schema, -(-files // 2)), out, scratch_path(spark, "chats-progress"), 0.2)
    return spark.read.parquet(out).select("conv_id", "split", "reject_reason")


@query(
    "stream_ema",
    """
    WITH s AS (SELECT user_id AS run, event_id AS key, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step FROM events)
    SELECT a.run, a.key, a.step::BIGINT AS step,
           round(sum(0.1 * pow(0.9, a.step - b.step) * b.value) / (1 - pow(0.9, a.step + 1)), 6) AS ema, min(b.value) AS best
    FROM s a JOIN s b ON a.run = b.run AND b.step <= a.step GROUP BY a.run, a.key, a.step
    """,
)
def stream_ema(spark, sf_dir):
    points = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("key"), "value"
    )
    # Arrivals by a hash, so that every file holds points of the whole range of keys and none
    # is in order; a last one a whole range later lets all of them be finished.
    low, high = points.agg(F.min("key"), F.max("key")).first()
    spread = (high or 0) - (low or 0)
    landed = scratch_path(spark, "series-in")
    files = _n_files(points)
    points.repartition(files, F.xxhash64("key")).write.parquet(landed)
    out, progress = scratch_path(spark, "series-out"), scratch_path(spark, "series-progress")

    def follow():
        jobs.follow_series(jobs.source(spark, landed, points.schema, -(-files // 4)), out, progress, disorder=spread)

    follow()
    last = spark.range(1).select(F.lit(None).cast("bigint").alias("run"), F.lit((high or 0) + spread + 2).alias("key"), F.lit(0.0).alias("value"))
    last.write.mode("append").parquet(landed)
    follow()
    done = spark.read.parquet(out).filter(F.col("key") <= (high or 0))
    return done.select("run", "key", "step", F.round("ema", 6).alias("ema"), "best")


@query(
    "stream_log_events",
    "SELECT DISTINCT user_id AS job_id FROM events WHERE event_type = 'error' AND value > 100",
)
def stream_log_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    stopped = (F.col("event_type") == "error") & (F.col("value") > 100)
    line = F.when(
        stopped,
        F.concat(
            F.lit("slurmstepd: error: *** JOB "), F.col("user_id"), F.lit(" ON node7 CANCELLED AT "),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" DUE TO TIME LIMIT ***"),
        ),
    ).otherwise(F.concat(F.lit("step "), F.col("event_id"), F.lit(" done")))
    landed = scratch_path(spark, "log-in")
    files = _n_files(events)
    events.select(line.alias("value")).repartition(files).write.text(landed)
    lines = spark.readStream.option("maxFilesPerTrigger", -(-files // 2)).text(landed)
    out = scratch_path(spark, "log-out")
    jobs.time_limited_jobs(lines, out, scratch_path(spark, "log-progress"))
    return spark.read.parquet(out).select("job_id")
