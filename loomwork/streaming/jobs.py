"""Incremental jobs. Each runs to the end of what has arrived and stops.

Progress lives in the stream's checkpoint, so an input file that was finished is
not read again, and a restarted job goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomwork.functions.text import strip
from loomwork.operators import chatforms, splits
from loomwork.operators.chunking import fixed_blocks
from loomwork.session import stored
from loomwork.sources import storage

# Fixed value: the scheduler's line about a job that hit its time limit.
TIME_LIMIT = r"slurmstepd: error: \*\*\* JOB ([0-9]+) ON .* DUE TO TIME LIMIT \*\*\*"


def _finish(stream: DataFrame, out: str, checkpoint: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.trigger(availableNow=True).outputMode("append").start(out).awaitTermination()


def source(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def ingest_texts(texts: DataFrame, out: str, checkpoint: str, column: str = "text") -> None:
    """Strip texts, drop empty ones, append the rest."""
    clean = texts.withColumn(column, strip(F.col(column)))
    _finish(clean.filter(F.col(column).isNotNull() & (F.col(column) != "")), out, checkpoint)


def block_texts(
    texts: DataFrame, key: str, encode: Callable[[Column], Column], size: int, out: str, checkpoint: str
) -> None:
    """Tokenize arriving texts and append blocks of ``size`` tokens of one stream.

    The tokens left over by a batch, fewer than ``size``, open the next one, so the
    blocks do not depend on how files fall into batches; only the stream's last tail
    stays out. Keys are whole numbers; files arrive in key order. Files already in the
    checkpoint are not read again; a repeated batch replaces its own output and tail.
    """

    def advance(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        tokens = stored(batch.select(key, encode(F.col("text")).alias("tokens")), "batch-tokens")
        element = tokens.schema["tokens"].dataType.simpleString()
        base, before = 0, f"{out}/_open/{number - 1}"
        if storage.exists(spark, before):
            left = spark.read.schema(f"base bigint, tokens {element}").parquet(before)
            base = left.first()["base"]
            # The tail stands before all keys of the batch.
            first = tokens.agg(F.min(key)).first()[0]
            opening = F.lit((first if first is not None else 0) - 1).cast(tokens.schema[key].dataType)
            tokens = left.select(opening.alias(key), "tokens").unionByName(tokens)
        blocks = stored(fixed_blocks(tokens, key, size, keep_tail=True), "batch-blocks")
        whole = blocks.filter(F.size("tokens") == size)
        numbered = whole.withColumn("block_id", F.col("block_id") + base)
        numbered.write.mode("overwrite").parquet(f"{out}/batch={number}")
        open_tail = blocks.filter(F.size("tokens") < size).agg(F.first("tokens").alias("tokens"))
        rest = F.coalesce("tokens", F.array().cast(element)).alias("tokens")
        state = open_tail.select(F.lit(base + whole.count()).cast("bigint").alias("base"), rest)
        state.write.mode("overwrite").parquet(f"{out}/_open/{number}")

    writer = texts.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def prepare_chats(rows: DataFrame, out: str, checkpoint: str, ratio: float) -> None:
    """Coerce, validate and split chat rows; rejects keep their reason."""
    coerced = chatforms.coerce_messages(rows)
    reason = chatforms.reject_reason(F.col("messages_out"))
    lines = F.transform("messages_out", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    split = splits.hash_split(F.array_join(lines, "|"), ratio=ratio)
    named = coerced.withColumn("reject_reason", reason).withColumn(
        "split", F.when(F.col("reject_reason").isNotNull(), "rejected").otherwise(split)
    )
    _finish(named, out, checkpoint, ("split",))


# A key's time: the engine takes times up to the epoch for late from
# the start. Keys lie between -2^40 and 2^42.
_ORIGIN = 1 << 40


class _Series(StatefulProcessor):
    """A run's sums, and the points that wait until no earlier one can come."""

    def __init__(self, beta: float):
        self.beta = beta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "seen bigint, total double, best double")
        self.waiting = handle.getListState("waiting", "key bigint, value double")

    def handleInputRows(self, key, rows, timerValues):
        for points in rows:
            points = points.dropna(subset=["key"])
            if len(points):
                self.waiting.appendList(list(zip(points["key"].astype(int).tolist(), points["value"].tolist())))
                self.handle.registerTimer(int(points["key"].min()) + _ORIGIN)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        limit = timerValues.getCurrentWatermarkInMs() - _ORIGIN
        points = sorted(self.waiting.get())
        ready = [p for p in points if p[0] <= limit]
        later = points[len(ready) :]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0] + _ORIGIN)
        else:
            self.waiting.clear()
        if not ready:
            return
        seen, total, best = self.sums.get() if self.sums.exists() else (0, 0.0, None)
        out = []
        for at, value in ready:
            total = self.beta * total + value
            best = value if best is None else min(best, value)
            out.append((key[0], at, seen, (1 - self.beta) * total / (1 - self.beta ** (seen + 1)), best))
            seen += 1
        self.sums.update((seen, total, best))
        yield pd.DataFrame(out, columns=["run", "key", "step", "ema", "best"])

    def close(self) -> None:
        pass


def follow_series(points: DataFrame, out: str, checkpoint: str, beta: float = 0.9, disorder: int = 0) -> None:
    """Debiased exponential average and running minimum per run, carried across batches.

    ``points`` has (run, key, value); keys are whole numbers and may come out of order by
    up to ``disorder``, within a file or across files. The state of a run is Spark's keyed
    state: its sums, and the points whose key is not yet ``disorder`` behind the greatest
    key seen of any run. A timer at a point's key finishes all points up to the
    watermark, in order of key (equal keys by value). A point that comes later than that is dropped by
    the engine; points still within the bound wait for the next start of the job. Points
    without a key have no place and are left out; a null run is a run.
    """
    kind = points.schema["run"].dataType.simpleString()
    timed = points.select("run", "key", "value", F.timestamp_millis(F.col("key").cast("bigint") + _ORIGIN).alias("at"))
    rows = (
        timed.filter("key IS NOT NULL")
        .withWatermark("at", f"{disorder + 1} milliseconds")
        .groupBy("run")
        .transformWithStateInPandas(_Series(beta), f"run {kind}, key bigint, step bigint, ema double, best double", "Append", "EventTime")
    )
    spark = points.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    # Timers and lists are kept by this store only; the setting is read when the query starts.
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        _finish(rows, out, checkpoint)
    finally:
        spark.conf.set(name, before)


def time_limited_jobs(lines: DataFrame, out: str, checkpoint: str) -> None:
    """Each job id once, however often its line is seen.

    What was seen is the output itself: a batch leaves out the ids of earlier batches,
    and a repeated batch replaces its own, so no state grows beside the result.
    """
    job = F.regexp_extract("value", TIME_LIMIT, 1)
    found = lines.select(F.nullif(job, F.lit("")).cast("bigint").alias("job_id")).filter("job_id IS NOT NULL")

    def advance(batch: DataFrame, number: int) -> None:
        fresh = batch.distinct()
        if number and storage.exists(batch.sparkSession, out):
            told = batch.sparkSession.read.schema("job_id bigint, batch int").parquet(out)
            fresh = fresh.join(told.filter(F.col("batch") < number).select("job_id"), "job_id", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = found.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
