"""Corpus scans: file resolution, text column mapping, epochs and resume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

# Text column of each known corpus; "text" for any other.
TEXT_COLUMNS = {"fineweb-edu": "text", "rust": "content"}


def resolve_files(spark: SparkSession, candidates: Sequence[str]) -> list[str]:
    """Files of the first candidate folder that holds any ``*.parquet``, by name."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in candidates:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            continue
        names = sorted(
            str(s.getPath().toString())
            for s in fs.listStatus(path)
            if s.getPath().getName().endswith(".parquet")
        )
        if names:
            return names
    return []


def read_corpus(spark: SparkSession, dataset: str, candidates: Sequence[str], fallback: str | None = None) -> DataFrame:
    """(text, shard, source_file) of a corpus; ``shard`` is the file's place by name.

    Falls back to another folder where no candidate has files.
    """
    files = resolve_files(spark, candidates)
    if not files and fallback:
        files = resolve_files(spark, [fallback])
    if not files:
        raise FileNotFoundError(f"no parquet files for {dataset} in {list(candidates)}")
    column = TEXT_COLUMNS.get(dataset, "text")
    frame = spark.read.parquet(*files)
    shards = spark.createDataFrame(
        [(name.rsplit("/", 1)[1], i) for i, name in enumerate(files)], "file_name string, shard int"
    )
    located = frame.withColumn("file_name", F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B"))))
    # One row per file; a file without a place is an error, never a lost row.
    placed = located.join(F.broadcast(shards), "file_name", "left")
    lost = F.raise_error(F.concat(F.lit("no shard for file "), F.col("file_name"))).cast("int")
    shard = F.when(F.col("shard").isNull(), lost).otherwise(F.col("shard"))
    return placed.withColumn("shard", shard).withColumnRenamed(column, "text")


def text_rows(df: DataFrame, column: str = "text") -> DataFrame:
    """The corpus under its common column name, null texts dropped."""
    return df.withColumnRenamed(column, "text").filter(F.col("text").isNotNull())


def epochs(df: DataFrame, n_epochs: int, first: int = 1) -> DataFrame:
    """Each row once per epoch; no data moves, rows are repeated where they are."""
    if n_epochs < 1:
        raise ValueError("need one epoch at least")
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(first), F.lit(first + n_epochs - 1))))


def resume_after(df: DataFrame, position: dict, columns: Sequence[str] = ("epoch", "shard", "row_group")) -> DataFrame:
    """Rows strictly after a saved position; the leading columns order it."""
    here = F.struct(*columns)
    saved = F.struct(*[F.lit(position[c]).cast(dict(df.dtypes)[c]).alias(c) for c in columns])
    return df.filter(here > saved)
