"""Line- and file-oriented sources, with rejects kept beside the accepted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from loomwork.functions.text import strip
from loomwork.schemas import BASELINES, MESSAGES

_CORRUPT = "_corrupt"


def jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): one JSON object per line; blank lines are neither."""
    lines = spark.read.text(path).filter(strip(F.col("value")) != "")
    wide = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    parsed = lines.select("value", F.from_json("value", wide, options).alias("row"))
    broken = F.col("row").isNull() | F.col(f"row.{_CORRUPT}").isNotNull()
    rows = parsed.filter(~broken).select("row.*").drop(_CORRUPT)
    return rows, parsed.filter(broken).select(F.col("value").alias("line"))


def message_arrays(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): each line is an array of messages."""
    lines = spark.read.text(path).filter(strip(F.col("value")) != "")
    parsed = lines.select("value", F.from_json("value", MESSAGES).alias("messages"))
    broken = F.col("messages").isNull() | F.exists(
        "messages", lambda m: m.isNull() | m["role"].isNull() | m["content"].isNull()
    )
    return (
        parsed.filter(~broken).select("messages"),
        parsed.filter(broken).select(F.col("value").alias("line")),
    )


def baselines(spark: SparkSession, path: str) -> DataFrame:
    """(task, baseline): chance accuracy in percent."""
    rows = spark.read.csv(path, header=True, schema=BASELINES)
    return rows.select(F.col("Eval Task").alias("task"), F.col("Random baseline").alias("baseline"))


def words(spark: SparkSession, path: str) -> DataFrame:
    """One word per line, trimmed."""
    return spark.read.text(path).select(strip(F.col("value")).alias("word"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): whole files, stripped; empty ones are dropped."""
    files = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), strip(F.col("value")).alias("text")
    )
    return files.filter(F.col("text") != "")


def task_config(spark: SparkSession, tasks: list[dict]) -> DataFrame:
    """Task list as a table; the delimiter defaults to one blank, the first shot count is used."""
    rows = [
        (
            t["label"], t["icl_task_type"], t["dataset_uri"], int(t["num_fewshot"][0]),
            t.get("continuation_delimiter", " "),
        )
        for t in tasks
    ]
    return spark.createDataFrame(
        rows, "task string, kind string, dataset string, n_shots int, delimiter string"
    )
