"""Prepared chat data: rolling Parquet shards, manifest, success markers, guarded scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwork.operators.chatcheck import parse_names
from loomwork.operators.splits import hash_order, require_rows
from loomwork.sources import storage

SPLITS = ("train", "val")
MARKER = "_SUCCESS.json"
MANIFEST = "_manifest.json"
# Subset names of the prepared chat corpus.
SUBSETS = (
    "general", "instruction-following", "tool_calling", "math", "science", "code",
    "swe_localization", "swe_repair", "swe_testgen",
)


def _split_dir(path: str, split: str) -> str:
    return f"{path.rstrip('/')}/split={split}"


def data_files(spark: SparkSession, path: str, split: str) -> list[str]:
    return [n for n in storage.names(spark, _split_dir(path, split)) if n.endswith(".parquet")]


def is_prepared(spark: SparkSession, path: str, split: str) -> bool:
    """Files and the split's marker are both there."""
    marked = storage.exists(spark, f"{_split_dir(path, split)}/{MARKER}")
    return marked and bool(data_files(spark, path, split))


def is_incomplete(spark: SparkSession, path: str, split: str) -> bool:
    """Something was written, but the split was never marked."""
    return bool(data_files(spark, path, split)) and not is_prepared(spark, path, split)


def all_prepared(spark: SparkSession, path: str) -> bool:
    return all(is_prepared(spark, path, s) for s in SPLITS)


def refuse_partial(spark: SparkSession, path: str) -> None:
    if any(is_prepared(spark, path, s) or is_incomplete(spark, path, s) for s in SPLITS):
        raise RuntimeError(f"partial output in {path}: delete it before preparing again")


def write_prepared(
    rows: DataFrame, path: str, parameters: dict, rows_per_shard: int = 50_000, compression: str = "snappy"
) -> dict:
    """Write rows (with ``split`` and ``subset``) and publish manifest and markers.

    Files roll at ``rows_per_shard``; the markers come last, so a failed write
    leaves a split that reads as incomplete.
    """
    spark = rows.sparkSession
    if all_prepared(spark, path):
        return storage.read_json(spark, f"{path}/{MANIFEST}")
    refuse_partial(spark, path)
    (
        rows.write.mode("append")
        .partitionBy("split")
        .option("maxRecordsPerFile", rows_per_shard)
        .option("compression", compression)
        .option("parquet.enable.dictionary", "false")
        .parquet(path)
    )
    # Counted from what was written: two columns, no second run of the job.
    counts = {s: {} for s in SPLITS}
    for r in spark.read.parquet(path).groupBy("split", "subset").count().collect():
        counts[r["split"]][r["subset"]] = r["count"]
    manifest = {**parameters, "rows_per_shard": rows_per_shard, "compression": compression, "counts": counts}
    storage.write_json(spark, f"{path}/{MANIFEST}", manifest)
    for split in SPLITS:
        files = data_files(spark, path, split)
        if files:
            storage.write_json(
                spark,
                f"{_split_dir(path, split)}/{MARKER}",
                {"split": split, "rows": sum(counts[split].values()), "shards": len(files)},
            )
    return manifest


def require_same_parameters(spark: SparkSession, path: str, parameters: dict) -> None:
    """Refuse to continue a run whose saved parameters differ."""
    saved = storage.read_json(spark, f"{path}/{MANIFEST}")
    changed = {k: (saved.get(k), v) for k, v in parameters.items() if saved.get(k) != v}
    if changed:
        raise ValueError(f"saved run differs: {changed}")


def scan(
    spark: SparkSession,
    path: str,
    split: str,
    subsets: str | list | None = None,
    key: str | None = None,
    seed: int | None = 42,
    supported: tuple[str, ...] = SUBSETS,
) -> DataFrame:
    """Rows of a finished split, optionally of some subsets and in seeded order."""
    if split not in SPLITS:
        raise ValueError("split must be train or val")
    if not is_prepared(spark, path, split):
        if is_incomplete(spark, path, split):
            raise RuntimeError(f"split {split} in {path} is incomplete: delete it and prepare again")
        raise FileNotFoundError(f"no prepared data for split {split} in {path}")
    rows = spark.read.parquet(path).filter(F.col("split") == split)
    names = parse_names(subsets, supported)
    if names:
        rows = rows.filter(F.col("subset").isin(*names))
    require_rows(rows, f"split {split} of {path}")
    return rows if key is None or seed is None else hash_order(rows, key, seed=seed)


def load_chat(spark: SparkSession, path: str, split: str, recipe, subsets=None) -> DataFrame:
    """The prepared split where it is finished, else the given recipe's mixture."""
    return scan(spark, path, split, subsets) if is_prepared(spark, path, split) else recipe()


def write_records(records: DataFrame, path: str) -> None:
    """Instruction records as JSON lines; the committer publishes them at once."""
    records.write.mode("errorifexists").json(path)


def has_records(spark: SparkSession, path: str, required=("instruction", "input", "output")) -> bool:
    """Whether a usable output exists: readable, not empty, required fields in its first row."""
    if not [n for n in storage.names(spark, path) if not n.startswith(("_", "."))]:
        return False
    found = spark.read.json(path)
    if not set(required) <= set(found.columns):
        return False
    first = found.select(*required).head(1)
    return bool(first) and all(first[0][c] is not None for c in required)


def write_metrics(scores: DataFrame, core: DataFrame, path: str) -> None:
    """Per-task scores and the CORE line as one CSV; as many rows as tasks."""
    lines = scores.select("task", "accuracy", "centred").unionByName(
        core.select(
            F.lit("CORE").alias("task"), F.lit(None).cast("double").alias("accuracy"), F.col("metric").alias("centred")
        )
    )
    lines.coalesce(1).write.mode("errorifexists").csv(path, header=True)
