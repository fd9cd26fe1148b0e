"""Landed files as many as the scan has tasks."""

import os

from pyspark.sql import functions as F

from loomwork.plans import streams


def test_landed_files_follow_the_scan(spark, monkeypatch, tmp_path):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}
    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.concat(F.lit(" t"), "id").alias("text"))
    docs.repartition(16).write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    made = streams._landed
    monkeypatch.setattr(streams, "_landed", lambda *a: seen.append(made(*a)) or seen[-1])
    try:
        for n in names:
            spark.conf.set(n, "1000")
        out = streams.stream_ingest(spark, str(tmp_path)).collect()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert len(out) == 64
    files = [f for f in os.listdir(seen[0].removeprefix("file:")) if f.endswith(".parquet")]
    assert len(files) == 16
