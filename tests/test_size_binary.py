"""Token files written in Arrow batches."""

from pyspark.sql.datasource import DataSourceArrowWriter

from loomwork.sources import shardfiles


def test_token_files_are_written_from_arrow_batches(spark, tmp_path):
    # Not from rows of Python numbers.
    assert issubclass(shardfiles._TokenWriter, DataSourceArrowWriter)
    rows = spark.createDataFrame([(i, list(range(i))) for i in (5, 0, 3, 7)], "id int, tokens array<int>")
    shardfiles.write_tokens(rows, "id", str(tmp_path / "t"))
    read = shardfiles.read_tokens(spark, str(tmp_path / "t"), block=4).orderBy("stream_offset").collect()
    assert [t for r in read for t in r["tokens"]] == [*range(3), *range(5), *range(7)]
