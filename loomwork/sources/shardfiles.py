"""Data sources for separator-joined text shards and flat token binaries.

Both are Python data sources: Spark decides the partitions, each task streams its
rows to its own file under a temporary name, and the driver publishes the files
only after every task has finished.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)

from loomwork.sources import storage

_INDEX = "index.json"


def _filesystem(path: str):
    """Arrow file system and path of a URI or plain path."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _FileWriter(DataSourceWriter):
    """Rename on commit, remove on abort; ``index.json`` lists what was published."""

    def __init__(self, options):
        self.path = options["path"]
        self.options = dict(options)

    def _temporary(self, name: str) -> str:
        context = TaskContext.get()
        return f"{self.path.rstrip('/')}/.{name}.{context.taskAttemptId()}.tmp"

    def commit(self, messages):
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f["name"])
        system, root = _filesystem(self.path)
        for entry in files:
            _, source = _filesystem(entry["temporary"])
            system.move(source, f"{root.rstrip('/')}/{entry['name']}")
        index = [{k: v for k, v in f.items() if k != "temporary"} for f in files]
        with system.open_output_stream(f"{root.rstrip('/')}/{_INDEX}") as out:
            out.write(json.dumps(index).encode())

    def abort(self, messages):
        for entry in (f for m in messages if m for f in m.files):
            system, source = _filesystem(entry["temporary"])
            system.delete_file(source)


class _TextShardWriter(_FileWriter):
    """Rows (shard, row_in_shard, text) arrive grouped and ordered by shard."""

    def write(self, iterator):
        separator = self.options["separator"]
        prefix = self.options.get("prefix", "train")
        files, current, out = [], None, None
        for row in iterator:
            if row.shard != current:
                if out is not None:
                    out.close()
                current = row.shard
                name = f"{prefix}_{current:05d}.txt"
                temporary = self._temporary(name)
                system, target = _filesystem(temporary)
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                out = system.open_output_stream(target)
                files.append({"name": name, "temporary": temporary, "rows": 0, "chars": 0})
            text = row.text if files[-1]["rows"] == 0 else separator + row.text
            out.write(text.encode("utf-8"))
            files[-1]["rows"] += 1
            files[-1]["chars"] += len(text)
        if out is not None:
            out.close()
        return _Written(files)


class TextShards(DataSource):
    @classmethod
    def name(cls):
        return "loomwork_text_shards"

    def schema(self):
        return "shard bigint, row_in_shard bigint, text string"

    def writer(self, schema, overwrite):
        return _TextShardWriter(self.options)


class _TokenWriter(_FileWriter, DataSourceArrowWriter):
    """Rows (tokens) arrive in stream order, as Arrow batches; one file per partition."""

    def write(self, iterator):
        name = f"part-{TaskContext.get().partitionId():06d}.bin"
        width = np.dtype(self.options.get("dtype", "uint16"))
        limit = np.iinfo(width).max
        temporary = self._temporary(name)
        system, target = _filesystem(temporary)
        system.create_dir(target.rsplit("/", 1)[0], recursive=True)
        count = 0
        with system.open_output_stream(target) as out:
            for batch in iterator:
                rows = batch.column(batch.schema.get_field_index("tokens"))
                ids = rows.flatten()
                if rows.null_count or ids.null_count:
                    raise ValueError("null tokens")
                ids = ids.to_numpy()
                if ids.size and (ids.max() > limit or ids.min() < 0):
                    raise ValueError(f"token id does not fit {width.name}")
                out.write(ids.astype(width).tobytes())
                count += ids.size
        return _Written([{"name": name, "temporary": temporary, "tokens": int(count)}])


@dataclass
class _Range(InputPartition):
    file: str
    first_token: int
    stream_offset: int
    tokens: int


class _TokenReader(DataSourceReader):
    """Byte ranges of the part files, a fixed number of tokens per task."""

    def __init__(self, options):
        self.path = options["path"]
        self.width = np.dtype(options.get("dtype", "uint16"))
        self.block = int(options.get("block", "65536"))
        self.per_task = self.block * int(options.get("blocks_per_task", "256"))

    def partitions(self):
        system, root = _filesystem(self.path)
        with system.open_input_stream(f"{root.rstrip('/')}/{_INDEX}") as stream:
            index = json.loads(stream.read())
        ranges, offset = [], 0
        for entry in index:
            for first in range(0, entry["tokens"], self.per_task):
                size = min(self.per_task, entry["tokens"] - first)
                ranges.append(_Range(entry["name"], first, offset + first, size))
            offset += entry["tokens"]
        return ranges

    def read(self, partition):
        system, root = _filesystem(self.path)
        with system.open_input_file(f"{root.rstrip('/')}/{partition.file}") as stream:
            for start in range(0, partition.tokens, self.block):
                size = min(self.block, partition.tokens - start)
                stream.seek((partition.first_token + start) * self.width.itemsize)
                ids = np.frombuffer(stream.read(size * self.width.itemsize), dtype=self.width)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([partition.stream_offset + start], pa.int64()),
                        pa.array([ids.astype(np.int32)], pa.list_(pa.int32())),
                    ],
                    names=["stream_offset", "tokens"],
                )


class TokenBinary(DataSource):
    @classmethod
    def name(cls):
        return "loomwork_tokens"

    def schema(self):
        return "stream_offset bigint, tokens array<int>"

    def reader(self, schema):
        return _TokenReader(self.options)

    def writer(self, schema, overwrite):
        return _TokenWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TextShards)
    spark.dataSource.register(TokenBinary)


def write_text_shards(
    plan: DataFrame, path: str, separator: str, prefix: str = "train", overwrite: bool = False
) -> None:
    """One text file per shard from (shard, row_in_shard, text); a filled folder is refused."""
    storage.claim(plan.sparkSession, path, overwrite)
    register(plan.sparkSession)
    rows = plan.select("shard", "row_in_shard", "text")
    ordered = rows.repartition("shard").sortWithinPartitions("shard", "row_in_shard")
    writer = ordered.write.format("loomwork_text_shards").mode("append")
    writer.option("separator", separator).option("prefix", prefix).save(path)


def write_tokens(tokens: DataFrame, key: str, path: str, dtype: str = "uint16", overwrite: bool = False) -> None:
    """Flat binary of ``tokens`` in key order; parts follow one another in name order.

    A filled folder is refused, or replaced with ``overwrite``.
    """
    storage.claim(tokens.sparkSession, path, overwrite)
    register(tokens.sparkSession)
    ordered = tokens.repartitionByRange(key).sortWithinPartitions(key).select("tokens")
    stream = ordered.select(F.lit(0).cast("bigint").alias("stream_offset"), "tokens")
    stream.write.format("loomwork_tokens").mode("append").option("dtype", dtype).save(path)


def read_tokens(spark: SparkSession, path: str, dtype: str = "uint16", block: int = 65_536) -> DataFrame:
    """(stream_offset, tokens): the stream in blocks, each read by byte range."""
    register(spark)
    reader = spark.read.format("loomwork_tokens").option("dtype", dtype).option("block", str(block))
    return reader.load(path)
