"""Token files of independent zstandard frames with a trailing seek table.

A file, in the public seekable zstandard layout:

* data frames: the ids (little-endian unsigned 32-bit) of whole documents, about
  ``FRAME_BYTES`` raw each, longer only for one longer document;
* a skippable frame with the document index (keys, lengths, frame numbers);
* a skippable frame with the seek table: compressed size, raw size and checksum
  (low 32 bits of XXH64) per frame, then the footer.

A plain zstandard reader sees one stream of ids; ``FrameFile`` decompresses only the
frames of the documents asked for and checks each against its checksum.

The corpus is range-partitioned by key once, as text; each task sorts its range and
streams one file to the shared folder under a name of its own attempt. Only files of
tasks that succeeded stand in the manifest, so a lost executor leaves at most a file
that nobody reads.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomwork.llm.arrowtext import text_slices
from loomwork.llm.tokenids import TokenizerFile, shared_encoder
from loomwork.session import scratch_path, stored
from loomwork.sources.shardfiles import _filesystem

FRAME_BYTES = 1 << 16
FRAMES_PER_TASK = 256
# Fixed values of the public seekable format.
_INDEX_MAGIC, _SEEK_MAGIC, _FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_CHECKSUMS = 0x80


def _check(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class FrameWriter:
    """Streams documents in key order to ``out``; ``close`` writes index and seek table."""

    def __init__(self, out, level: int = 3):
        self.out, self.packer = out, zstandard.ZstdCompressor(level=level)
        self.table: list[tuple[int, int, int]] = []
        self.held: list[np.ndarray] = []
        self.held_bytes = self.tokens = 0
        self.keys, self.lengths, self.frames = [], [], []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        if self.held and self.held_bytes + 4 * len(ids) > FRAME_BYTES:
            self._flush()
        self.held.append(ids)
        self.held_bytes += 4 * len(ids)
        self.tokens += len(ids)
        self.keys.append(key)
        self.lengths.append(len(ids))
        self.frames.append(len(self.table))

    def _flush(self) -> None:
        raw = np.concatenate(self.held).astype("<u4").tobytes()
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.table.append((len(packed), len(raw), _check(raw)))
        self.held, self.held_bytes = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        valid = np.array([k is not None for k in self.keys], dtype=np.uint8)
        keys = np.array([k or 0 for k in self.keys], dtype="<i8")
        raw = struct.pack("<Q", len(keys)) + valid.tobytes() + keys.tobytes()
        raw += np.array(self.lengths, dtype="<i8").tobytes() + np.array(self.frames, dtype="<u4").tobytes()
        packed = self.packer.compress(raw)
        self.out.write(struct.pack("<II", _INDEX_MAGIC, len(packed)) + packed)
        self.table.append((len(packed) + 8, 0, 0))
        rows = b"".join(struct.pack("<III", *row) for row in self.table)
        footer = struct.pack("<IBI", len(self.table), _CHECKSUMS, _FOOTER_MAGIC)
        self.out.write(struct.pack("<II", _SEEK_MAGIC, len(rows) + len(footer)) + rows + footer)


class FrameFile:
    """Random access to the documents of one file."""

    def __init__(self, path: str):
        system, name = _filesystem(path)
        self.file, self.unpacker = system.open_input_file(name), zstandard.ZstdDecompressor()
        size = self.file.size()
        frames, _, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != _FOOTER_MAGIC:
            raise ValueError(f"{path} has no seek table")
        table = np.frombuffer(self._read(size - 9 - 12 * frames, 12 * frames), dtype="<u4").reshape(-1, 3)
        ends = np.cumsum(table[:, 0], dtype=np.int64)
        self.table, self.offsets = table[:-1], ends - table[:, 0]
        raw = self.unpacker.decompress(self._read(int(self.offsets[-1]) + 8, int(table[-1, 0]) - 8))
        (n,) = struct.unpack_from("<Q", raw)
        at = 8 + n
        self.valid = np.frombuffer(raw, dtype=np.uint8, count=n, offset=8).astype(bool)
        self.keys = np.frombuffer(raw, dtype="<i8", count=n, offset=at)
        self.lengths = np.frombuffer(raw, dtype="<i8", count=n, offset=at + 8 * n)
        self.frames = np.frombuffer(raw, dtype="<u4", count=n, offset=at + 16 * n)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def frame(self, k: int) -> np.ndarray:
        packed, size, check = (int(x) for x in self.table[k])
        raw = self.unpacker.decompress(self._read(int(self.offsets[k]), packed), max_output_size=size)
        if len(raw) != size or _check(raw) != check:
            raise ValueError(f"frame {k} does not match its checksum")
        return np.frombuffer(raw, dtype="<u4")

    def documents(self, first: int, last: int):
        """(row in file, ids) of every document in the frames ``first`` to ``last`` - 1."""
        low, high = np.searchsorted(self.frames, [first, last])
        frame, ids, base = -1, None, 0
        for row in range(int(low), int(high)):
            if self.frames[row] != frame:
                frame, base = int(self.frames[row]), int(self.starts[row])
                ids = self.frame(frame)
            at = int(self.starts[row]) - base
            yield row, ids[at : at + int(self.lengths[row])]

    def find(self, key: int | None) -> list[np.ndarray]:
        """Ids of the documents with this key; only their frames are read."""
        if key is None:
            rows = np.flatnonzero(~self.valid)
        else:
            low = int((~self.valid).sum())  # null keys stand first
            a, b = np.searchsorted(self.keys[low:], [key, key + 1])
            rows = np.arange(low + a, low + b)
        wanted = set(rows.tolist())
        out = []
        for k in np.unique(self.frames[rows]).tolist():
            out += [ids for row, ids in self.documents(k, k + 1) if row in wanted]
        return out

    def close(self) -> None:
        self.file.close()


def write(docs: DataFrame, path: str, tokenizer: TokenizerFile, key: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """Write the corpus to ``path`` in ascending ``key``; returns the manifest, one row per file.

    ``key`` is a long. Null keys come first; a null or empty text is the end id alone;
    rows of one key follow the hash of their text. An empty table writes no file.
    """

    def run(batches):
        encoder, writer, out, name = shared_encoder(tokenizer), None, None, None
        end = np.array([end_id], dtype=np.uint32)
        for part, texts in text_slices(batches, "__text"):
            if writer is None:
                name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.zst"
                system, root = _filesystem(path)
                system.create_dir(root, recursive=True)
                out = system.open_output_stream(f"{root.rstrip('/')}/{name}", compression=None)
                writer = FrameWriter(out)
            flat, counts = encoder.encode(texts)
            stops = np.cumsum(counts)
            for k, stop, n in zip(part.column(0).to_pylist(), stops.tolist(), counts.tolist()):
                writer.add(k, np.concatenate([flat[stop - n : stop], end]))
        if writer is not None:
            writer.close()
            out.close()
            row = (TaskContext.get().partitionId(), name, len(writer.keys), writer.tokens, len(writer.table) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()))],
                names=["part", "file", "docs", "tokens", "frames"],
            )

    rows = docs.select(F.col(key).cast("bigint").alias("__key"), F.col(text).alias("__text"))
    # The text's hash parts the rows of one key, which may be most rows.
    order = [F.col("__key"), F.xxhash64("__text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    files = ordered.mapInArrow(run, "part int, file string, docs bigint, tokens bigint, frames int")
    return stored(files, "manifest")


def read(spark: SparkSession, path: str, manifest: DataFrame, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """``key``, start, n_tokens, ids_crc32 (and ids) of every document, from the files.

    ``start`` counts the ids of all documents before, over the files in order. A task
    reads a bounded number of frames.
    """
    # One row per file here, not per document.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))
    steps = F.sequence(F.lit(0), F.col("frames") - 1, F.lit(FRAMES_PER_TASK))
    tasks = based.select("file", "base", "frames", F.explode(steps).alias("first"))
    # As many partitions as reading tasks: a number of its own is not merged, small as the rows are.
    number = manifest.agg(F.sum(F.ceil(F.col("frames") / FRAMES_PER_TASK))).first()[0] or 1
    tasks = tasks.repartition(int(number), "file", "first")

    def run(batches):
        for batch in batches:
            for task in batch.to_pylist():
                file = FrameFile(f"{path.rstrip('/')}/{task['file']}")
                last = min(task["first"] + FRAMES_PER_TASK, task["frames"])
                columns = [[], [], [], [], []]
                for row, ids in file.documents(task["first"], last):
                    value = (
                        int(file.keys[row]) if file.valid[row] else None,
                        task["base"] + int(file.starts[row]),
                        len(ids),
                        zlib.crc32(ids.tobytes()),
                        ids.astype(np.int32) if with_ids else None,
                    )
                    for column, v in zip(columns, value):
                        column.append(v)
                file.close()
                arrays = [pa.array(c, pa.int64()) for c in columns[:4]]
                names = [key, "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(columns[4], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return tasks.mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: TokenizerFile, key: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """Write to a fresh folder below the shared one and read the files back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    return read(spark, path, write(docs, path, tokenizer, key, text, end_id), key)
