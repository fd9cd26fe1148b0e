"""Small helpers for Arrow batches of texts inside tasks.

A batch is worked through in slices of bounded text size, so a task's memory
follows the slice (or the one longest text) and not the batch or the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20


def text_slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """(rows, their texts with null as empty) with at most ``limit`` bytes of text, one row at least."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            part = batch.slice(start, stop - start)
            yield part, pc.fill_null(part.column(at), "")
            start = stop


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices of the given ranges, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int32)
    small = np.int32 if total < 1 << 31 and int(starts.max()) < 1 << 31 else np.int64
    ends = np.cumsum(lengths)
    out = np.repeat((starts - (ends - lengths)).astype(small), lengths)
    out += np.arange(total, dtype=small)
    return out


def split_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words of lower-cased (A-Z) texts, cut at blank and \\x09-\\x0D.

    Returns (code of each word, the distinct words, number of words per text).
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.flatten()
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)
    if empty.any():  # leading and trailing blanks
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = counts - np.bincount(owner[empty], minlength=len(counts))
        flat = flat.filter(pa.array(~empty))
    encoded = flat.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes, encoded.dictionary.to_pylist(), counts
