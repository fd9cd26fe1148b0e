"""Memory of a task that counts windows."""

import random
import tracemalloc

import pyarrow as pa

from loomwork.llm import collocations


def test_nothing_of_a_slice_is_left_beside_its_blocks():
    draw = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(draw.choices(words, k=200)) for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "__text"])
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        blocks = collocations._window_blocks(words[:50], set(), 8)(iter([batch]))
        made = next(blocks)
        left = pa.total_allocated_bytes() - before + tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert left < 1.5 * made.nbytes
