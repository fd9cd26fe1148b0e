"""SimHash near-duplicates with bit-sliced comparison.

1. ``fingerprints``: words, 3-word shingles, XXH64, one majority bit per position.
2. Distinct fingerprints are dealt into buckets: 64 bits are cut into ``blocks``
   parts, and two fingerprints at ``radius`` or fewer differing bits agree in some
   ``blocks - radius`` of them, so every such choice of parts is one bucket key. No
   link is lost. A bucket above ``TILE`` members is cut into tiles, and each pair of
   tiles is one task's work, so no task holds an unbounded bucket.
3. In a task all fingerprints of many buckets stand vertically: plane ``k`` holds
   bit ``k`` of every fingerprint, 64 to a word. One pass compares each fingerprint
   with the one ``d`` places on: planes are XORed with their shifted selves and
   added into carry-save counters (ones, twos, fours), and word blocks in which all
   lanes have passed the radius are abandoned.
4. Of a bucket's links only a spanning forest leaves the task, as long as the
   members and not the pairs; ``components`` then joins the forests.

Copies share a fingerprint, so a group of any size is one node from step 2 on.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from loomwork.llm.arrowtext import ranges
from loomwork.llm.components import connected_components
from loomwork.session import stored

SHINGLE = 3
RADIUS = 3
BLOCKS = 5
TILE = 4096
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash; zero where the text has no word."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    votes = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, len(starts), _CHUNK):
        spans = zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])
        raw = np.frombuffer(b"".join([digest(joined[s:e], 42) for s, e in spans]), dtype=np.uint8)
        votes += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, keys: Sequence[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``keys`` and ``fp``, the fingerprint as a signed long."""
    schema = docs.select(*keys).schema.add("fp", "long")

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            values = [fingerprint(t.as_py(), shingle) for t in batch.column(at)]
            fp = np.array(values, dtype=np.uint64).view(np.int64)
            kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fp)], names=[*keys, "fp"])

    # The text goes under a name of its own, so that it may also be a key.
    return docs.select(*keys, F.col(text).alias("__text")).mapInArrow(run, schema)


def hex_of(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def _bucket_keys(fp: Column, blocks: int, radius: int) -> Column:
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    keys = []
    for n, chosen in enumerate(combinations(masks, blocks - radius)):
        mask = sum(chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        # A hash collision only brings two buckets together; distances are exact.
        keys.append(F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(signed).cast("bigint"))))
    return F.array(*keys)


def planes_of(values: np.ndarray) -> np.ndarray:
    """(64, words): row k packs bit k of every value, 64 values to a little-endian word."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = -(-len(values) // 64) * 64
    padded = np.zeros((64, lanes), dtype=np.uint8)
    padded[:, : len(values)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def _shifted(plane: np.ndarray, distance: int, words: int) -> np.ndarray:
    """Lane i of the result is lane ``i + distance``; zero beyond the end."""
    skip, bit = divmod(distance, 64)
    here = np.zeros(words, dtype=np.uint64)
    part = plane[skip : skip + words]
    here[: len(part)] = part
    if bit:
        here >>= np.uint64(bit)
        part = plane[skip + 1 : skip + 1 + words]
        here[: len(part)] |= part << np.uint64(64 - bit)
    return here


def within_radius(planes: np.ndarray, distance: int, lanes: int, radius: int) -> np.ndarray:
    """Lanes below ``lanes`` whose value is within ``radius`` (at most 3) of the one ``distance`` on."""
    words = -(-lanes // 64)
    live = np.arange(words)
    ones = np.zeros(words, dtype=np.uint64)
    twos, over = ones.copy(), ones.copy()
    for k in range(64):
        whole = _shifted(planes[k], distance, words) ^ planes[k, :words]
        carry = whole[live]
        ones, carry = ones ^ carry, ones & carry
        twos, carry = twos ^ carry, twos & carry
        over |= carry
        if k % 8 == 7:
            past = over if radius == 3 else over | (twos if radius == 1 else twos & ones if radius == 2 else ones | twos)
            open_ = past != np.uint64(0xFFFFFFFFFFFFFFFF)
            if not open_.any():
                return np.zeros(0, dtype=np.int64)
            if not open_.all():
                live, ones, twos, over = live[open_], ones[open_], twos[open_], over[open_]
    past = over if radius == 3 else over | (twos if radius == 1 else twos & ones if radius == 2 else ones | twos)
    hits = np.unpackbits((~past).view(np.uint8), bitorder="little").reshape(-1, 64)
    word, bit = np.nonzero(hits)
    found = live[word] * 64 + bit
    return found[found < lanes]


def forest(values: np.ndarray, sizes: np.ndarray, sides: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links inside each bucket.

    ``values`` holds the buckets one after another, the largest first, as ``sizes``
    says. ``sides`` marks the two tiles of a split bucket; links inside one side are
    the work of another task.
    """
    planes = planes_of(values)
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    root = np.arange(len(values))
    reach = np.cumsum(sizes)
    left, right = [], []
    for d in range(1, int(sizes[0]) if len(sizes) else 0):
        lanes = int(reach[np.searchsorted(-sizes, -d, side="left") - 1])  # buckets of more than d members
        i = within_radius(planes, d, lanes, radius)
        i = i[i + d < len(values)]
        i = i[bucket[i] == bucket[i + d]]
        if sides is not None:
            i = i[sides[i] | sides[i + d] == 3]
        i = i[root[i] != root[i + d]]
        if not len(i):
            continue
        for a in i.tolist():
            b = a + d
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                left.append(max(a, b))
                right.append(min(a, b))
        while True:  # flatten, so that equal roots are seen at once
            nearer = root[root]
            if (nearer == root).all():
                break
            root = nearer
    return values[np.array(left, dtype=np.int64)], values[np.array(right, dtype=np.int64)]


def _bucket_links(radius: int, rows_at_once: int = 1 << 16):
    """Task function: rows (bucket, part, side, fp) sorted by bucket and part to edges (a, b)."""

    def solve(bucket, side, fp):
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        sizes = np.diff(np.concatenate([edge, [len(fp)]]))
        many = np.flatnonzero(sizes > 1)
        many = many[np.argsort(-sizes[many], kind="stable")]
        if not len(many):
            return None
        rows = ranges(edge[many], sizes[many])
        return forest(fp[rows].view(np.uint64), sizes[many], side[rows], radius)

    def run(batches):
        held = None
        for batch in batches:
            part = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            held = part if held is None else tuple(np.concatenate(p) for p in zip(held, part))
            if len(held[0]) < rows_at_once:
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last bucket may go on
            if cut:
                found = solve(*(h[:cut] for h in held))
                held = tuple(h[cut:] for h in held)
                if found is not None:
                    yield _edges(*found)
        if held is not None and len(held[0]):
            found = solve(*held)
            if found is not None:
                yield _edges(*found)

    def _edges(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between distinct ``fp`` that span every group linked at ``radius`` bits."""
    if not 0 <= radius <= 3 or blocks <= radius:
        raise ValueError("radius is 0 to 3, below the number of blocks")
    keyed = nodes.select(F.explode(_bucket_keys(F.col("fp"), blocks, radius)).alias("bucket"), "fp")
    large = keyed.groupBy("bucket").count().filter(F.col("count") > tile)
    large = stored(large.select("bucket", F.ceil(F.col("count") / F.lit(tile / 2)).cast("int").alias("tiles")), "large")
    plain = keyed.select("bucket", F.lit(3).cast("int").alias("side"), "fp")
    if large.isEmpty():
        dealt = plain
    else:
        # Row r of a split bucket stands in tile t(r) and meets every tile in one task each.
        rows = keyed.join(large, "bucket").withColumn("t", F.expr("pmod(xxhash64(fp, 7), tiles)").cast("int"))
        met = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        split = met.select(
            F.xxhash64("bucket", F.least("t", "o"), F.greatest("t", "o")).alias("bucket"),
            F.expr("case when t = o then 3 when t < o then 1 else 2 end").cast("int").alias("side"),
            "fp",
        )
        dealt = plain.join(large.select("bucket"), "bucket", "left_anti").unionAll(split)
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(_bucket_links(radius), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
) -> DataFrame:
    """One row per document: ``key``, ``fp`` and ``component_id``.

    ``component_id`` is the smallest key reachable over links of ``radius`` or fewer
    differing bits. A null or wordless text has fingerprint zero and is linked like
    any other. Null keys are kept: they take the smallest key of their component, null
    where it has none. Repeated rows stay, each with the same result; an empty table
    gives an empty one. Other columns are not carried, so their names cannot clash.
    """
    prints = stored(fingerprints(docs, [key], text, shingle), "prints")
    nodes = stored(prints.groupBy("fp").agg(F.min(key).alias("__least")), "nodes")
    roots = stored(connected_components(links(nodes, radius)), "roots")
    by_root = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = by_root.groupBy("root").agg(F.min("__least").alias("component_id"))
    ids = by_root.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(ids, "fp").select(key, "fp", "component_id")


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs``, all columns, with one row per near-duplicate group: that of the smallest key.

    Rows that share this key and fingerprint are one row in the result, the one of the
    smallest text, then of the other columns. In a group without any key a null key
    stays. Texts are joined with the decisions on (fingerprint, key), so that a group
    that holds a third of all rows is spread over the tasks; repeated rows are reduced
    before they are shuffled.
    """
    columns = docs.columns
    schema = docs.select(*columns).schema.add("__fp", "long")

    def run(batches):
        for batch in batches:
            values = [fingerprint(t.as_py()) for t in batch.column(columns.index(text))]
            fp = pa.array(np.array(values, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, fp], names=[*columns, "__fp"])

    narrow = stored(fingerprints(docs, [key], text), "prints")
    times = narrow.groupBy("fp", key).agg(F.count("*").alias("__times"))
    nodes = stored(times.groupBy("fp").agg(F.min(F.struct(F.col(key).isNull(), F.col(key), "__times")).alias("first")), "nodes")
    roots = stored(connected_components(links(nodes, radius)), "roots")
    grouped = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("first.col1"), F.col(f"first.{key}"), "fp", "first.__times")).alias("b"))
    stays = best.select(F.col("b.fp").alias("__at"), F.col(f"b.{key}").alias("__least"), F.col("b.__times").alias("__times"))
    printed = docs.mapInArrow(run, schema)
    kept = printed.join(stays, (F.col("__fp") == F.col("__at")) & F.col(key).eqNullSafe(F.col("__least")))
    others = [c for c in columns if c not in (key, text)]
    order = F.struct(text, F.to_json(F.struct(*others))) if others else F.struct(text)
    repeated = kept.filter("__times > 1").groupBy("__fp", key).agg(F.min_by(F.struct(*columns), order).alias("__r"))
    return kept.filter("__times = 1").select(*columns).unionAll(repeated.select("__r.*"))
