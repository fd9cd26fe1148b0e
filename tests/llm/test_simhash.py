import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomwork.llm import components, simhash
from tests.llm.helpers import frame, odd_rows


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(keys, prints, radius=3):
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(keys))]


def expected(rows):
    prints = [plain_fingerprint(r[1]) for r in rows]
    root = groups([r[0] for r in rows], prints)
    least = {}
    for r, g in zip(rows, root):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return sorted(((r[0], p, least.get(g)) for r, p, g in zip(rows, prints, root)), key=repr)


def test_odd_rows(spark):
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(frame(spark)).collect()]
    assert sorted(got, key=repr) == expected(odd_rows())


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.first_of_each(frame(spark, [])).count() == 0


def test_one_row_of_each_group_stays(spark):
    kept = simhash.first_of_each(frame(spark))
    assert kept.columns == frame(spark).columns
    rows = odd_rows()
    want = {(c if c is not None else None) for _, _, c in expected(rows)}
    got = [r.doc_id for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_planes_agree_with_popcount(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 64, 4, dtype=np.uint64)
    values = base[rng.integers(0, 4, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (
        np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
    )
    planes = simhash.planes_of(values)
    for d in (1, 7, 63, 64, 65, 130):
        got = simhash.within_radius(planes, d, len(values) - d, radius)
        want = np.flatnonzero(np.bitwise_count(values[:-d] ^ values[d:]) <= radius)
        assert got.tolist() == want.tolist()


@pytest.mark.parametrize("tile", [8, 4096])
def test_links_span_the_groups(spark, tile):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(100)}
    for v in list(values)[:20]:
        for _ in range(12):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    values = sorted(values)
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint")
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(nodes, tile=tile).collect()]
    # An edge joins two members of one group; their chain of links may be longer.
    place = {v: i for i, v in enumerate(values)}
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        i, j = find(place[a]), find(place[b])
        parent[max(i, j)] = min(i, j)
    assert [find(i) for i in range(len(values))] == groups(values, values)


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 300: 300, 301: 300}
    empty = spark.createDataFrame([], "a bigint, b bigint")
    assert components.connected_components(empty).count() == 0


def test_hex(spark):
    row = spark.createDataFrame([(-1,), (0,), (255,)], "fp bigint").select(simhash.hex_of("fp").alias("h")).orderBy(F.col("h"))
    assert [r.h for r in row.collect()] == ["0" * 16, "0" * 14 + "ff", "f" * 16]
