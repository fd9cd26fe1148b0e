"""The conversation trie against brute force; parentheses against a stack."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from loomwork.llm import prefixtrie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, node string, bytes int"


def brute(rows, members=()):
    """Rows (conv, turn, role, text); content order settles equal turns."""
    talks = {c: [] for c in members}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            order = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            talks.setdefault(c, []).append(((turn is not None, turn or 0), order, role, text))
    paths = {c: tuple((r, t) for _, _, r, t in sorted(said)) for c, said in talks.items()}
    nodes = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
    saves = {p: (len(m) - 1) * len(p[-1][1].encode()) if p else 0 for p, m in nodes.items()}
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    for p in nodes:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += saves[p]
    out = []
    for p, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(m) if paths[c] == p)
        above = min(nodes[p[:-1]]) if p else None
        out.append((min(m), len(p), above, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows, members=None):
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    known = None if members is None else spark.createDataFrame([(c,) for c in members], "conv bigint")
    return sorted((tuple(r) for r in prefixtrie.prefix_trie(prefixtrie.turn_keys(table), known).collect()), key=str)


def made_up(seed, count=120):
    rng = random.Random(seed)
    rows = []
    for c in range(count):
        said = ["hi", "hi", "héllo", "", None][: rng.randrange(1, 6)] if c % 3 else ["hi", "yes", "no"]
        for turn in range(rng.randrange(1, 9)):
            rows.append((c * 7 - 50, turn, rng.choice(["user", "user", "assistant", None]), rng.choice(said)))
    return rows


def test_against_brute_force(spark):
    rows = made_up(1)
    assert trie(spark, rows) == brute(rows)


def test_small_shards_and_bands(spark, monkeypatch):
    """Spines shared by many shards, paths cut into bands, digests in blocks."""
    monkeypatch.setattr(prefixtrie, "BAND", 3)
    monkeypatch.setattr(prefixtrie, "SHARD_NODES", 5)
    monkeypatch.setattr(prefixtrie, "DIGEST_IDS", 16)
    rows = made_up(2) + [(c, t, "user", "same") for c in range(2000, 2090) for t in range(11)]
    rows += [(9000, t, "user", "same" if t < 40 else f"x{t}") for t in range(60)]
    assert trie(spark, rows) == brute(rows)


def test_nulls_ties_and_empty(spark):
    rows = [
        (1, None, "user", "first"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", None), (None, 0, "user", "lost"),
        (2, None, "user", "first"), (2, 5, "user", "a"), (3, 1, None, None), (4, 1, "", ""), (-5, 2, "user", "b" * 5000),
    ]
    assert trie(spark, rows) == brute(rows)
    assert trie(spark, rows, [1, 2, 3, 4, -5, 77, 78]) == brute(rows, [1, 2, 3, 4, -5, 77, 78])
    assert trie(spark, []) == []
    assert trie(spark, [], [4, 9]) == brute([], [4, 9])


@pytest.mark.parametrize("size", [1, 3, 70, 700, 5000])
def test_find_close(size):
    rng = random.Random(size)
    bits, depth = [1], 1
    while len(bits) < 2 * size - 1 and depth:
        up = depth == 1 or (rng.random() < 0.5 + 0.3 * (len(bits) % 600 < 300) and len(bits) + depth < 2 * size - 1)
        bits.append(1 if up and len(bits) + depth < 2 * size - 1 else 0)
        depth += 1 if bits[-1] else -1
    bits += [0] * depth
    stack, close = [], {}
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            close[stack.pop()] = i
    tree = prefixtrie.Parentheses(np.array(bits, dtype=np.int8))
    opens = np.array(sorted(close))
    assert tree.find_close(opens).tolist() == [close[i] for i in opens.tolist()]
