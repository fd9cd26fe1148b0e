import random

import numpy as np
import pyarrow as pa
import pytest

from loomwork.llm import decontaminate as dc
from tests.llm.helpers import frame, odd_rows


def plain_distance(item, window):
    """Least edits between ``item`` and any prefix of ``window``."""
    row = list(range(len(window) + 1))
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(window, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edit_distances():
    rng = np.random.default_rng(0)
    items, windows = rng.integers(0, 4, (200, 9)), rng.integers(-1, 4, (200, 12))
    got = dc.edit_distances(items, windows)
    assert got.tolist() == [plain_distance(a.tolist(), b.tolist()) for a, b in zip(items, windows)]


def words(rng, n, vocabulary=400):
    return [f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n)]


def edited(rng, passage, k):
    out = list(passage)
    for _ in range(k):
        at = rng.randrange(len(out))
        kind = rng.choice("sid")
        if kind == "s":
            out[at] = "zz"
        elif kind == "i":
            out.insert(at, "yy")
        else:
            out.pop(at)
    return out


def test_recall_and_exactness():
    rng = random.Random(7)
    passages = [words(rng, rng.randint(8, 50)) for _ in range(60)]
    index = dc.ItemIndex(list(range(60)), [" ".join(p) for p in passages])
    texts, planted = [], []
    for rate in (0.0, 0.1, 0.2):
        for i, p in enumerate(passages):
            inner = edited(rng, p, int(rate * len(p)))
            text = words(rng, 40) + inner + words(rng, 40)
            planted.append((len(texts), i))
            texts.append(text)
    texts += [words(rng, 120) for _ in range(100)]
    row, item, first, edits = index.find(pa.array([" ".join(t) for t in texts]))
    got = {(r, index.keys[i][0]): (f, e) for r, i, f, e in zip(row.tolist(), item.tolist(), first.tolist(), edits.tolist())}
    assert sum(p in got for p in planted) >= 0.95 * len(planted)
    for (r, i), (f, e) in got.items():
        p = passages[i]
        k = int(dc.RATIO * len(p))
        assert e <= k and e == plain_distance(p, texts[r][f : f + len(p) + k])
    # Nothing beyond the planted pairs but what really is that close.
    close = {
        (r, i)
        for r, t in enumerate(texts)
        for i, p in enumerate(passages)
        if min(plain_distance(p, t[s : s + len(p) + int(dc.RATIO * len(p))]) for s in range(0, len(t))) <= int(dc.RATIO * len(p))
    } if len(texts) < 50 else set(got)
    assert set(got) <= close


def test_the_count_filter_loses_nothing():
    rng = random.Random(8)
    for _ in range(300):
        p = words(rng, rng.randint(8, 30), 30)
        k = int(dc.RATIO * len(p))
        window = edited(rng, p, k)
        runs = {tuple(p[i : i + 3]) for i in range(len(p) - 2)}
        assert sum(tuple(window[i : i + 3]) in runs for i in range(len(window) - 2)) >= len(p) - 2 - 3 * k


def bound_edits(rng, passage, kind):
    """``passage`` with as many edits of one kind as the bound allows; new words are foreign."""
    out, n, k = list(passage), len(passage), int(dc.RATIO * len(passage))
    new = [f"x{rng.randrange(9999)}" for _ in range(k)]
    if kind == "first words replaced":
        return new + out[k:]
    if kind == "first words dropped":
        return out[k:]
    if kind == "last words replaced":
        return out[: n - k] + new
    if kind == "last words dropped":
        return out[: n - k]
    if kind == "middle replaced":
        return out[: (n - k) // 2] + new + out[(n - k) // 2 + k :]
    if kind == "middle dropped":
        return out[: (n - k) // 2] + out[(n - k) // 2 + k :]
    if kind == "words put into the middle":
        return out[: n // 2] + new + out[n // 2 :]
    if kind == "substitutions":
        for at, word in zip(rng.sample(range(n), k), new):
            out[at] = word
        return out
    if kind == "deletions":
        lost = set(rng.sample(range(n), k))
        return [w for i, w in enumerate(out) if i not in lost]
    if kind == "insertions":
        for word in new:
            out.insert(rng.randrange(len(out) + 1), word)
        return out
    if kind == "mixed":
        return edited(rng, out, k)
    raise ValueError(kind)


def share_found(kind):
    rng = random.Random(11)
    passages = [words(rng, rng.randint(15, 59), 4000) for _ in range(200)]
    index = dc.ItemIndex(list(range(200)), [" ".join(p) for p in passages])
    around = lambda n: [f"x{rng.randrange(9999)}" for _ in range(n)]
    texts = [around(40) + bound_edits(rng, p, kind) + around(60) for p in passages]
    row, item, _, _ = index.find(pa.array([" ".join(t) for t in texts]))
    return sum(r == index.keys[i][0] for r, i in zip(row.tolist(), item.tolist())) / 200


KINDS = ["first words replaced", "first words dropped", "last words replaced", "last words dropped", "middle replaced"]
KINDS += ["middle dropped", "words put into the middle", "substitutions", "deletions", "insertions", "mixed"]


@pytest.mark.parametrize("kind", KINDS)
def test_recall_at_the_bound(kind):
    assert share_found(kind) >= 0.95


def test_windows_set_aside_are_too_far():
    rng = random.Random(12)
    head = words(rng, 4)
    passages = [head + words(rng, rng.randint(4, 26), 60) for _ in range(80)]
    for ratio in (0.1, 0.2, 0.3):
        index = dc.ItemIndex(list(range(80)), [" ".join(p) for p in passages], ratio=ratio)
        texts = [words(rng, 9) + edited(rng, p, int(ratio * len(p))) + words(rng, 9) for p in passages]
        codes, vocabulary, counts = dc.word_symbols(pa.array([" ".join(t) for t in texts]))
        symbols = dc.pc.fill_null(dc.pc.index_in(vocabulary, index.words), -1).to_numpy().astype(np.int32)[codes]
        stop = np.cumsum(counts)
        left = set()
        for length, *postings in index.runs:
            for item, start in index._windows(length, postings, symbols, stop - counts, stop):
                left |= set(zip(start.tolist(), item.tolist()))
        for t, (text, begin) in enumerate(zip(texts, (stop - counts).tolist())):
            p = passages[t]
            k = int(ratio * len(p))
            # A window that starts with a foreign word is as close from its next word on.
            for s in range(len(text)):
                if text[s] in p[: k + 1] and plain_distance(p, text[s : s + len(p) + k]) <= k:
                    assert (begin + s, t) in left


PASSAGE = "nine grey geese watch the quick brown fox jump over some lazy dog"


def test_odd_rows(spark):
    docs = frame(spark, odd_rows() + [(50, f"before, {PASSAGE.upper()}! after", "en", "a", 1, "c", "c", 1)] * 2)
    items = spark.createDataFrame(
        [(1, PASSAGE), (2, PASSAGE), (3, "too short"), (4, None), (5, ""), (None, PASSAGE.replace(" ", "\n"))],
        "item_id bigint, text string",
    )
    got = dc.leaks(docs, items).collect()
    assert sorted(((r.doc_id, r.item_id, r.first_word, r.edits) for r in got), key=repr) == sorted(
        [(50, i, 1, 0) for i in (1, 2, None)] * 2, key=repr
    )
    kept = dc.without_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(odd_rows())
    assert dc.leaks(docs, items.limit(0)).count() == 0
    assert dc.without_leaks(docs, items.limit(0)).count() == docs.count()
    assert dc.leaks(frame(spark, []), items).count() == 0
    # Item blocks of any size give the same rows.
    blocks = list(dc.item_blocks(items, "item_id", "text", limit=60))
    assert len(blocks) > 1


def test_recall_statement():
    assert dc.recall(1.0) == 1.0 and dc.recall(0.0) == 0.0 and dc.recall(0.6) > 0.95


def test_short_and_unspaced_items_match_word_for_word(spark):
    """Items under eight words, of one word and of a script without spaces are found where they stand."""
    items = [(1, "seven plain words make this one item"), (2, "北京的秋天很美丽我们去看红叶"), (3, "xylograph"), (4, None), (5, "..."), (6, "สวัสดีครับ")]
    texts = [
        (1, "Before it, Seven plain words make this one item! and after"), (2, "他说：北京的秋天很美丽，我们去看红叶。好"), (3, "a xylograph here"),
        (4, "seven plain words make no item"), (5, "北京的秋天"), (6, None), (7, "พูดว่าสวัสดีครับแล้ว"), (8, "..."),
    ]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id, r.edits) for r in dc.leaks(docs, bench).collect()}
    assert found == {(1, 1, 0), (2, 2, 0), (3, 3, 0), (7, 6, 0)}
    assert {r.doc_id for r in dc.without_leaks(docs, bench).collect()} == {4, 5, 6, 8}


def test_workers_need_no_copy_of_the_package(tmp_path):
    """What travels to a worker loads in a process that cannot import the package."""
    import subprocess
    import sys

    import loomwork  # noqa: F401  (registers pickling by value)
    from pyspark import cloudpickle

    index = dc.ItemIndex([1], ["one two three four five six seven eight nine ten"])
    (tmp_path / "index").write_bytes(cloudpickle.dumps((index, dc.ItemIndex.find)))
    code = """
import pickle, sys
import pyarrow as pa
try:
    import loomwork
    raise SystemExit("the package can be imported")
except ImportError:
    pass
index, find = pickle.load(open(sys.argv[1], "rb"))
print(len(find(index, pa.array(["zero one two three four five six seven eight nine ten"]))[0]))
"""
    ran = subprocess.run([sys.executable, "-c", code, str(tmp_path / "index")], capture_output=True, text=True, cwd=tmp_path, env={"PATH": "/usr/bin"})
    assert ran.stdout.strip() == "1", ran.stderr
