"""Phrase collocations against a brute-force count, on odd rows and with hot pairs."""

import random
import re
from collections import Counter

import pytest

from loomwork.llm import collocations
from tests.llm.helpers import frame, odd_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_count, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            totals[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    counts[lang, words[i : i + n]] += 1
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= min_count}
    out = {}
    for (lang, words), a in candidates.items():
        inside = False
        for (other, longer), b in candidates.items():
            n = len(words)
            if other == lang and len(longer) > n and 100 * b >= 80 * a:
                inside = inside or any(longer[i : i + n] == words for i in range(len(longer) - n + 1))
        if inside:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((2000000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, right, totals[lang], -s)
        for lang, found in out.items()
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])
    )


def mined(docs, **options):
    return sorted(tuple(r) for r in collocations.collocations(docs, **options).collect())


def made_up(count, seed):
    """Texts with common pairs, code-like words, odd blanks and marks, of skewed words."""
    rng = random.Random(seed)
    words = ["new", "york", "City", "a", "of", "the", "ࠀ", "ࠁx", "中", "日本", "x y", "\x00", "\x0bz"]
    words += [f"w{i}" for i in range(40)]
    rows = []
    for i in range(count):
        picked = [words[min(int(rng.expovariate(0.15)), len(words) - 1)] for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for w in picked)
        rows.append((rng.choice(["en", "en", "en", "de", None]), text if rng.random() > 0.02 else None))
    return rows


@pytest.mark.parametrize("min_count", [2, 8])
def test_against_brute_force(spark, min_count):
    rows = made_up(300, 5)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert mined(docs, min_count=min_count) == brute(rows, min_count)


def test_hot_pairs_are_dealt_by_the_whole_window(spark):
    rows = made_up(80, 1) + [("en", f"hot pair of{i % 9} x{i % 7} hot pair") for i in range(900)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    narrow = docs.select("lang", docs["text"].alias("__text"))
    assert ("en", "hot", "pair") in collocations._seen_in_sample(narrow.na.fill("und", ["lang"]), 1.0, 8)[1]
    assert mined(docs, min_count=10) == brute(rows, 10)


def test_odd_rows_and_limits(spark):
    rows = [(lang, text) for _, text, lang, *_ in odd_rows()]
    assert mined(frame(spark), min_count=2) == brute(rows, 2)
    assert mined(frame(spark), min_count=2, top=3) == brute(rows, 2, 3)
    assert mined(frame(spark, [])) == []
