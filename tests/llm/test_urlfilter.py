import random
import re

from loomwork.llm import urlfilter


def as_regex(glob):
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
            i += 1
    return re.compile(out, re.S)


def test_automaton_agrees_with_regex():
    rng = random.Random(1)
    globs = ["".join(rng.choice("ab/.*?") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    globs = [g.replace("***", "**") for g in globs] + ["**", "", "*", "a**b", "a" * 70 + "*"]
    texts = ["".join(rng.choice("ab/.é") for _ in range(rng.randint(0, 12))) for _ in range(200)] + ["", "a" * 75]
    # '?' is one byte: leave other letters to the byte-wise patterns only.
    globs = [g for g in globs if "?" not in g] + ["a?b", "?/a"]
    got = urlfilter.GlobAutomaton([urlfilter._symbols(g) for g in globs]).matches(texts)
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            if "?" in g and not t.isascii():
                continue
            assert got[i, j] == bool(as_regex(g).fullmatch(t)), (t, g)


RULES = [
    urlfilter.Rule("block", "net", "/"),
    urlfilter.Rule("allow", "example.net", "/en/"),
    urlfilter.Rule("block", "a.org", ""),
]


def test_rules(spark):
    rows = [
        (1, "http://X.NET/", "net/", "block"),
        (2, "https://m.example.net/en/1?x#y", "example.net/en/", "allow"),
        (3, "https://example.net/de/", "net/", "block"),
        (4, "http://badnet/", None, "allow"),
        (5, "http://net", None, "allow"),
        (6, None, None, "allow"),
        (7, "no scheme", None, "allow"),
        (8, "http://a.org", "a.org", "block"),
        (9, "http://b.a.org/x", "a.org", "block"),
        (10, "http://spam-farm.com/x", None, "block"),
        (11, "http://ok.com/spam", None, "allow"),
        (None, "", None, "allow"),
        (12, "http://evil.com/x.net/", None, "allow"),
        (12, "x://a://b/c", None, "allow"),
    ]
    frame = spark.createDataFrame([(i, u, "clash") for i, u, *_ in rows], "page_id bigint, url string, host string")
    got = urlfilter.judge(frame, ["page_id"], "url", RULES)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(((r.page_id, r.rule, r.verdict) for r in got.collect()), key=repr) == sorted(
        ((i, r, v) for i, _, r, v in rows), key=repr
    )
    assert urlfilter.judge(frame.limit(0), ["page_id"], "url", RULES).count() == 0
    assert [r.host for r in got.filter("page_id = 2").collect()] == ["m.example.net"]
