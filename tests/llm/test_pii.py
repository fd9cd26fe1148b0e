import hashlib
import random
import re
from collections import Counter

from loomwork.llm import pii
from tests.llm.helpers import frame, odd_rows

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(number):
    total = 0
    for i, c in enumerate(number[::-1]):
        n = int(c) * (2 if i % 2 else 1)
        total += n // 10 + n % 10
    return total % 10 == 0


def plain(text):
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [
        (m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))
    ]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(found)


def test_base_spans_agree_with_the_patterns():
    rng = random.Random(2)
    parts = list("a.@-_%+ é1205\n()") + ["4111 1111 1111 1111", "+1 (555) 010-9999", "a@b.c", "1.2.3.4", "255", "@@", ".."]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_cost_no_more_than_their_length():
    for text in ("a" * 300_000, "1" * 300_000, "@" + "a" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000):
        pii.base_spans(text)


def test_odd_rows(spark):
    got = pii.detect(frame(spark)).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((r[0] for r in odd_rows()), key=repr)
    texts = {r[0]: r[1] or "" for r in odd_rows()}
    for r in got:
        if r.doc_id is None:
            continue
        spans = plain(texts[r.doc_id])
        count = Counter(k for _, k, _ in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [count[k] for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.joined(spans).encode()).hexdigest()
    assert pii.detect(frame(spark, [])).count() == 0
    assert pii.sanitise(frame(spark, [])).count() == 0


def told(spark):
    rows = []
    for i in range(8):
        rows.append((i, f"note {i} the owner zorblat writes from jane.doe@example.org on the day{i} about it"))
        rows.append((100 + i, f"the day{i} was long and the walk{i} too, said of the the the end{i}"))
    rows.append((200, "the other one, zed@example.org, met nobody"))
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_a_term_that_gives_a_value_away_is_marked(spark):
    got = {r.doc_id: r for r in pii.detect(told(spark)).collect()}
    text = told(spark).filter("doc_id = 3").first().text
    spans = [s.split(":") for s in got[3].spans.split(",")]
    words = {text[int(a) : int(b)] for kind, a, b in spans if kind == "term"}
    assert "zorblat" in words and "the" not in words and "day3" not in words
    assert got[3].n_term == len(words) and got[3].n_email == 1
    assert got[100].n_term == 0 and got[200].n_term == 0


def test_copies_of_one_window_are_no_support(spark):
    rows = [(i, "zorblat writes from jane.doe@example.org today") for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.n_term for r in pii.detect(frame).collect()} == {0}


FILLER = "so it was that they went on and on about this and that"


def far_away(spark):
    """A term seven and more words from its value; one passage copied into different texts."""
    rows = [(i, f"zorblat {FILLER} n{i} mail jane.doe@example.org {FILLER} zorblat n{i}") for i in range(6)]
    rows += [(50 + i, f"u{i} quixley lives at bob@example.net by the sea v{i}") for i in range(6)]
    rows += [(100 + i, f"{FILLER} o{i} by the sea mail lives at") for i in range(30)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_a_term_far_from_the_value_is_marked_at_all_its_places(spark):
    texts = {r.doc_id: r.text for r in far_away(spark).collect()}
    marked = {}
    for r in pii.detect(far_away(spark)).collect():
        spans = [s.split(":") for s in r.spans.split(",") if s]
        marked[r.doc_id] = [texts[r.doc_id][int(a) : int(b)] for kind, a, b in spans if kind == "term"]
    clean = {r.doc_id: r.text for r in pii.sanitise(far_away(spark)).collect()}
    for i in range(6):
        assert marked[i] == ["zorblat", "zorblat"] and "zorblat" not in clean[i] and FILLER in clean[i]
        # The window of six words is the same in each of these texts.
        assert "quixley" in marked[50 + i] and "quixley" not in clean[50 + i]
    assert all(not marked[100 + i] and clean[100 + i] == texts[100 + i] for i in range(30))


def test_copies_of_a_text_are_one_in_all_counts(spark):
    once = far_away(spark)
    copied = once.unionAll(once.filter("doc_id < 3")).unionAll(once.filter("doc_id = 100").withColumn("doc_id", once.doc_id + 900))
    told = lambda docs: {(r.doc_id, r.spans) for r in pii.detect(docs).collect() if r.doc_id < 900}
    assert told(copied) == told(once)


def test_sanitised_texts(spark):
    got = {r.doc_id: r.text for r in pii.sanitise(told(spark)).collect()}
    assert len(got) == 17
    assert "jane.doe" not in got[3] and "[EMAIL]" in got[3] and "zorblat" not in got[3]
    assert got[100] == told(spark).filter("doc_id = 100").first().text
    odd = pii.sanitise(frame(spark))
    assert odd.columns == frame(spark).columns
    assert Counter(r.text is None for r in odd.collect()) == Counter(r[1] is None for r in odd_rows())


def test_redaction():
    text = "aa bb cc dd"
    assert pii.redact(text, [(3, 0, 5)], [(6, 8, True), (9, 11, False)]) == "aa [EMAIL]  [WORD]"
    assert pii.redact(text, [(0, 1, 5), (3, 2, 8)], []) == "[IP] dd"
