"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing names."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, __text string, fp string, score int"

WORDS = "the quick brown fox jumps over a lazy dog while nine grey geese watch from some far away hill".split()


def odd_rows():
    long = " ".join(WORDS[i % len(WORDS)] + str(i % 97) for i in range(6000))
    rows = [
        (1, "The quick brown fox. It jumps!\nOver the dog.", "en", "a"),
        (2, "The quick brown fox. It jumps!\nOver the dog.", "en", "a"),
        (2, "The quick brown fox. It jumps!\nOver the dog.", "en", "a"),
        (3, None, None, None),
        (4, "", "en", "b"),
        (5, " \t\n ", "de", None),
        (6, long, "en", "a"),
        (7, long + " end", "en", "a"),
        (8, "Wörter für die Prüfung, über alles", "de", "c"),
        (9, "12345 67890 !!", None, "c"),
        (None, "The quick brown fox. It jumps!\nOver the dog.", "en", "a"),
        (None, "a b", "en", "a"),
        (10, "x", "fr", "a"),
        (-5, "one two", "en", "a"),
    ]
    return [(i, t, l, s, len(t or ""), "clash", "clash", 1) for i, t, l, s in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)
