"""Personal data: fixed patterns, and terms that give a protected value away.

Base spans come from four patterns. Information-theoretic sanitisation then asks of
every term (word) in a document that holds a protected value ``e`` how much of ``e`` it
reveals. Over the distinct texts, with ``co(t, e)`` the number that hold both term ``t``
and ``e``, and ``n(t)`` and ``n(e)`` those that hold either,

    p(e | t) = co(t, e) / n(t)        p(e) = n(e) / all texts
    revealed = log2(p(e | t) / p(e)) / -log2 p(e)

is the share of the information in ``e`` that ``t`` discloses. Where both stand in at
least ``SUPPORT`` different texts, a share of ``GENERALISE`` or more generalises the term
to its class and one of ``REMOVE`` or more removes it, at all its places in the texts
that hold ``e``. Common words reveal next to nothing and stay, as do texts without ``e``.

Copies of a whole text are one text in every count; a passage copied into different
texts counts in each of them. Values in fewer than ``SUPPORT`` texts cannot be judged
and are set aside before pairs are made.

Terms and values travel as 64-bit hashes. Pairs are added up in each task before they
move, so a value that a third of all documents hold is counted in parts.

Defined cases: a null text is empty; an empty one has no spans. Null keys and repeated
rows keep a row each. Documents with a clash of column names are safe: only the key
and the text are read, or (``sanitise``) all columns are carried under their own names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from loomwork.llm.arrowtext import text_slices
from loomwork.llm.decontaminate import word_symbols
from loomwork.session import stored

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT = 3
GENERALISE = 0.8
REMOVE = 0.95

# The base patterns, written so that a long text costs no more per
# character than a short one. The part before @ is found from the @ backwards, and an
# address of numbers starts where its digits start.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NO_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, kind, end


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m.group())
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _hash(value: str) -> int:
    return _signed(xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")))


def _normal(words: list[str]) -> list[str]:
    lowered = pc.utf8_lower(pa.array(words, pa.string()))
    return pc.replace_substring_regex(lowered, r"[^\pL\pN]+", "").to_pylist()


def value_hashes(text: str, spans: list[Span]) -> list[int]:
    """Hashes of the distinct values that the spans hold."""
    values = ((k, text[s:e] if k == 0 else _NO_DIGIT.sub(" " if k == 1 else "", text[s:e])) for s, k, e in spans)
    return list({_hash(f"{KINDS[k]}:{value.lower()}") for k, value in values})


def text_terms(text: str, spans: list[Span]) -> list[tuple[int, int, int]]:
    """(term hash, start, end) of every word of the text outside its base spans."""
    words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]
    starts = [w[0] for w in words]
    covered = np.zeros(len(words), dtype=bool)
    for s, _, e in spans:
        covered[max(0, bisect_left(starts, s + 1) - 1) : bisect_left(starts, e)] = True
    free = [w for w, c in zip(words, covered.tolist()) if not c]
    terms = _normal([w[2] for w in free])
    known = {t: _hash(t) for t in set(terms) if t}
    return [(known[t], s, e) for (s, e, _), t in zip(free, terms) if t]


def _maybe(text: str) -> Column:
    """Whether a text can hold a base span at all."""
    return F.coalesce(F.col(text).rlike("[0-9@]"), F.lit(False))


def _scan(marked: DataFrame, text: str) -> DataFrame:
    """__row (hash of key and text), __copy (hash of the text), __values and __terms of rows that hold a value.

    Hashes only: places are found again in the text where a term is flagged.
    """

    def run(batches):
        for part, texts in text_slices(batches, "__text"):
            rows, values, terms = [], [], []
            for i, value in enumerate(texts.to_pylist()):
                found = base_spans(value)
                if found:
                    rows.append(i)
                    values.append(value_hashes(value, found))
                    terms.append(list({t for t, _, _ in text_terms(value, found)}))
            kept = [part.column(i).take(pa.array(rows, pa.int64())) for i in (0, 1)]
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(values, lists), pa.array(terms, lists)], names=["__row", "__copy", "__values", "__terms"]
            )

    copy = F.md5(F.coalesce(F.col(text), F.lit(""))).alias("__copy")
    rows = marked.select("__row", copy, F.col(text).alias("__text"))
    return rows.mapInArrow(run, "__row string, __copy string, __values array<bigint>, __terms array<bigint>")


def _with_row(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A null key is told from every other, so that no two different rows share a hash."""
    name = F.when(F.col(key).isNull(), F.lit("n")).otherwise(F.concat(F.lit("k"), F.col(key).cast("string")))
    return docs.withColumn("__row", F.md5(F.concat(name, F.lit("|"), F.coalesce(F.col(text), F.lit("")))))


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): how many of the distinct texts hold a word hash."""

    def run(batches):
        for _, texts in text_slices(batches, "__text"):
            codes, words, counts = word_symbols(texts)
            # Each word once per text.
            cell = np.repeat(np.arange(len(counts)), counts) * max(1, len(words)) + codes
            cell.sort()
            once = cell[np.flatnonzero(np.diff(cell, prepend=-1))]
            n = np.bincount(once % max(1, len(words)), minlength=len(words))
            terms = [_hash(w) for w in words.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(n.astype(np.int64))], names=["term", "n"])

    partial = docs.select(F.col(text).alias("__text")).distinct().mapInArrow(run, "term bigint, n bigint")
    return partial.groupBy("term").agg(F.sum("n").alias("n")).filter("n > 0")


def disclosures(held: DataFrame, values: DataFrame, counts: DataFrame, total: int, generalise=GENERALISE, remove=REMOVE, support=SUPPORT) -> DataFrame:
    """(value, term, remove) of pairs past the threshold.

    ``held`` has rows (__copy, __held, __terms): a text's supported values and distinct terms;
    ``values`` (value, n_value), ``counts`` (term, n) and ``total`` the number of texts.
    """
    # Copies come together first, by task, so that each text is one row.
    texts = held.groupBy("__copy").agg(F.first("__held").alias("__held"), F.first("__terms").alias("__terms"))
    pairs = texts.select(F.explode("__held").alias("value"), "__terms").select("value", F.explode("__terms").alias("term"))
    frequent = pairs.groupBy("value", "term").agg(F.count("*").alias("co")).filter(F.col("co") >= support)
    judged = frequent.join(values, "value").join(counts, "term")
    p_value = F.col("n_value") / F.lit(float(total or 1))
    p_given = F.least(F.col("co") / F.col("n"), F.lit(1.0))
    share = F.log2(p_given / p_value) / F.greatest(-F.log2(p_value), F.lit(1e-9))
    return judged.withColumn("share", share).filter(F.col("share") >= generalise).select(
        "value", "term", (F.col("share") >= remove).alias("remove")
    )


def _flagged(scanned: DataFrame, counts: DataFrame, total: int, thresholds: dict) -> DataFrame:
    """(__row, __terms): per row its disclosing terms, each with whether it is removed."""
    support = thresholds.get("support", SUPPORT)
    owned = scanned.select("__row", "__copy", F.explode("__values").alias("value"))
    values = owned.groupBy("value", "__copy").count().groupBy("value").agg(F.count("*").alias("n_value"))
    values = stored(values.filter(F.col("n_value") >= support), "values")
    # Rows by their supported values; copies of a row are one.
    mine = owned.distinct().join(values, "value").groupBy("__row").agg(F.collect_set("value").alias("__held"))
    held = stored(scanned.select("__row", "__copy", "__terms").dropDuplicates(["__row"]).join(mine, "__row"), "held")
    found = stored(disclosures(held, values, counts, total, **thresholds), "disclosing")
    near = held.select("__row", "__terms", F.explode("__held").alias("value")).select("__row", "value", F.explode("__terms").alias("term"))
    once = near.join(found, ["value", "term"]).groupBy("__row", "term").agg(F.max("remove").alias("remove"))
    return once.groupBy("__row").agg(F.collect_list(F.struct("term", "remove")).alias("__terms"))  # at most the row's own terms


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", **thresholds) -> DataFrame:
    """``key``, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_term per row."""
    marked = _with_row(docs.filter(_maybe(text)), key, text)
    flagged = _flagged(stored(_scan(marked, text), "spans"), stored(term_counts(docs, text), "terms"), _texts(docs, text), thresholds)
    kind = docs.schema[key].dataType.simpleString()
    names = ["n_email", "n_ip", "n_card", "n_phone"]

    def run(batches):
        for part, texts in text_slices(batches, "__text"):
            found = texts.to_pylist()
            flags = [set(f or []) for f in part.column(2).to_pylist()]
            base = [base_spans(value) for value in found]
            terms = [[(s, 4, e) for t, s, e in text_terms(v, b) if t in f] if f else [] for v, b, f in zip(found, base, flags)]
            numbers = [pa.array([sum(k == n for _, k, _ in b) for b in base], pa.int64()) for n in range(4)]
            digests = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
            spans = pa.array([joined(b + t) for b, t in zip(base, terms)], pa.string())
            columns = [part.column(0), *numbers, pa.array(digests, pa.string()), spans, pa.array([len(t) for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *names, "base_sha256", "spans", "n_term"])

    rows = marked.select(key, "__row", F.col(text).alias("__text")).join(flagged, "__row", "left")
    shown = rows.select(key, "__text", F.col("__terms.term").alias("__terms")).mapInArrow(
        run,
        f"`{key}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_term bigint",
    )
    zero = F.lit(0).cast("bigint")
    rest = docs.filter(~_maybe(text)).select(
        key, *[zero.alias(n) for n in names], F.sha2(F.lit(b""), 256).alias("base_sha256"), F.lit("").alias("spans"), zero.alias("n_term")
    )
    return shown.unionAll(rest)


def _texts(docs: DataFrame, text: str) -> int:
    """Number of distinct texts."""
    return docs.select(F.md5(F.coalesce(F.col(text), F.lit("")))).distinct().count()


def redact(text: str, base: list[Span], terms: list[tuple[int, int, bool]]) -> str:
    """Base spans become their kind, generalised terms their class, removed ones nothing.

    Spans that overlap are one, under the kind of the first.
    """
    marks = [(s, e, f"[{KINDS[k].upper()}]") for s, k, e in base]
    marks += [(s, e, "" if gone else "[NUMBER]" if text[s:e].isdigit() else "[WORD]") for s, e, gone in terms]
    out, at = [], 0
    for s, e, mark in sorted(marks, key=lambda m: (m[0], -m[1])):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", **thresholds) -> DataFrame:
    """``docs``, all columns, with sanitised texts; a null text stays null.

    Rows without a digit or an @ cannot hold a base span and are passed through;
    only the others are joined with the disclosing terms.
    """
    columns, schema = docs.columns, docs.schema
    held = _with_row(docs.filter(_maybe(text)), key, text)
    flagged = _flagged(stored(_scan(held, text), "spans"), stored(term_counts(docs, text), "terms"), _texts(docs, text), thresholds)
    at = columns.index(text)

    def run(batches):
        for part, texts in text_slices(batches, text):
            terms = part.column(len(columns)).to_pylist()
            done = []
            for value, flags in zip(texts.to_pylist(), terms):
                spans, gone = base_spans(value), {t["term"]: t["remove"] for t in flags or []}
                words = text_terms(value, spans) if gone else []
                done.append(redact(value, spans, [(s, e, gone[t]) for t, s, e in words if t in gone]))
            arrays = [part.column(i) for i in range(len(columns))]
            arrays[at] = pa.array(done, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    joined_rows = held.join(flagged, "__row", "left").select(*columns, "__terms")
    return docs.filter(~_maybe(text)).unionAll(joined_rows.mapInArrow(run, schema))
