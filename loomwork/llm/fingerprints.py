"""Homomorphic document fingerprints: vectors hashed from paragraphs, summed modulo powers of two.

A document is the multiset of its paragraphs. Each paragraph hashes to a wide vector,
and the document's vector is the sum over its paragraphs, so

* the order of paragraphs does not matter, and equal multisets have equal vectors;
* a paragraph is inserted or deleted by adding or subtracting its vector
  (``insert``, ``delete``), without reading the rest;
* the difference of two vectors is the vector of what the documents do not share.

The vector has ``EQUAL`` lanes of 32 random bits, summed modulo 2^32, that tell unequal
multisets apart, and ``SIGNS`` lanes that take one random bit per paragraph, summed
modulo 2^32 as well. With ``c`` paragraphs, ``2 * sum - c`` of such a lane is a sum of
random signs; over the lanes its mean square estimates the size of a (difference)
multiset, from which ``likeness`` is twice the shared part over both sizes, 1 for equal
and about 0 for unrelated documents.

A paragraph here is a run of text up to a line end or a closing mark (. ! ? ; : , or |)
and white space, trimmed; empty ones do not count. Finer paragraphs keep likeness
meaningful for texts without line breaks.

Everything is DataFrame functions. Paragraph rows are summed in the task that made
them: the table is shuffled once, by a range block of the key that also serves the
windows over neighbouring documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomwork.operators.running import add_range_block

EQUAL = 8
SIGNS = 128
_LANES = 1 << 32
_BREAK = r"\s*[\r\n]+\s*|(?<=[.!?;:,|])\s+"
_WORDS = EQUAL // 2  # each 64-bit hash gives two equality lanes
# 64 sign bits from each of two more hashes, two lanes to a summed long.
_PAIRS = [(h, b) for h in range(SIGNS // 64) for b in range(32)]


def paragraphs(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), _BREAK), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def _sums(paragraph: Column) -> list[Column]:
    """Aggregates over paragraph rows: count, equality lanes, packed sign lanes.

    A null paragraph, the mark of a row without any, adds nothing.
    """
    # The paragraph's own hash is shared; further hashes are of that long.
    here = F.when(paragraph.isNotNull(), F.xxhash64(paragraph))
    out = [F.count(paragraph).alias("n")]
    for i in range(_WORDS):
        h = F.when(paragraph.isNotNull(), F.xxhash64(paragraph, F.lit(i)))
        out.append(F.sum(h.bitwiseAND(F.lit(_LANES - 1))).alias(f"e{2 * i}"))
        out.append(F.sum(F.shiftrightunsigned(h, 32)).alias(f"e{2 * i + 1}"))
    mask = F.lit((1 << 32) + 1)
    for k, b in _PAIRS:
        h = F.when(here.isNotNull(), F.xxhash64(here, F.lit(-1 - k)))
        out.append(F.sum(F.shiftrightunsigned(h, b).bitwiseAND(mask)).alias(f"s{k}_{b}"))
    return out


def _vector() -> Column:
    """array<bigint>: count, then every lane."""
    low = lambda c: c.bitwiseAND(F.lit(_LANES - 1))
    lanes = [F.coalesce(F.col("n"), F.lit(0))]
    lanes += [low(F.coalesce(F.col(f"e{i}"), F.lit(0))) for i in range(EQUAL)]
    for k, b in _PAIRS:
        packed = F.coalesce(F.col(f"s{k}_{b}"), F.lit(0))
        lanes += [low(packed), F.shiftrightunsigned(packed, 32)]
    return F.array(*lanes)


def text_of(vector: Column) -> Column:
    """The equality lanes and the count in hex."""
    return F.concat(*[F.lower(F.lpad(F.hex(F.get(vector, F.lit(i))), 8, "0")) for i in range(EQUAL + 1)])


def insert(vector: Column, paragraph_vector: Column) -> Column:
    return F.zip_with(vector, paragraph_vector, lambda a, b: (a + b).bitwiseAND(F.lit(_LANES - 1)))


def delete(vector: Column, paragraph_vector: Column) -> Column:
    return F.zip_with(vector, paragraph_vector, lambda a, b: (a - b + _LANES).bitwiseAND(F.lit(_LANES - 1)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated shared part of two vectors, 0 to 1; exactly 1 where all lanes are equal.

    Two documents without paragraphs are alike; one without and one with are not.
    """
    lanes = F.slice(F.zip_with(a, b, lambda x, y: x - y), EQUAL + 2, SIGNS)
    count = F.get(a, F.lit(0)) - F.get(b, F.lit(0))
    both = F.get(a, F.lit(0)) + F.get(b, F.lit(0))
    squares = F.aggregate(
        lanes, F.lit(0.0), lambda acc, d: acc + F.pow((2 * d - count).cast("double"), F.lit(2.0))
    )

    def size(v: Column) -> Column:
        n = F.get(v, F.lit(0))
        return F.aggregate(
            F.slice(v, EQUAL + 2, SIGNS), F.lit(0.0), lambda acc, x: acc + F.pow((2 * x - n).cast("double"), F.lit(2.0))
        )

    # Repeated paragraphs weigh by their square in all three, so sizes are estimated alike.
    sizes = size(a) + size(b)
    estimate = F.greatest(F.lit(0.0), F.lit(1.0) - squares / sizes)
    return F.when(a == b, 1.0).when((both == 0) | (sizes == 0), 0.0).otherwise(estimate)


def vectors(rows: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """``keys`` and ``vector`` per row; ``keys`` tell rows apart."""
    parts = rows.select(*keys, F.explode_outer(paragraphs(F.col(text))).alias("__p"))
    return parts.groupBy(*keys).agg(*_sums(F.col("__p"))).select(*keys, _vector().alias("vector"))


def _with_guests(docs: DataFrame, key: str, text: str, blocks: int | None) -> DataFrame:
    """(__blk, __key, __text, __guest): all documents by range block of the key, and in each
    block a copy of the first document after it (after the last block: of all)."""
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    placed = add_range_block(rows, "__key", "__blk", blocks).withColumn("__blk", F.coalesce("__blk", F.lit(-1)))
    placed = placed.withColumn("__blk", F.when(F.col("__key").isNull(), -1).otherwise(F.col("__blk")))
    # One row per block, not per document.
    heads = placed.groupBy("__blk").agg(F.min("__key").alias("__head"))
    order = Window.orderBy("__blk")
    before = heads.withColumn("__to", F.lag("__blk").over(order)).withColumn("__last", F.max("__blk").over(Window.partitionBy()))
    before = before.select("__blk", "__head", F.coalesce("__to", "__last").alias("__to"))
    first = placed.join(F.broadcast(before), "__blk").filter(F.col("__key").eqNullSafe(F.col("__head")))
    least = first.groupBy("__to").agg(
        F.min(F.struct(F.xxhash64("__text").alias("h"), F.col("__key").alias("k"), F.col("__text").alias("t"))).alias("m")
    )
    guests = least.select(
        F.col("__to").alias("__blk"), F.col("m.k").alias("__key"), F.col("m.t").alias("__text"), F.lit(True).alias("__guest")
    )
    return placed.select("__blk", "__key", "__text", F.lit(False).alias("__guest")).unionAll(guests)


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", blocks: int | None = None) -> DataFrame:
    """Per document: ``key``, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, vector, edited_vector.

    The edited text has its last floor(n_chars / 2) code points replaced by as many of
    the next document's first (or all it has). Documents follow one another by ``key``,
    null keys first; rows of one key by the hash of their text; after the last comes the
    first. A null text is empty, and an empty one has no paragraph and the zero vector.
    Repeated rows keep a row each; an empty table gives an empty result. Other columns
    are not carried, so their names cannot clash.
    """
    rows = _with_guests(docs, key, text, blocks)
    inside = Window.partitionBy("__blk").orderBy("__guest", "__key", F.xxhash64("__text"))
    numbered = rows.withColumn("__n", F.row_number().over(inside)).withColumn("__next", F.lead("__text").over(inside))
    n = F.length("__text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(
        F.substring("__text", F.lit(1), n - half), F.substring(F.coalesce("__next", F.lit("")), F.lit(1), half)
    )
    both = numbered.withColumn("__edited", F.when(~F.col("__guest"), edited))
    # Facts come out of a window over the row itself: a plain projection would be worked
    # out again for every paragraph row above the explode.
    itself = inside.rowsBetween(Window.currentRow, Window.currentRow)
    both = both.withColumn("n_chars", F.first(n.cast("bigint")).over(itself))
    both = both.withColumn("edited_sha256", F.first(F.sha2(F.col("__edited"), 256)).over(itself))
    # Own text before the edited one: (document, 0), (document, 1), (next, 0), ...
    own = F.transform(paragraphs(F.col("__text")), lambda p: F.struct(F.lit(0).alias("w"), p.alias("p")))
    changed = F.transform(paragraphs(F.col("__edited")), lambda p: F.struct(F.lit(1).alias("w"), p.alias("p")))
    marks = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(None).cast("string").alias("p")) for w in (0, 1)])
    # A row without paragraph per text keeps empty texts.
    parts = both.select(
        "__blk", "__n", "__key", "__guest", "n_chars", "edited_sha256", F.explode(F.concat(marks, own, changed)).alias("__x")
    )
    parts = parts.select("*", F.col("__x.w").alias("__w"), F.col("__x.p").alias("__p"))
    keys = ["__blk", "__n", "__w", "__key", "__guest", "n_chars", "edited_sha256"]
    summed = parts.groupBy(*keys).agg(*_sums(F.col("__p"))).select(*keys, _vector().alias("vector"))
    along = Window.partitionBy("__blk").orderBy("__n", "__w")
    near = summed.withColumn("edited_vector", F.lead("vector", 1).over(along)).withColumn(
        "__next", F.lead("vector", 2).over(along)
    )
    return near.filter((F.col("__w") == 0) & ~F.col("__guest")).select(
        F.col("__key").alias(key),
        "n_chars",
        "edited_sha256",
        text_of(F.col("vector")).alias("fingerprint"),
        text_of(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        likeness(F.col("vector"), F.col("__next")).alias("near_next"),
        "vector",
        "edited_vector",
    )
