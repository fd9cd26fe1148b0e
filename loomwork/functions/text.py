"""Text expressions: stripping, pre-token splitting, hashing. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the pre-token pattern that defines token boundaries.
SPLIT_PATTERN = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""

# The characters str.strip() removes: Unicode white space and the four separators.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Looks at the ends only, so long texts cost no more than short ones."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def pretokens(text: Column) -> Column:
    """Array of pre-tokens; concatenated they give the text back."""
    return F.regexp_extract_all(text, F.lit(f"((?U){SPLIT_PATTERN})"), F.lit(1))


HASH_BITS = 60


def hash60(*parts: Column | str) -> Column:
    """Non-negative 60-bit hash of the parts, equal in every engine with md5."""
    payload = F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(payload), 1, 15), 16, 10).cast("bigint")


def unit_hash(*parts: Column | str) -> Column:
    """The same hash scaled to [0, 1)."""
    return hash60(*parts) / F.lit(float(1 << HASH_BITS))


def byte_text(text: Column) -> Column:
    """UTF-8 bytes as a string with one character (code point 0-255) per byte."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def adjacent_pairs(symbols: Column) -> Column:
    """Every two neighbouring characters, overlapping."""
    return F.regexp_extract_all(symbols, F.lit("(?s)(?=(..))"), F.lit(1))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once.

    Inside higher-order functions Spark repeats an expression at every mention; a
    lambda variable is the way to hold its result.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
