"""Fragments shared by the DuckDB statements that check the queries."""

WS = r"\s\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# The pre-token pattern without possessive quantifiers and lookahead.
PRETOKEN = (
    r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,2}"
    r"| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]|\s+"
)
_QUOTED = PRETOKEN.replace("'", "''")


def h60(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"


def unit(*parts: str) -> str:
    return f"({h60(*parts)}::DOUBLE / 1152921504606846976::DOUBLE)"


def pieces(text: str) -> str:
    return f"regexp_extract_all({text}, '{_QUOTED}')"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{WS}]+|[{WS}]+$', '', 'g')"


CONVS = """
turns AS (
  SELECT conv_id, turn, role, text FROM conversations
)"""
