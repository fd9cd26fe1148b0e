"""Registered queries of this folder and the SQL that checks them, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwork.llm import bestfit, collocations, decontaminate, fingerprints, langid, maxent, mixpack, pii, prefixtrie, simhash, tokenfiles, toxicity, urlfilter
from loomwork.llm.tokenids import TokenizerFile
from loomwork.session import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash")
def op1(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


URL_RULES = (
    urlfilter.Rule("block", "net", "/"),
    urlfilter.Rule("allow", "example.net", "/en/"),
    urlfilter.Rule("block", "example.com", "/de/"),
    urlfilter.Rule("allow", "org", "/fr/"),
)

_URL_SQL = """
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(action, rhost, rpath) AS (VALUES
  ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT page_id, action, rhost || rpath AS rule,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, action DESC, rhost || rpath) AS n
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, host, path, f.rule,
  coalesce(f.action, CASE WHEN regexp_matches(host, 'spam|pills|casino|free-money') THEN 'block' ELSE 'allow' END)
    AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.n = 1
"""


@query("op2_urlfilter", _URL_SQL)
def op2(spark, sf_dir):
    return urlfilter.judge(table(spark, sf_dir, "pages"), ["page_id"], "url", URL_RULES)


def word_tokenizer() -> TokenizerFile:
    return TokenizerFile(public_tokenizers.path("word_bpe_49k.json"))


@query("op3_bestfit_packing")
def op3(spark, sf_dir):
    return bestfit.pack(table(spark, sf_dir, "documents"), word_tokenizer())


@query("op7_token_files")
def op7(spark, sf_dir):
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"), word_tokenizer())


@query("op10_decontaminate")
def op10(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_toxicity")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op4_pii")
def op4(spark, sf_dir):
    return pii.detect(table(spark, sf_dir, "documents"))


@query("op9_fingerprints")
def op9(spark, sf_dir):
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents")).drop("vector", "edited_vector")


@query("op6_langid")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pieces = langid.public_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return langid.predict(docs, langid.train(docs, pieces))


@query("op8_maxent_lm")
def op8(spark, sf_dir):
    return maxent.score(table(spark, sf_dir, "documents"))


_PHRASE_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists), (VALUES (1), (2), (3), (4)) AS o(k)
  WHERE i + k - 1 <= len(ws)),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE k > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.a, j, p.f AS l, s.f AS r, (2000000::HUGEINT * c.a) // (p.f + s.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c
  JOIN counts p ON p.lang = c.lang AND p.phrase = array_to_string(c.ws[1:j], ' ')
  JOIN counts s ON s.lang = c.lang AND s.phrase = array_to_string(c.ws[j + 1:c.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS outer_f
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM cand, (VALUES (2), (3)) AS o(m) WHERE m < k)
  GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, encode(b.phrase)) AS rank,
  b.phrase, b.a, l, r, t.n, score::BIGINT AS score
FROM best b JOIN totals t ON t.lang = b.lang LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
WHERE i.outer_f IS NULL OR 100 * i.outer_f < 80 * b.a
QUALIFY rank <= 2000
"""


@query("op13_collocations", _PHRASE_SQL)
def op13(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def byte_tokenizer() -> TokenizerFile:
    return TokenizerFile(public_tokenizers.path("byte_bpe_50k.json"))


@query("op11_mixture_packing")
def op11(spark, sf_dir):
    return mixpack.pack(table(spark, sf_dir, "documents"), byte_tokenizer())


# Beginnings shared across conversations: five in a row take their first turns from one.
_TRIE_SQL = """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS m,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT c, c - c % 5 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
        lambda k, b: list_reduce(list_prepend(xor(k, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
          lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT c FROM t)),
seq AS (
  SELECT ids.c, t.i AS o, m, x FROM ids JOIN t ON t.c = ids.base AND t.i < h
  UNION ALL SELECT ids.c, 9 + t.i, m, x FROM ids JOIN t ON t.c = ids.c AND t.i >= h),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY o) AS d, m, strlen(x) AS b FROM seq),
paths AS (
  SELECT c, d, b, string_agg(m, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS p FROM placed
  UNION ALL SELECT c, 0, 0, '' FROM ids),
nodes AS (SELECT d, p, any_value(b) AS b, min(c) AS c, count(*) AS n FROM paths GROUP BY d, p),
kids AS (SELECT left(p, (32 * (d - 1))::BIGINT) AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
under AS (
  SELECT left(u.p, (32 * a)::BIGINT) AS p, sum((n - 1) * b)::BIGINT AS saved, count(*) FILTER (WHERE k IS NULL) AS leaves
  FROM (SELECT nodes.*, k, unnest(range(0, d + 1)) AS a FROM nodes LEFT JOIN kids ON kids.p = nodes.p) u GROUP BY 1),
ends AS (
  SELECT p, string_agg(c::VARCHAR, ',' ORDER BY c) AS e
  FROM (SELECT * FROM paths QUALIFY row_number() OVER (PARTITION BY c ORDER BY d DESC) = 1) GROUP BY p)
SELECT n.c AS conv_id, n.d AS depth, q.c AS parent_conv_id, n.n AS n_convs, coalesce(k, 0) AS n_children,
  leaves AS n_leaves, saved AS saved_tokens, sha256(coalesce(e, '')) AS ends_sha256
FROM nodes n JOIN under u ON u.p = n.p LEFT JOIN kids ON kids.p = n.p LEFT JOIN ends ON ends.p = n.p
LEFT JOIN nodes q ON n.d > 0 AND q.p = left(n.p, (32 * (n.d - 1))::BIGINT)
"""


def spliced(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turn keys of the rebuilt conversations, all conversation ids)."""
    keys = stored(prefixtrie.numbered(prefixtrie.turn_keys(turns)), "turns")
    taken = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(9))
    ids = keys.select("conv").distinct().withColumn("h", taken).withColumn("base", F.col("conv") - F.pmod("conv", F.lit(5)))
    heads = keys.filter("i < 8").select(F.col("conv").alias("base"), "i", "content", "bytes").join(ids, "base").filter("i < h")
    own = keys.withColumn("h", taken).filter("i >= h").select("conv", (F.col("i") + 9).alias("turn"), "content", "bytes")
    return heads.select("conv", F.col("i").alias("turn"), "content", "bytes").unionByName(own), ids.select("conv")


@query("op12_prefix_trie", _TRIE_SQL)
def op12(spark, sf_dir):
    return prefixtrie.prefix_trie(*spliced(table(spark, sf_dir, "conversations")))
