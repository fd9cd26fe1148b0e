"""Queries about tokenization: counts, training, encoding, compression."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions.text import pretokens
from loomwork.operators import bpe, encode, splits
from loomwork.plans.registry import query, table
from loomwork.plans.sqltext import pieces, unit
from loomwork.session import spread, stored


def _documents(spark, sf_dir, *columns):
    return spread(table(spark, sf_dir, "documents").select(*columns), "doc_id")


@query(
    "pretoken_counts",
    f"""
    SELECT piece, count(*)::BIGINT AS n
    FROM (SELECT unnest({pieces('text')}) AS piece FROM documents) GROUP BY piece
    """,
)
def pretoken_counts(spark, sf_dir):
    return bpe.pretoken_counts(_documents(spark, sf_dir, "doc_id", "text"))


@query(
    "pair_counts_first_merge",
    f"""
    WITH p AS (SELECT piece, count(*) AS n
               FROM (SELECT unnest({pieces('text')}) AS piece FROM documents) GROUP BY piece),
    b AS (SELECT hex(encode(piece)) AS h, n FROM p),
    pairs AS (SELECT unnest(list_transform(range(0, length(h) // 2 - 1), lambda i: substr(h, (2 * i + 1)::INT, 4))) AS pair, n
              FROM b WHERE length(h) > 2),
    sums AS (SELECT pair, sum(n)::BIGINT AS n FROM pairs GROUP BY pair)
    SELECT pair, n, row_number() OVER (ORDER BY n DESC, pair) = 1 AS is_first_merge FROM sums
    """,
)
def pair_counts_first_merge(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text")
    counts = bpe.pair_counts(bpe.initial_state(bpe.pretoken_counts(docs)))
    pairs = counts.select(F.hex(F.encode("pair", "ISO-8859-1")).alias("pair"), "n")
    best = pairs.agg(F.min(F.struct(-F.col("n"), "pair")).alias("top")).select("top.pair").scalar()
    return pairs.withColumn("is_first_merge", F.col("pair") == best)


def _vocabulary(docs, merges: int) -> bpe.Vocabulary:
    return bpe.train(docs, bpe.BYTE_IDS + merges + len(bpe.SPECIAL_TOKENS))


def _training_ctes(merges: int) -> list[str]:
    """Greedy training, one merge per step, over distinct pre-tokens held as byte characters."""
    ctes = [
        f"""p AS (SELECT piece, count(*) AS n
                  FROM (SELECT unnest({pieces('text')}) AS piece FROM documents) GROUP BY piece)""",
        """s0 AS MATERIALIZED (
             SELECT array_to_string(list_transform(range(0, octet_length(encode(piece))),
                    lambda i: chr(('0x' || substr(hex(encode(piece)), (2 * i + 1)::INT, 2))::INT)), '') AS s, n FROM p)""",
    ]
    for i in range(merges):
        ctes.append(f"""
        t{i} AS MATERIALIZED (
          SELECT pair, sum(n)::BIGINT AS n
          FROM (SELECT unnest(list_transform(range(1, length(s)), lambda i: substr(s, i::INT, 2))) AS pair, n FROM s{i})
          GROUP BY pair ORDER BY n DESC, unicode(substr(pair, 1, 1)), unicode(substr(pair, 2, 1)) LIMIT 1),
        s{i + 1} AS MATERIALIZED (
          SELECT replace(s, (SELECT pair FROM t{i}), chr({256 + i})) AS s, n FROM s{i} WHERE length(s) > 1)""")
    return ctes


def _training_sql(merges: int) -> str:
    found = " UNION ALL ".join(f"SELECT {i} AS rank, pair, n FROM t{i}" for i in range(merges))
    return f"""
    WITH {", ".join(_training_ctes(merges))}, m AS ({found})
    SELECT rank::INTEGER AS rank, unicode(substr(pair, 1, 1))::INTEGER AS left_id,
           unicode(substr(pair, 2, 1))::INTEGER AS right_id, (256 + rank)::INTEGER AS token_id, n
    FROM m
    """


@query("bpe_train_k", _training_sql(48))
def bpe_train_k(spark, sf_dir):
    vocabulary = _vocabulary(_documents(spark, sf_dir, "doc_id", "text"), 48)
    rows = [(rank, m.left, m.right, m.token, m.count) for rank, m in enumerate(vocabulary.merges)]
    return spark.createDataFrame(rows, "rank int, left_id int, right_id int, token_id int, n bigint")


@query(
    "encode_roundtrip",
    """
    SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, true AS same_text,
           true AS bytes_add_up, true AS starts_with_bos
    FROM documents
    """,
)
def encode_roundtrip(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text")
    vocabulary = _vocabulary(docs, 24)
    bos = vocabulary.bos()
    tokenized = encode.tokenize(docs, vocabulary, prepend=bos)
    decode = encode.decoder_function(spark, vocabulary)
    body = F.slice("tokens", F.lit(2), F.greatest(F.size("tokens") - 1, F.lit(0)))
    stored_tokens = stored(tokenized.withColumn("body", body), "encoded")
    # Byte lengths come from the vocabulary's table, joined on the id.
    used = stored_tokens.select("doc_id", F.explode("body").alias("token_id")).groupBy("doc_id", "token_id").count()
    told = used.join(vocabulary.table(spark), "token_id").groupBy("doc_id").agg(
        F.sum(F.col("count") * F.col("n_bytes")).alias("n_bytes")
    )
    joined = stored_tokens.join(told, "doc_id", "left")
    n_bytes = F.coalesce("n_bytes", F.lit(0)).cast("bigint")
    return joined.select(
        "doc_id",
        n_bytes.alias("n_bytes"),
        (decode(F.col("body")) == F.col("text")).alias("same_text"),
        (n_bytes == F.octet_length("text")).alias("bytes_add_up"),
        (F.element_at("tokens", 1) == bos).alias("starts_with_bos"),
    )


def encoding_ctes(merges: int) -> list[str]:
    """CTEs up to ``j`` (doc_id, ids): the trained merges as a chain of replacements over each distinct piece."""
    bytes_of = """array_to_string(list_transform(range(0, octet_length(encode(piece))),
                  lambda i: chr(('0x' || substr(hex(encode(piece)), (2 * i + 1)::INT, 2))::INT)), '')"""
    steps = [f"e0 AS MATERIALIZED (SELECT piece, {bytes_of} AS s FROM p)"]
    steps += [
        f"e{i + 1} AS MATERIALIZED (SELECT piece, replace(s, (SELECT pair FROM t{i}), chr({256 + i})) AS s FROM e{i})"
        for i in range(merges)
    ]
    return [
        *_training_ctes(merges),
        *steps,
        f"ids AS (SELECT piece, array_to_string(list_transform(string_split(s, ''), lambda c: unicode(c)), ',') AS ids FROM e{merges})",
        f"cut AS (SELECT doc_id, {pieces('text')} AS parts FROM documents)",
        "d AS (SELECT doc_id, unnest(parts) AS piece, unnest(range(0, len(parts))) AS i FROM cut)",
        "j AS (SELECT doc_id, string_agg(ids, ',' ORDER BY i) AS ids FROM d JOIN ids USING (piece) GROUP BY doc_id)",
    ]


def _encoding_sql(merges: int) -> str:
    return f"""
    WITH {", ".join(encoding_ctes(merges))}
    SELECT doc_id, md5({256 + merges} || coalesce(',' || ids, '') || ',' || {256 + merges + 8}) AS ids_md5
    FROM documents LEFT JOIN j USING (doc_id)
    """


@query("encode_ids", _encoding_sql(24))
def encode_ids(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text")
    vocabulary = _vocabulary(docs, 24)
    end = vocabulary.special("<|output_end|>")
    tokenized = encode.tokenize(docs, vocabulary, prepend=vocabulary.bos(), append=end)
    return tokenized.select("doc_id", F.md5(F.array_join("tokens", ",")).alias("ids_md5"))


@query(
    "token_byte_stats",
    f"""
    WITH v AS (SELECT DISTINCT unnest({pieces('text')}) AS piece FROM documents)
    SELECT count(*)::BIGINT AS n_tokens, min(octet_length(encode(piece)))::BIGINT AS bytes_min,
           max(octet_length(encode(piece)))::BIGINT AS bytes_max,
           round(avg(octet_length(encode(piece))), 6) AS bytes_mean,
           round(stddev_samp(octet_length(encode(piece))), 6) AS bytes_std
    FROM v
    """,
)
def token_byte_stats(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text")
    vocabulary = bpe.pretoken_counts(docs).select(F.octet_length("piece").alias("n_bytes"))
    return encode.byte_stats(vocabulary)


@query(
    "vocab_table",
    """
    WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents),
    v AS (SELECT unicode(ch)::BIGINT AS token_id, count(*)::BIGINT AS n,
                 octet_length(encode(ch))::BIGINT AS n_bytes FROM c WHERE ch <> '' GROUP BY ALL),
    s AS (SELECT unnest(['<|bos|>', '<|user_start|>', '<|user_end|>', '<|assistant_start|>',
                 '<|assistant_end|>', '<|python_start|>', '<|python_end|>', '<|output_start|>',
                 '<|output_end|>']) AS name, unnest(range(0, 9)) AS i)
    SELECT token_id, n, n_bytes, false AS is_special FROM v
    UNION ALL
    SELECT (SELECT max(token_id) FROM v) + 1 + i, 0, 0, true FROM s
    """,
)
def vocab_table(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text")
    chars = docs.select(F.explode(F.regexp_extract_all("text", F.lit("(?s)(.)"), F.lit(1))).alias("ch"))
    seen = chars.groupBy("ch").agg(F.count(F.lit(1)).alias("n")).select(
        F.ascii("ch").cast("bigint").alias("token_id"),
        "n",
        F.octet_length("ch").cast("bigint").alias("n_bytes"),
        F.lit(False).alias("is_special"),
    )
    specials = seen.agg(F.max("token_id").alias("top")).select(
        F.explode(F.sequence(F.col("top") + 1, F.col("top") + len(bpe.SPECIAL_TOKENS))).alias("token_id"),
        F.lit(0).cast("bigint").alias("n"),
        F.lit(0).cast("bigint").alias("n_bytes"),
        F.lit(True).alias("is_special"),
    )
    return seen.unionByName(specials)


@query(
    "token_inspector",
    f"""
    WITH d AS (SELECT doc_id, {pieces('text')} AS p FROM documents)
    SELECT doc_id, (unnest(range(0, len(p))))::BIGINT AS pos, unnest(p) AS token,
           lower(hex(encode(unnest(p)))) AS hex
    FROM d
    """,
)
def token_inspector(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text")
    return encode.inspect(docs, "doc_id", pretokens(F.col("text")))


_SIZES_SQL = f"""
    WITH s AS (
      SELECT lang, sum(octet_length(encode(text)))::BIGINT AS n_bytes,
             sum(octet_length(encode(text)))::BIGINT AS "byte",
             sum(length(text))::BIGINT AS "char",
             sum(len({pieces('text')}))::BIGINT AS "piece"
      FROM documents GROUP BY lang),
    l AS (SELECT lang, n_bytes, tokenizer, n_tokens, n_bytes / n_tokens::DOUBLE AS ratio
          FROM (UNPIVOT s ON "byte", "char", "piece" INTO NAME tokenizer VALUE n_tokens))
"""


def _compression(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "lang", "text")
    sizes = {
        "byte": F.octet_length("text"),
        "char": F.length("text"),
        "piece": F.size(pretokens(F.col("text"))),
    }
    return encode.compression(docs, "lang", sizes)


@query(
    "compression_by_class",
    _SIZES_SQL + "SELECT lang, tokenizer, n_bytes, n_tokens, round(ratio, 6) AS ratio FROM l",
)
def compression_by_class(spark, sf_dir):
    return _compression(spark, sf_dir).withColumn("ratio", F.round("ratio", 6))


@query(
    "compression_compare",
    _SIZES_SQL
    + """
    SELECT b.lang, b.tokenizer AS baseline, b.n_tokens AS baseline_tokens, o.n_tokens AS our_tokens,
           round((b.n_tokens - o.n_tokens) / b.n_tokens::DOUBLE * 100, 6) AS saving_pct,
           CASE WHEN b.ratio > o.ratio THEN b.tokenizer WHEN o.ratio > b.ratio THEN 'piece' ELSE 'Tie' END AS better
    FROM l b JOIN l o ON b.lang = o.lang AND o.tokenizer = 'piece' AND b.tokenizer <> 'piece'
    """,
)
def compression_compare(spark, sf_dir):
    compared = encode.compare(_compression(spark, sf_dir), "lang", "piece", ["byte", "char"])
    return compared.withColumn("saving_pct", F.round("saving_pct", 6))


@query(
    "tokens_per_split",
    f"""
    SELECT CASE WHEN {unit("'2357'", "doc_id")} < 0.05 THEN 'val' ELSE 'train' END AS split,
           count(*)::BIGINT AS n_docs, sum(len({pieces('text')}) + 1)::BIGINT AS n_tokens
    FROM documents GROUP BY ALL
    """,
)
def tokens_per_split(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text")
    with_end = F.size(pretokens(F.col("text"))) + 1
    return (
        docs.groupBy(splits.hash_split("doc_id", ratio=0.05).alias("split"))
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(with_end).cast("bigint").alias("n_tokens"))
    )
