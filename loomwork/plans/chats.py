"""Queries over conversations: validation, splits, rendering, record conversion."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions.text import hash60
from loomwork.operators import chatcheck, chatforms, render, splits
from loomwork.operators.running import take_until
from loomwork.plans.registry import query, table
from loomwork.plans.sqltext import h60, strip as sql_strip, unit

# Special ids of the code-point tokenizer used by these queries.
MARKER_IDS = {
    "<|bos|>": 1_200_000,
    "<|user_start|>": 1_200_001,
    "<|user_end|>": 1_200_002,
    "<|assistant_start|>": 1_200_003,
    "<|assistant_end|>": 1_200_004,
    "<|python_start|>": 1_200_005,
    "<|python_end|>": 1_200_006,
    "<|output_start|>": 1_200_007,
    "<|output_end|>": 1_200_008,
}
IM_IDS = {"<|endoftext|>": 1_200_000, "<|im_start|>": 1_200_001, "<|im_end|>": 1_200_002}
MARKERS = render.Codec(render.code_points, MARKER_IDS)
IM = render.Codec(render.code_points, IM_IDS)


def turns_of(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


def _judged(rules: str) -> str:
    """Row-numbered messages and the ordered reasons, per rule set."""
    led = "head = 'system'" if rules != "strict" else "false"
    blank = f"""CASE WHEN role IS NULL OR role NOT IN ('system', 'user', 'assistant') THEN 'unsupported_role'
                WHEN text IS NULL THEN 'content_not_string'
                WHEN {sql_strip('text')} = '' THEN 'content_empty' END"""
    plain = "CASE WHEN text IS NULL THEN 'content_not_string' END"
    prepared = rules == "prepared"
    return f"""
    WITH m AS (
      SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i,
             {blank if prepared else plain} AS fault FROM conversations),
    f AS (
      SELECT conv_id, count(*) AS n, first(role ORDER BY i) AS head, last(role ORDER BY i) AS tail,
             max(CASE WHEN i = 1 THEN role END) AS second,
             first(fault ORDER BY i) FILTER (fault IS NOT NULL) AS fault,
             count(*) FILTER (role <> CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END) AS off0,
             count(*) FILTER (i > 0 AND role <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END) AS off1
      FROM m GROUP BY conv_id),
    judged AS (
      SELECT conv_id, n::BIGINT AS n_messages, CASE
        WHEN n < {1 if rules == 'loose' else 2} THEN 'too_few_messages'
        WHEN {'fault IS NOT NULL' if prepared else 'false'} THEN fault
        WHEN n - ({led})::INT < 2 THEN CASE WHEN {led} THEN 'system_without_dialogue' ELSE 'too_few_messages' END
        WHEN {prepared} AND CASE WHEN {led} THEN second ELSE head END <> 'user' THEN 'not_user_first'
        WHEN {prepared} AND tail <> 'assistant' THEN 'not_assistant_last'
        WHEN CASE WHEN {led} THEN off1 ELSE off0 END > 0 THEN 'roles_not_alternating'
        ELSE fault END AS reject_reason
      FROM f)
    """


def _validate(rules):
    def run(spark, sf_dir):
        return chatcheck.judge(turns_of(spark, sf_dir), rules)

    return run


for _name, _rules, _key in (
    ("chat_validate", chatcheck.PREPARED, "prepared"),
    ("chat_validate_loose", chatcheck.LOOSE, "loose"),
    ("chat_validate_strict", chatcheck.STRICT, "strict"),
):
    query(_name, _judged(_key) + "SELECT conv_id, n_messages, reject_reason FROM judged")(_validate(_rules))


@query(
    "reject_report",
    _judged("prepared")
    + """
    , named AS (SELECT conv_id, coalesce(reject_reason, 'accepted') AS outcome FROM judged),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY conv_id) AS rn FROM named)
    SELECT outcome, count(*)::BIGINT AS n_conversations,
           string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (rn <= 5) AS first_ids
    FROM ranked GROUP BY outcome
    """,
)
def reject_report(spark, sf_dir):
    return chatcheck.reject_report(chatcheck.judge(turns_of(spark, sf_dir)))


@query(
    "chat_size_limits",
    f"""
    WITH m AS (
      SELECT conv_id, turn, role, text, {h60("'temperature'", 'conv_id')} % 250 / 100.0 AS temperature,
             CASE WHEN length(text) = 0 THEN 'empty_content' WHEN length(text) > 600 THEN 'message_too_long' END AS fault
      FROM conversations),
    f AS (
      SELECT conv_id, count(*) AS n, sum(length(text)) AS total, max(temperature) AS temperature,
             first(fault ORDER BY turn) FILTER (fault IS NOT NULL) AS fault,
             count(*) FILTER (role NOT IN ('user', 'assistant')) AS bad
      FROM m GROUP BY conv_id)
    SELECT conv_id, total::BIGINT AS total_chars, CASE
      WHEN n > 6 THEN 'too_many_messages' WHEN fault IS NOT NULL THEN fault
      WHEN total > 1500 THEN 'conversation_too_long' WHEN bad > 0 THEN 'invalid_role'
      WHEN temperature NOT BETWEEN 0 AND 2 THEN 'temperature_out_of_range' END AS size_issue
    FROM f
    """,
)
def chat_size_limits(spark, sf_dir):
    # Limits are set low enough for the stored chats to meet every one of them.
    limits = chatcheck.SizeLimits(max_messages=6, max_message_chars=600, max_total_chars=1_500)
    turns = turns_of(spark, sf_dir).withColumn(
        "temperature", (hash60(F.lit("temperature"), "conv_id") % 250) / 100
    )
    return chatcheck.judge_size(turns, limits)


@query(
    "complete_only",
    """
    SELECT conv_id, max(turn) AS last_turn FROM conversations
    GROUP BY conv_id HAVING last(role ORDER BY turn) = 'assistant'
    """,
)
def complete_only(spark, sf_dir):
    return chatcheck.completed(turns_of(spark, sf_dir))


# The stand-in for a subset name: whether the conversation opens with a system text.
_SUBSET_SQL = """
    SELECT conv_id, CASE WHEN count(*) FILTER (turn = 0 AND role = 'system') > 0 THEN 'led' ELSE 'plain' END AS subset
    FROM conversations GROUP BY conv_id
"""


def _subsets(turns):
    led = F.count_if((F.col("turn") == 0) & (F.col("role") == "system")) > 0
    return turns.groupBy("conv_id").agg(F.when(led, "led").otherwise("plain").alias("subset"))


_DIGEST_SQL = f"""
    d AS (SELECT conv_id, sum(({h60('turn', 'role', 'text')})::HUGEINT) AS digest FROM conversations GROUP BY conv_id)
"""


def _content_split(turns, ratio):
    """Split by a sum of message hashes: content-based, and a mergeable aggregate."""
    digest = F.sum(hash60("turn", "role", "text").cast("decimal(20,0)")).alias("digest")
    return turns.groupBy("conv_id").agg(digest).select(
        "conv_id", splits.hash_split(F.col("digest"), ratio=ratio).alias("split")
    )


@query(
    "hash_split",
    f"""
    WITH {_DIGEST_SQL}
    SELECT conv_id, CASE WHEN {unit("'2357'", 'digest')} < 0.2 THEN 'val' ELSE 'train' END AS split FROM d
    """,
)
def hash_split(spark, sf_dir):
    return _content_split(turns_of(spark, sf_dir), 0.2)


@query("hash_split_exact")
def hash_split_exact(spark, sf_dir):
    turns = turns_of(spark, sf_dir)
    rows = chatforms.assemble(turns).join(_subsets(turns), "conv_id")
    split = splits.exact_content_split(F.col("messages"), F.col("subset"), 0.2)
    return rows.select("conv_id", "subset", split.alias("split"))


@query(
    "manifest_counts",
    _judged("prepared")
    + f"""
    , {_DIGEST_SQL}, s AS ({_SUBSET_SQL}),
    r AS (
      SELECT subset, reject_reason IS NULL AS kept,
             CASE WHEN reject_reason IS NOT NULL THEN 'skipped'
                  WHEN {unit("'2357'", 'digest')} < 0.2 THEN 'val' ELSE 'train' END AS split
      FROM judged JOIN s USING (conv_id) JOIN d USING (conv_id))
    SELECT coalesce(split, '(all)') AS split, coalesce(subset, '(all)') AS subset, count(*)::BIGINT AS n_rows
    FROM r GROUP BY ROLLUP (split, subset)
    """,
)
def manifest_counts(spark, sf_dir):
    turns = turns_of(spark, sf_dir)
    rows = (
        chatcheck.judge(turns)
        .join(_subsets(turns), "conv_id")
        .join(_content_split(turns, 0.2), "conv_id")
        .withColumn("split", F.when(F.col("reject_reason").isNotNull(), "skipped").otherwise(F.col("split")))
    )
    return manifest(rows)


def manifest(rows):
    """Rows per split and subset with totals."""
    return rows.rollup("split", "subset").agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.coalesce("split", F.lit("(all)")).alias("split"),
        F.coalesce("subset", F.lit("(all)")).alias("subset"),
        "n_rows",
    )


@query(
    "cap_seen_vs_kept",
    _judged("prepared")
    + f"""
    , s AS ({_SUBSET_SQL}),
    j AS (SELECT conv_id, subset, reject_reason IS NULL AS ok FROM judged JOIN s USING (conv_id)),
    seen AS (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY conv_id) AS rn FROM j),
    kept AS (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY conv_id) AS rn FROM j WHERE ok)
    SELECT 'seen' AS cap, subset, conv_id FROM seen WHERE rn <= 20 AND ok
    UNION ALL SELECT 'kept', subset, conv_id FROM kept WHERE rn <= 20
    """,
)
def cap_seen_vs_kept(spark, sf_dir):
    turns = turns_of(spark, sf_dir)
    judged = chatcheck.judge(turns).join(_subsets(turns), "conv_id")
    accepted = F.col("reject_reason").isNull()

    def cap(rows):
        return take_until(rows, "conv_id", F.lit(1), 20, ["subset"], keep_crossing=False)

    seen = cap(judged).filter(accepted).withColumn("cap", F.lit("seen"))
    kept = cap(judged.filter(accepted)).withColumn("cap", F.lit("kept"))
    return seen.unionByName(kept).select("cap", "subset", "conv_id")


_FOLD_SQL = """
    WITH folded AS (
      SELECT c.conv_id, c.turn, c.role,
             CASE WHEN s.text IS NULL THEN c.text ELSE s.text || chr(10) || chr(10) || c.text END AS text,
             c.turn = 0 OR s.text IS NOT NULL AS opens
      FROM conversations c LEFT JOIN conversations s
        ON s.conv_id = c.conv_id AND s.turn = 0 AND s.role = 'system' AND c.turn = 1
      WHERE NOT (c.turn = 0 AND c.role = 'system'))
"""


@query("fold_system", _FOLD_SQL + "SELECT conv_id, turn, role, md5(text) AS text_md5, opens FROM folded")
def fold_system(spark, sf_dir):
    return render.fold_system(turns_of(spark, sf_dir)).select(
        "conv_id", "turn", "role", F.md5("text").alias("text_md5"), "opens"
    )


_CODES = "list_transform(list_filter(string_split(text, ''), lambda x: x <> ''), lambda x: unicode(x)::BIGINT)"


# Reference default, and a length that no conversation reaches.
MAX_TOKENS, UNCUT = 2048, 1 << 30


def _rendered_sql(head: str, tail: str, tail_mask: str, source: str = "folded", limit: int = MAX_TOKENS) -> str:
    return f"""
    , seg AS (
      SELECT conv_id, turn,
             list_concat(CASE WHEN opens THEN [1200000::BIGINT] ELSE []::BIGINT[] END, {head}, {_CODES}, {tail}) AS toks,
             list_concat(CASE WHEN opens THEN [0] ELSE []::INT[] END,
                         list_transform({head}, lambda x: 0),
                         list_transform({_CODES}, lambda x: CASE WHEN role = 'assistant' THEN 1 ELSE 0 END),
                         list_transform({tail}, lambda x: {tail_mask})) AS msk
      FROM {source}),
    conv AS (
      SELECT conv_id, flatten(list(toks ORDER BY turn))[1:{limit}] AS tokens, flatten(list(msk ORDER BY turn))[1:{limit}] AS mask
      FROM seg GROUP BY conv_id)
    """


_MARKER_SQL = _rendered_sql(
    "CASE WHEN role = 'user' THEN [1200001::BIGINT] ELSE [1200003::BIGINT] END",
    "CASE WHEN role = 'user' THEN [1200002::BIGINT] ELSE [1200004::BIGINT] END",
    "CASE WHEN role = 'assistant' THEN 1 ELSE 0 END",
)
_IM_SQL = _rendered_sql(
    "list_concat([1200001::BIGINT], list_transform(string_split(role || chr(10), ''), lambda x: unicode(x)::BIGINT))",
    "[1200002::BIGINT, 10::BIGINT]",
    "CASE WHEN role = 'assistant' THEN 1 ELSE 0 END",
    limit=UNCUT,
)
_SUMMARY_SQL = """
    SELECT conv_id, len(tokens)::BIGINT AS n_tokens, list_sum(mask)::BIGINT AS n_supervised,
           md5(array_to_string(tokens, ',')) AS tokens_md5, md5(array_to_string(mask, ',')) AS mask_md5
    FROM conv
"""


def summarize(rendered):
    """Lengths and digests of rendered conversations, for comparison."""
    total = F.aggregate("mask", F.lit(0).cast("bigint"), lambda a, m: a + m)
    return rendered.select(
        "conv_id",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        total.alias("n_supervised"),
        F.md5(F.array_join("tokens", ",")).alias("tokens_md5"),
        F.md5(F.array_join("mask", ",")).alias("mask_md5"),
    )


@query("render_ids_mask", _FOLD_SQL + _MARKER_SQL + _SUMMARY_SQL)
def render_ids_mask(spark, sf_dir):
    return summarize(render.render(turns_of(spark, sf_dir), MARKERS))


@query("render_im_template", _FOLD_SQL + _IM_SQL + _SUMMARY_SQL)
def render_im_template(spark, sf_dir):
    return summarize(render.render(turns_of(spark, sf_dir), IM, UNCUT))


@query(
    "completion_prompt",
    _FOLD_SQL
    + """
    , whole AS (SELECT conv_id, max(turn) AS last_turn FROM conversations
                GROUP BY conv_id HAVING last(role ORDER BY turn) = 'assistant'),
    prompt AS (SELECT folded.* FROM folded JOIN whole USING (conv_id) WHERE turn < last_turn)
    """
    + _MARKER_SQL.replace("FROM folded)", "FROM prompt)")
    + """
    SELECT conv_id, (len(tokens) + 1)::BIGINT AS n_tokens,
           md5(array_to_string(list_append(tokens, 1200003::BIGINT), ',')) AS tokens_md5 FROM conv
    """,
)
def completion_prompt(spark, sf_dir):
    prompts = render.render_for_completion(turns_of(spark, sf_dir), MARKERS)
    return prompts.select(
        "conv_id",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.md5(F.array_join("tokens", ",")).alias("tokens_md5"),
    )


@query(
    "shift_targets",
    _FOLD_SQL
    + _MARKER_SQL
    + """
    SELECT conv_id, md5(array_to_string(tokens[1:len(tokens) - 1], ',')) AS inputs_md5,
           md5(array_to_string(list_transform(list_zip(tokens[2:], mask[2:]),
               lambda p: CASE WHEN p[2] = 0 THEN -1 ELSE p[1] END), ',')) AS targets_md5
    FROM conv
    """,
)
def shift_targets(spark, sf_dir):
    rendered = render.render(turns_of(spark, sf_dir), MARKERS)
    inputs, targets = render.loss_targets(F.col("tokens"), F.col("mask"))
    return rendered.select(
        "conv_id",
        F.md5(F.array_join(inputs, ",")).alias("inputs_md5"),
        F.md5(F.array_join(targets, ",")).alias("targets_md5"),
    )


def chat_rows(spark, sf_dir):
    """Stored chats rewritten to the three accepted row shapes, a third each."""
    messages = chatforms.assemble(turns_of(spark, sf_dir))
    kind = F.col("conv_id") % 3
    first_user = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["content"]
    last = F.element_at("messages", -1)["content"]
    system = F.get(F.filter("messages", lambda m: m["role"] == "system"), F.lit(0))["content"]
    named = {"user": "human", "assistant": "gpt"}

    def shared(m):
        role = F.when(m["role"] == "user", named["user"]).when(m["role"] == "assistant", named["assistant"])
        return F.struct(
            F.lit("").alias("role"),
            F.coalesce(role, m["role"]).alias("from"),
            F.lit(None).cast("string").alias("content"),
            m["content"].alias("value"),
        )

    pair = kind == 2
    return messages.select(
        "conv_id",
        F.when(kind == 0, F.col("messages")).alias("messages"),
        F.when(kind == 1, F.transform("messages", shared)).alias("conversations"),
        F.when(pair, F.lit("")).alias("instruction"),
        F.when(pair, first_user).alias("prompt"),
        F.lit(None).cast("string").alias("question"),
        F.lit(None).cast("string").alias("output"),
        F.when(pair, F.lit("")).alias("response"),
        F.when(pair, last).alias("answer"),
        F.when(pair, system).alias("system"),
        F.lit(None).cast("string").alias("system_prompt"),
    )


_COERCED_SQL = """
    WITH m AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS messages FROM conversations GROUP BY conv_id),
    c AS (
      SELECT conv_id, CASE WHEN conv_id % 3 <> 2 THEN messages ELSE list_concat(
          CASE WHEN messages[1].role = 'system' THEN [messages[1]] ELSE [] END,
          [{'role': 'user', 'content': list_filter(messages, lambda m: m.role = 'user')[1].content},
           {'role': 'assistant', 'content': messages[-1].content}]) END AS messages
      FROM m)
"""


@query(
    "coerce_messages",
    _COERCED_SQL
    + """
    SELECT conv_id, len(messages)::BIGINT AS n_messages,
           md5(array_to_string(list_transform(messages, lambda m: m.role || ':' || m.content), '|')) AS messages_md5
    FROM c
    """,
)
def coerce_messages(spark, sf_dir):
    rows = chatforms.coerce_messages(chat_rows(spark, sf_dir))
    lines = F.transform("messages_out", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return rows.select(
        "conv_id",
        F.size("messages_out").cast("bigint").alias("n_messages"),
        F.md5(F.array_join(lines, "|")).alias("messages_md5"),
    )


@query(
    "instruction_record",
    _COERCED_SQL
    + f"""
    , ok AS (SELECT * FROM c WHERE messages[-1].role = 'assistant'),
    t AS (SELECT conv_id, unnest(messages) AS m, unnest(range(1, len(messages) + 1)) AS i, len(messages) AS n FROM ok),
    s AS (SELECT conv_id, i, n, m.role AS role, {sql_strip('m.content')} AS content,
                 min(CASE WHEN m.role = 'user' THEN i END) OVER (PARTITION BY conv_id) AS u FROM t)
    SELECT conv_id,
           string_agg(content, chr(10) || chr(10) ORDER BY i) FILTER (role = 'system' OR i = u) AS instruction,
           coalesce(string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || content,
                    chr(10) || chr(10) ORDER BY i) FILTER (role <> 'system' AND i <> u AND i < n), '') AS input,
           max(CASE WHEN i = n THEN content END) AS output
    FROM s GROUP BY conv_id
    """,
)
def instruction_record(spark, sf_dir):
    rows = chatforms.coerce_messages(chat_rows(spark, sf_dir))
    valid = rows.filter(chatforms.reject_reason(F.col("messages_out")).isNull())
    return valid.select("conv_id", chatforms.instruction_record(F.col("messages_out")).alias("r")).select(
        "conv_id", "r.instruction", "r.input", "r.output"
    )
