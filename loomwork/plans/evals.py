"""Queries about evaluation metrics and rollouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions.text import hash60, pretokens, unit_hash
from loomwork.operators import bpe, evals, render, rollouts, splits, tasks
from loomwork.plans import chats
from loomwork.plans.registry import query, table
from loomwork.plans.sqltext import h60, pieces, unit
from loomwork.plans.taskdata import _ANSWERS_SQL, four_choices, worked_answers
from loomwork.session import spread, stored

# --- bits per byte: token ids are pre-tokens hashed into a vocabulary of 32,768.

_VOCAB = 32_768
_LOSS_SQL = f"""
    WITH d AS (SELECT doc_id, {pieces('text')} AS p FROM documents),
    t AS (SELECT doc_id, unnest(range(0, len(p))) AS pos, unnest(p) AS piece FROM d),
    k AS (SELECT doc_id, pos, piece, {h60('piece')} % {_VOCAB} AS token_id,
                 {unit("'loss'", 'doc_id', 'pos')} * 4 AS loss,
                 {h60("'skip'", 'doc_id', 'pos')} % 20 = 0 AS skip FROM t),
    b AS (SELECT token_id, CASE WHEN token_id < 9 THEN 0 ELSE min(octet_length(encode(piece))) END AS n_bytes
          FROM k GROUP BY token_id)
"""


def _losses(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    token_id = (hash60("piece") % _VOCAB).cast("int").alias("token_id")
    # The split is of the document: worked out before its tokens are exploded.
    placed = docs.withColumn("split", splits.hash_split("doc_id", ratio=0.1))
    tokens = placed.select("doc_id", "split", F.posexplode(pretokens(F.col("text"))).alias("pos", "piece"))
    keyed = tokens.select("doc_id", "split", "pos", token_id)
    # Distinct pieces are found first, so each is hashed once for the byte table.
    distinct = bpe.pretoken_counts(docs).select("piece", token_id)
    token_bytes = distinct.groupBy("token_id").agg(F.min(F.octet_length("piece")).alias("n_bytes")).select(
        "token_id", F.when(F.col("token_id") < 9, 0).otherwise(F.col("n_bytes")).alias("n_bytes")
    )
    skip = hash60(F.lit("skip"), "doc_id", "pos") % 20 == 0
    losses = keyed.select(
        "doc_id",
        "split",
        F.when(skip, -1).otherwise(F.col("token_id")).alias("target"),
        (unit_hash(F.lit("loss"), "doc_id", "pos") * 4).alias("loss"),
    )
    return losses, stored(token_bytes, "token-bytes")


@query(
    "bits_per_byte",
    _LOSS_SQL
    + f"""
    SELECT CASE WHEN {unit("'2357'", 'doc_id')} < 0.1 THEN 'val' ELSE 'train' END AS split,
           round(sum(CASE WHEN n_bytes > 0 THEN loss END), 3) AS nats, sum(n_bytes)::BIGINT AS n_bytes,
           round(sum(CASE WHEN n_bytes > 0 THEN loss END) / (ln(2) * sum(n_bytes)), 6) AS bpb
    FROM k JOIN b USING (token_id) WHERE NOT skip GROUP BY ALL
    """,
)
def bits_per_byte(spark, sf_dir):
    losses, token_bytes = _losses(spark, sf_dir)
    return evals.bits_per_byte(losses, token_bytes, ["split"]).select(
        "split", F.round("nats", 3).alias("nats"), "n_bytes", F.round("bpb", 6).alias("bpb")
    )


@query(
    "bits_per_byte_budget",
    _LOSS_SQL
    + """
    SELECT round(sum(CASE WHEN n_bytes > 0 THEN loss END), 3) AS nats, sum(n_bytes)::BIGINT AS n_bytes,
           round(sum(CASE WHEN n_bytes > 0 THEN loss END) / (ln(2) * sum(n_bytes)), 6) AS bpb
    FROM k JOIN b USING (token_id)
    WHERE NOT skip AND doc_id < (100000 // (8 * 256 * 2)) * 8 * 2
    """,
)
def bits_per_byte_budget(spark, sf_dir):
    losses, token_bytes = _losses(spark, sf_dir)
    # A document stands for a packed row here, numbered by its id.
    rows = evals.rows_in_budget(100_000, batch=8, length=256, world=2)
    scored = evals.bits_per_byte(losses.filter(F.col("doc_id") < rows), token_bytes)
    return scored.select(F.round("nats", 3).alias("nats"), "n_bytes", F.round("bpb", 6).alias("bpb"))


# --- benchmark items: three tasks by id, the first four words are the choices.


def items_of(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")
    return rows.select(
        "item_id",
        F.concat(F.lit("task_"), (F.col("item_id") % 3).cast("string")).alias("task"),
        F.col("text").alias("query"),
        four_choices("text").alias("choices"),
        (hash60(F.lit("gold"), "item_id") % 4).cast("int").alias("gold"),
    )


_ITEMS_SQL = f"""
    WITH items AS (
      SELECT item_id, 'task_' || (item_id % 3) AS task, text AS query, string_split(text, ' ')[1:4] AS choices,
             ({h60("'gold'", 'item_id')} % 4)::INT AS gold FROM benchmark),
    ranked AS (
      SELECT item_id, task, row_number() OVER (PARTITION BY task ORDER BY {h60("'shots'", 'item_id')}) - 1 AS rnk,
             count(*) OVER (PARTITION BY task) AS n FROM items),
    draws AS (
      SELECT item_id, task, s AS shot_no,
             (rnk + 1 + ({h60('rnk + 1234')} + s * ({list(evals.STRIDES)})[1 + {h60("'stride'", 'rnk + 1234')} % {len(evals.STRIDES)}]) % (n - 1)) % n AS want
      FROM ranked, (SELECT unnest(range(1, 4)) AS s)),
    drawn AS (
      SELECT d.task, d.item_id, d.shot_no, r.item_id AS shot_key
      FROM draws d JOIN ranked r ON r.task = d.task AND r.rnk = d.want)
"""


@query(
    "fewshot_draw",
    _ITEMS_SQL + "SELECT task, item_id, shot_no::BIGINT AS shot_no, shot_key FROM drawn",
)
def fewshot_draw(spark, sf_dir):
    return evals.fewshot_draw(items_of(spark, sf_dir), "item_id", 3)


_SHOTS_SQL = _ITEMS_SQL + """
    , shots AS (
      SELECT d.item_id, string_agg({text} || chr(10) || chr(10), '' ORDER BY d.shot_no) AS shots
      FROM drawn d JOIN items e ON e.item_id = d.shot_key AND e.task = d.task GROUP BY d.item_id)
"""


def _with_shots(items, shot_text):
    draws = evals.fewshot_draw(items, "item_id", 3)
    return evals.with_shots(items, draws, shot_text, "item_id")


def _exploded(prompts):
    return prompts.select("item_id", F.posexplode("prompts").alias("option", "prompt")).select(
        "item_id", F.col("option").cast("bigint").alias("option"), "prompt"
    )


@query(
    "prompts_mc",
    _SHOTS_SQL.format(text="e.query || ' ' || e.choices[e.gold + 1]")
    + """
    SELECT item_id, (o - 1)::BIGINT AS option, shots || query || ' ' || choices[o] AS prompt
    FROM items JOIN shots USING (item_id), (SELECT unnest(range(1, 5)) AS o)
    """,
)
def prompts_mc(spark, sf_dir):
    items = items_of(spark, sf_dir)
    shot = F.concat("query", F.lit(" "), F.get("choices", F.col("gold")))
    told = _with_shots(items, shot)
    prompts = evals.choice_prompts(F.col("query"), F.col("choices"), " ", F.col("shots"))
    return _exploded(told.withColumn("prompts", prompts))


@query(
    "prompts_schema",
    _SHOTS_SQL.format(text="e.choices[e.gold + 1] || ': ' || e.query")
    + """
    SELECT item_id, (o - 1)::BIGINT AS option, shots || choices[o] || ': ' || query AS prompt
    FROM items JOIN shots USING (item_id), (SELECT unnest(range(1, 5)) AS o)
    """,
)
def prompts_schema(spark, sf_dir):
    items = items_of(spark, sf_dir)
    shot = F.concat(F.get("choices", F.col("gold")), F.lit(": "), "query")
    told = _with_shots(items, shot)
    prompts = evals.schema_prompts(F.col("choices"), F.col("query"), ": ", F.col("shots"))
    return _exploded(told.withColumn("prompts", prompts))


@query(
    "prompts_lm",
    _SHOTS_SQL.format(text="e.query || ' ' || e.choices[1]")
    + """
    SELECT item_id, unnest([0, 1])::BIGINT AS option,
           unnest([shots || query, shots || query || ' ' || choices[1]]) AS prompt
    FROM items JOIN shots USING (item_id)
    """,
)
def prompts_lm(spark, sf_dir):
    items = items_of(spark, sf_dir)
    context = F.concat("query", F.lit("  "))
    ending = F.get("choices", F.lit(0))
    told = _with_shots(items, F.concat("query", F.lit(" "), ending))
    prompts = evals.language_prompts(context, ending, " ", F.col("shots"))
    return _exploded(told.withColumn("prompts", prompts))


def _option_tokens(spark, sf_dir):
    """Code points of each option's prompt, a start token in front."""
    items = items_of(spark, sf_dir)
    start = F.array(F.lit(chats.MARKER_IDS["<|bos|>"]))
    # Options share their opening, the question, and their ending.
    prompts = F.transform("choices", lambda c: F.concat("query", F.lit(" "), c, F.lit(" ok")))
    return items.withColumn("tokens", F.transform(prompts, lambda p: F.concat(start, render.code_points(p))))


_TOKENS_SQL = _ITEMS_SQL + """
    , seqs AS (
      SELECT item_id, task, gold, list_transform(choices, lambda c: list_prepend(1200000::BIGINT,
             list_transform(list_filter(string_split(query || ' ' || c || ' ok', ''), lambda x: x <> ''),
             lambda x: unicode(x)::BIGINT))) AS t FROM items),
    shared AS (
      SELECT seqs.*, length(query) AS q_len, list_min(list_transform(t, lambda s: len(s))) AS m FROM seqs JOIN items USING (item_id)),
    com AS (
      SELECT *, coalesce(list_min(list_filter(range(1, m + 1), lambda i: len(list_distinct(list_transform(t, lambda s: s[i]))) > 1)) - 1, m) AS prefix,
             coalesce(list_min(list_filter(range(1, m + 1), lambda i: len(list_distinct(list_transform(t, lambda s: s[len(s) - i + 1]))) > 1)) - 1, m) AS suffix
      FROM shared)
"""


@query("common_prefix", _TOKENS_SQL + "SELECT item_id, prefix::BIGINT AS prefix, suffix::BIGINT AS suffix FROM com")
def common_prefix(spark, sf_dir):
    return _option_tokens(spark, sf_dir).select(
        "item_id",
        evals.common_length(F.col("tokens")).cast("bigint").alias("prefix"),
        evals.common_length(F.col("tokens"), from_end=True).cast("bigint").alias("suffix"),
    )


def _spans(tokens, kind, source="tokens"):
    spans = tokens.select("item_id", "task", "gold", F.posexplode(evals.spans(F.col(source), kind)).alias("option", "s"))
    return spans.withColumn("option", F.col("option").cast("bigint"))


@query(
    "scoring_spans",
    _TOKENS_SQL
    + """
    SELECT 'multiple_choice' AS kind, item_id, (o - 1)::BIGINT AS option, prefix::BIGINT AS span_start,
           len(t[o])::BIGINT AS span_end, NULL AS fault
    FROM com, (SELECT unnest(range(1, 5)) AS o) WHERE o <= len(t)
    UNION ALL
    SELECT 'schema', item_id, o - 1, len(t[o]) - suffix, len(t[o]), NULL
    FROM com, (SELECT unnest(range(1, 5)) AS o) WHERE o <= len(t)
    UNION ALL
    SELECT 'language_modelling', item_id, 0, q_len + 1, len(t[1]), NULL FROM com WHERE item_id % 2 = 0
    UNION ALL
    SELECT 'language_modelling', item_id, 0, len(t[2]), len(t[1]), 'not_a_prefix' FROM com WHERE item_id % 2 = 1
    """,
)
def scoring_spans(spark, sf_dir):
    tokens = _option_tokens(spark, sf_dir)
    # Even items give a true prefix (start token and question), odd ones another option.
    whole = F.get("tokens", F.lit(0))
    without = F.when(F.col("item_id") % 2 == 0, F.slice(whole, F.lit(1), F.length("query") + 1)).otherwise(F.get("tokens", F.lit(1)))
    tokens = tokens.withColumn("pair", F.array(without, whole))
    out = None
    for kind, source in (("multiple_choice", "tokens"), ("schema", "tokens"), ("language_modelling", "pair")):
        part = _spans(tokens, kind, source).select(
            F.lit(kind).alias("kind"),
            "item_id",
            "option",
            F.col("s.start").cast("bigint").alias("span_start"),
            F.col("s.end").cast("bigint").alias("span_end"),
            F.col("s.fault").alias("fault"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "left_crop",
    _TOKENS_SQL
    + """
    , c AS (SELECT item_id, o - 1 AS option, prefix, t[o] AS s, greatest(len(t[o]) - 24, 0) AS gone
            FROM com, (SELECT unnest(range(1, 5)) AS o) WHERE o <= len(t))
    SELECT item_id, option::BIGINT AS option, md5(array_to_string(s[gone + 1:], ',')) AS tokens_md5,
           (prefix - gone)::BIGINT AS span_start, (len(s) - gone)::BIGINT AS span_end
    FROM c
    """,
)
def left_crop(spark, sf_dir):
    cropped = _spans(_option_tokens(spark, sf_dir), "multiple_choice").withColumn(
        "s", evals.crop_left(F.col("s"), 24)
    )
    return cropped.select(
        "item_id",
        "option",
        F.md5(F.array_join("s.tokens", ",")).alias("tokens_md5"),
        F.col("s.start").cast("bigint").alias("span_start"),
        F.col("s.end").cast("bigint").alias("span_end"),
    )


def _option_losses(spark, sf_dir):
    """Seeded losses for every position of every option."""
    spans = _spans(_option_tokens(spark, sf_dir), "multiple_choice")
    positions = F.explode(F.sequence(F.lit(0), F.size("s.tokens") - 2))
    return spans.select(
        "task", "item_id", "gold", "option", F.col("s.start").alias("start"), F.col("s.end").alias("end"),
        positions.alias("pos"),
    ).withColumn("loss", unit_hash(F.lit("loss"), "item_id", "option", "pos"))


_CHOICE_SQL = _TOKENS_SQL + f"""
    , l AS (
      SELECT item_id, task, gold, o - 1 AS option, prefix, len(t[o]) AS e, unnest(range(0, len(t[o]) - 1)) AS pos
      FROM com, (SELECT unnest(range(1, 5)) AS o) WHERE o <= len(t)),
    means AS (
      SELECT item_id, task, gold, option, avg({unit("'loss'", 'item_id', 'option', 'pos')}) AS mean_loss
      FROM l WHERE pos >= prefix - 1 AND pos < e - 1 GROUP BY ALL),
    chosen AS (
      SELECT item_id, task, gold, arg_min(option, mean_loss) AS predicted, min(mean_loss) AS mean_loss
      FROM means GROUP BY ALL)
"""


@query(
    "option_choice",
    _CHOICE_SQL
    + """
    SELECT task, item_id, predicted::BIGINT AS predicted, round(mean_loss, 9) AS mean_loss, predicted = gold AS correct
    FROM chosen
    """,
)
def option_choice(spark, sf_dir):
    chosen = evals.option_choice(_option_losses(spark, sf_dir), ["task", "item_id", "gold"])
    return chosen.select(
        "task", "item_id", "predicted", F.round("mean_loss", 9).alias("mean_loss"),
        (F.col("predicted") == F.col("gold")).alias("correct"),
    )


@query(
    "core_metric",
    _CHOICE_SQL
    + f"""
    , base AS (SELECT task, {h60('task')} % 30 AS b FROM (SELECT DISTINCT task FROM items)),
    acc AS (SELECT task, avg((predicted = gold)::INT) AS accuracy FROM chosen GROUP BY task),
    s AS (SELECT task, accuracy, (accuracy - 0.01 * b) / (1 - 0.01 * b) AS centred FROM acc JOIN base USING (task))
    SELECT task, round(accuracy, 9) AS accuracy, round(centred, 9) AS centred FROM s
    UNION ALL SELECT 'CORE', NULL, round(avg(centred), 9) FROM s
    """,
)
def core_metric(spark, sf_dir):
    chosen = evals.option_choice(_option_losses(spark, sf_dir), ["task", "item_id", "gold"])
    outcomes = chosen.withColumn("correct", F.col("predicted") == F.col("gold"))
    baselines = items_of(spark, sf_dir).select("task").distinct().withColumn(
        "baseline", (hash60("task") % 30).cast("double")
    )
    scores = evals.task_scores(outcomes, baselines)
    total = evals.mean_centred(scores).select(
        F.lit("CORE").alias("task"), F.lit(None).cast("double").alias("accuracy"), F.col("metric").alias("centred")
    )
    return scores.unionByName(total).select(
        "task", F.round("accuracy", 9).alias("accuracy"), F.round("centred", 9).alias("centred")
    )


@query(
    "lm_match",
    f"""
    WITH p AS (
      SELECT l_orderkey, l_linenumber AS pos, l_partkey AS next_token,
             CASE WHEN {h60('l_orderkey', 'l_linenumber')} % 10 = 0 THEN l_partkey + 1 ELSE l_partkey END AS predicted
      FROM lineitem)
    SELECT l_orderkey, bool_and(predicted = next_token) AS correct FROM p GROUP BY l_orderkey
    """,
)
def lm_match(spark, sf_dir):
    # One order is one sequence; its lines are the positions.
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_linenumber").alias("pos"),
        F.col("l_partkey").alias("next_token"),
        (F.col("l_partkey") + F.when(hash60("l_orderkey", "l_linenumber") % 10 == 0, 1).otherwise(0)).alias(
            "predicted_token"
        ),
        F.lit(1).alias("start"),
    )
    # Every line is judged: the span ends with the order.
    ends = lines.groupBy("l_orderkey").agg((F.max("pos") + 2).alias("end"))
    lines = lines.join(ends, "l_orderkey")
    return evals.all_tokens_match(lines, ["l_orderkey"])


# --- events as samples: a user is a problem, a purchase is a correct sample.


def _samples(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", "event_type", "value", (F.col("event_type") == "purchase").alias("correct")
    )


@query(
    "categorical_eval",
    f"""
    WITH l AS (
      SELECT event_id, event_type AS task, unnest(['A', 'B', 'C', 'D']) AS letter, unnest([0, 1, 2, 3]) AS ord FROM events),
    s AS (
      SELECT *, {h60("'logit'", 'event_id', 'letter')} % 7 AS logit, ord <= 2 + event_id % 2 AS allowed,
             ['A', 'B', 'C'][({h60("'gold'", 'event_id')} % 3 + 1)::INT] AS gold FROM l),
    p AS (
      SELECT task, event_id, gold, first(letter ORDER BY logit DESC, ord) AS predicted FROM s WHERE allowed GROUP BY ALL)
    SELECT task, count(*)::BIGINT AS n_problems, count(*) FILTER (predicted = gold)::BIGINT AS n_correct FROM p GROUP BY task
    """,
)
def categorical_eval(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("task"))
    letters = F.array(*[F.lit(x) for x in tasks.LETTERS])
    scored = events.select("event_id", F.explode(letters).alias("letter")).withColumn(
        "logit", (hash60(F.lit("logit"), "event_id", "letter") % 7).cast("double")
    )
    # Odd problems offer four letters, even ones three.
    offered = F.slice(letters, F.lit(1), (3 + F.col("event_id") % 2).cast("int"))
    allowed = events.select("event_id", F.posexplode(offered).alias("ord", "letter"))
    predicted = evals.categorical_outcomes(scored, allowed, "event_id")
    gold = F.get(letters, (hash60(F.lit("gold"), "event_id") % 3).cast("int"))
    return (
        predicted.join(events, "event_id")
        .groupBy("task")
        .agg(
            F.count(F.lit(1)).alias("n_problems"),
            F.count_if(F.col("predicted") == gold).alias("n_correct"),
        )
    )


@query(
    "generative_pass",
    """
    WITH p AS (SELECT user_id, bool_or(event_type = 'purchase' AND value > 150) AS passed FROM events GROUP BY user_id),
    c AS (SELECT * FROM p ORDER BY user_id LIMIT 100)
    SELECT 'all' AS scope, count(*)::BIGINT AS n_problems, count(*) FILTER (passed)::BIGINT AS n_passed,
           round(count(*) FILTER (passed) / count(*), 9) AS accuracy FROM p
    UNION ALL
    SELECT 'first 100', count(*), count(*) FILTER (passed), round(count(*) FILTER (passed) / count(*), 9) FROM c
    """,
)
def generative_pass(spark, sf_dir):
    samples = _samples(spark, sf_dir).withColumn("correct", F.col("correct") & (F.col("value") > 150))
    whole = evals.pass_rate(samples, "user_id").withColumn("scope", F.lit("all"))
    capped = evals.pass_rate(samples, "user_id", max_problems=100).withColumn("scope", F.lit("first 100"))
    return whole.unionByName(capped).withColumn("accuracy", F.round("accuracy", 9))


# Chat tasks with their chance accuracy; the first three are categorical.
CHAT_BASELINES = {
    "ARC-Easy": 0.25, "ARC-Challenge": 0.25, "MMLU": 0.25, "GSM8K": 0.0, "HumanEval": 0.0, "SpellingBee": 0.0,
}
CATEGORICAL = ("ARC-Easy", "ARC-Challenge", "MMLU")
_TASK_LIST = "[" + ", ".join(f"'{t}'" for t in CHAT_BASELINES) + "]"


@query(
    "chatcore",
    f"""
    WITH e AS (SELECT {_TASK_LIST}[({h60("'task'", 'event_id')} % 6 + 1)::INT] AS task, event_type = 'purchase' AS ok FROM events),
    a AS (SELECT task, avg(ok::INT) AS acc, CASE WHEN task IN ('ARC-Easy', 'ARC-Challenge', 'MMLU') THEN 0.25 ELSE 0.0 END AS b
          FROM e GROUP BY task),
    c AS (SELECT task, (acc - b) / (1 - b) AS centred FROM a)
    SELECT 'ChatCORE' AS metric, CASE WHEN count(*) = 6 THEN round(avg(centred), 9) END AS value FROM c
    UNION ALL
    SELECT 'ChatCORE categorical', CASE WHEN count(*) = 3 THEN round(avg(centred), 9) END FROM c
    WHERE task IN ('ARC-Easy', 'ARC-Challenge', 'MMLU')
    """,
)
def chatcore(spark, sf_dir):
    names = F.array(*[F.lit(t) for t in CHAT_BASELINES])
    outcomes = _samples(spark, sf_dir).select(
        F.get(names, (hash60(F.lit("task"), "event_id") % 6).cast("int")).alias("task"), "correct"
    )
    baselines = spark.createDataFrame(list(CHAT_BASELINES.items()), "task string, baseline double")
    scores = evals.task_scores(outcomes, baselines, percent=False)
    whole = evals.mean_centred(scores, tuple(CHAT_BASELINES)).withColumn("name", F.lit("ChatCORE"))
    part = evals.mean_centred(scores, CATEGORICAL).withColumn("name", F.lit("ChatCORE categorical"))
    return whole.unionByName(part).select(F.col("name").alias("metric"), F.round("metric", 9).alias("value"))


@query(
    "pass_at_k",
    """
    WITH r AS (SELECT user_id, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    f AS (SELECT user_id, min(CASE WHEN ok THEN rn END) AS hit FROM r GROUP BY user_id)
    SELECT k::BIGINT AS k, round(count(*) FILTER (hit <= k) / count(*), 9) AS pass_at_k
    FROM f, (SELECT unnest(range(1, 9)) AS k) GROUP BY k
    """,
)
def pass_at_k(spark, sf_dir):
    curve = evals.pass_at_k(_samples(spark, sf_dir), "user_id", "event_id", 8)
    return curve.withColumn("pass_at_k", F.round("pass_at_k", 9))


# --- rollouts: an order is a sample, its customer the prompt.

_REWARD_SQL = _ANSWERS_SQL + """
    , r AS (SELECT a.o_orderkey, o_custkey, (reference_answer IS NOT DISTINCT FROM given_answer)::INT::DOUBLE AS reward
            FROM a JOIN orders USING (o_orderkey)),
    adv AS (SELECT *, reward - avg(reward) OVER (PARTITION BY o_custkey) AS advantage FROM r)
"""


def _rewarded(spark, sf_dir):
    answers = worked_answers(spark, sf_dir)
    return answers.select(
        "o_orderkey", "o_custkey",
        rollouts.reward(F.col("reference"), F.col("completion")).alias("reward"),
        F.length("completion").alias("n_tokens"),
    )


@query(
    "rewards_advantage",
    _REWARD_SQL + "SELECT o_orderkey, o_custkey, reward, round(advantage, 9) AS advantage FROM adv",
)
def rewards_advantage(spark, sf_dir):
    rows = rollouts.advantages(_rewarded(spark, sf_dir).drop("n_tokens"), "o_custkey")
    return rows.withColumn("advantage", F.round("advantage", 9))


@query(
    "rollout_means",
    _REWARD_SQL
    + """
    , t AS (
      SELECT o_custkey % 5 AS step, o_custkey % 4 AS rank, o_custkey, reward, length(o_orderpriority) AS n_tokens
      FROM r JOIN orders USING (o_orderkey, o_custkey)),
    e AS (SELECT step, rank, o_custkey, avg(reward) AS rw, sum(n_tokens) AS tk, count(*) AS n FROM t GROUP BY ALL),
    k AS (SELECT step, rank, avg(rw) AS rw, sum(tk) / sum(n) AS ln FROM e GROUP BY ALL)
    SELECT step, round(avg(rw), 9) AS mean_reward, round(avg(ln), 9) AS mean_length FROM k GROUP BY step
    """,
)
def rollout_means(spark, sf_dir):
    lengths = table(spark, sf_dir, "orders").select("o_orderkey", F.length("o_orderpriority").alias("n_tokens"))
    samples = (
        _rewarded(spark, sf_dir)
        .drop("n_tokens")
        .join(lengths, "o_orderkey")
        .withColumn("step", F.col("o_custkey") % 5)
        .withColumn("rank", F.col("o_custkey") % 4)
    )
    means = rollouts.step_means(samples, "step", "rank", "o_custkey")
    return means.select(
        "step", F.round("mean_reward", 9).alias("mean_reward"), F.round("mean_length", 9).alias("mean_length")
    )


@query(
    "rollout_targets",
    chats._FOLD_SQL
    + chats._MARKER_SQL
    + """
    , g AS (SELECT *, conv_id // 4 AS prompt, max(len(tokens)) OVER (PARTITION BY conv_id // 4) AS longest FROM conv),
    p AS (SELECT conv_id, prompt, list_concat(tokens, list_transform(range(0, longest - len(tokens)), lambda x: 1200004::BIGINT)) AS t,
                 list_concat(mask, list_transform(range(0, longest - len(tokens)), lambda x: 0)) AS m FROM g)
    SELECT conv_id, prompt, (len(t) - 1)::BIGINT AS n_targets,
           md5(array_to_string(list_transform(list_zip(t[2:], m[2:]), lambda p: CASE WHEN p[2] = 0 THEN -1 ELSE p[1] END), ',')) AS targets_md5
    FROM p
    """,
)
def rollout_targets(spark, sf_dir):
    rendered = render.render(chats.turns_of(spark, sf_dir), chats.MARKERS)
    samples = rendered.withColumn("prompt", F.floor(F.col("conv_id") / 4))
    out = rollouts.targets(samples, "prompt", chats.MARKER_IDS["<|assistant_end|>"])
    return out.select(
        "conv_id",
        "prompt",
        F.size("targets").cast("bigint").alias("n_targets"),
        F.md5(F.array_join("targets", ",")).alias("targets_md5"),
    )


@query(
    "pg_objective",
    _REWARD_SQL
    + f"""
    , k AS (
      SELECT l_orderkey AS o_orderkey, -{unit("'logp'", 'l_orderkey', 'l_linenumber')} AS logp,
             {h60("'mask'", 'l_orderkey', 'l_linenumber')} % 5 <> 0 AS valid FROM lineitem)
    SELECT o_custkey, (o_orderkey % 2)::BIGINT AS pass_no, count(*) FILTER (valid)::BIGINT AS n_valid,
           round(sum(CASE WHEN valid THEN logp * advantage ELSE 0 END) / (greatest(1, count(*) FILTER (valid)) * 2 * 4), 9) AS objective
    FROM k JOIN adv USING (o_orderkey) GROUP BY ALL
    """,
)
def pg_objective(spark, sf_dir):
    tokens = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.when(hash60(F.lit("mask"), "l_orderkey", "l_linenumber") % 5 == 0, -1).otherwise(1).alias("target"),
        (-unit_hash(F.lit("logp"), "l_orderkey", "l_linenumber")).alias("logp"),
    )
    samples = rollouts.advantages(_rewarded(spark, sf_dir), "o_custkey").withColumn(
        "pass_no", (F.col("o_orderkey") % 2).cast("bigint")
    )
    out = rollouts.objective(tokens, samples, "o_orderkey", ["o_custkey", "pass_no"], n_passes=2, n_examples=4)
    return out.withColumn("objective", F.round("objective", 9))


@query(
    "sample_stop",
    f"""
    WITH d AS (SELECT doc_id, {pieces('text')} AS p FROM documents),
    s AS (SELECT doc_id, p, least(nullif(list_position(p[4:], '.'), 0), nullif(list_position(p[4:], ','), 0)) AS hit FROM d),
    c AS (SELECT doc_id, CASE WHEN hit IS NULL THEN p ELSE p[1:3 + hit - 1] END AS kept FROM s)
    SELECT doc_id, len(kept)::BIGINT AS n_kept, len(kept)::BIGINT AS n_mask, md5(array_to_string(kept, '|')) AS kept_md5 FROM c
    """,
)
def sample_stop(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    tokens = docs.select("doc_id", pretokens(F.col("text")).alias("tokens"))
    mask = F.transform("tokens", lambda t, i: F.when(i < 3, 0).otherwise(1))
    # Full stop and comma play the two terminal tokens; the prompt is three tokens.
    kept = rollouts.stop_at(F.col("tokens"), mask, 3, [".", ","])
    return tokens.select("doc_id", kept.alias("s")).select(
        "doc_id",
        F.size("s.tokens").cast("bigint").alias("n_kept"),
        F.size("s.mask").cast("bigint").alias("n_mask"),
        F.md5(F.array_join("s.tokens", "|")).alias("kept_md5"),
    )
