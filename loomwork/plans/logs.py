"""Queries about run logs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions.text import hash60
from loomwork.operators import runlog
from loomwork.plans.registry import query, table
from loomwork.plans.sqltext import h60


def step_lines(spark, sf_dir):
    """Log lines written from events; error events give a line of another kind."""
    events = table(spark, sf_dir, "events")
    e = F.col("event_id")
    line = F.format_string(
        "step %05d/%05d (%.2f%%) | loss: %.6f | lrm: %.2f | dt: %.2fms | tok/sec: %s | bf16_mfu: %.2f"
        " | epoch: %d pq: %d rg: %d | total time: %.2fm",
        e, e + 1000, (e % 10_001) / 100, F.col("value"), (e % 100) / 100, F.col("value") * 10,
        F.format_number(e * 13 + 1, 0), (e % 1000) / 100, e % 3 + 1, e % 7, e % 11, (e % 5000) / 100,
    )
    eta = F.when(e > 10, F.format_string(" | eta: %.1fm", (e % 997) / 10)).otherwise("")
    return events.select(
        "event_id",
        F.when(F.col("event_type") == "error", F.concat(F.lit("WARNING at step "), e)).otherwise(
            F.concat(line, eta)
        ).alias("line"),
    )


@query(
    "log_parse",
    """
    SELECT event_id, event_id AS step, event_id + 1000 AS planned, (event_id % 10001) / 100 AS pct, value AS loss,
           (event_id % 100) / 100 AS lrm, round(value * 10, 2) AS dt_ms, event_id * 13 + 1 AS tok_per_sec,
           (event_id % 1000) / 100 AS mfu, event_id % 3 + 1 AS epoch, event_id % 7 AS pq, event_id % 11 AS rg,
           (event_id % 5000) / 100 AS total_min, CASE WHEN event_id > 10 THEN (event_id % 997) / 10 END AS eta_min
    FROM events WHERE event_type <> 'error'
    """,
)
def log_parse(spark, sf_dir):
    return runlog.parse_steps(step_lines(spark, sf_dir))


def _run_logs(spark, sf_dir):
    """Named log lines per user, one for each event; few users get a CORE line."""
    e = F.col("event_id")
    kind = F.col("event_type")
    number = F.format_number(e * 1000 + 7, 0)
    line = (
        F.when(kind == "view", F.concat(F.lit("transformer_matrices    : "), number))
        .when((kind == "click") & (e % 2 == 0), F.concat(F.lit("lm_head                 : "), number))
        .when(kind == "click", F.concat(F.lit("total                   : "), number))
        .when(kind == "signup", F.concat(F.lit("Calculated number of iterations from target: "), F.format_number(e + 1, 0)))
        .when((kind == "purchase") & (e % 2 == 0), F.concat(F.lit("Total batch size "), number, F.lit(" => steps: 1")))
        .when(kind == "purchase", F.concat(F.lit("Step 9 | Validation bpb: "), F.format_string("%.4f", (e % 10_000) / 10_000)))
        .when(F.col("user_id") % 3 == 0, F.concat(F.lit("Step 9 | CORE metric: "), F.format_string("%.4f", (e % 100) / 100)))
        .otherwise(F.lit("total time: 3m"))
    )
    return table(spark, sf_dir, "events").select("user_id", "event_id", line.alias("line"))


_LAST_SQL = """
    WITH v AS (
      SELECT user_id,
        max(CASE WHEN event_type = 'view' THEN event_id END) * 1000 + 7 AS params_transformer,
        max(CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN event_id END) * 1000 + 7 AS params_lm_head,
        CASE WHEN max(CASE WHEN event_type = 'error' AND user_id % 3 <> 0 THEN event_id END)
                  > coalesce(max(CASE WHEN event_type = 'click' AND event_id % 2 = 1 THEN event_id END), -1)
             THEN 3 ELSE max(CASE WHEN event_type = 'click' AND event_id % 2 = 1 THEN event_id END) * 1000 + 7 END AS params_total,
        max(CASE WHEN event_type = 'signup' THEN event_id END) + 1 AS num_iterations,
        max(CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN event_id END) * 1000 + 7 AS batch_size,
        max(CASE WHEN event_type = 'purchase' AND event_id % 2 = 1 THEN event_id END) % 10000 / 10000 AS val_bpb,
        coalesce(max(CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN event_id END) % 100 / 100, 0.0) AS core_score
      FROM events GROUP BY user_id)
"""


@query(
    "log_last_value",
    _LAST_SQL
    + """
    SELECT user_id, coalesce(params_transformer, -1) AS params_transformer, coalesce(params_lm_head, -1) AS params_lm_head,
           coalesce(params_total, -1) AS params_total, coalesce(num_iterations, -1) AS num_iterations,
           coalesce(batch_size, -1) AS batch_size, val_bpb, core_score FROM v
    """,
)
def log_last_value(spark, sf_dir):
    last = runlog.last_values(_run_logs(spark, sf_dir), "user_id", "event_id")
    counts = ("params_transformer", "params_lm_head", "params_total", "num_iterations", "batch_size")
    return last.select("user_id", *counts, "val_bpb", "core_score").na.fill(-1, list(counts))


@query(
    "sweep_table",
    _LAST_SQL
    + """
    SELECT user_id, user_id % 30 + 1 AS depth, (user_id % 30 + 1) * 64 AS model_dim,
           coalesce(num_iterations * batch_size, -1) AS tokens_trained,
           round(num_iterations * batch_size / (params_transformer + params_lm_head), 2) AS token_param_ratio,
           user_id * 10 AS train_time_sec
    FROM v
    """,
)
def sweep_table(spark, sf_dir):
    last = runlog.last_values(_run_logs(spark, sf_dir), "user_id", "event_id")
    table_ = runlog.sweep_table(last, F.col("user_id") % 30 + 1, F.col("user_id") * 10)
    return table_.select(
        "user_id", "depth", "model_dim", "tokens_trained", "token_param_ratio", "train_time_sec"
    ).na.fill(-1, ["tokens_trained"])


def losses_of(spark, sf_dir):
    """An event's value stands for a training loss, its user for a run."""
    return table(spark, sf_dir, "events").select("user_id", "event_id", "value")


@query(
    "ema_loss",
    """
    WITH s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step FROM events)
    SELECT a.user_id, a.event_id, a.step::BIGINT AS step,
           round(sum(0.1 * pow(0.9, a.step - b.step) * b.value) / (1 - pow(0.9, a.step + 1)), 6) AS ema
    FROM s a JOIN s b ON a.user_id = b.user_id AND b.step <= a.step GROUP BY a.user_id, a.event_id, a.step
    """,
)
def ema_loss(spark, sf_dir):
    averaged = runlog.exponential_average(losses_of(spark, sf_dir), "user_id", "event_id", "value")
    return averaged.select("user_id", "event_id", "step", F.round("ema", 6).alias("ema"))


@query(
    "running_min",
    """
    SELECT user_id, event_id, min(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best FROM events
    """,
)
def running_min(spark, sf_dir):
    return runlog.running_minimum(losses_of(spark, sf_dir), "user_id", "event_id", "value").drop("value")


@query(
    "throughput",
    """
    WITH s AS (
      SELECT user_id, event_id, value / 97 AS dt, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step,
             count(*) OVER (PARTITION BY user_id) AS planned FROM events),
    t AS (SELECT *, sum(CASE WHEN step > 10 THEN dt ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS total FROM s)
    SELECT user_id, event_id, step::BIGINT AS step, round(100 * step / planned, 6) AS pct_done,
           coalesce(floor(524288 / nullif(dt, 0))::BIGINT, -1) AS tok_per_sec, round(100 * (6e9 * 524288 / nullif(dt, 0)) / 9.89e14, 6) AS mfu,
           round(total, 6) AS total_time,
           CASE WHEN step > 10 THEN round((planned - step) * total / (step - 10), 6) END AS eta_sec
    FROM t
    """,
)
def throughput(spark, sf_dir):
    rows = losses_of(spark, sf_dir).select("user_id", "event_id", (F.col("value") / 97).alias("dt"))
    out = runlog.throughput(rows, "user_id", "event_id", "dt", 524_288, 6e9, 9.89e14)
    return out.select(
        "user_id", "event_id", "step", "tok_per_sec",
        *[F.round(c, 6).alias(c) for c in ("pct_done", "mfu", "total_time", "eta_sec")],
    ).na.fill(-1, ["tok_per_sec"])


@query(
    "metric_aliases",
    """
    WITH m AS (
      SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS a, CASE WHEN event_id % 2 = 0 THEN value * 2 END AS b,
             event_id * 10.0::DOUBLE AS total_tokens, value AS tokens, (event_id % 4)::DOUBLE AS iter_time FROM events)
    SELECT event_id, a AS mfu, b AS samples_per_sec,
           round(CASE WHEN iter_time > 0 THEN tokens / iter_time END, 6) AS tokens_per_sec,
           round(100 * total_tokens / 5000000, 6) AS percent_of_token_budget
    FROM m
    """,
)
def metric_aliases(spark, sf_dir):
    metrics = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("device/mfu"),
        F.when(F.col("event_id") % 2 == 0, F.col("value") * 2).alias("throughput/device/samples_per_sec"),
        (F.col("event_id") * 10.0).alias("total_tokens"),
        F.col("value").alias("tokens"),
        (F.col("event_id") % 4).cast("double").alias("iter_time"),
    )
    named = runlog.with_aliases(metrics, max_tokens=5_000_000)
    return named.select(
        "event_id", "mfu", "samples_per_sec",
        F.round("tokens_per_sec", 6).alias("tokens_per_sec"),
        F.round("percent_of_token_budget", 6).alias("percent_of_token_budget"),
    )


def _nation_report(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    per_customer = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total")
    )
    joined = per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(
        F.sum("n").alias("orders"),
        F.sum("total").alias("total"),
    )
    named = nations.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("section"))
    return joined.join(named, "c_nationkey")


_NATION_SQL = """
    WITH r AS (
      SELECT n_name AS section, count(*) AS orders, sum(o_totalprice::DECIMAL(18,2)) AS total
      FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name)
"""


@query(
    "report_long",
    _NATION_SQL
    + """
    SELECT section, 'orders' AS key, CASE WHEN orders >= 10000 THEN format('{:,}', orders) ELSE orders::VARCHAR END AS value FROM r
    UNION ALL SELECT section, 'share', printf('%.4f', orders / 8) FROM r
    UNION ALL SELECT section, 'cents', CASE WHEN total >= 100 THEN format('{:,}', (total * 100)::BIGINT) ELSE (total * 100)::BIGINT::VARCHAR END FROM r
    UNION ALL SELECT section, 'name', section FROM r
    """,
)
def report_long(spark, sf_dir):
    rows = _nation_report(spark, sf_dir)
    return runlog.report_lines(
        rows,
        "section",
        {
            "orders": F.col("orders"),
            "share": F.col("orders") / 8,
            "cents": (F.col("total") * 100).cast("bigint"),
            "name": F.col("section"),
        },
    )


@query(
    "report_extract",
    """
    WITH l AS (
      SELECT user_id, event_id, event_type, value FROM events WHERE event_type IN ('view', 'click', 'purchase')),
    v AS (
      SELECT user_id, 'CORE' AS key, event_id, value FROM l WHERE event_type = 'view'
      UNION ALL SELECT user_id, 'CORE', event_id, value FROM l WHERE event_type = 'click'
      UNION ALL SELECT user_id, 'ChatCORE', event_id, value FROM l WHERE event_type = 'click')
    SELECT user_id, key, arg_max(printf('%.2f', value), event_id) AS value FROM v GROUP BY ALL
    """,
)
def report_extract(spark, sf_dir):
    # "CORE" also occurs inside "ChatCORE", as a plain substring match has it.
    label = (
        F.when(F.col("event_type") == "view", "- CORE metric: ")
        .when(F.col("event_type") == "click", "- ChatCORE metric: ")
        .otherwise("- loss: ")
    )
    lines = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.concat(label, F.format_string("%.2f", "value"), F.lit(": end")).alias("line")
    )
    keys = spark.createDataFrame([("CORE",), ("ChatCORE",)], "key string")
    return runlog.extract_keys(lines, keys, ["user_id"], "event_id")


@query(
    "report_pivot",
    f"""
    WITH m AS (
      SELECT CASE r_regionkey WHEN 0 THEN 'CORE' WHEN 1 THEN 'ChatCORE' ELSE r_name END AS metric,
             CASE {h60('n_nationkey')} % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'sft' ELSE 'rl' END AS stage,
             printf('%06d', count(*)) AS value
      FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
      GROUP BY r_regionkey, r_name, n_nationkey)
    SELECT metric, coalesce(max(CASE WHEN stage = 'base' THEN value END), '-') AS base,
           coalesce(max(CASE WHEN stage = 'sft' THEN value END), '-') AS sft,
           coalesce(max(CASE WHEN stage = 'rl' THEN value END), '-') AS rl,
           CASE metric WHEN 'CORE' THEN '0' WHEN 'ChatCORE' THEN '2' ELSE '1' END || '|' || metric AS sort_key
    FROM m GROUP BY metric
    """,
)
def report_pivot(spark, sf_dir):
    per_nation = table(spark, sf_dir, "customer").groupBy("c_nationkey").count()
    nations = table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region")
    joined = per_nation.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(
        regions, F.col("n_regionkey") == F.col("r_regionkey")
    )
    stage = hash60("n_nationkey") % 3
    metrics = joined.select(
        F.when(F.col("r_regionkey") == 0, "CORE").when(F.col("r_regionkey") == 1, "ChatCORE")
        .otherwise(F.col("r_name")).alias("metric"),
        F.when(stage == 0, "base").when(stage == 1, "sft").otherwise("rl").alias("stage"),
        F.format_string("%06d", "count").alias("value"),
    )
    return runlog.summary_table(metrics, ["base", "sft", "rl"])


@query(
    "report_wall_clock",
    """
    WITH s AS (
      SELECT min(o_orderdate) AS a, max(CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate END) AS b FROM orders)
    SELECT (epoch(b)::BIGINT - epoch(a)::BIGINT) // 3600 AS hours,
           ((epoch(b)::BIGINT - epoch(a)::BIGINT) % 3600) // 60 AS minutes
    FROM s
    """,
)
def report_wall_clock(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    shown = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    sections = orders.select(
        F.when(F.col("o_orderpriority") == "1-URGENT", "chat rl").otherwise(F.col("o_orderpriority")).alias("section"),
        shown.alias("stamp"),
    )
    start = orders.agg(F.min(shown).alias("stamp")).select(F.lit("header").alias("section"), "stamp")
    return runlog.wall_clock(sections.unionByName(start))
