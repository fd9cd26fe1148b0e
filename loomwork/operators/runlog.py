"""Training-log and report analytics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomwork.operators.running import null_safe_join, running, with_ordinal
from loomwork.session import stored

# --- log lines -------------------------------------------------------------

# Field, pattern and type of one training log line.
STEP_FIELDS = {
    "step": (r"^step (\d+)/", "bigint"),
    "planned": (r"^step \d+/(\d+)", "bigint"),
    "pct": (r"\(([\d.]+)%\)", "double"),
    "loss": (r"\| loss: (-?[\d.]+)", "double"),
    "lrm": (r"\| lrm: ([\d.]+)", "double"),
    "dt_ms": (r"\| dt: ([\d.]+)ms", "double"),
    "tok_per_sec": (r"\| tok/sec: ([\d,]+)", "bigint"),
    "mfu": (r"\| bf16_mfu: ([\d.]+)", "double"),
    "epoch": (r"\| epoch: (\d+)", "bigint"),
    "pq": (r" pq: (\d+)", "bigint"),
    "rg": (r" rg: (\d+)", "bigint"),
    "total_min": (r"\| total time: ([\d.]+)m", "double"),
    "eta_min": (r"\| eta: ([\d.]+)m", "double"),
}


def _number(line: Column, pattern: str, kind: str) -> Column:
    """First match as a number, thousands separators removed; null when absent."""
    found = F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
    return F.replace(found, F.lit(","), F.lit("")).try_cast(kind)


def parse_steps(lines: DataFrame, column: str = "line") -> DataFrame:
    """One row per step line; other lines are passed over."""
    kept = lines.filter(F.col(column).rlike(r"^step \d+/\d+ "))
    return kept.select(
        *[c for c in lines.columns if c != column],
        *[_number(F.col(column), pattern, kind).alias(name) for name, (pattern, kind) in STEP_FIELDS.items()],
    )


# Named lines of a run log.
SUMMARY_FIELDS = {
    "params_wte": (r"^wte .*?([\d,]+)", "bigint"),
    "params_value_embeds": (r"^value_embeds .*?([\d,]+)", "bigint"),
    "params_lm_head": (r"^lm_head .*?([\d,]+)", "bigint"),
    "params_transformer": (r"^transformer_matrices .*?([\d,]+)", "bigint"),
    "params_scalars": (r"^scalars .*?([\d,]+)", "bigint"),
    "params_total": (r"^total .*?([\d,]+)", "bigint"),
    "num_iterations": (r"Calculated number of iterations.*: ([\d,]+)", "bigint"),
    "batch_size": (r"Total batch size ([\d,]+)", "bigint"),
    "val_bpb": (r"Validation bpb:.*?([\d.]+)$", "double"),
    "core_score": (r"CORE metric:.*?(\S+)$", "double"),
}


def last_values(lines: DataFrame, file: str, order: str, column: str = "line") -> DataFrame:
    """Per log, the last value of every named line; a missing CORE score is 0.0.

    ``max_by`` merges partially, so a long log is never sorted or gathered.
    """
    aggregates = []
    for name, (pattern, kind) in SUMMARY_FIELDS.items():
        value = _number(F.col(column), pattern, kind)
        last = F.max_by(value, F.when(F.col(column).rlike(pattern), F.col(order)))
        aggregates.append((F.coalesce(last, F.lit(0.0)) if name == "core_score" else last).alias(name))
    return lines.groupBy(file).agg(*aggregates)


def sweep_table(values: DataFrame, depth: Column, elapsed: Column) -> DataFrame:
    """Sweep columns derived from the last values."""
    tokens = F.col("num_iterations") * F.col("batch_size")
    scaling = F.col("params_transformer") + F.col("params_lm_head")
    return values.select(
        "*",
        depth.alias("depth"),
        (depth * 64).alias("model_dim"),
        tokens.alias("tokens_trained"),
        F.round(tokens / F.nullif(scaling, F.lit(0)), 2).alias("token_param_ratio"),
        elapsed.alias("train_time_sec"),
    )


# --- series ----------------------------------------------------------------

def exponential_average(
    rows: DataFrame, run: str, key: str, value: str, beta: float = 0.9, out: str = "ema"
) -> DataFrame:
    """Append ``step`` and the debiased exponential average of ``value`` per run.

    The recurrence is linear, so a run is cut into blocks of up to 256 steps: inside
    a block it is a weighted running sum, and a block adds its carry, which is the
    same recurrence one level up with ``beta ** block``. No run is held in one task.
    """
    steps = stored(with_ordinal(rows, key, "step", by=[run]), "steps")
    raw = decayed_sum(steps, run, "step", value, beta)
    return raw.withColumn(
        out, (1 - beta) * F.col("__state") / (1 - F.pow(F.lit(beta), F.col("step") + 1))
    ).drop("__state")


def decayed_sum(rows: DataFrame, run: str, step: str, value: str, beta: float) -> DataFrame:
    """Append ``__state``: sum of beta**(t-i) * value_i over i <= t, steps dense from 0."""
    # Weights inside a block stay below e^40, so values up to 1e290 cannot overflow.
    size = max(2, min(256, int(40 / -math.log(beta)))) if beta > 0 else 2
    staged = rows.withColumn("__b", F.floor(F.col(step) / size)).withColumn("__i", F.col(step) % size)
    inside = Window.partitionBy(run, "__b").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    grown = F.pow(F.lit(1 / beta), F.col("__i")) * F.col(value)
    local = F.pow(F.lit(beta), F.col("__i")) * F.sum(grown).over(inside)
    staged = staged.withColumn("__local", local)

    ends = staged.filter(F.col("__i") == size - 1).select(
        F.col(run), F.col("__b").alias("__step"), F.col("__local").alias("__end")
    )
    outer = beta**size
    if outer < 1e-3:
        # A block reaches as far as its weight is a double above zero: a few dozen blocks.
        reach = F.explode(F.sequence(F.lit(0), F.lit(int(745 / -math.log(max(outer, 1e-300))) + 1)))
        told = ends.select(F.col(run), "__step", "__end", reach.alias("__d"))
        carry = told.groupBy(run, (F.col("__step") + F.col("__d") + 1).alias("__b")).agg(
            F.sum(F.col("__end") * F.pow(F.lit(outer), F.col("__d"))).alias("__carry")
        )
    else:
        carried = decayed_sum(ends, run, "__step", "__end", outer)
        carry = carried.select(F.col(run), (F.col("__step") + 1).alias("__b"), F.col("__state").alias("__carry"))
    joined = staged.join(carry, [run, "__b"], "left")
    state = F.col("__local") + F.pow(F.lit(beta), F.col("__i") + 1) * F.coalesce("__carry", F.lit(0.0))
    return joined.withColumn("__state", state).drop("__b", "__i", "__local", "__carry")


def running_minimum(rows: DataFrame, run: str, key: str, value: str, out: str = "best") -> DataFrame:
    return running(rows, key, {out: ("min", F.col(value))}, by=[run])


def throughput(
    rows: DataFrame, run: str, key: str, dt: str, batch_tokens: int, flops_per_token: float, peak_flops: float
) -> DataFrame:
    """Per step: percent done, tokens and FLOP per second, MFU, counted time, ETA.

    Time counts only after step 10, and the ETA uses the mean step of that time.
    """
    steps = with_ordinal(rows, key, "step", by=[run])
    planned = steps.groupBy(run).agg(F.count(F.lit(1)).alias("planned"))
    counted = F.when(F.col("step") > 10, F.col(dt)).otherwise(0.0)
    timed = null_safe_join(running(steps, key, {"total_time": ("sum", counted)}, by=[run]), planned, [run])
    seconds = F.nullif(F.col(dt), F.lit(0.0))
    flops = flops_per_token * batch_tokens / seconds
    after = F.col("step") - 10
    eta = F.when(after > 0, (F.col("planned") - F.col("step")) * F.col("total_time") / F.nullif(after, F.lit(0)))
    return timed.select(
        *rows.columns,
        "step",
        (100 * F.col("step") / F.col("planned")).alias("pct_done"),
        F.floor(batch_tokens / seconds).alias("tok_per_sec"),
        flops.alias("flops_per_sec"),
        (100 * flops / peak_flops).alias("mfu"),
        "total_time",
        eta.alias("eta_sec"),
    )


# Alias -> source names, the first present one wins.
ALIASES = {
    "mfu": ("mfu", "device/mfu"),
    "batches_per_sec": ("batches_per_sec", "throughput/device/batches_per_sec", "device/batches_per_sec"),
    "samples_per_sec": ("samples_per_sec", "throughput/device/samples_per_sec", "device/samples_per_sec"),
    "items_per_sec": ("items_per_sec", "throughput/device/items_per_sec", "device/items_per_sec"),
    "flops_per_sec": ("flops_per_sec", "throughput/device/flops_per_sec", "device/flops_per_sec"),
    "tokens_per_sec": ("tokens_per_sec", "device/tokens_per_sec", "throughput/device/tokens_per_sec"),
}


def with_aliases(metrics: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """Common names for metrics, plus two derived ones where their inputs exist."""
    present = set(metrics.columns)
    out = metrics
    for alias, sources in ALIASES.items():
        found = [F.col(f"`{s}`") for s in sources if s in present]
        if found:
            out = out.withColumn(alias, F.coalesce(*found))
    if {"tokens", "iter_time"} <= present:
        derived = F.when(F.col("iter_time") > 0, F.col("tokens") / F.nullif(F.col("iter_time"), F.lit(0.0)))
        known = [F.col("tokens_per_sec")] if "tokens_per_sec" in out.columns else []
        out = out.withColumn("tokens_per_sec", F.coalesce(*known, derived))
    if max_tokens and "total_tokens" in present:
        share = 100.0 * F.col("total_tokens") / max_tokens
        known = [F.col("percent_of_token_budget")] if "percent_of_token_budget" in present else []
        out = out.withColumn("percent_of_token_budget", F.coalesce(*known, share))
    return out


# --- reports ---------------------------------------------------------------


def report_lines(sections: DataFrame, section: str, values: Mapping[str, Column]) -> DataFrame:
    """(section, key, value): floats with four places, integers from 10,000 grouped."""
    kinds = dict(sections.select(*[c.alias(k) for k, c in values.items()]).dtypes)

    def shown(name: str, value: Column) -> Column:
        if kinds[name] in ("double", "float"):
            return F.format_string("%.4f", value)
        if kinds[name] in ("int", "bigint"):
            return F.when(value >= 10_000, F.format_number(value, 0)).otherwise(value.cast("string"))
        return value.cast("string")

    entries = F.array(
        *[F.struct(F.lit(k).alias("key"), shown(k, c).alias("value")) for k, c in values.items()]
    )
    return sections.select(section, F.inline(entries))


def extract_keys(lines: DataFrame, keys: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """(group, key, value): text after the first colon on the last line naming the key.

    Keys are a short list, held as one array next to each line instead of a join.
    """
    wanted = [r["key"] for r in keys.select("key").collect()]
    hits = lines.select(
        *group, order, "line", F.explode(F.filter(F.array(*[F.lit(k) for k in wanted]), lambda k: F.col("line").contains(k))).alias("key")
    )
    value = F.trim(F.get(F.split("line", ":"), F.lit(1)))
    return hits.groupBy(*group, "key").agg(F.max_by(value, order).alias("value"))


def summary_table(metrics: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Metric by stage, '-' where missing; CORE first, ChatCORE last (``sort_key``)."""
    wide = metrics.groupBy("metric").pivot("stage", list(stages)).agg(F.max("value"))
    place = F.when(F.col("metric") == "CORE", 0).when(F.col("metric") == "ChatCORE", 2).otherwise(1)
    return wide.na.fill("-").withColumn("sort_key", F.concat_ws("|", place.cast("string"), "metric"))


def wall_clock(stamps: DataFrame) -> DataFrame:
    """One row: hours and minutes from the start stamp to the last non-RL section.

    ``stamps`` has (section, stamp) with the text form ``yyyy-MM-dd HH:mm:ss``; the
    start has section ``header``.
    """
    at = F.try_to_timestamp("stamp", F.lit("yyyy-MM-dd HH:mm:ss"))
    start = F.max(F.when(F.col("section") == "header", at))
    end = F.max(F.when((F.col("section") != "header") & ~F.lower("section").contains("rl"), at))
    return stamps.agg(start.alias("s"), end.alias("e")).select(
        (F.unix_timestamp("e") - F.unix_timestamp("s")).alias("seconds")
    ).select(
        F.floor(F.col("seconds") / 3600).alias("hours"),
        F.floor((F.col("seconds") % 3600) / 60).alias("minutes"),
    )
