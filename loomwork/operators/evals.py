"""Evaluation metrics over tables of prompts, losses, predictions and samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loomwork.functions.text import bind, hash60, strip
from loomwork.operators.running import hash_block, null_safe_join, top_rows, with_ordinal

# Fixed value: first part of the seed of few-shot draws.
FEWSHOT_SEED = 1234
# Primes above any number of items, so that a stride meets each distance once.
STRIDES = (2147483659, 2147483693, 2147483713, 2147483743, 2147483777, 2147483783, 2147483813, 2147483857)


# --- bits per byte ---------------------------------------------------------


def bits_per_byte(losses: DataFrame, token_bytes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, nats, n_bytes, bpb) from (by, target, loss) and (token_id, n_bytes).

    Targets below zero are ignored, as are tokens of zero bytes. Losses are summed per
    target first, so what meets the byte lengths is as small as the vocabulary.
    """
    # Not filtered before the sums: Spark would work out the target's expression twice per row.
    totals = losses.groupBy(*by, F.col("target").alias("token_id")).agg(
        F.sum("loss").alias("loss"), F.count(F.lit(1)).alias("__n")
    )
    # No hint: a stored vocabulary is broadcast by its file size, a large one is not.
    joined = totals.join(token_bytes, "token_id", "left")
    scored = F.coalesce(F.col("token_id") >= 0, F.lit(False))
    missing = F.raise_error(F.concat(F.lit("no byte length for token "), F.col("token_id").cast("string")))
    known = F.when(F.col("n_bytes").isNull(), missing.cast("bigint")).otherwise(F.col("n_bytes"))
    joined = joined.withColumn("n_bytes", F.when(scored, known).otherwise(F.lit(0)))
    sums = joined.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("n_bytes") > 0, F.col("loss"))), F.lit(0.0)).alias("nats"),
        F.coalesce(F.sum(F.col("n_bytes") * F.col("__n")), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.count_if(scored).alias("__scored"),
    )
    if by:
        sums = sums.filter("__scored > 0")
    sums = sums.drop("__scored")
    bpb = F.when(F.col("n_bytes") == 0, F.lit(float("inf"))).otherwise(
        F.col("nats") / (F.lit(math.log(2)) * F.nullif(F.col("n_bytes"), F.lit(0)))
    )
    return sums.withColumn("bpb", bpb)


def rows_in_budget(tokens: int, batch: int, length: int, world: int) -> int:
    """Packed rows scored for a token budget: whole steps only."""
    return tokens // (batch * length * world) * batch * world


# --- few-shot prompts ------------------------------------------------------


def fewshot_draw(items: DataFrame, key: str, n_shots: int, task: str = "task") -> DataFrame:
    """(task, key, shot_no, shot_key): distinct others per item, never itself.

    Items are ranked in hash order and each draws the ranks at seeded, distinct
    distances ahead of its own, a seeded stride apart, so drawing is an equi-join on
    (task, rank). Without shots the table is empty.
    """
    if n_shots < 1:
        return items.select(task, key, F.lit(0).cast("bigint").alias("shot_no"), F.col(key).alias("shot_key")).limit(0)
    keyed = items.select(task, key, hash60(F.lit("shots"), key).alias("__h"))
    ranked = with_ordinal(keyed, "__h", "rank", by=[task], block=hash_block(items.sparkSession, "__h"), ties=[key])
    sizes = items.groupBy(task).agg(F.count(F.lit(1)).alias("n"))
    placed = null_safe_join(ranked, sizes, [task])
    enough = F.when(F.col("n") <= n_shots, F.raise_error(F.lit("fewer items than shots"))).otherwise(F.col("n"))
    number = (F.col("rank") + FEWSHOT_SEED).cast("string")
    seed = hash60(number)
    stride = F.get(F.array(*[F.lit(s) for s in STRIDES]), F.pmod(hash60(F.lit("stride"), number), F.lit(len(STRIDES))).cast("int"))
    draws = placed.withColumn("n", enough).select(
        task, key, "rank", "n", seed.alias("seed"), stride.alias("stride"), F.explode(F.sequence(F.lit(1), F.lit(n_shots))).alias("shot_no")
    )
    distance = 1 + F.pmod(F.col("seed") + F.col("shot_no") * F.col("stride"), F.col("n") - 1)
    wanted = draws.withColumn("__rank", F.pmod(F.col("rank") + distance, F.col("n"))).drop("rank")
    others = ranked.select(F.col(task), F.col("rank").alias("__rank"), F.col(key).alias("shot_key"))
    return null_safe_join(wanted, others, [task, "__rank"]).select(
        task, key, F.col("shot_no").cast("bigint").alias("shot_no"), "shot_key"
    )


def shot_texts(draws: DataFrame, shots: DataFrame, key: str, task: str = "task") -> DataFrame:
    """(task, key, shots): example texts of each item, each followed by a blank line.

    Keys are those of a task: equal ones in two tasks are two items.
    """
    told = null_safe_join(draws, shots.withColumnRenamed(key, "shot_key"), [task, "shot_key"])
    ordered = F.array_sort(F.collect_list(F.struct("shot_no", "shot_text")))
    joined = F.array_join(
        F.transform(ordered, lambda s: F.concat(s["shot_text"], F.lit("\n\n"))), ""
    )
    return told.groupBy(task, key).agg(joined.alias("shots"))


def with_shots(items: DataFrame, draws: DataFrame, shot_text: Column, key: str, task: str = "task") -> DataFrame:
    """``items`` with their ``shots``, an empty text where an item draws none."""
    told = shot_texts(draws, items.select(task, key, shot_text.alias("shot_text")), key, task)
    return null_safe_join(items, told, [task, key], "left").fillna("", ["shots"])


def choice_prompts(query: Column, choices: Column, delimiter: str, shots: Column) -> Column:
    """One prompt per choice."""
    return F.transform(choices, lambda c: F.concat(shots, query, F.lit(delimiter), c))


def schema_prompts(contexts: Column, continuation: Column, delimiter: str, shots: Column) -> Column:
    """One prompt per context option, the continuation shared."""
    return F.transform(contexts, lambda c: F.concat(shots, c, F.lit(delimiter), continuation))


def language_prompts(context: Column, continuation: Column, delimiter: str, shots: Column) -> Column:
    """[without, with] continuation; the context is trimmed, the first one stripped."""
    start = F.concat(shots, strip(context), F.lit(delimiter))
    return F.array(strip(start), F.concat(start, continuation))


# --- scoring spans ---------------------------------------------------------


def common_length(sequences: Column, from_end: bool = False) -> Column:
    """Length of the prefix (or suffix) that all token arrays of a row share."""
    shortest = F.array_min(F.transform(sequences, lambda s: F.size(s)))

    def first_miss(first: Column) -> Column:
        def same_at(i: Column) -> Column:
            at = -i if from_end else i
            return F.forall(sequences, lambda s: F.try_element_at(s, at) == F.try_element_at(first, at))

        positions = F.sequence(F.lit(1), F.size(first))
        return F.array_position(F.transform(positions, same_at), False)

    # Only positions inside the shortest array can match in all of them.
    head = F.slice(F.get(sequences, F.lit(0)), F.lit(1), shortest)
    if from_end:
        head = F.slice(F.get(sequences, F.lit(0)), -shortest, shortest)
    miss = F.when(shortest > 0, bind(head, first_miss)).otherwise(F.lit(0))
    return F.when(miss > 0, miss - 1).otherwise(shortest).cast("int")


def spans(tokens: Column, kind: str) -> Column:
    """array<{tokens, start, end, fault}>: what to score, per option.

    ``multiple_choice`` starts at the common prefix, ``schema`` takes the common
    suffix, ``language_modelling`` scores the continuation of one prompt.
    """

    def span(t: Column, start: Column, fault: Column) -> Column:
        return F.struct(
            t.alias("tokens"), start.cast("int").alias("start"), F.size(t).alias("end"), fault.alias("fault")
        )

    fine = F.lit(None).cast("string")
    if kind == "multiple_choice":
        return bind(common_length(tokens), lambda n: F.transform(tokens, lambda t: span(t, n, fine)))
    if kind == "schema":
        suffix = common_length(tokens, from_end=True)
        return bind(suffix, lambda n: F.transform(tokens, lambda t: span(t, F.size(t) - n, fine)))
    if kind == "language_modelling":
        without, whole = F.get(tokens, F.lit(0)), F.get(tokens, F.lit(1))
        start = F.size(without)
        fault = F.when(
            (start >= F.size(whole)) | (F.slice(whole, F.lit(1), start) != without), "not_a_prefix"
        )
        return F.array(span(whole, start, fault))
    raise ValueError(f"unknown task kind: {kind}")


def crop_left(span: Column, max_tokens: int) -> Column:
    """Keep the last ``max_tokens`` tokens and move the span with them."""
    gone = F.greatest(F.size(span["tokens"]) - max_tokens, F.lit(0))
    kept = F.slice(span["tokens"], gone + 1, F.lit(max_tokens))
    start, end = span["start"] - gone, span["end"] - gone
    return F.struct(
        kept.alias("tokens"),
        start.alias("start"),
        end.alias("end"),
        F.coalesce(span["fault"], F.when((start < 0) | (end < 0), "cropped_into_span")).alias("fault"),
    )


# --- outcomes --------------------------------------------------------------


def option_choice(losses: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, predicted): option with the lowest mean loss over its span, first on ties.

    ``losses`` has (by, option, pos, loss, start, end); the loss at ``pos`` is that
    of the next token, so a span reads positions start-1 to end-2.
    """
    inside = losses.filter((F.col("pos") >= F.col("start") - 1) & (F.col("pos") < F.col("end") - 1))
    means = inside.groupBy(*by, "option").agg(F.avg("loss").alias("mean_loss"))
    return means.groupBy(*by).agg(
        F.min(F.struct("mean_loss", "option")).alias("best")
    ).select(*by, F.col("best.option").alias("predicted"), F.col("best.mean_loss").alias("mean_loss"))


def all_tokens_match(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, correct): every predicted token inside the span equals the next token."""
    inside = predictions.filter((F.col("pos") >= F.col("start") - 1) & (F.col("pos") < F.col("end") - 1))
    return inside.groupBy(*by).agg(F.bool_and(F.col("predicted_token") == F.col("next_token")).alias("correct"))


def centred(accuracy: Column, baseline: Column) -> Column:
    return (accuracy - baseline) / (1 - baseline)


def task_scores(outcomes: DataFrame, baselines: DataFrame, task: str = "task", percent: bool = True) -> DataFrame:
    """(task, accuracy, centred); baselines are (task, baseline)."""
    accuracy = outcomes.groupBy(task).agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))
    base = F.col("baseline") * 0.01 if percent else F.col("baseline")
    known = null_safe_join(accuracy, baselines, [task], "left")
    missing = F.raise_error(F.concat(F.lit("no baseline for task "), F.coalesce(F.col(task).cast("string"), F.lit("null"))))
    base = F.when(F.col("baseline").isNull(), missing.cast("double")).otherwise(base)
    return known.select(task, "accuracy", centred(F.col("accuracy"), base).alias("centred"))


def mean_centred(scores: DataFrame, required: Sequence[str] | None = None) -> DataFrame:
    """One row: the mean centred accuracy, null unless every required task is there."""
    value = F.avg("centred")
    n = F.count(F.lit(1))
    if required is not None:
        present = F.count_distinct(F.when(F.col("task").isin(*required), F.col("task")))
        value = F.when(present == len(required), F.avg(F.when(F.col("task").isin(*required), F.col("centred"))))
    return scores.agg(n.alias("n_tasks"), value.alias("metric"))


def categorical_outcomes(logits: DataFrame, allowed: DataFrame, problem: str) -> DataFrame:
    """(problem, predicted): best of the problem's own letters, first on ties.

    ``logits`` has (problem, letter, logit); ``allowed`` has (problem, letter, ord).
    """
    own = logits.join(allowed, [problem, "letter"])
    best = F.max_by("letter", F.struct(F.col("logit"), -F.col("ord")))
    return own.groupBy(problem).agg(best.alias("predicted"))


def any_passed(samples: DataFrame, problem: Sequence[str]) -> DataFrame:
    return samples.groupBy(*problem).agg(F.bool_or("correct").alias("passed"))


def pass_rate(samples: DataFrame, problem: str, max_problems: int | None = None) -> DataFrame:
    """One row: problems, passed, accuracy; optionally over the first problems by id."""
    outcomes = any_passed(samples, [problem])
    if max_problems is not None:
        outcomes = outcomes.orderBy(problem).limit(max_problems)
    n, passed = F.count(F.lit(1)), F.count_if("passed")
    return outcomes.agg(n.alias("n_problems"), passed.alias("n_passed"), (passed / n).alias("accuracy"))


def pass_at_k(samples: DataFrame, problem: str, order: str, k_max: int) -> DataFrame:
    """(k, pass_at_k) for k = 1..k_max: any of the first k samples correct.

    Only the first ``k_max`` samples of a problem can matter, and each map task
    trims to those before the shuffle.
    """
    first = top_rows(samples.select(problem, order, "correct"), [problem], [F.col(order)], k_max)
    window_rank = F.struct(F.col(order), F.col("correct"))
    ordered = first.groupBy(problem).agg(F.array_sort(F.collect_list(window_rank)).alias("s"))
    hit = ordered.select(F.array_position(F.col("s.correct"), True).alias("hit"))
    counts = hit.agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.count_if(F.col("hit").between(1, k)) for k in range(1, k_max + 1)]).alias("passed"),
    )
    return counts.select("n", F.posexplode("passed").alias("i", "p")).select(
        (F.col("i") + 1).cast("bigint").alias("k"), (F.col("p") / F.col("n")).alias("pass_at_k")
    )
