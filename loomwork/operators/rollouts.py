"""Rewards, advantages and reported objectives over stored samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loomwork.functions.text import bind
from loomwork.operators.chunking import pad_to_longest
from loomwork.operators.render import loss_targets
from loomwork.operators.running import null_safe_join
from loomwork.operators.tasks import same_answer


def reward(reference: Column, completion: Column) -> Column:
    return same_answer(reference, completion).cast("double")


def advantages(samples: DataFrame, prompt: str) -> DataFrame:
    """Append ``advantage``: reward less the mean over the prompt's samples.

    The mean is a partial aggregate joined back, which AQE can split on a hot
    prompt; a window would put all of its samples in one task.
    """
    means = samples.groupBy(prompt).agg(F.avg("reward").alias("__mean"))
    return (
        null_safe_join(samples, means, [prompt])
        .withColumn("advantage", F.col("reward") - F.col("__mean"))
        .drop("__mean")
    )


def targets(samples: DataFrame, group: str, pad: int) -> DataFrame:
    """Pad samples of a prompt to its longest and shift; -1 where the mask is 0."""
    padded = pad_to_longest(samples, group, pad)
    mask = F.concat("mask", F.array_repeat(F.lit(0), F.size("tokens") - F.col("n_real")))
    inputs, shifted = loss_targets(F.col("tokens"), F.col("full_mask"))
    return padded.withColumn("full_mask", mask).withColumn("inputs", inputs).withColumn("targets", shifted)


def step_means(samples: DataFrame, step: str, rank: str, example: str) -> DataFrame:
    """(step, mean_reward, mean_length): per example, then per rank, then over ranks."""
    per_example = samples.groupBy(step, rank, example).agg(
        F.avg("reward").alias("r"), F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")
    )
    per_rank = per_example.groupBy(step, rank).agg(
        F.avg("r").alias("r"), (F.sum("tokens") / F.sum("n")).alias("len")
    )
    return per_rank.groupBy(step).agg(F.avg("r").alias("mean_reward"), F.avg("len").alias("mean_length"))


def objective(
    token_logp: DataFrame, sample_advantage: DataFrame, sample: str, by: Sequence[str], n_passes: int, n_examples: int
) -> DataFrame:
    """(by, n_valid, objective): advantage-weighted log-probability per pass.

    ``token_logp`` has (sample, target, logp); targets below zero count for nothing.
    """
    valid = F.col("target") >= 0
    # Summed per sample before the join, which then moves one row per sample.
    per_sample = token_logp.groupBy(sample).agg(
        F.sum(F.when(valid, F.col("logp")).otherwise(0.0)).alias("logp"), F.count_if(valid).alias("valid")
    )
    joined = per_sample.join(sample_advantage.select(sample, *by, "advantage"), sample)
    n_valid = F.sum("valid")
    return joined.groupBy(*by).agg(
        n_valid.alias("n_valid"),
        (
            F.sum(F.col("logp") * F.col("advantage"))
            / (F.greatest(n_valid, F.lit(1)) * n_passes * n_examples)
        ).alias("objective"),
    )


def stop_at(tokens: Column, mask: Column, prefix: Column | int, terminals: Sequence) -> Column:
    """{tokens, mask}: a sample up to its first terminal token after the prompt."""
    prefix = F.lit(prefix) if isinstance(prefix, int) else prefix
    body = F.slice(tokens, prefix + 1, F.greatest(F.size(tokens) - prefix, F.lit(0)))
    stop = F.array(*[F.lit(t) for t in terminals])
    first = F.array_position(F.transform(body, lambda t: F.array_contains(stop, t)), True)

    def cut(hit: Column) -> Column:
        keep = F.when(hit == 0, F.size(tokens)).otherwise(prefix + hit - 1).cast("int")
        return F.struct(
            F.slice(tokens, F.lit(1), keep).alias("tokens"), F.slice(mask, F.lit(1), keep).alias("mask")
        )

    return bind(first, cut)
