"""Conversations to token ids and loss mask.

A conversation is worked on as exploded segments (one row per message part), so
its length does not matter until the end. Only segments that start inside
``max_tokens`` are gathered; each has at least one token, which bounds the group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loomwork.operators.chatcheck import completed
from loomwork.operators.running import running

# Turns per block of the running token count (bounds a window partition).
_TURNS_PER_BLOCK = 1024


@dataclass(frozen=True)
class Codec:
    """How text becomes ids: a column function and the ids of special tokens."""

    encode: Callable[[Column], Column]
    specials: dict[str, int]

    def ids(self, *names: str) -> Column:
        return F.array(*[F.lit(self.specials[n]) for n in names]).cast("array<int>")


def code_points(text: Column) -> Column:
    """Ids are the characters' code points."""
    chars = F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))
    return F.transform(chars, lambda c: F.ascii(c))


def as_parts(turns: DataFrame) -> DataFrame:
    """Give plain-text messages the one-part form."""
    if "parts" in turns.columns:
        return turns
    part = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    return turns.withColumn("parts", F.array(part))


def fold_system(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Put a leading system text in front of the first user turn, blank line between.

    Messages keep their ``turn``; the system row goes. The join is on (conversation,
    turn), of which there is one row each, so no conversation is gathered.
    """
    system = turns.filter((F.col("turn") == 0) & (F.col("role") == "system")).select(
        conv, F.lit(1).cast(dict(turns.dtypes)["turn"]).alias("turn"), F.col("text").alias("__system")
    )
    folded = turns.filter(~((F.col("turn") == 0) & (F.col("role") == "system"))).join(
        system, [conv, "turn"], "left"
    )
    text = F.when(
        F.col("__system").isNotNull(), F.concat("__system", F.lit("\n\n"), "text")
    ).otherwise(F.col("text"))
    return folded.withColumn("text", text).withColumn(
        "opens", (F.col("turn") == 0) | F.col("__system").isNotNull()
    ).drop("__system")


def _empty() -> Column:
    return F.array().cast("array<int>")


def choose_template(specials) -> str:
    """Marker template where its four tokens exist, else the im template."""
    if all(f"<|{t}|>" in specials for t in ("user_start", "user_end", "assistant_start", "assistant_end")):
        return "markers"
    if all(f"<|{t}|>" in specials for t in ("im_start", "im_end")):
        return "im"
    raise ValueError("vocabulary has no chat tokens")


def _bos(codec: Codec) -> Column:
    return codec.ids("<|bos|>" if "<|bos|>" in codec.specials else "<|endoftext|>")


def segments(turns: DataFrame, codec: Codec, conv: str = "conv_id", template: str | None = None) -> DataFrame:
    """(conv, turn, pos, tokens, mask) from folded turns."""
    template = template or choose_template(codec.specials)
    exploded = as_parts(turns).select(
        conv, "turn", "role", "opens",
        (F.size("parts") - 1).alias("last"),
        F.posexplode("parts").alias("pos", "part"),
    )
    kind, user = F.col("part.type"), F.col("role") == "user"
    first, last = F.col("pos") == 0, F.col("pos") == F.col("last")
    body = F.when(~user & (kind != "python_output"), 1).otherwise(0)
    start = F.when(F.col("opens") & first, _bos(codec)).otherwise(_empty())

    if template == "markers":
        # (ids, mask) pairs in the order they are written around the body.
        before = [
            (start, 0),
            (F.when(user & first, codec.ids("<|user_start|>")).when(first, codec.ids("<|assistant_start|>")), 0),
            (F.when(~user & (kind == "python"), codec.ids("<|python_start|>")), 1),
            (F.when(~user & (kind == "python_output"), codec.ids("<|output_start|>")), 0),
        ]
        after = [
            (F.when(~user & (kind == "python"), codec.ids("<|python_end|>")), 1),
            (F.when(~user & (kind == "python_output"), codec.ids("<|output_end|>")), 0),
            (F.when(user & last, codec.ids("<|user_end|>")), 0),
            (F.when(~user & last, codec.ids("<|assistant_end|>")), 1),
        ]
    else:
        exploded = exploded.withColumn("__role", codec.encode(F.concat("role", F.lit("\n"))))
        exploded = exploded.withColumn("__newline", codec.encode(F.lit("\n")))
        close = F.concat(codec.ids("<|im_end|>"), F.col("__newline"))
        before = [(start, 0), (F.when(first, F.concat(codec.ids("<|im_start|>"), F.col("__role"))), 0)]
        after = [(F.when(user & last, close), 0), (F.when(~user & last, close), 1)]

    exploded = exploded.withColumn("__body", codec.encode(F.col("part.text")))

    def filled(pieces):
        return [(F.coalesce(ids, _empty()), F.lit(m)) for ids, m in pieces]

    pieces = [*filled(before), (F.col("__body"), body), *filled(after)]
    return exploded.select(
        conv,
        F.col("turn").cast("bigint").alias("turn"),
        "pos",
        F.concat(*[ids for ids, _ in pieces]).alias("tokens"),
        F.concat(*[F.array_repeat(m, F.size(ids)) for ids, m in pieces]).alias("mask"),
    )


def gather(parts: DataFrame, max_tokens: int, conv: str = "conv_id") -> DataFrame:
    """(conv, tokens, mask): segments in order, cut to ``max_tokens``."""
    cut = parts.withColumn("tokens", F.slice("tokens", 1, max_tokens)).withColumn(
        "mask", F.slice("mask", 1, max_tokens)
    )
    placed = running(
        cut,
        "turn",
        {"__offset": ("sum", F.size("tokens"))},
        by=[conv],
        block=F.floor(F.col("turn") / _TURNS_PER_BLOCK),
        inclusive=False,
        ties=["pos"],
    ).filter(F.col("__offset") < max_tokens)
    rows = F.array_sort(F.collect_list(F.struct("turn", "pos", "tokens", "mask")))
    return placed.groupBy(conv).agg(rows.alias("rows")).select(
        conv,
        F.slice(F.flatten("rows.tokens"), 1, max_tokens).alias("tokens"),
        F.slice(F.flatten("rows.mask"), 1, max_tokens).alias("mask"),
    )


def render(
    turns: DataFrame, codec: Codec, max_tokens: int = 2048, conv: str = "conv_id", template: str | None = None
) -> DataFrame:
    """(conv, tokens, mask) of validated conversations."""
    return gather(segments(fold_system(turns, conv), codec, conv, template), max_tokens, conv)


def render_for_completion(
    turns: DataFrame, codec: Codec, max_tokens: int = 2048, conv: str = "conv_id", template: str | None = None
) -> DataFrame:
    """(conv, tokens): without the last assistant message, primed with its start marker."""
    template = template or choose_template(codec.specials)
    prompt = turns.join(completed(turns, conv), conv).filter(F.col("turn") < F.col("last_turn")).drop("last_turn")
    rendered = render(prompt, codec, max_tokens, conv, template)
    if template == "markers":
        primer = codec.ids("<|assistant_start|>")
    else:
        rendered = rendered.withColumn("__role", codec.encode(F.lit("assistant\n")))
        primer = F.concat(codec.ids("<|im_start|>"), F.col("__role"))
    return rendered.select(conv, F.concat("tokens", primer).alias("tokens"))


def loss_targets(tokens: Column, mask: Column) -> tuple[Column, Column]:
    """(inputs, targets) shifted by one; targets are -1 where the mask is 0."""
    length = F.greatest(F.size(tokens) - 1, F.lit(0))
    inputs = F.slice(tokens, F.lit(1), length)
    targets = F.zip_with(
        F.slice(tokens, F.lit(2), length),
        F.slice(mask, F.lit(2), length),
        lambda t, m: F.when(m == 0, F.lit(-1)).otherwise(t),
    )
    return inputs, targets
