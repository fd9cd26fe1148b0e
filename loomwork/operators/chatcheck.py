"""Conversation validity as turn-level aggregates.

Input is one row per turn with ``turn`` the message's index in its
conversation. Every check is a mergeable aggregate, so a conversation of any
length is judged without gathering its messages anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loomwork.functions.text import is_blank
from loomwork.operators.running import top_rows


@dataclass(frozen=True)
class ChatRules:
    allow_system: bool = True
    check_role_names: bool = True
    reject_blank: bool = True
    assistant_last: bool = True
    min_messages: int = 2
    min_dialogue: int = 2


PREPARED = ChatRules()
LOOSE = ChatRules(check_role_names=False, reject_blank=False, assistant_last=False, min_messages=1)
STRICT = ChatRules(
    allow_system=False, check_role_names=False, reject_blank=False, assistant_last=False
)

ROLES = ("system", "user", "assistant")


# Roles and faults travel through the aggregates as numbers: a (turn, code) pair packs
# into one long, and the aggregate then needs no sort.
_OTHER = 15
_FAULTS = ("unsupported_role", "content_not_string", "content_empty", "message_too_long", "empty_content")


def _code(value: Column, names: tuple[str, ...]) -> Column:
    code = F.lit(_OTHER)
    for i, name in enumerate(names):
        code = F.when(value == name, i).otherwise(code)
    return code


def _pack(turn: Column, code: Column) -> Column:
    return turn.cast("bigint") * 16 + code


def _unpack(packed: Column, names: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), (packed % 16).cast("int"))


def judge(turns: DataFrame, rules: ChatRules = PREPARED, conv: str = "conv_id") -> DataFrame:
    """(conv, n_messages, reject_reason); the reason is null when accepted."""
    turn, text = F.col("turn"), F.col("text")
    role = _code(F.col("role"), ROLES)
    fault = F.lit(None).cast("int")
    if rules.reject_blank:
        fault = F.when(is_blank(text), _FAULTS.index("content_empty"))
    fault = F.when(text.isNull(), _FAULTS.index("content_not_string")).otherwise(fault)
    if rules.check_role_names:
        fault = F.when(role == _OTHER, _FAULTS.index("unsupported_role")).otherwise(fault)

    system, user, assistant = (ROLES.index(r) for r in ("system", "user", "assistant"))

    def expected(offset: Column) -> Column:
        return F.when(F.pmod(offset, F.lit(2)) == 0, user).otherwise(assistant)

    facts = turns.groupBy(conv).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.min(_pack(turn, fault)).alias("first_fault"),
        F.min(_pack(turn, role)).alias("head"),
        F.max(F.when(turn == 1, role)).alias("second"),
        F.max(_pack(turn, role)).alias("tail"),
        F.count_if(role != expected(turn)).alias("off_plain"),
        F.count_if((turn > 0) & (role != expected(turn - 1))).alias("off_system"),
        F.min(turn).alias("lowest"),
        F.sum(turn.cast("decimal(38,0)")).alias("turns"),
        F.sum((turn * turn).cast("decimal(38,0)")).alias("squares"),
    )
    head, tail = F.col("head") % 16, F.col("tail") % 16
    led = (head == system) if rules.allow_system else F.lit(False)
    dialogue = F.col("n_messages") - led.cast("int")
    opener = F.when(led, F.col("second")).otherwise(head)
    off = F.when(led, F.col("off_system")).otherwise(F.col("off_plain"))
    # Turns 0 to n - 1 once each: parity then tells a message's place.
    n = F.col("n_messages").cast("decimal(18,0)")
    contiguous = F.coalesce(
        (F.col("lowest") == 0)
        & (F.col("turns") * 2 == n * (n - 1))
        & (F.col("squares") * 6 == n * (n - 1) * (n * 2 - 1)),
        F.lit(False),
    )
    first_fault = _unpack(F.col("first_fault"), _FAULTS)
    reason = (
        F.when(F.col("n_messages") < rules.min_messages, "too_few_messages")
        .when(~contiguous, "turns_not_contiguous")
        .when(F.col("first_fault").isNotNull() & F.lit(rules.check_role_names), first_fault)
        .when(dialogue < rules.min_dialogue, F.when(led, "system_without_dialogue").otherwise("too_few_messages"))
    )
    if rules.assistant_last:
        reason = reason.when(~opener.eqNullSafe(F.lit(user)), "not_user_first").when(
            tail != assistant, "not_assistant_last"
        )
    reason = reason.when(off > 0, "roles_not_alternating").when(F.col("first_fault").isNotNull(), first_fault)
    return facts.select(conv, "n_messages", reason.alias("reject_reason"))


def reject_report(judged: DataFrame, conv: str = "conv_id", examples: int = 5) -> DataFrame:
    """Count per outcome with the first few conversation ids of each."""
    outcome = F.coalesce("reject_reason", F.lit("accepted"))
    named = judged.withColumn("outcome", outcome)
    counts = named.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_conversations"))
    first = (
        top_rows(named, ["outcome"], [F.col(conv)], examples)
        .groupBy("outcome")
        .agg(F.array_join(F.array_sort(F.collect_list(conv)), ",").alias("first_ids"))
    )
    return counts.join(first, "outcome")


@dataclass(frozen=True)
class SizeLimits:
    """Limits on a stored chat request."""

    max_messages: int = 500
    max_message_chars: int = 8_000
    max_total_chars: int = 32_000
    temperature: tuple[float, float] = (0.0, 2.0)
    top_k: tuple[int, int] = (0, 200)
    max_tokens: tuple[int, int] = (1, 4_096)
    allow_system: bool = False


def judge_size(turns: DataFrame, limits: SizeLimits = SizeLimits(), conv: str = "conv_id") -> DataFrame:
    """(conv, total_chars, size_issue); sampling fields are checked when present."""
    chars = F.length("text")
    fault = F.when(F.coalesce(chars, F.lit(0)) == 0, _FAULTS.index("empty_content")).when(
        chars > limits.max_message_chars, _FAULTS.index("message_too_long")
    )
    roles = ["user", "assistant"] + (["system"] if limits.allow_system else [])
    aggregates = [
        F.count("role").alias("n_messages"),
        F.coalesce(F.sum(chars), F.lit(0)).alias("total_chars"),
        F.min(_pack(F.col("turn"), fault)).alias("first_fault"),
        F.count_if(~F.coalesce(F.col("role").isin(*roles), F.lit(False))).alias("bad_roles"),
    ]
    sampling = [f for f in ("temperature", "top_k", "max_tokens") if f in turns.columns]
    aggregates += [F.max(f).alias(f) for f in sampling]
    facts = turns.groupBy(conv).agg(*aggregates)
    issue = (
        F.when(F.col("n_messages") == 0, "no_messages")
        .when(F.col("n_messages") > limits.max_messages, "too_many_messages")
        .when(F.col("first_fault").isNotNull(), _unpack(F.col("first_fault"), _FAULTS))
        .when(F.col("total_chars") > limits.max_total_chars, "conversation_too_long")
        .when(F.col("bad_roles") > 0, "invalid_role")
    )
    for field in sampling:
        low, high = getattr(limits, field)
        issue = issue.when(~F.col(field).between(low, high), f"{field}_out_of_range")
    return facts.select(conv, F.col("total_chars").cast("bigint").alias("total_chars"), issue.alias("size_issue"))


def completed(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, last_turn) of conversations whose last message is from the assistant."""
    last = turns.groupBy(conv).agg(F.max(_pack(F.col("turn"), _code(F.col("role"), ROLES))).alias("tail"))
    return last.filter(F.col("tail") % 16 == ROLES.index("assistant")).select(
        conv, F.shiftright("tail", 4).alias("last_turn")
    )


def parse_names(raw: str | list | None, supported: tuple[str, ...]) -> tuple[str, ...] | None:
    """Comma list to a checked tuple; blank means no restriction."""
    names = raw.split(",") if isinstance(raw, str) else list(raw or [])
    names = [str(n).strip() for n in names if str(n).strip()]
    unknown = sorted(set(names) - set(supported))
    if unknown:
        raise ValueError(f"unknown subsets: {unknown}")
    return tuple(names) or None
