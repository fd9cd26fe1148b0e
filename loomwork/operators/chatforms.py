"""Whole-conversation rows: assembly, coercion of input shapes, instruction records.

Here the result row *is* the conversation, so its messages are held in one array.
Checks and counts that do not need the array live in chatcheck.py.
"""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from loomwork.functions.text import bind, is_blank, strip
from loomwork.operators.chatcheck import PREPARED, ROLES, ChatRules
from loomwork.schemas import MESSAGES

# Fixed value: the category kept from code instruction rows.
CODE_CATEGORY = "code_generation"


def assemble(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, messages): turn rows to the declared array-of-messages form."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy(conv).agg(ordered.alias("rows")).select(
        conv,
        F.transform("rows", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias(
            "messages"
        ),
    )


def reject_reason(messages: Column, rules: ChatRules = PREPARED) -> Column:
    """First reason to refuse an array of messages; null when it is valid."""

    def fault(m: Column) -> Column:
        found = F.lit(None).cast("string")
        if rules.reject_blank:
            found = F.when(is_blank(m["content"]), "content_empty")
        found = F.when(m["content"].isNull(), "content_not_string").otherwise(found)
        if rules.check_role_names:
            known = F.coalesce(m["role"].isin(*ROLES), F.lit(False))
            found = F.when(~known, "unsupported_role").otherwise(found)
        return found

    faults = F.filter(F.transform(messages, fault), lambda f: f.isNotNull())
    first_fault = F.get(faults, F.lit(0))
    size = F.size(messages)
    led = F.lit(False)
    if rules.allow_system:
        led = F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False))
    dialogue = F.slice(messages, F.when(led, 2).otherwise(1), F.greatest(size, F.lit(1)))
    wrong = F.exists(
        F.transform(
            dialogue,
            lambda m, i: ~m["role"].eqNullSafe(F.when(i % 2 == 0, "user").otherwise("assistant")),
        ),
        lambda bad: bad,
    )
    reason = F.when(messages.isNull() | (size < rules.min_messages), "too_few_messages")
    if rules.check_role_names:
        reason = reason.when(first_fault.isNotNull(), first_fault)
    reason = reason.when(
        F.size(dialogue) < rules.min_dialogue,
        F.when(led, "system_without_dialogue").otherwise("too_few_messages"),
    )
    if rules.assistant_last:
        reason = reason.when(~F.get(dialogue, F.lit(0))["role"].eqNullSafe("user"), "not_user_first").when(
            ~F.element_at(messages, -1)["role"].eqNullSafe("assistant"), "not_assistant_last"
        )
    return reason.when(wrong, "roles_not_alternating").when(first_fault.isNotNull(), first_fault)


def _first_filled(*names: str) -> Column:
    """First column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def coerce_messages(rows: DataFrame) -> DataFrame:
    """Append ``messages_out`` built from whichever of the three shapes a row has."""

    def message(role: Column, content: Column) -> Column:
        return F.struct(role.alias("role"), content.alias("content"))

    def renamed(m: Column) -> Column:
        role = F.coalesce(F.nullif(m["role"], F.lit("")), m["from"])
        role = F.when(role == "human", "user").when(role == "gpt", "assistant").otherwise(role)
        return message(role, F.coalesce(F.nullif(m["content"], F.lit("")), m["value"]))

    asked = _first_filled("instruction", "prompt", "question")
    answered = _first_filled("output", "response", "answer")
    system = _first_filled("system", "system_prompt")
    pair = F.array(message(F.lit("user"), asked), message(F.lit("assistant"), answered))
    with_system = F.concat(F.array(message(F.lit("system"), system)), pair)
    built = (
        F.when(F.col("messages").isNotNull(), F.col("messages"))
        .when(F.col("conversations").isNotNull(), F.transform("conversations", renamed))
        .when(
            asked.isNotNull() & answered.isNotNull(),
            F.when(system.isNotNull() & ~is_blank(system), with_system).otherwise(pair),
        )
    )
    return rows.withColumn("messages_out", built.cast(MESSAGES))


def instruction_record(messages: Column) -> Column:
    """{instruction, input, output} of one valid conversation."""
    clean = F.transform(
        messages, lambda m, i: F.struct(m["role"].alias("role"), strip(m["content"]).alias("content"), i.alias("i"))
    )

    def build(turns: Column) -> Column:
        system = F.filter(turns, lambda m: m["role"] == "system")
        opener = F.get(F.filter(turns, lambda m: m["role"] == "user"), F.lit(0))
        return bind(opener, lambda first: record(turns, system, first))

    def record(turns: Column, system: Column, first: Column) -> Column:
        middle = F.filter(
            turns,
            lambda m: (m["role"] != "system") & (m["i"] != first["i"]) & (m["i"] != F.size(turns) - 1),
        )
        speaker = lambda m: F.when(m["role"] == "user", "User: ").otherwise("Assistant: ")
        lines = F.transform(middle, lambda m: F.concat(speaker(m), m["content"]))
        opening = F.concat(F.transform(system, lambda m: m["content"]), F.array(first["content"]))
        return F.struct(
            F.array_join(opening, "\n\n").alias("instruction"),
            F.array_join(lines, "\n\n").alias("input"),
            F.element_at(turns, -1)["content"].alias("output"),
        )

    return bind(clean, build)


@F.pandas_udf(T.StringType())
def _literal_to_json(texts: pd.Series) -> pd.Series:
    """Python-literal dicts as JSON text; null for anything else."""

    def one(text):
        try:
            value = ast.literal_eval(text.strip())
        except (ValueError, SyntaxError, MemoryError, RecursionError, AttributeError):
            return None
        return json.dumps(value) if isinstance(value, dict) else None

    return pd.Series([one(t) for t in texts], dtype="object")


def structured_fields(rows: DataFrame, column: str, field: str, out: str) -> DataFrame:
    """Append ``out``: one field of a dict given as JSON or Python-literal text.

    JSON is read by the built-in; only texts it finds no field in reach Python.
    """
    text = strip(F.col(column))
    is_dict = text.startswith("{")
    return (
        rows.withColumn("__direct", F.when(is_dict, F.get_json_object(text, f"$.{field}")))
        .withColumn("__json", _literal_to_json(F.when(is_dict & F.col("__direct").isNull(), text)))
        .withColumn(
            out, strip(F.coalesce("__direct", F.get_json_object("__json", f"$.{field}"), F.lit("")))
        )
        .drop("__direct", "__json")
    )


def code_records(rows: DataFrame) -> DataFrame:
    """Code instruction rows with ``instruction``, ``output`` and ``reject_reason``."""
    titled = structured_fields(rows, "input_data", "title", "instruction")
    coded = structured_fields(titled, "output_data", "code", "output")
    category = strip(F.coalesce(F.col("task_category"), F.lit("")))
    reason = (
        F.when(category != CODE_CATEGORY, "unsupported_category")
        .when(F.col("instruction") == "", "missing_title")
        .when(F.col("output") == "", "missing_code")
    )
    return coded.withColumn("input", F.lit("")).withColumn("reject_reason", reason)
