"""Benchmark rows to conversations, and answers out of completions."""

from __future__ import annotations

import ast
import operator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from loomwork.functions.text import strip
from loomwork.schemas import PARTS

# Answer letters of four-choice questions and the answer marker.
LETTERS = ["A", "B", "C", "D"]
ANSWER = r"#### (\-?[0-9\.\,]+)"


def multiple_choice_prompt(question: Column, letters: Column, choices: Column) -> Column:
    """Question, one ``- choice=letter`` line each, and the closing request."""
    n = F.least(F.size(letters), F.size(choices))
    lines = F.zip_with(
        F.slice(letters, F.lit(1), n),
        F.slice(choices, F.lit(1), n),
        lambda letter, choice: F.concat(F.lit("- "), choice, F.lit("="), letter, F.lit("\n")),
    )
    return F.concat(
        F.lit("Multiple Choice question: "), question, F.lit("\n"),
        F.array_join(lines, ""),
        F.lit("\nRespond only with the letter of the correct answer."),
    )


def indexed_choice(question: Column, choices: Column, answer: Column) -> Column:
    """{prompt, answer, reject_reason} of a row with four choices and an answer index."""
    letters = F.array(*[F.lit(x) for x in LETTERS])
    return F.struct(
        multiple_choice_prompt(question, letters, choices).alias("prompt"),
        F.get(letters, answer).alias("answer"),
        F.when(F.size(choices) != 4, "not_four_choices").alias("reject_reason"),
    )


def labelled_choice(question: Column, labels: Column, choices: Column, key: Column) -> Column:
    """The same for a row that carries its own labels."""
    return F.struct(
        multiple_choice_prompt(question, labels, choices).alias("prompt"),
        key.alias("answer"),
        F.when(~F.array_contains(labels, key), "answer_not_among_labels").alias("reject_reason"),
    )


def worked_answer_parts(answer: Column) -> Column:
    """Split at ``<<expr=result>>`` into text, python and python_output parts."""
    texts = F.split(answer, "<<[^>]+>>", -1)
    calls = F.regexp_extract_all(answer, F.lit("(<<[^>]+>>)"), F.lit(1))

    def part(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), text.alias("text"))

    def call_parts(call: Column) -> Column:
        inner = call.substr(F.lit(3), F.length(call) - 4)
        # Everything up to the last "=" is the expression.
        stated = F.substring_index(inner, "=", -1)
        before = inner.substr(F.lit(1), F.length(inner) - F.length(stated) - 1)
        has_result = inner.contains("=")
        return F.array(
            part("python", F.when(has_result, before).otherwise(inner)),
            part("python_output", F.when(has_result, stated).otherwise("")),
        )

    # There is one text more than calls; the last one meets a null.
    woven = F.zip_with(
        texts,
        calls,
        lambda text, call: F.when(call.isNull(), F.array(part("text", text))).otherwise(
            F.concat(F.array(part("text", text)), call_parts(call))
        ),
    )
    return F.flatten(woven).cast(PARTS)


def final_answer(completion: Column) -> Column:
    """Number after the marker with commas removed; null where there is none."""
    found = F.nullif(F.regexp_extract(completion, ANSWER, 1), F.lit(""))
    return F.replace(found, F.lit(","), F.lit(""))


def same_answer(reference: Column, completion: Column) -> Column:
    """Both missing counts as the same answer."""
    return final_answer(reference).eqNullSafe(final_answer(completion))


def leading_imports(prompt: Column) -> Column:
    """Import lines at the top; blanks and comments are passed over."""
    lines = F.transform(F.split(prompt, "\n", -1), lambda line: strip(line))
    is_import = lambda line: line.startswith("import ") | line.startswith("from ")
    stops = F.transform(lines, lambda line: (line != "") & ~line.startswith("#") & ~is_import(line))
    first_stop = F.array_position(stops, True)
    head = F.when(first_stop > 0, F.slice(lines, F.lit(1), (first_stop - 1).cast("int"))).otherwise(lines)
    return F.array_join(F.filter(head, is_import), "\n")


def fenced_program(completion: Column) -> Column:
    """First fenced code block, else the whole text; stripped either way."""
    fence = r"(?sU)```(?:python)?\s*\n(.*?)\n```"
    block = F.when(completion.rlike(fence), F.regexp_extract(completion, fence, 1))
    return strip(F.coalesce(block, completion))


def test_program(prompt: Column, completion: Column, test: Column, entry_point: Column) -> Column:
    """Imports, program, test and the call of the check, as one text. It is not run."""
    return F.concat(
        leading_imports(prompt), F.lit("\n\n"), fenced_program(completion), F.lit("\n\n"), test,
        F.lit("\n"), F.concat(F.lit("check("), entry_point, F.lit(")")),
    )


def response_text(generation: Column) -> Column:
    """Text after the response heading, else after the assistant marker, else all."""
    text = strip(generation)
    heading = r"(?sU)### Response:\s*(.*)"
    marker = r"(?sU)<\|im_start\|>assistant\s*(.*)"
    return (
        F.when(text.rlike(heading), strip(F.regexp_extract(text, heading, 1)))
        .when(text.rlike(marker), strip(F.regexp_extract(text, marker, 1)))
        .otherwise(text)
    )


_OPERATORS = {
    ast.Add: operator.add,
    ast.Sub: operator.sub,
    ast.Mult: operator.mul,
    ast.Div: operator.truediv,
    ast.FloorDiv: operator.floordiv,
}
_SIGNS = {ast.UAdd: operator.pos, ast.USub: operator.neg}


def _evaluate(node):
    """Value of an arithmetic or ``'text'.count('t')`` tree; anything else raises."""
    match node:
        case ast.Expression(body=body):
            return _evaluate(body)
        case ast.Constant(value=value) if type(value) in (int, float):
            return value
        case ast.BinOp(left=left, op=op, right=right) if type(op) in _OPERATORS:
            return _OPERATORS[type(op)](_evaluate(left), _evaluate(right))
        case ast.UnaryOp(op=op, operand=operand) if type(op) in _SIGNS:
            return _SIGNS[type(op)](_evaluate(operand))
        case ast.Call(
            func=ast.Attribute(value=ast.Constant(value=str(text)), attr="count"),
            args=[ast.Constant(value=str(part))],
            keywords=[],
        ):
            return text.count(part)
    raise ValueError("not allowed")


@F.pandas_udf(T.DoubleType())
def tool_value(expressions: pd.Series) -> pd.Series:
    """Value of a tool call, commas removed; null when refused or failing."""

    def one(text):
        if text is None:
            return None
        try:
            return float(_evaluate(ast.parse(text.replace(",", "").strip(), mode="eval")))
        except (ValueError, SyntaxError, ArithmeticError, TypeError, MemoryError, RecursionError):
            return None

    # Equal expressions in a batch are evaluated once.
    known = {text: one(text) for text in expressions.unique()}
    return expressions.map(known).astype("float64")
