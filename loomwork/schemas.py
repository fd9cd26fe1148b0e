"""Declared schemas for every source the engine reads."""

from pyspark.sql import types as T

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])
MESSAGES = T.ArrayType(MESSAGE)

PART = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
])
PARTS = T.ArrayType(PART)

CONVERSATION = T.StructType([
    T.StructField("subset", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("generator", T.StringType()),
    T.StructField("thinking", T.BooleanType()),
    T.StructField("messages", MESSAGES),
])

# The loosest chat row: any of the three accepted shapes may be filled in.
CHAT_ROW = T.StructType([
    T.StructField("messages", MESSAGES),
    T.StructField("conversations", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()),
        T.StructField("from", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("value", T.StringType()),
    ]))),
    *[
        T.StructField(name, T.StringType())
        for name in (
            "instruction", "prompt", "question", "output", "response", "answer",
            "system", "system_prompt",
        )
    ],
])

BASELINES = T.StructType([
    T.StructField("Eval Task", T.StringType()),
    T.StructField("Random baseline", T.DoubleType()),
])

MULTIPLE_CHOICE = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("choices", T.ArrayType(T.StringType())),
    T.StructField("gold", T.IntegerType()),
])
SCHEMA_ITEM = T.StructType([
    T.StructField("context_options", T.ArrayType(T.StringType())),
    T.StructField("continuation", T.StringType()),
    T.StructField("gold", T.IntegerType()),
])
LANGUAGE_MODELLING = T.StructType([
    T.StructField("context", T.StringType()),
    T.StructField("continuation", T.StringType()),
])
