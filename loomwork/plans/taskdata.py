"""Queries over benchmark-style rows: prompts, tool calls, answers, synthetic spelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions.text import hash60
from loomwork.operators import chatforms, synth, tasks
from loomwork.plans.registry import query, table
from loomwork.plans.sqltext import h60, strip as sql_strip
from loomwork.session import spread


def four_choices(text):
    """The first four words of a text as choices."""
    return F.slice(F.split(text, " "), 1, 4)


_MC_SQL = """
    'Multiple Choice question: ' || text || chr(10) ||
    array_to_string(list_transform(list_zip({letters}, {choices}), lambda p: '- ' || p[2] || '=' || p[1] || chr(10)), '')
    || chr(10) || 'Respond only with the letter of the correct answer.'
"""


@query(
    "mc_prompt",
    f"""
    SELECT item_id,
           {_MC_SQL.format(letters="['A', 'B', 'C', 'D']", choices="string_split(text, ' ')[1:4]")} AS prompt,
           ['A', 'B', 'C', 'D'][({h60("'gold'", 'item_id')} % 4 + 1)::INT] AS answer,
           CASE WHEN len(string_split(text, ' ')[1:4]) <> 4 THEN 'not_four_choices' END AS reject_reason
    FROM benchmark
    """,
)
def mc_prompt(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    gold = (hash60(F.lit("gold"), "item_id") % 4).cast("int")
    made = tasks.indexed_choice(F.col("text"), four_choices("text"), gold)
    return items.select("item_id", made.alias("r")).select("item_id", "r.*")


@query(
    "labelled_prompt",
    f"""
    WITH l AS (
      SELECT item_id, text, CASE WHEN item_id % 2 = 0 THEN ['1', '2', '3', '4'] ELSE ['A', 'B', 'C', 'D'] END AS labels,
             ['A', 'B', 'C', 'D'][({h60("'key'", 'item_id')} % 4 + 1)::INT] AS answer FROM benchmark)
    SELECT item_id, {_MC_SQL.format(letters="labels", choices="string_split(text, ' ')[1:4]")} AS prompt, answer,
           CASE WHEN NOT list_contains(labels, answer) THEN 'answer_not_among_labels' END AS reject_reason
    FROM l
    """,
)
def labelled_prompt(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    letters = F.array(*[F.lit(x) for x in tasks.LETTERS])
    numbers = F.array(*[F.lit(str(i)) for i in range(1, 5)])
    labels = F.when(F.col("item_id") % 2 == 0, numbers).otherwise(letters)
    key = F.get(letters, (hash60(F.lit("key"), "item_id") % 4).cast("int"))
    made = tasks.labelled_choice(F.col("text"), labels, four_choices("text"), key)
    return items.select("item_id", made.alias("r")).select("item_id", "r.*")


@query(
    "completion_conversation",
    """
    SELECT item_id, text AS user_text, text || chr(10) || '    return ' || length(text)::VARCHAR AS assistant_text,
           'task_' || item_id::VARCHAR AS entry_point
    FROM benchmark
    """,
)
def completion_conversation(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    solution = F.concat(F.lit("    return "), F.length("text").cast("string"))
    return items.select(
        "item_id",
        F.col("text").alias("user_text"),
        F.concat_ws("\n", "text", solution).alias("assistant_text"),
        F.concat(F.lit("task_"), F.col("item_id").cast("string")).alias("entry_point"),
    )


def _worked_lines(spark, sf_dir):
    """One worked answer per order line; some state a wrong product."""
    lines = spread(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_linenumber",
            F.col("l_quantity").cast("int").alias("q"),
            F.floor("l_extendedprice").cast("bigint").alias("p"),
        ),
        "l_orderkey",
    )
    off = F.when(hash60("l_orderkey", "l_linenumber") % 7 == 0, 1).otherwise(0)
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        F.concat(
            F.lit("Sold "), F.col("q"), F.lit(" at "), F.col("p"), F.lit(": <<"), F.col("q"), F.lit("*"), F.col("p"),
            F.lit("="), F.col("q") * F.col("p") + off, F.lit(">> in all.\nLess <<"), F.col("q"), F.lit("-1="),
            F.col("q") - 1, F.lit(">>.\n#### "), F.col("q") * F.col("p"),
        ).alias("answer"),
    )


_WORKED_SQL = f"""
    WITH l AS (
      SELECT l_orderkey, l_linenumber, l_quantity::INT AS q, floor(l_extendedprice)::BIGINT AS p,
             CASE WHEN {h60('l_orderkey', 'l_linenumber')} % 7 = 0 THEN 1 ELSE 0 END AS off FROM lineitem)
"""


@query(
    "toolcall_parts",
    _WORKED_SQL
    + """
    SELECT l_orderkey, l_linenumber, 7::BIGINT AS n_parts,
           'text:Sold ' || q || ' at ' || p || ': |python:' || q || '*' || p || '|python_output:' || (q * p + off)
           || '|text: in all.' || chr(10) || 'Less |python:' || q || '-1|python_output:' || (q - 1)
           || '|text:.' || chr(10) || '#### ' || (q * p) AS parts
    FROM l
    """,
)
def toolcall_parts(spark, sf_dir):
    parts = _worked_lines(spark, sf_dir).withColumn("parts", tasks.worked_answer_parts(F.col("answer")))
    named = F.transform("parts", lambda p: F.concat(p["type"], F.lit(":"), p["text"]))
    return parts.select(
        "l_orderkey", "l_linenumber",
        F.size("parts").cast("bigint").alias("n_parts"),
        F.array_join(named, "|").alias("parts"),
    )


@query(
    "toolcall_check",
    _WORKED_SQL
    + f"""
    , calls AS (
      SELECT 'arithmetic' AS kind, off = 0 AS agrees FROM l
      UNION ALL SELECT 'arithmetic', true FROM l
      UNION ALL
      SELECT 'count', length(p_name) - length(replace(p_name, 'e', '')) = {h60('p_partkey')} % 3 FROM part)
    SELECT kind, count(*)::BIGINT AS n_calls, count(*) FILTER (agrees)::BIGINT AS n_agree, 0::BIGINT AS n_refused
    FROM calls GROUP BY kind
    """,
)
def toolcall_check(spark, sf_dir):
    parts = _worked_lines(spark, sf_dir).select(
        tasks.worked_answer_parts(F.col("answer")).alias("parts")
    )
    # A call is followed at once by its stated result.
    pairs = parts.select(
        F.explode(
            F.zip_with(
                "parts",
                F.slice("parts", F.lit(2), F.size("parts")),
                lambda call, result: F.struct(call.alias("call"), result.alias("result")),
            )
        ).alias("p")
    ).filter(F.col("p.call.type") == "python")
    arithmetic = pairs.select(
        F.lit("arithmetic").alias("kind"),
        F.col("p.call.text").alias("expression"),
        F.col("p.result.text").alias("stated"),
    )
    counting = table(spark, sf_dir, "part").select(
        F.lit("count").alias("kind"),
        F.concat(F.lit("'"), F.col("p_name"), F.lit("'.count('e')")).alias("expression"),
        (hash60("p_partkey") % 3).cast("string").alias("stated"),
    )
    # Each distinct expression goes to Python once, with its multiplicity.
    distinct = arithmetic.unionByName(counting).groupBy("kind", "expression", "stated").agg(
        F.count(F.lit(1)).alias("n")
    )
    value = distinct.withColumn("value", tasks.tool_value("expression"))
    agrees = F.abs(F.col("value") - F.expr("try_cast(stated AS double)")) < 1e-9
    return value.groupBy("kind").agg(
        F.sum("n").alias("n_calls"),
        F.sum(F.when(agrees, F.col("n")).otherwise(0)).alias("n_agree"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_refused"),
    )


_ANSWERS_SQL = f"""
    WITH o AS (
      SELECT o_orderkey, floor(o_totalprice)::BIGINT AS v, {h60('o_orderkey')} % 5 AS k FROM orders),
    a AS (
      SELECT o_orderkey, k,
        CASE WHEN k = 4 THEN NULL ELSE v::VARCHAR END AS reference_answer,
        CASE WHEN k IN (0, 1) THEN v::VARCHAR WHEN k = 2 THEN (v + 1)::VARCHAR END AS given_answer FROM o)
"""


@query(
    "extract_answer",
    _ANSWERS_SQL
    + """
    SELECT o_orderkey, reference_answer, given_answer, reference_answer IS NOT DISTINCT FROM given_answer AS correct,
           reference_answer IS NULL AND given_answer IS NULL AS both_missing
    FROM a
    """,
)
def extract_answer(spark, sf_dir):
    answers = worked_answers(spark, sf_dir)
    return answers.select(
        "o_orderkey",
        tasks.final_answer(F.col("reference")).alias("reference_answer"),
        tasks.final_answer(F.col("completion")).alias("given_answer"),
        tasks.same_answer(F.col("reference"), F.col("completion")).alias("correct"),
        (
            tasks.final_answer(F.col("reference")).isNull() & tasks.final_answer(F.col("completion")).isNull()
        ).alias("both_missing"),
    )


def worked_answers(spark, sf_dir):
    """Reference and completion texts per order: right, grouped, wrong or unmarked."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.floor("o_totalprice").cast("bigint").alias("v")
    )
    kind = hash60("o_orderkey") % 5
    plain, grouped = F.col("v").cast("string"), F.format_number("v", 0)
    return orders.select(
        "o_orderkey",
        "o_custkey",
        F.when(kind == 4, F.lit("no total given")).otherwise(F.concat(F.lit("Total.\n#### "), grouped)).alias("reference"),
        F.when(kind == 0, F.concat(F.lit("so\n#### "), plain))
        .when(kind == 1, F.concat(F.lit("so #### "), grouped, F.lit(" in all")))
        .when(kind == 2, F.concat(F.lit("#### "), (F.col("v") + 1).cast("string")))
        .otherwise(F.concat(F.lit("about "), plain))
        .alias("completion"),
    )


_COMPLETION_SQL = """
    CASE doc_id % 3
      WHEN 0 THEN 'Here it is:' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'Done.'
      WHEN 1 THEN 'Sure.' || chr(10) || '``` ' || chr(10) || text || chr(10) || '```'
      ELSE ' ' || text || chr(10) END
"""
_PROMPT_SQL = """
    '# task' || chr(10) || 'import os' || chr(10) || chr(10) || '  from re import sub' || chr(10)
    || 'def f_' || doc_id || '():' || chr(10) || 'import late'
"""


@query(
    "code_extract",
    f"""
    WITH d AS (
      SELECT doc_id, CASE WHEN doc_id % 3 = 2 OR NOT contains(text, chr(10) || '```') THEN {sql_strip('text')}
        ELSE {sql_strip("string_split(text, chr(10) || '```')[1]")} END AS program FROM documents)
    SELECT doc_id, 'import os' || chr(10) || 'from re import sub' AS imports, md5(program) AS program_md5,
           md5('import os' || chr(10) || 'from re import sub' || chr(10) || chr(10) || program || chr(10) || chr(10)
               || 'assert f' || chr(10) || 'check(f_' || doc_id || ')') AS assembled_md5
    FROM d
    """,
)
def code_extract(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    fenced = (
        F.when(
            F.col("doc_id") % 3 == 0,
            F.concat(F.lit("Here it is:\n```python\n"), "text", F.lit("\n```\nDone.")),
        )
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Sure.\n``` \n"), "text", F.lit("\n```")))
        .otherwise(F.concat(F.lit(" "), "text", F.lit("\n")))
    )
    entry = F.concat(F.lit("f_"), F.col("doc_id").cast("string"))
    prompt = F.concat(
        F.lit("# task\nimport os\n\n  from re import sub\ndef "), entry, F.lit("():\nimport late")
    )
    return docs.select("doc_id", fenced.alias("completion"), prompt.alias("prompt"), entry.alias("entry")).select(
        "doc_id",
        tasks.leading_imports(F.col("prompt")).alias("imports"),
        F.md5(tasks.fenced_program(F.col("completion"))).alias("program_md5"),
        F.md5(
            tasks.test_program(F.col("prompt"), F.col("completion"), F.lit("assert f"), F.col("entry"))
        ).alias("assembled_md5"),
    )


@query(
    "response_text",
    f"""
    SELECT doc_id, md5({sql_strip('text')}) AS response_md5 FROM documents
    """,
)
def response_text(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    generation = (
        F.when(
            F.col("doc_id") % 3 == 0,
            F.concat(F.lit("### Instruction:\nsay\n### Response:\n "), "text", F.lit("\n")),
        )
        .when(
            F.col("doc_id") % 3 == 1,
            F.concat(F.lit("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n"), "text"),
        )
        .otherwise(F.concat(F.lit("\n"), "text", F.lit("  ")))
    )
    return docs.select("doc_id", F.md5(tasks.response_text(generation)).alias("response_md5"))


@query(
    "code_record",
    f"""
    SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'unsupported_category'
                        WHEN doc_id % 7 = 0 THEN 'missing_title' END AS reject_reason,
           CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'Title ' || doc_id || ' it''s' END AS instruction,
           md5({sql_strip('text')}) AS output_md5
    FROM documents
    """,
)
def code_record(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    title = F.when(F.col("doc_id") % 7 == 0, "").otherwise(
        F.concat(F.lit("Title "), F.col("doc_id").cast("string"), F.lit(" it's"))
    )
    as_json = F.to_json(F.struct(title.alias("title")))
    literal = F.concat(F.lit("{'title': \""), title, F.lit("\"}"))
    rows = docs.select(
        "doc_id",
        F.when(F.col("doc_id") % 5 == 4, "bug_fixing").otherwise(chatforms.CODE_CATEGORY).alias("task_category"),
        F.when(F.col("doc_id") % 2 == 0, as_json).otherwise(literal).alias("input_data"),
        F.to_json(F.struct(F.col("text").alias("code"))).alias("output_data"),
    )
    return chatforms.code_records(rows).select(
        "doc_id", "reject_reason", "instruction", F.md5("output").alias("output_md5")
    )


def words_of(spark, sf_dir):
    """Distinct words of the part names, trimmed."""
    names = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return names.select(F.trim("word").alias("word")).filter(F.col("word") != "").distinct()


_WORDS_SQL = f"""
    WITH w AS (SELECT DISTINCT trim(unnest(string_split(p_name, ' '))) AS word FROM part),
    numbered AS (SELECT word, row_number() OVER (ORDER BY {h60('word')}) - 1 AS slot FROM w WHERE word <> ''),
    n AS (SELECT count(*) AS n FROM numbered),
    picked AS (
      SELECT p_partkey AS idx, p_partkey + {{offset}} AS seed,
             {h60('p_partkey + {offset}', "'word'")} % n AS slot FROM part, n),
    p AS (SELECT idx, seed, word FROM picked JOIN numbered USING (slot))
"""


@query(
    "spelling_synth",
    _WORDS_SQL.format(offset=0)
    + """
    SELECT idx AS index, 'Spell the word: ' || word AS "user",
           word || ':' || array_to_string(list_filter(string_split(word, ''), lambda x: x <> ''), ',') AS assistant
    FROM p
    """,
)
def spelling_synth(spark, sf_dir):
    index = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("index"))
    return synth.spelling(synth.pick_words(index, words_of(spark, sf_dir)))


def _question_list() -> str:
    return "[" + ", ".join("'" + q.replace("'", "''") + "'" for q in synth.QUESTIONS) + "]"


def _pick(purpose: str, n: str) -> str:
    return f"{h60('seed', repr(purpose))} % {n}"


_QUOTE_SQL = """['', '''', '"']"""


@query(
    "spelling_count",
    _WORDS_SQL.format(offset=synth.TEST_SEED_OFFSET)
    + f"""
    , l AS (
      SELECT *, CASE WHEN {_pick('from_word', '10')} < 9 THEN substr(word, (1 + {_pick('own', 'length(word)')})::INT, 1)
             ELSE substr('{synth.ALPHABET}', (1 + {_pick('other', '26')})::INT, 1) END AS letter FROM p),
    c AS (SELECT *, length(word) - length(replace(word, letter, '')) AS cnt,
                 {_question_list()}[({_pick('question', str(len(synth.QUESTIONS)))} + 1)::INT] AS q FROM l),
    t AS (SELECT *, CASE WHEN {_pick('lower', '10')} < 3 THEN lower(q) ELSE q END AS asked,
                 {_QUOTE_SQL}[({_pick('letter_quote', '3')} + 1)::INT] AS lq,
                 {_QUOTE_SQL}[({_pick('word_quote', '3')} + 1)::INT] AS wq FROM c)
    SELECT idx AS index, word, letter, cnt::BIGINT AS count,
           replace(replace(asked, '{{letter}}', lq || letter || lq), '{{word}}', wq || word || wq)
             || CASE WHEN {_pick('mark', '2')} = 0 THEN '?' ELSE '' END AS "user",
           md5('text:We are asked to find the number ''' || letter || ''' in the word ''' || word
             || '''. Let me try a manual approach first.' || chr(10) || chr(10) || 'First spell the word out:' || chr(10)
             || word || ':' || array_to_string(list_filter(string_split(word, ''), lambda x: x <> ''), ',')
             || chr(10) || chr(10) || 'Then count the occurrences of ''' || letter || ''':' || chr(10)
             || array_to_string(list_transform(range(1, length(word) + 1), lambda i: i || ':' || substr(word, i::INT, 1)
                || CASE WHEN substr(word, i::INT, 1) = letter
                   THEN ' hit! count=' || (i - length(replace(substr(word, 1, i::INT), letter, ''))) ELSE '' END || chr(10)), '')
             || chr(10) || 'This gives us ' || cnt || '.'
             || '|text:' || chr(10) || chr(10) || 'Let me double check this using Python:' || chr(10) || chr(10)
             || '|python:''' || word || '''.count(''' || letter || ''')|python_output:' || cnt
             || '|text:' || chr(10) || chr(10) || 'Python gives us ' || cnt || '.' || chr(10) || chr(10)
             || 'My final answer is:' || chr(10) || chr(10) || '#### ' || cnt) AS parts_md5
    FROM t
    """,
)
def spelling_count(spark, sf_dir):
    index = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("index"))
    made = synth.letter_counting(synth.pick_words(index, words_of(spark, sf_dir), split="test"))
    named = F.transform("parts", lambda p: F.concat(p["type"], F.lit(":"), p["text"]))
    return made.select(
        "index", "word", "letter", "count", "user", F.md5(F.array_join(named, "|")).alias("parts_md5")
    )


@query(
    "benchmark_source",
    f"""
    SELECT item_id, (row_number() OVER (ORDER BY {h60("'42'", 'item_id')}) - 1)::BIGINT AS position,
           md5(text) AS question_md5
    FROM benchmark
    """,
)
def benchmark_source(spark, sf_dir):
    from loomwork.operators.splits import hash_order

    # One subset of the benchmark wraps its columns in a "train" struct.
    wrapped = table(spark, sf_dir, "benchmark").select(
        F.struct("item_id", F.col("text").alias("question")).alias("train")
    )
    rows = wrapped.select("train.*")
    return hash_order(rows.select("item_id", F.md5("question").alias("question_md5")), "item_id").select(
        "item_id", "position", "question_md5"
    )
