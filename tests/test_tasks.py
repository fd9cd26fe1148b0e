import pytest
from pyspark.sql import functions as F

from loomwork.operators import evals, rollouts, synth, tasks


def one(spark, expression, **values):
    row = [(tuple(values.values()))]
    return spark.createDataFrame(row, list(values)).select(expression.alias("v")).first()["v"]


def test_worked_answer(spark):
    text = "Weng earns 12/60 = $<<12/60=0.2>>0.2 per minute.<<a==b>><<none>>"
    got = [tuple(p) for p in one(spark, tasks.worked_answer_parts(F.col("t")), t=text)]
    assert got == [
        ("text", "Weng earns 12/60 = $"), ("python", "12/60"), ("python_output", "0.2"),
        ("text", "0.2 per minute."), ("python", "a="), ("python_output", "b"), ("text", ""),
        ("python", "none"), ("python_output", ""), ("text", ""),
    ]


@pytest.mark.parametrize(
    "text,want",
    [("so #### 1,234.50 yes", "1234.50"), ("#### -7", "-7"), ("none", None), ("####7", None), ("#### 1\n#### 2", "1")],
)
def test_final_answer(spark, text, want):
    assert one(spark, tasks.final_answer(F.col("t")), t=text) == want


def test_both_missing_is_same(spark):
    assert one(spark, tasks.same_answer(F.col("a"), F.col("b")), a="x", b="y") is True
    assert one(spark, rollouts.reward(F.col("a"), F.col("b")), a="#### 1", b="y") == 0.0


@pytest.mark.parametrize(
    "text,want",
    [
        ("12/60", 0.2), ("1,000*2", 2000.0), ("'strawberry'.count('r')", 3.0), ("2**9", None), ("1/0", None),
        ("__import__('os')", None), ("'a'.upper()", None), ("-(3-5)", 2.0), ("7//2", 3.0), ("x", None), (None, None),
    ],
)
def test_tool_value(spark, text, want):
    frame = spark.createDataFrame([(text,)], "t string")
    got = frame.select(tasks.tool_value("t").alias("v")).first()["v"]
    assert got == pytest.approx(want) if want is not None else got is None


def test_imports_and_program(spark):
    prompt = "\n# c\nimport os\nfrom a import b\n\ndef f():\n  import late"
    assert one(spark, tasks.leading_imports(F.col("p")), p=prompt) == "import os\nfrom a import b"
    assert one(spark, tasks.leading_imports(F.col("p")), p="import os") == "import os"
    fenced = "text\n```python\nx = 1\n\ny = 2\n```\nmore\n```\nz\n```"
    assert one(spark, tasks.fenced_program(F.col("p")), p=fenced) == "x = 1\n\ny = 2"
    assert one(spark, tasks.fenced_program(F.col("p")), p=" plain \n") == "plain"
    program = one(
        spark, tasks.test_program(F.col("p"), F.col("c"), F.col("t"), F.col("e")),
        p="import os\ndef f():", c="```\nbody\n```", t="T", e="f",
    )
    assert program == "import os\n\nbody\n\nT\ncheck(f)"


def test_response_text(spark):
    cases = {
        " a ### Response:\n b c ": "b c",
        "<|im_start|>assistant\n hi": "hi",
        "  plain  ": "plain",
    }
    for text, want in cases.items():
        assert one(spark, tasks.response_text(F.col("t")), t=text) == want


def test_prompt_lines(spark):
    made = one(spark, tasks.indexed_choice(F.col("q"), F.col("c"), F.lit(2)), q="Why?", c=["w", "x", "y", "z"])
    assert made["prompt"] == (
        "Multiple Choice question: Why?\n- w=A\n- x=B\n- y=C\n- z=D\n\nRespond only with the letter of the correct answer."
    )
    assert made["answer"] == "C" and made["reject_reason"] is None


def test_letter_counting_counts(spark):
    words = spark.createDataFrame([(w,) for w in ("strawberry", "apple", "moon", "a")], "word string")
    index = spark.range(60).withColumnRenamed("id", "index")
    train = synth.letter_counting(synth.pick_words(index, words)).collect()
    test = synth.letter_counting(synth.pick_words(index, words, split="test")).collect()
    assert len(train) == 60
    for r in train:
        assert r["count"] == r["word"].count(r["letter"])
        assert r["parts"][2]["text"] == f"'{r['word']}'.count('{r['letter']}')"
        assert r["parts"][-1]["text"].endswith(f"#### {r['count']}")
        assert r["letter"] in r["user"] and r["word"] in r["user"]
        lines = r["parts"][0]["text"].split("\n")
        assert sum("hit!" in line for line in lines) == r["count"]
    assert {r["index"]: r["user"] for r in train} != {r["index"]: r["user"] for r in test}


def test_fewshot_draws(spark):
    items = spark.createDataFrame([(f"t{i % 2}", i) for i in range(23)], "task string, item_id bigint")
    rows = evals.fewshot_draw(items, "item_id", 5).collect()
    by_item = {}
    for r in rows:
        by_item.setdefault(r["item_id"], []).append(r["shot_key"])
        assert r["shot_key"] % 2 == r["item_id"] % 2
    assert len(by_item) == 23
    assert all(len(set(s)) == 5 and i not in s for i, s in by_item.items())
    with pytest.raises(Exception, match="fewer items"):
        evals.fewshot_draw(items, "item_id", 12).collect()


def test_common_length(spark):
    cases = [([[1, 2, 3], [1, 2, 4]], 2, 0), ([[1], [1, 2]], 1, 0), ([[5, 9], [7, 5, 9]], 0, 2), ([[1, 2], [1, 2]], 2, 2), ([[], [1]], 0, 0)]
    for seqs, prefix, suffix in cases:
        frame = spark.createDataFrame([(seqs,)], "s array<array<int>>")
        got = frame.select(evals.common_length(F.col("s")), evals.common_length(F.col("s"), from_end=True)).first()
        assert tuple(got) == (prefix, suffix), seqs


def test_bits_per_byte_edges(spark):
    token_bytes = spark.createDataFrame([(0, 0), (1, 2)], "token_id int, n_bytes int")
    losses = spark.createDataFrame([(-1, 9.0), (0, 9.0), (1, 1.0), (1, 3.0)], "target int, loss double")
    row = evals.bits_per_byte(losses, token_bytes).first()
    assert row["n_bytes"] == 4 and row["bpb"] == pytest.approx(4.0 / (0.6931471805599453 * 4))
    assert evals.bits_per_byte(losses.filter("target < 1"), token_bytes).first()["bpb"] == float("inf")
    assert evals.rows_in_budget(1000, 2, 30, 2) == 1000 // 120 * 4


def test_choice_prefers_the_first_of_equals(spark):
    rows = [(1, o, p, l, 1, 3) for o, l in ((0, 2.0), (1, 1.0), (2, 1.0)) for p in (0, 1, 2)]
    frame = spark.createDataFrame(rows, "item int, option int, pos int, loss double, start int, end int")
    assert evals.option_choice(frame, ["item"]).first()["predicted"] == 1


def test_metric_needs_every_task(spark):
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.1)], "task string, centred double")
    assert evals.mean_centred(scores, ("a", "b")).first()["metric"] == pytest.approx(0.3)
    assert evals.mean_centred(scores, ("a", "b", "c")).first()["metric"] is None


def test_sample_stops_before_terminal(spark):
    frame = spark.createDataFrame([([9, 1, 2, 9, 3], [0, 0, 1, 1, 1])], "t array<int>, m array<int>")
    got = frame.select(rollouts.stop_at(F.col("t"), F.col("m"), 1, [9, 8]).alias("s")).first()["s"]
    assert got["tokens"] == [9, 1, 2] and got["mask"] == [0, 0, 1]
    kept = frame.select(rollouts.stop_at(F.col("t"), F.col("m"), 1, [7]).alias("s")).first()["s"]
    assert kept["tokens"] == [9, 1, 2, 9, 3]
