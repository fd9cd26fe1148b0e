import hashlib
import json

import pytest
from pyspark.sql import functions as F

from loomwork.operators import chatcheck, chatforms, render, splits
from loomwork.plans.chats import IM, IM_IDS, MARKER_IDS, MARKERS

TURNS = "conv_id bigint, turn bigint, role string, text string"

CASES = {
    1: ([("system", "You are helpful."), ("user", "  hi  "), ("assistant", "  hello  ")], None),
    2: ([("assistant", "hello"), ("user", "hi")], "not_user_first"),
    3: ([("user", "hi")], "too_few_messages"),
    4: ([("user", "hi"), ("tool", "x"), ("assistant", "y")], "unsupported_role"),
    5: ([("user", "hi"), ("assistant", None)], "content_not_string"),
    6: ([("user", "　\n "), ("assistant", "y")], "content_empty"),
    7: ([("system", "s"), ("user", "hi")], "system_without_dialogue"),
    8: ([("user", "a"), ("assistant", "b"), ("user", "c")], "not_assistant_last"),
    9: ([("user", "a"), ("user", "b"), ("assistant", "c")], "roles_not_alternating"),
    10: ([("user", "a"), ("assistant", "b"), ("system", "c"), ("assistant", "d")], "roles_not_alternating"),
    11: ([("user", "a"), ("assistant", "b")], None),
    12: ([("system", "s"), ("system", "t"), ("assistant", "b")], "not_user_first"),
}


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(c, i, r, t) for c, (ms, _) in CASES.items() for i, (r, t) in enumerate(ms)]
    return spark.createDataFrame(rows, TURNS).repartition(3)


def test_turn_and_array_checks_agree(spark, turns):
    by_turn = {r["conv_id"]: r["reject_reason"] for r in chatcheck.judge(turns).collect()}
    assert by_turn == {c: reason for c, (_, reason) in CASES.items()}
    for rules in (chatcheck.PREPARED, chatcheck.LOOSE, chatcheck.STRICT):
        a = {r["conv_id"]: r["reject_reason"] for r in chatcheck.judge(turns, rules).collect()}
        rows = chatforms.assemble(turns).select(
            "conv_id", chatforms.reject_reason(F.col("messages"), rules).alias("reason")
        )
        assert {r["conv_id"]: r["reason"] for r in rows.collect()} == a


def test_looser_rules(spark, turns):
    def accepted(rules):
        return {r["conv_id"] for r in chatcheck.judge(turns, rules).filter("reject_reason IS NULL").collect()}

    assert accepted(chatcheck.PREPARED) == {1, 11}
    assert accepted(chatcheck.LOOSE) == {1, 6, 8, 11}
    assert accepted(chatcheck.STRICT) == {6, 8, 11}


def test_subset_names():
    known = ("general", "math")
    assert chatcheck.parse_names(" general , math,", known) == ("general", "math")
    assert chatcheck.parse_names(" , ", known) is None
    assert chatcheck.parse_names(None, known) is None
    with pytest.raises(ValueError):
        chatcheck.parse_names("general,not-a-real-subset", known)


def test_size_limits(spark):
    rows = [
        (1, 0, "user", "x" * 8001), (2, 0, "user", ""), (3, 0, "system", "s"),
        *[(4, i, "user", "x" * 7000) for i in range(5)], *[(5, i, "user", "x") for i in range(501)], (6, 0, "user", "ok"),
    ]
    got = chatcheck.judge_size(spark.createDataFrame(rows, TURNS)).collect()
    assert {r["conv_id"]: r["size_issue"] for r in got} == {
        1: "message_too_long", 2: "empty_content", 3: "invalid_role", 4: "conversation_too_long",
        5: "too_many_messages", 6: None,
    }


def test_exact_split_is_the_digest_of_sorted_json(spark):
    messages = [{"role": "user", "content": "a\nb é \"q\""}, {"role": "assistant", "content": "c"}]
    frame = spark.createDataFrame([(i, f"s{i}", messages) for i in range(50)], "i int, s string, m array<struct<role:string,content:string>>")
    got = {r["i"]: r["v"] for r in frame.select("i", splits.exact_content_split(F.col("m"), F.col("s"), 0.3).alias("v")).collect()}
    for i in range(50):
        payload = json.dumps({"subset": f"s{i}", "messages": messages}, ensure_ascii=False, sort_keys=True)
        score = int.from_bytes(hashlib.blake2b(payload.encode(), digest_size=8).digest(), "big") / 2**64
        assert got[i] == ("val" if score < 0.3 else "train")
    assert set(got.values()) == {"train", "val"}


def _shown(ids, specials):
    names = {v: k for k, v in specials.items()}
    return "".join(names.get(i) or chr(i) for i in ids)


CHAT = [("system", "You are helpful."), ("user", "Say hi."), ("assistant", "Hi there!")]


def _turns(spark, messages):
    return spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(messages)], TURNS)


def test_im_template(spark):
    row = render.render(_turns(spark, CHAT), IM).first()
    assert _shown(row["tokens"], IM_IDS) == (
        "<|endoftext|><|im_start|>user\nYou are helpful.\n\nSay hi.<|im_end|>\n"
        "<|im_start|>assistant\nHi there!<|im_end|>\n"
    )
    assert sum(row["mask"]) == 9 + 2 and len(row["mask"]) == len(row["tokens"])
    prompt = render.render_for_completion(_turns(spark, CHAT), IM).first()
    assert _shown(prompt["tokens"], IM_IDS) == (
        "<|endoftext|><|im_start|>user\nYou are helpful.\n\nSay hi.<|im_end|>\n<|im_start|>assistant\n"
    )


def test_marker_template_and_cut(spark):
    chat = [("user", "Hello"), ("assistant", "World")]
    row = render.render(_turns(spark, chat), MARKERS).first()
    assert _shown(row["tokens"], MARKER_IDS) == (
        "<|bos|><|user_start|>Hello<|user_end|><|assistant_start|>World<|assistant_end|>"
    )
    assert sum(row["mask"]) == 5 + 1
    cut = render.render(_turns(spark, chat), MARKERS, max_tokens=11).first()
    assert cut["tokens"] == row["tokens"][:11] and cut["mask"] == row["mask"][:11]


def test_tool_parts(spark):
    parts = [("text", "a"), ("python", "1+1"), ("python_output", "2"), ("text", "b")]
    rows = [(1, 0, "user", [("text", "q")]), (1, 1, "assistant", parts)]
    frame = spark.createDataFrame(
        rows, "conv_id bigint, turn bigint, role string, parts array<struct<type:string,text:string>>"
    ).withColumn("text", F.lit(None).cast("string"))
    row = render.render(frame, MARKERS).first()
    assert _shown(row["tokens"], MARKER_IDS) == (
        "<|bos|><|user_start|>q<|user_end|><|assistant_start|>a<|python_start|>1+1<|python_end|>"
        "<|output_start|>2<|output_end|>b<|assistant_end|>"
    )
    assert row["mask"] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 0, 0, 0, 1, 1]


def test_long_chats_are_cut_before_they_are_gathered(spark):
    n = 3000
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "xyz") for i in range(n)]
    row = render.render(spark.createDataFrame(rows, TURNS).repartition(4), MARKERS, max_tokens=50).first()
    assert len(row["tokens"]) == 50
    whole = render.render(spark.createDataFrame(rows, TURNS).repartition(4), MARKERS, max_tokens=10**6).first()
    assert len(whole["tokens"]) == 1 + n * 5 and whole["tokens"][:50] == row["tokens"]


def test_template_choice():
    assert render.choose_template(MARKER_IDS) == "markers"
    assert render.choose_template(IM_IDS) == "im"
    with pytest.raises(ValueError):
        render.choose_template({"<|bos|>": 1})


def test_instruction_record(spark):
    messages = [
        ("system", " s "), ("user", " q1 "), ("assistant", "a1"), ("user", "q2"), ("assistant", " a2 "),
    ]
    frame = spark.createDataFrame([([{"role": r, "content": c} for r, c in messages],)], "m array<struct<role:string,content:string>>")
    r = frame.select(chatforms.instruction_record(F.col("m")).alias("r")).select("r.*").first()
    assert r["instruction"] == "s\n\nq1"
    assert r["input"] == "Assistant: a1\n\nUser: q2"
    assert r["output"] == "a2"


def test_structured_fields(spark):
    values = ['{"title": " T ", "n": 1}', "{'title': 'it\\'s', 'x': None}", "", None, "[1]", "{bad", '{"other": 1}']
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r["i"]: r["t"] for r in chatforms.structured_fields(frame, "v", "title", "t").collect()}
    assert got == {0: "T", 1: "it's", 2: "", 3: "", 4: "", 5: "", 6: ""}
