import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomwork.operators import runlog, shards, splits
from loomwork.sources import prepared, records, shardfiles, storage, tables


def test_corpus_of_several_files(spark, tmp_path):
    folder = tmp_path / "corpus"
    folder.mkdir()
    for i, name in enumerate(["b", "a", "c"]):
        pd.DataFrame({"content": [f"{name}{j}" for j in range(i + 1)]}).to_parquet(folder / f"{name}.parquet")
    (folder / "z.parquet.tmp").write_text("x")
    rows = tables.read_corpus(spark, "rust", [str(tmp_path / "missing"), str(folder)])
    got = splits.last_shard_split(tables.text_rows(rows)).select("text", "shard", "split").collect()
    assert {(r["text"], r["shard"], r["split"]) for r in got} == {
        ("a0", 0, "train"), ("a1", 0, "train"), ("b0", 1, "train"),
        ("c0", 2, "val"), ("c1", 2, "val"), ("c2", 2, "val"),
    }
    with pytest.raises(FileNotFoundError):
        tables.read_corpus(spark, "rust", [str(tmp_path / "missing")])
    assert tables.read_corpus(spark, "rust", [str(tmp_path / "missing")], fallback=str(folder)).count() == 6


def test_markers(spark, tmp_path):
    """States in the order a preparation goes through them."""
    path = str(tmp_path / "prepared")

    def put(split, marker):
        folder = tmp_path / "prepared" / f"split={split}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "part-0.parquet").write_text("x")
        if marker:
            (folder / prepared.MARKER).write_text("{}")

    assert not prepared.is_prepared(spark, path, "train") and not prepared.all_prepared(spark, path)
    put("train", False)
    assert prepared.is_incomplete(spark, path, "train") and not prepared.is_prepared(spark, path, "train")
    with pytest.raises(RuntimeError):
        prepared.refuse_partial(spark, path)
    put("train", True)
    assert prepared.is_prepared(spark, path, "train") and not prepared.is_incomplete(spark, path, "train")
    put("val", False)
    assert prepared.is_incomplete(spark, path, "val") and not prepared.all_prepared(spark, path)
    put("val", True)
    assert prepared.all_prepared(spark, path)


def _chats(spark):
    return spark.createDataFrame(
        [(i, "general" if i % 3 else "math", "val" if i % 5 == 0 else "train") for i in range(60)],
        "id bigint, subset string, split string",
    )


def test_prepare_and_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    manifest = prepared.write_prepared(_chats(spark), path, {"val_ratio": 0.2}, rows_per_shard=10)
    assert manifest["counts"] == {"train": {"general": 32, "math": 16}, "val": {"general": 8, "math": 4}}
    marker = storage.read_json(spark, f"{path}/split=train/{prepared.MARKER}")
    assert marker["rows"] == 48 and marker["shards"] == len(prepared.data_files(spark, path, "train"))
    assert prepared.scan(spark, path, "val").count() == 12
    shuffled = prepared.scan(spark, path, "train", "math", key="id")
    assert sorted(r["position"] for r in shuffled.collect()) == list(range(16))
    # A finished output is kept as it is.
    assert prepared.write_prepared(_chats(spark), path, {})["val_ratio"] == 0.2
    prepared.require_same_parameters(spark, path, {"val_ratio": 0.2})
    with pytest.raises(ValueError):
        prepared.require_same_parameters(spark, path, {"val_ratio": 0.3})
    with pytest.raises(ValueError):
        prepared.scan(spark, path, "train", "code")
    with pytest.raises(FileNotFoundError):
        prepared.scan(spark, str(tmp_path / "none"), "train")
    chosen = prepared.load_chat(spark, str(tmp_path / "none"), "train", lambda: "recipe")
    assert chosen == "recipe"


def test_text_shards(spark, tmp_path):
    texts = [f" text {i}\nline " for i in range(25)] + ["", None, "   "]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    clean = shards.stripped(docs)
    plan = shards.text_shard_plan(clean, "doc_id", rows_per_shard=10)
    path = str(tmp_path / "txt")
    shardfiles.write_text_shards(clean.join(plan, "doc_id"), path, shards.END_OF_FILE)
    files = sorted(f for f in os.listdir(path) if f.endswith(".txt"))
    assert files == ["train_00000.txt", "train_00001.txt", "train_00002.txt"]
    want = [f"text {i}\nline" for i in range(25)]
    for i, name in enumerate(files):
        assert (tmp_path / "txt" / name).read_text() == shards.END_OF_FILE.join(want[i * 10 : i * 10 + 10])
    index = json.loads((tmp_path / "txt" / "index.json").read_text())
    summary = shards.shard_summary(plan, shards.END_OF_FILE).orderBy("shard").collect()
    assert [(e["rows"], e["chars"]) for e in index] == [(r["n_rows"], r["n_chars"]) for r in summary]
    assert sorted(r["text"] for r in records.whole_texts(spark, f"{path}/*.txt").collect()) == sorted(
        (tmp_path / "txt" / name).read_text() for name in files
    )


def test_token_binary(spark, tmp_path):
    import numpy as np

    docs = [(i, [i * 10 + j for j in range(i % 7)] + [50_256]) for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id bigint, tokens array<int>").repartition(5)
    path = str(tmp_path / "bin")
    shardfiles.write_tokens(frame, "doc_id", path)
    stream = [t for _, tokens in docs for t in tokens]
    parts = sorted(f for f in os.listdir(path) if f.endswith(".bin"))
    raw = np.concatenate([np.fromfile(f"{path}/{p}", dtype=np.uint16) for p in parts])
    assert raw.tolist() == stream
    blocks = shardfiles.read_tokens(spark, path, block=64).orderBy("stream_offset").collect()
    assert [t for b in blocks for t in b["tokens"]] == stream
    too_big = spark.createDataFrame([(1, [70_000])], "doc_id bigint, tokens array<int>")
    with pytest.raises(Exception, match="does not fit"):
        shardfiles.write_tokens(too_big, "doc_id", str(tmp_path / "bad"))
    assert not [f for f in os.listdir(tmp_path) if f == "bad" and os.listdir(tmp_path / "bad") == ["index.json"]]


def test_jsonl_rejects(spark, tmp_path):
    from loomwork.schemas import CHAT_ROW

    path = tmp_path / "in.jsonl"
    path.write_text('{"prompt": "p", "answer": "a"}\n\n{broken\n{"messages": [{"role": "user", "content": "x"}]}\n')
    rows, rejects = records.jsonl(spark, str(path), CHAT_ROW)
    assert rows.count() == 2 and [r["line"] for r in rejects.collect()] == ["{broken"]


def test_message_arrays(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('[{"role":"user","content":"Hi"},{"role":"assistant","content":"Hello"}]\n\n{"a":1}\n[{"role":"user"}]\n')
    rows, rejects = records.message_arrays(spark, str(path))
    assert rows.count() == 1 and rejects.count() == 2


def test_records_schema(spark, tmp_path):
    path = str(tmp_path / "r")
    assert not prepared.has_records(spark, path)
    prepared.write_records(spark.createDataFrame([("i", "", "o")], "instruction string, input string, output string"), path)
    assert prepared.has_records(spark, path)
    other = str(tmp_path / "o")
    prepared.write_records(spark.createDataFrame([("i",)], "instruction string"), other)
    assert not prepared.has_records(spark, other)


def test_task_config(spark):
    rows = records.task_config(
        spark,
        [
            {"label": "a", "icl_task_type": "schema", "dataset_uri": "a.jsonl", "num_fewshot": [10, 0]},
            {"label": "b", "icl_task_type": "schema", "dataset_uri": "b", "num_fewshot": [0], "continuation_delimiter": ": "},
        ],
    ).collect()
    assert [(r["n_shots"], r["delimiter"]) for r in rows] == [(10, " "), (0, ": ")]


def test_log_line(spark):
    line = (
        "step 00499/182414 (0.27%) | loss: 6.397844 | lrm: 1.00 | dt: 3830.24ms | tok/sec: 8,555 | bf16_mfu: 4.03"
        " | epoch: 1 pq: 0 rg: 33 | total time: 63.01m | eta: 23441.6m"
    )
    frame = spark.createDataFrame([(line,), ("other",)], "line string")
    got = runlog.parse_steps(frame).collect()
    assert len(got) == 1
    assert got[0].asDict() == {
        "step": 499, "planned": 182414, "pct": 0.27, "loss": 6.397844, "lrm": 1.0, "dt_ms": 3830.24,
        "tok_per_sec": 8555, "mfu": 4.03, "epoch": 1, "pq": 0, "rg": 33, "total_min": 63.01, "eta_min": 23441.6,
    }


@pytest.mark.parametrize("beta", [0.5, 0.9, 0.99, 0.9999])
def test_exponential_average_over_long_runs(spark, beta):
    import math

    n = 1500
    rows = [(0, k, math.sin(k)) for k in range(n)] + [(1, k, float(k)) for k in range(10)]
    frame = spark.createDataFrame(rows, "run int, key bigint, value double").repartition(4)
    got = {(r["run"], r["key"]): r["ema"] for r in runlog.exponential_average(frame, "run", "key", "value", beta).collect()}
    for run, size in ((0, n), (1, 10)):
        state = 0.0
        for k in range(size):
            value = math.sin(k) if run == 0 else float(k)
            state = beta * state + (1 - beta) * value
            assert got[(run, k)] == pytest.approx(state / (1 - beta ** (k + 1)), rel=1e-9, abs=1e-9)


def test_wall_clock_ignores_rl(spark):
    rows = [
        ("header", "2025-01-01 10:00:00"), ("chat sft", "2025-01-01 12:30:59"),
        ("chat rl", "2025-01-02 00:00:00"), ("base", "not a time"),
    ]
    row = runlog.wall_clock(spark.createDataFrame(rows, "section string, stamp string")).first()
    assert (row["hours"], row["minutes"]) == (2, 30)


def test_chat_recipe(spark):
    from loomwork.operators import mixture

    def ids(n):
        return spark.range(n), "id"

    train = {"smoltalk": ids(9), "identity": ids(4), "mmlu": ids(3), "gsm8k": ids(2), "spelling": ids(2), "letter_counting": ids(1)}
    mixed = mixture.mixture(mixture.chat_recipe(train, "train", {"gsm8k": 5})).collect()
    assert len(mixed) == 9 + 2 * 4 + 3 * 3 + 5 * 2 + 2 + 1
    assert sorted(r["position"] for r in mixed) == list(range(len(mixed)))
    assert [r["task"] for r in sorted(mixed, key=lambda r: r["position"])] != sorted(r["task"] for r in mixed)
    val = {"smoltalk": ids(5), "mmlu": ids(5_300), "gsm8k": ids(500)}
    counts = {r["task"]: r["n_rows"] for r in mixture.composition(mixture.index_map(mixture.chat_recipe(val, "val"))).collect()}
    assert counts == {"smoltalk": 5, "mmlu": 5_200, "gsm8k": 420, "(all)": 5_625}
