"""Cases that once gave wrong rows."""

import pytest
from pyspark.sql import functions as F

from loomwork.operators import chatcheck, chunking, evals, mixture, render, runlog, shards, splits
from loomwork.sources import records, shardfiles, tables
from loomwork.streaming import jobs


@pytest.mark.parametrize("n", [0, 1, 999, 1000, 1001, 5000])
def test_cap_keeps_exactly_n_on_tied_keys(spark, n):
    df = spark.range(4000).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 4).alias("key"), "id")
    kept = splits.cap_after_shuffle(df, ["g"], ["key"], n, seed=3).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in kept} == ({0: min(n, 2000), 1: min(n, 2000)} if n else {})


def test_token_files_are_not_overwritten_by_chance(spark, tmp_path):
    path = str(tmp_path / "tokens")
    rows = spark.range(10).select("id", F.array_repeat(F.lit(7), 20).alias("tokens"))
    shardfiles.write_tokens(rows, "id", path)
    with pytest.raises(FileExistsError):
        shardfiles.write_tokens(rows.limit(2), "id", path)
    count = lambda: shardfiles.read_tokens(spark, path).agg(F.sum(F.size("tokens"))).first()[0]
    assert count() == 200
    shardfiles.write_tokens(rows.limit(2), "id", path, overwrite=True)
    assert count() == 40


def test_files_with_a_blank_in_their_name_are_read(spark, tmp_path):
    import pandas as pd

    pd.DataFrame({"text": ["a", "b"]}).to_parquet(tmp_path / "part 1.parquet")
    pd.DataFrame({"text": ["c"]}).to_parquet(tmp_path / "p2.parquet")
    got = tables.read_corpus(spark, "any", [str(tmp_path)]).collect()
    assert sorted((r["text"], r["shard"]) for r in got) == [("a", 1), ("b", 1), ("c", 0)]


def test_zero_shots_and_equal_ids_in_two_tasks(spark):
    items = spark.createDataFrame(
        [(t, i, f"{t}{i}") for t in "ab" for i in range(4)], "task string, item_id int, query string"
    )
    none = evals.with_shots(items, evals.fewshot_draw(items, "item_id", 0), F.col("query"), "item_id").collect()
    assert len(none) == 8 and {r["shots"] for r in none} == {""}
    two = evals.with_shots(items, evals.fewshot_draw(items, "item_id", 2), F.col("query"), "item_id").collect()
    assert len(two) == 8
    for r in two:
        shown = r["shots"].split("\n\n")[:-1]
        assert len(shown) == 2 and len(set(shown)) == 2
        assert all(s[0] == r["task"] for s in shown) and r["query"] not in shown


def test_shots_are_not_only_neighbours(spark):
    items = spark.range(50).select(F.lit("t").alias("task"), F.col("id").alias("item_id"))
    draws = evals.fewshot_draw(items, "item_id", 2).groupBy("item_id").agg(F.collect_set("shot_key").alias("k"))
    assert all(len(r["k"]) == 2 for r in draws.collect())


def test_zero_repeats_leave_a_source_out(spark):
    rows = spark.range(3).withColumnRenamed("id", "k")
    recipe = [mixture.Ingredient("a", rows, "k", repeats=0), mixture.Ingredient("b", rows, "k", repeats=2)]
    assert [(r["task"], r["task_idx"]) for r in mixture.mixture(recipe).select("task", "task_idx").distinct().collect()] == [("b", 1)]
    with pytest.raises(ValueError):
        mixture.mixture(recipe[:1])
    with pytest.raises(ValueError):
        tables.epochs(rows, 0)


def test_blocks_per_group(spark):
    docs = spark.createDataFrame(
        [(s, k, [k] * 3) for s in ("a", "b") for k in range(4)], "split string, k int, tokens array<int>"
    )
    got = chunking.fixed_blocks(docs, "k", 6, by=["split"]).collect()
    assert sorted((r["split"], r["block_id"]) for r in got) == [(s, b) for s in "ab" for b in (0, 1)]


def test_a_task_without_baseline_is_an_error(spark):
    outcomes = spark.createDataFrame([("x", True), ("y", False)], "task string, correct boolean")
    known = spark.createDataFrame([("x", 25.0)], "task string, baseline double")
    with pytest.raises(Exception, match="no baseline for task y"):
        evals.task_scores(outcomes, known).collect()
    losses = spark.createDataFrame([(5, 1.0)], "target int, loss double")
    with pytest.raises(Exception, match="no byte length for token 5"):
        evals.bits_per_byte(losses, spark.createDataFrame([(4, 1)], "token_id int, n_bytes int")).collect()


def test_lines_of_tabs_are_no_rejects(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\t\t\n')
    schema = spark.createDataFrame([], "a int").schema
    rows, rejects = records.jsonl(spark, str(tmp_path / "a.jsonl"), schema)
    assert rows.count() == 1 and rejects.count() == 0


def test_gaps_in_turns_have_a_reason_of_their_own(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "a"), (1, 2, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"),
         (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 1, "user", "c"), (3, 3, "assistant", "d")],
        "conv_id int, turn int, role string, text string",
    )
    got = {r["conv_id"]: r["reject_reason"] for r in chatcheck.judge(turns).collect()}
    assert got == {1: "turns_not_contiguous", 2: None, 3: "turns_not_contiguous"}


def test_new_rows_are_appended_once_per_key(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "k int, v string")
    assert sorted(r["k"] for r in shards.append_missing(old, new, ["k"]).collect()) == [1, 2]


def test_large_early_values_stay_in_the_average(spark):
    values = [1e30] + [1.0] * 3000
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "run int, k int, value double")
    got = {r["step"]: r["ema"] for r in runlog.exponential_average(rows, "run", "k", "value", 0.9).collect()}
    state = 0.0
    for i, v in enumerate(values):
        state = 0.9 * state + 0.1 * v
        assert got[i] == pytest.approx(state / (1 - 0.9 ** (i + 1)), rel=1e-9)


def test_parts_beyond_any_fixed_number_keep_their_turn(spark):
    codec = render.Codec(render.code_points, {f"<|{n}|>": 1000 + i for i, n in enumerate(
        ("bos", "user_start", "user_end", "assistant_start", "assistant_end", "python_start", "python_end",
         "output_start", "output_end"))})
    turns = spark.createDataFrame(
        [(1, t, r, x) for t, r, x in ((0, "user", "a"), (1, "assistant", "b"), (5_000_000_000, "user", "c"))],
        "conv_id int, turn bigint, role string, text string",
    )
    (row,) = render.render(turns, codec).collect()
    assert row["tokens"] == [1000, 1001, 97, 1002, 1003, 98, 1004, 1001, 99, 1002]


@pytest.mark.parametrize("files_per_batch", [1, 4])
def test_stream_blocks_do_not_depend_on_batches(spark, tmp_path, files_per_batch):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for f in range(4):
        rows = spark.range(f * 10, f * 10 + 10).select("id", F.repeat(F.lit("x "), 7).alias("text"))
        rows.coalesce(1).write.mode("append").parquet(path)
    words = lambda t: F.split(F.trim(t), " ")
    stream = jobs.source(spark, path, spark.read.parquet(path).schema, files_per_batch)
    jobs.block_texts(stream, "id", words, 56, out, str(tmp_path / "progress"))
    got = spark.read.parquet(out)
    assert [r["block_id"] for r in got.orderBy("block_id").collect()] == list(range(5))
    assert got.agg(F.sum(F.size("tokens"))).first()[0] == 280


def test_scratch_is_released(spark, tmp_path):
    import os

    from loomwork import session

    session.release(spark)
    kept = session.stored(spark.range(3), "stage")
    (path,) = session._SCRATCH
    assert kept.count() == 3 and os.path.isdir(path.removeprefix("file:"))
    session.release(spark)
    assert not os.path.exists(path.removeprefix("file:"))


def test_a_job_seen_in_two_batches_is_told_once(spark, tmp_path):
    line = "slurmstepd: error: *** JOB {} ON n1 CANCELLED AT now DUE TO TIME LIMIT ***"
    source = tmp_path / "log"
    for jobs_here in ((1, 2), (2, 3), (1, 3)):
        rows = [(line.format(j),) for j in jobs_here] + [("step 1 done",)]
        spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").text(str(source))
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(source))
    for _ in range(2):
        jobs.time_limited_jobs(lines, str(tmp_path / "out"), str(tmp_path / "progress"))
    got = [r["job_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [1, 2, 3]
