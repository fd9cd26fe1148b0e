import random

import pytest
from pyspark.sql import functions as F

from loomwork.operators import chunking, packing

SIX = [
    ([1, 11, 12, 13, 14], [0, 1, 1, 1, 1]),
    ([1, 21, 22], [0, 1, 1]),
    ([1, 31, 32, 33], [0, 1, 1, 1]),
    ([1, 41, 42, 43, 44, 45], [0, 1, 1, 1, 1, 1]),
    ([1, 51, 52, 53], [0, 1, 1, 1]),
    ([1, 61, 62], [0, 1, 1]),
]


def simulate(lengths, capacity, buffer_size, crop):
    """The packing rule written as plain scans of a list."""
    source, buffer, rows = list(enumerate(lengths)), [], []
    while source or buffer:
        row, used = [], 0
        while used < capacity:
            while len(buffer) < buffer_size and source:
                buffer.append(source.pop(0))
            if not buffer:
                break
            fitting = [b for b in buffer if b[1] <= capacity - used]
            if fitting:
                best = max(b[1] for b in fitting)
                chosen = next(b for b in fitting if b[1] == best)
            elif crop:
                least = min(b[1] for b in buffer)
                chosen = next(b for b in buffer if b[1] == least)
            else:
                break
            buffer.remove(chosen)
            take = min(chosen[1], capacity - used)
            row.append((chosen[0], used, take))
            used += take
        if row:
            rows.append(row)
    return rows


@pytest.mark.parametrize("crop", [True, False])
@pytest.mark.parametrize("seed", range(6))
def test_place_equals_simulation(crop, seed):
    rng = random.Random(seed)
    capacity = 40
    top = 90 if crop else capacity
    lengths = [rng.randint(1, top) for _ in range(rng.choice([1, 7, 150]))]
    got = {}
    for row, pos, item, start, take, _ in packing.place(enumerate(lengths), capacity, 9, crop):
        got.setdefault(row, []).append((item, start, take))
        assert pos == len(got[row]) - 1
    assert [got[r] for r in sorted(got)] == simulate(lengths, capacity, 9, crop)


def test_padded_rows_and_targets(spark):
    """Two epochs of six chats, capacity 8, buffer 4: the first four rows are known."""
    feed = [(e * 6 + i, tokens, mask) for e in range(2) for i, (tokens, mask) in enumerate(SIX)]
    frame = spark.createDataFrame(feed, "doc_id bigint, tokens array<int>, mask array<int>")
    frame = frame.withColumn("n_tokens", F.size("tokens")).withColumn("pack_group", F.lit(0))
    placements = packing.plan(frame, 8, crop=False, buffer_size=4)
    rows = packing.fill_rows(frame, placements, {"tokens": 1, "mask": 0}, 8)
    out = packing.masked_targets(rows, 8).orderBy("row_in_group").collect()[:4]
    assert [r["tokens"] for r in out] == [
        [1, 41, 42, 43, 44, 45, 1, 1],
        [1, 11, 12, 13, 14, 1, 21, 22],
        [1, 11, 12, 13, 14, 1, 61, 62],
        [1, 31, 32, 33, 1, 51, 52, 53],
    ]
    assert [r["targets"] for r in out] == [
        [41, 42, 43, 44, 45, -1, -1],
        [11, 12, 13, 14, -1, 21, 22],
        [11, 12, 13, 14, -1, 61, 62],
        [31, 32, 33, -1, 51, 52, 53],
    ]
    assert out[0]["inputs"] == [1, 41, 42, 43, 44, 45, 1]


def _documents(spark, n=400):
    rng = random.Random(3)
    rows = [(i, [1] + [1000 + i] * rng.randint(0, 120)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, tokens array<int>").withColumn("n_tokens", F.size("tokens"))


@pytest.mark.parametrize("partitions", [1, 8])
def test_crop_mode_invariants(spark, partitions):
    frame = packing.with_pack_group(_documents(spark).repartition(partitions), n_groups=20)
    placements = packing.plan(frame, 65, crop=True, buffer_size=20).cache()
    assert placements.count() == 400 and placements.select("doc_id").distinct().count() == 400
    rows = packing.fill_rows(frame, placements, {"tokens": None}, 65).collect()
    short = [r for r in rows if len(r["tokens"]) < 65]
    assert all(r["tokens"][0] == 1 for r in rows)
    assert len(short) <= frame.select("pack_group").distinct().count()
    quality = packing.quality(placements, 65).first()
    assert quality["placed_tokens"] == sum(len(r["tokens"]) for r in rows)
    assert quality["n_tokens"] == frame.agg(F.sum("n_tokens")).first()[0]
    numbered = packing.number_rows(placements)
    assert sorted(r["row_id"] for r in numbered.collect()) == list(range(len(rows)))


def test_partitioning_does_not_change_placements(spark):
    plans = []
    for p in (1, 8):
        frame = packing.with_pack_group(_documents(spark).repartition(p), n_groups=20)
        placements = packing.plan(frame, 65, crop=True, buffer_size=20)
        plans.append(sorted(map(tuple, placements.collect())))
    assert plans[0] == plans[1]


def test_steps_and_resume(spark):
    rows = [(i, ([1, i, i], [0, 1, 1])) for i in range(4)]
    frame = spark.createDataFrame(
        [(i, t, m) for i, (t, m) in rows], "doc_id bigint, tokens array<int>, mask array<int>"
    ).withColumn("n_tokens", F.size("tokens")).withColumn("pack_group", F.lit(0))
    numbered = packing.number_rows(packing.plan(frame, 4, crop=False, buffer_size=2)).cache()
    state = packing.steps(numbered, 1, 4, num_iterations=4).orderBy("step").collect()
    assert [s["progress"] for s in state] == [0.25, 0.5, 0.75, 1.0]
    assert [s["last_step"] for s in state] == [False, False, False, True]
    by_docs = packing.steps(numbered, 1, 4).orderBy("step").collect()
    assert [s["consumed"] for s in by_docs] == [1, 2, 3, 4]
    assert sorted(r["row_id"] for r in packing.resume(numbered, 1, 1).collect()) == [2, 3]


def test_blocks_keep_or_drop_the_tail(spark):
    docs = spark.createDataFrame(
        [(3, [7, 8]), (1, [1, 2, 3, 4, 5]), (2, []), (9, [9])], "doc_id bigint, tokens array<int>"
    )
    whole = chunking.fixed_blocks(docs, "doc_id", 3, keep_tail=True).orderBy("block_id").collect()
    assert [r["tokens"] for r in whole] == [[1, 2, 3], [4, 5, 7], [8, 9]]
    assert chunking.fixed_blocks(docs, "doc_id", 3).count() == 2


def test_windows_cross_block_edges(spark):
    stream = list(range(100))
    docs = spark.createDataFrame([(i, stream[i * 10 : i * 10 + 10]) for i in range(10)], "doc_id bigint, tokens array<int>")
    blocks = chunking.fixed_blocks(docs, "doc_id", 16, keep_tail=True)
    starts = [0, 5, 15, 16, 31, 60, 91]
    windows = spark.createDataFrame([(i, s) for i, s in enumerate(starts)], "window_id bigint, start bigint")
    for length in (8, 40):
        usable = windows.filter(F.col("start") + length < 100)
        got = {r["window_id"]: (r["x"], r["y"]) for r in chunking.random_windows(blocks, 16, usable, length).collect()}
        for i, s in enumerate(starts):
            if s + length < 100:
                assert got[i] == (stream[s : s + length], stream[s + 1 : s + 1 + length])


def test_padding_keeps_real_lengths(spark):
    rows = spark.createDataFrame([(0, [1]), (0, [1, 2, 3]), (1, [4])], "g int, tokens array<int>")
    got = sorted((r["g"], r["n_real"], r["tokens"]) for r in chunking.pad_to_longest(rows, "g", 0).collect())
    assert got == [(0, 1, [1, 0, 0]), (0, 3, [1, 2, 3]), (1, 1, [4])]


@pytest.mark.parametrize("crop", [True, False])
def test_resuming_places_what_the_uninterrupted_plan_places(spark, crop):
    """Three epochs, cut before every step of every group; also states saved while the buffer drains."""
    rng = random.Random(7)
    sizes = [(i, rng.randint(0, 90 if crop else 40)) for i in range(60)] + [(None, 5)]
    frame = packing.with_pack_group(spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint"), 3)
    columns = ["pack_group", "row_in_group", "pos", "doc_id", "epoch", "start_at", "take"]

    def planned(state=None):
        steps = packing.plan_steps(frame, 40, crop, 6, 2, epochs=3, state=state).cache()
        return steps, sorted((tuple(r) for r in steps.filter("row_in_group IS NOT NULL").select(*columns).collect()), key=repr)

    whole, placed = planned()
    states = packing.saved_states(whole)
    told = sorted(tuple(r) for r in states.select("pack_group", "step", "consumed").collect())
    for group, step, consumed in told[::5]:
        _, after = planned(states.filter(f"pack_group = {group} AND step = {step}"))
        assert after == [p for p in placed if p[0] == group and p[1] >= 2 * step]
        assert consumed == sum(p[0] == group and p[1] < 2 * step for p in placed)
    assert {e for *_, e, _, _ in placed} == {0, 1, 2} and len(placed) == 3 * sum(n > 0 for _, n in sizes)


def test_long_inputs_are_planned_as_they_come():
    """A packer holds its buffer and nothing more, however much is fed."""
    packer = packing.Packer(100, 50, crop=True)
    placed = 0
    for i in range(20_000):
        placed += sum(1 for _ in packer.feed(i, 1 + i % 37))
        assert packer.buffer.size < 50
    assert placed + sum(1 for _ in packer.drain()) == 20_000
