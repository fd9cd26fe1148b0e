"""Losses summed per target, each token hashed as seldom as can be."""

from loomwork.operators import evals
from loomwork.plans import evals as eval_plans


def test_ignored_targets_make_no_group(spark):
    rows = [("a", 1, 2.0), ("a", -1, 9.0), ("a", None, 9.0), ("a", 0, 5.0), ("a", 1, None), ("b", -1, 1.0), (None, 1, 4.0)]
    losses = spark.createDataFrame(rows, "split string, target int, loss double")
    table = spark.createDataFrame([(0, 0), (1, 3)], "token_id int, n_bytes int")
    got = {r["split"]: (r["nats"], r["n_bytes"]) for r in evals.bits_per_byte(losses, table, ["split"]).collect()}
    assert got == {"a": (2.0, 6), None: (4.0, 3)}
    none = evals.bits_per_byte(losses.filter("target < 0").drop("split"), table).collect()
    assert [(r["nats"], r["n_bytes"], r["bpb"]) for r in none] == [(0.0, 0, float("inf"))]


def test_each_token_is_hashed_for_its_id_skip_and_loss_once(spark):
    losses, table = eval_plans._losses(spark, "/root/testdata/sf0.001")
    scored = evals.bits_per_byte(losses, table, ["split"])
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    # And once per document for its split, below the tokens.
    assert plan.count("md5(") == 4
    assert "md5(" in plan[plan.index("posexplode") :]
