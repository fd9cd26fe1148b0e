import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomwork.operators import running as R


@pytest.fixture(scope="module")
def skewed():
    """A third of the rows in one group, sparse and unordered keys, a null group."""
    rng = np.random.default_rng(5)
    n = 900
    group = np.where(np.arange(n) < n // 3, "hot", rng.choice(["a", "b", "c"], n)).astype(object)
    group[-20:] = None
    keys = rng.choice(10**12, n, replace=False)
    return pd.DataFrame({"g": group, "k": keys, "v": rng.integers(-50, 50, n)})


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_matches_pandas(spark, skewed, inclusive):
    df = spark.createDataFrame(skewed, "g string, k bigint, v bigint").repartition(5)
    measures = {
        "s": ("sum", F.col("v")), "n": ("count", F.lit(1)), "lo": ("min", F.col("v")), "hi": ("max", F.col("v")),
    }
    got = R.running(df, "k", measures, by=["g"], inclusive=inclusive).toPandas().set_index("k").sort_index()
    want = skewed.sort_values("k").set_index("k")
    grouped = want["v"].groupby(want["g"].fillna("?"))
    assert len(got) == len(want)
    if inclusive:
        assert (got["s"] == grouped.cumsum()).all()
        assert (got["lo"] == grouped.cummin()).all()
        assert (got["hi"] == grouped.cummax()).all()
        assert (got["n"] == grouped.cumcount() + 1).all()
    else:
        assert (got["s"] == grouped.cumsum() - want["v"]).all()
        assert (got["n"] == grouped.cumcount()).all()


def test_ordinal_is_the_same_for_any_partitioning(spark, skewed):
    df = spark.createDataFrame(skewed, "g string, k bigint, v bigint")
    one, many = (
        R.with_ordinal(df.repartition(p), "k").select("k", "ordinal").orderBy("k").collect() for p in (1, 8)
    )
    assert one == many
    assert [r["ordinal"] for r in one] == list(range(len(skewed)))


@pytest.mark.parametrize("keep_crossing", [True, False])
def test_take_until(spark, keep_crossing):
    rows = [(g, k, 10 + (k * 7) % 13) for g in ("x", "y", "z") for k in range(200)]
    df = spark.createDataFrame(rows, "g string, k bigint, w bigint")
    got = R.take_until(df, "k", F.col("w"), 400, ["g"], keep_crossing=keep_crossing)
    want = set()
    for name in ("x", "y", "z"):
        total = 0
        for g, k, w in rows:
            if g != name:
                continue
            if (total if keep_crossing else total + w) > 400:
                break
            want.add((g, k))
            total += w
    assert {(r["g"], r["k"]) for r in got.collect()} == want


def test_take_until_over_everything(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert R.take_until(df, "k", F.lit(1), 10, keep_crossing=False).count() == 10


def test_caps_beyond_and_below_the_trim_limit_agree_with_order(spark):
    from loomwork.operators import splits

    df = spark.range(5000).select("id", (F.col("id") % 2).alias("g"))
    order = {r["id"]: r["position"] for r in splits.hash_order(df, "id", seed=7).collect()}
    assert sorted(order.values()) == list(range(5000))
    for n in (100, 1500):
        kept = splits.cap_after_shuffle(df, ["g"], ["id"], n, seed=7).collect()
        for g in (0, 1):
            want = sorted((i for i in order if i % 2 == g), key=order.get)[:n]
            assert sorted(r["id"] for r in kept if r["g"] == g) == sorted(want)
