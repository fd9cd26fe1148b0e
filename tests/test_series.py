"""Following a series: points out of order across files, late points, a run that is started again."""

import random

from loomwork.streaming import jobs

SCHEMA = "run bigint, key bigint, value double"


def expected(points, beta=0.9):
    out, sums = set(), {}
    for run, key, value in sorted(points, key=lambda p: (p[0] is not None, p[0] or 0, p[1], p[2])):
        seen, total, best = sums.get(run, (0, 0.0, None))
        total = beta * total + value
        best = value if best is None else min(best, value)
        out.add((run, key, seen, round((1 - beta) * total / (1 - beta ** (seen + 1)), 9), best))
        sums[run] = seen + 1, total, best
    return out


def test_points_out_of_order_late_and_after_a_restart(spark, tmp_path):
    landed, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    rng = random.Random(5)

    def arrive(points):
        spark.createDataFrame(points, SCHEMA).coalesce(1).write.mode("append").parquet(landed)

    def follow():
        jobs.follow_series(jobs.source(spark, landed, spark.createDataFrame([], SCHEMA).schema, 1), out, progress, disorder=50)
        return {(r.run, r.key, r.step, round(r.ema, 9), r.best) for r in spark.read.parquet(out).collect()}

    # Keys from -20 to 79, each file out of order; no point comes over 50 behind the greatest.
    points = [(run, key, float(rng.randrange(100))) for key in range(-20, 80) for run in (1, 2, None) if rng.random() < 0.7]
    points += [(1, 3, 7.0), (None, 3, 8.0)]
    early, later = [p for p in points if p[1] < 25], [p for p in points if p[1] >= 25]
    for part in (early, later):
        rng.shuffle(part)
        arrive(part)
    arrive([(1, None, 1.0)])
    told = follow()
    whole = expected(points)
    # The greatest key is 79: what lies over 50 behind it is finished, the rest waits.
    assert told == {p for p in whole if p[1] < max(k for _, k, _ in points) - 50}
    arrive([(1, -19, 5.0)])  # too late: dropped
    arrive([(9, 500, 0.0)])
    again = follow()
    assert {p for p in again if p[0] != 9} == whole
    assert follow() == again
