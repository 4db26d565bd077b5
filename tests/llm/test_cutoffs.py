import random

import pytest
from pyspark.sql import functions as F

from tidegate.llm.cutoffs import cutoffs

ROWS = "score_id long, target_name string, row_id long, source string, p_attack double, y int, scored_at timestamp, n int, score string, drop_at int"


def run(spark, rows, targets):
    df = spark.createDataFrame([(i, t, r, s, p, None, at, 1, "x", 2) for i, (t, r, s, p, at) in enumerate(rows)], ROWS)
    t = spark.createDataFrame(targets, "target_name string, threshold double, keep_ppm long, n int")
    return cutoffs(df, t)


def expected(rows, ppm):
    latest = {}
    for i, (t, r, s, p, at) in enumerate(rows):
        if (t, r) not in latest or (str(at or ""), i) >= (str(latest[t, r][2] or ""), latest[t, r][3]):
            latest[t, r] = (s, p, at, i)
    groups = {}
    for (t, _), (s, p, _, i) in latest.items():
        if s is not None and p is not None and 0 <= p <= 1:
            groups.setdefault((t, s), []).append((p + 0.0, i))
    kept = set()
    for (t, _), g in groups.items():
        if t in ppm:
            limit, used = len(g) * (ppm[t] or 0) // 1_000_000, 0
            for p in sorted({p for p, _ in g}, reverse=True):
                own = [i for q, i in g if q == p]
                if used + len(own) > limit:
                    break
                used += len(own)
                kept |= set(own)
    return kept


def times(k):
    import datetime as dt

    return dt.datetime(2025, 1, 1) + dt.timedelta(seconds=k)


def test_brute_force(spark):
    rng = random.Random(3)
    scores = [0.0, -0.0, 1.0, 0.5, 0.25, 1e-300, 2**-41, 1 - 2**-53, 0.5 + 2**-52, 0.3, None, float("nan"), -0.25, 97.3]
    rows = []
    for _ in range(3000):
        p = rng.choice(scores) if rng.random() < 0.5 else rng.random() ** rng.choice([1, 8, 40])
        rows.append((rng.choice(["a", "b", "c", "d", None]), rng.randrange(1200), rng.choice(["hot"] * 5 + ["s1", "s2", None, ""]), p, times(rng.randrange(3)) if rng.random() < 0.9 else None))
    targets = [("a", 0.5, 300_000, 1), ("b", None, 999_999, 1), ("c", 0.1, None, 1), ("z", 0.1, 500_000, 1), ("d", 0.0, 1_000_000, 1)]
    got = run(spark, rows, targets)
    assert sorted(r.score_id for r in got.kept().collect()) == sorted(expected(rows, {t[0]: t[2] for t in targets}))
    for r in got.report.collect():
        assert r.n_kept <= r.may_keep and (r.cutoff is None) == (r.n_kept == 0)


@pytest.mark.parametrize("n,ppm,kept", [(10, 500_000, 0), (10, 1_000_000, 10), (1, 999_999, 0), (10, 0, 0)])
def test_ties_stay_together(spark, n, ppm, kept):
    got = run(spark, [("a", i, "s", 0.9, times(0)) for i in range(n)], [("a", None, ppm, 0)])
    assert got.kept().count() == kept


def test_close_scores_across_intervals(spark):
    """Cutoffs inside one interval of width 2^-40, and at an interval's edge."""
    scores = [0.5 + k * 2**-52 for k in range(20)] + [0.75, 0.25]
    rows = [(f"t{k}", i, "s", p, times(0)) for k in range(23) for i, p in enumerate(scores)]
    got = run(spark, rows, [(f"t{k}", None, -(-k * 1_000_000 // 22), 0) for k in range(23)]).kept().collect()
    best = sorted(range(22), key=lambda i: -scores[i])
    assert sorted(r.score_id for r in got) == sorted(k * 22 + i for k in range(23) for i in best[:k])


def test_empty(spark):
    got = run(spark, [], [("a", None, 5, 0)])
    assert got.kept().count() == 0 and got.report.count() == 0
    assert run(spark, [("a", 1, "s", 0.5, times(0))], []).kept().count() == 0


def test_saturated_scores_fill_no_interval(spark):
    """A million distinct scores below 2^-40, down to the smallest double: no window of a level is unbounded."""
    from tidegate.llm.cutoffs import intervals

    tiny = spark.range(1_000_000).select(F.pow(F.lit(10.0), -12.1 - F.col("id") * F.lit(311.0 / 1_000_000)).alias("s"))
    cells = tiny.where("s > 0").withColumns(intervals(F.col("s")))
    most = lambda *by: cells.groupBy(*by).agg(F.count_distinct("s").alias("n")).agg(F.max("n")).first()[0]
    assert cells.select("b0").distinct().count() < 1100 and most("b0", "b1", "b2") <= 1 << 12
    ends = [0.0, 5e-324, 1e-323, 2.0**-1022, 2.0**-41, 1 - 2.0**-53, 1.0, 0.5, 0.1, 2.0**-40 * (1 - 2.0**-53), 2.0**-40]
    rows = spark.createDataFrame([(v,) for v in ends], "s double").withColumns(intervals(F.col("s"))).collect()
    assert [r.s for r in sorted(rows, key=lambda r: (r.b0, r.b1, r.b2, r.s))] == sorted(ends)


def test_cutoff_among_saturated_scores(spark):
    rng = random.Random(5)
    scores = [10 ** -rng.uniform(13, 300) for _ in range(3000)]
    df = spark.createDataFrame([(i, "t", i, "d", p, None) for i, p in enumerate(scores)], "score_id long, target_name string, row_id long, source string, p_attack double, scored_at timestamp")
    targets = spark.createDataFrame([("t", 0.5, 250_000)], "target_name string, threshold double, keep_ppm long")
    want = set(sorted(range(3000), key=lambda i: -scores[i])[:750])
    assert {r.score_id for r in cutoffs(df, targets).kept().collect()} == want
