import random
from collections import Counter

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidegate.llm.quotas import availability, controlled_rounding, draw, population, plan_quotas, quotas, unmet

TARGETS = "plan_id long, population string, grp string, target_ppm long, min_rows long, sample_size long, have int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 400), min_size=3, max_size=3), min_size=1, max_size=6))
def test_controlled_rounding_keeps_both_margins(units):
    cells = [[u / 100 for u in row] for row in units]
    rows = [(sum(r) // 100, -(-sum(r) // 100)) for r in units]
    cols = [(sum(c) // 100, -(-sum(c) // 100)) for c in zip(*units)]
    grand = sum(map(sum, units))
    for total in (grand // 100, -(-grand // 100)):
        table = controlled_rounding(cells, rows, cols, [[9] * 3] * len(units), total)
        assert table is not None and sum(map(sum, table)) == total
        assert all(u // 100 <= t <= -(-u // 100) for ur, tr in zip(units, table) for u, t in zip(ur, tr))
        assert all(lo <= sum(t) <= hi for (lo, hi), t in zip(rows, table))
        assert all(lo <= sum(t) <= hi for (lo, hi), t in zip(cols, zip(*table)))


def test_plan_with_shortage_and_minimum():
    lines = [{"target": 50.0, "need_low": 50, "need_high": 50, "have": {"a": 3, "b": 4}}, {"target": 10.5, "need_low": 20, "need_high": 20, "have": {"a": 90, "b": 10}},
             {"target": 39.5, "need_low": 39, "need_high": 40, "have": {}}]
    table = plan_quotas(lines, ["a", "b"], 100)
    assert table[0] == [3, 4] and sum(table[1]) == 20 and table[1][0] in (18, 19) and table[2] == [0, 0]


def pop(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "rid long, k long, grp string, s string, stratum string")
    return population(df, "p", [F.col("k")], F.col("rid"), F.col("grp"), F.col("s"))


def test_draw_takes_exact_quotas(spark):
    rng = random.Random(2)
    rows = [(i, i, rng.choice(["A-", "a", "B", "b ", "C"]) if i % 50 else None, rng.choice(["s", "t", None])) for i in range(4000)]
    rows += [(i + 5000, i, g, s) for i, _, g, s in rows[:300]]  # delivered again
    have = Counter((g.lower().strip(" -"), s or "") for i, _, g, s in rows[:4000] if g)
    want = [(1, "p", "A", 500_000, 0, 1001, 0), (1, "p", "b", 300_000, 0, 1001, 0), (1, "p", "c", 200_000, 0, 1001, 0),
            (2, "p", "a", 1_000_000, 9_000, 3000, 0), (2, "p", "zz", 0, 1, 3000, 0), (3, "p", "c", 0, 0, 10, 0), (4, "p", "c", None, 3, None, 0), (4, "q", "c", 1, 1, 1, 0)]
    people = pop(spark, rows)
    quota = quotas(availability(people), spark.createDataFrame(want, TARGETS))
    q = {(r.plan_id, r.population, r.grp_slug, r.stratum): r for r in quota.collect()}
    assert sum(r.quota for k, r in q.items() if k[0] == 1) == 1001
    sample = draw(people, quota).collect()
    counts = Counter((r.plan_id, r.population, r.grp_slug, r.stratum) for r in sample)
    assert counts == {k: r.quota for k, r in q.items() if r.quota}
    assert len({(r.plan_id, r.population, r.id) for r in sample}) == len(sample) and max(r.id for r in sample) < 5000
    assert sum(v for k, v in counts.items() if k[0] == 2) == sum(v for (g, _), v in have.items() if g == "a")
    assert sorted((r.plan_id, r.grp_slug) for r in unmet(quota).collect()) == [(2, "a"), (2, "zz"), (4, "c")]
    again = draw(people, quota).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, sample))


def test_empty_and_repeated_lines(spark):
    lines = [(1, "p", "a", 500_000, 0, 10, 0), (1, "p", "A", 500_000, 0, 10, 0)]
    quota = quotas(availability(pop(spark, [])), spark.createDataFrame(lines, TARGETS))
    assert [(r.grp_slug, r.available, r.quota) for r in unmet(quota).collect()] == [("a", 0, 0)] * 2
    assert draw(pop(spark, []), quota).count() == 0
    assert quotas(availability(pop(spark, [(1, 1, "a", "s")])), spark.createDataFrame([], TARGETS)).count() == 0
    twice = quotas(availability(pop(spark, [(i, i, "a", "s") for i in range(7)])), spark.createDataFrame(lines, TARGETS))
    assert sum(r.quota for r in twice.collect()) == 7 and unmet(twice).count() == 0


def test_two_lines_for_one_group_get_their_sum(spark):
    """Strata of ten rows each and two lines that need ten: all twenty rows are drawn."""
    from tidegate.llm.quotas import availability, draw, quotas

    rows = spark.createDataFrame([("p", i, "g", "a" if i < 10 else "b") for i in range(20)], "population string, id long, grp_slug string, stratum string")
    plan = spark.createDataFrame([(1, "p", "G", 500_000, 10, 20), (1, "p", "g ", 500_000, 10, 20)], "plan_id long, population string, grp string, target_ppm long, min_rows long, sample_size long")
    quota = quotas(availability(rows), plan)
    per = {r.grp: r.q for r in quota.groupBy("grp").agg({"quota": "sum"}).withColumnRenamed("sum(quota)", "q").collect()}
    assert per == {"G": 10, "g ": 10}
    assert sorted(r.id for r in draw(rows, quota).collect()) == list(range(20))
