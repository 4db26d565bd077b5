import math
import random

from tidegate.llm.overlap import cross_split_overlap, overlap_report

FEATURES = ["x", "id", "h0"]  # names that clash with inner ones on purpose
SCHEMA = "rid long, split string, side string, x double, id double, h0 double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def pairs(spark, rows, **kw):
    got = cross_split_overlap(frame(spark, rows), "rid", "split", FEATURES, carry=("side",), **kw)
    return sorted((r.train_id, r.eval_id, r.exact) for r in got.pairs("side").collect()), got


def brute(rows, tol=0.001):
    inf = float("inf")
    good = [r for r in rows if all(v is not None and v == v and abs(v) != inf for v in r[3:])]
    return sorted(
        (a[0], b[0], a[3:] == b[3:])
        for a in good if a[1] == "train"
        for b in good if b[1] in ("val", "test")
        if all(abs(u - v) <= tol * max(abs(u), abs(v)) for u, v in zip(a[3:], b[3:]))
    )


def test_brute_force_at_cell_edges(spark):
    rng = random.Random(1)
    bases = [[rng.choice([0.0, -0.0, 1.0, 6.0, 17.0, 5e-324, 1e308, -3.5, 10 ** rng.uniform(-9, 9)]) for _ in FEATURES] for _ in range(60)]
    rows = []
    for i in range(2500):
        base = [v * (1 + rng.choice([0, 0, 0.0005, 0.00099, 0.001, -0.0011, 1e-9])) for v in rng.choice(bases)]
        if rng.random() < 0.05:
            base[rng.randrange(3)] = rng.choice([None, float("nan"), float("inf"), -float("inf")])
        rows.append((i, rng.choice(["train", "train", "val", "test", None]), rng.choice(["s", None]), *base))
    got, _ = pairs(spark, rows)
    want = brute(rows)
    assert got == want and len(want) > 1000


def test_copies_signs_and_zeros(spark):
    rows = [(1, "train", "s", 0.0, 1.0, 2.0), (2, "train", "s", -0.0, 1.0, 2.0), (3, "val", "s", 0.0, 1.0, 2.0), (3, "val", "t", 0.0, 1.0, 2.0),
            (4, "test", None, 0.0, -1.0, 2.0), (5, "val", "s", 1e-300, 1.0, 2.0), (None, "val", "s", 0.0, 1.0, 2.0)]
    got, overlap = pairs(spark, rows)
    assert got == [(1, 3, True), (1, 3, True), (2, 3, True), (2, 3, True)]
    report = overlap_report(cross_split_overlap(frame(spark, rows), "rid", "split", FEATURES, carry=("split", "side")), "split", "side")
    assert sorted((r.split, r.side, r.n_rows, r.n_exact, r.n_almost) for r in report.collect()) == [("val", "s", 1, 1, 0), ("val", "t", 1, 1, 0)]


def test_dense_cells_are_cut_again(spark, monkeypatch):
    """Very many distinct vectors of one cell: all pairs are found and few are compared."""
    from tidegate.llm import overlap as o

    monkeypatch.setattr(o, "DENSE", 500)
    compared = []
    monkeypatch.setattr(o, "materialize", lambda df, name, real=o.materialize: (compared.append((name, out := real(df, name))), out)[1])
    rng = random.Random(2)
    near = lambda v: v * (1 + rng.uniform(0, 0.05))
    rows = [(i, rng.choice(["train", "test"]), "s", near(1.02), near(30.0), 7.0) for i in range(3000)]
    rows += [(3000 + i, rng.choice(["train", "test"]), "s", 1.02 * 10**i, 1.0, 1.0) for i in range(20)]
    got, _ = pairs(spark, rows)
    assert got == brute(rows) and len(got) > 100
    n_train = sum(r[1] == "train" for r in rows)
    made = [df for name, df in compared if name == "candidates"][-1].count()
    assert len(got) <= made < n_train * (3000 - n_train) / 50
    same = [(i, "train" if i % 2 else "val", "s", 5.0, 5.0 * (1 + 1e-7 * i), 5.0) for i in range(400)]  # no cut helps: all pairs are true
    assert pairs(spark, same)[0] == brute(same)


def test_rows_near_many_edges(spark, monkeypatch):
    from tidegate.llm import overlap as o

    monkeypatch.setattr(o, "MAX_PROBES", 2)
    rng = random.Random(3)
    edge = lambda k: math.exp((k - o.SHIFT) * o.STEP)
    bases = [[edge(rng.randrange(9)) if rng.random() < 0.7 else rng.uniform(1, 9) for _ in FEATURES] for _ in range(40)]
    rows = [(i, rng.choice(["train", "val"]), "s", *(v * (1 + rng.uniform(-0.0008, 0.0008)) for v in rng.choice(bases))) for i in range(900)]
    got, _ = pairs(spark, rows)
    assert got == brute(rows) and len(got) > 500


def test_empty(spark):
    assert pairs(spark, [])[0] == []
    assert pairs(spark, [(1, "train", "s", 1.0, 1.0, 1.0)])[0] == []
