import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidegate.llm.grouping import allocate, assign_splits, combine, difference, text_key, tied_records

SCHEMA = "rid long, g long, h long, cap string, attack string, model string, root_id int, key string"
SPLITS = {"train": 0.7, "val": 0.15, "test": 0.15}


def keys():
    return {"g": F.col("g"), "h": F.col("h"), "cap": text_key(F.col("cap"))}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "k") for r in rows], SCHEMA)


def brute(rows):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    first = {}
    for rid, g, h, cap, *_ in rows:
        cap = (cap or "").strip().lower()
        for k in ((0, g), (1, h), (2, None if cap in ("", "unknown", "n/a") else cap)):
            if k[1] is not None:
                a, b = find(first.setdefault(k, rid)), find(rid)
                root[max(a, b)] = min(a, b)
    return sorted((find(r[0]), r[0]) for r in rows if find(r[0]) != r[0])


def make(rng, n, groups):
    return [(i, rng.choice([None, rng.randrange(groups)]), rng.choice([None, rng.randrange(groups)]),
             rng.choice([None, "", " N/A", "Unknown", f" CAP-{rng.randrange(groups)} ", f"cap-{rng.randrange(groups)}"]),
             rng.choice(["none", "pgd", "bim", None]), rng.choice(["mlp", "cnn"])) for i in range(1, n + 1)]


def test_components_against_union_find(spark):
    rng = random.Random(5)
    for n, groups in ((400, 1200), (300, 60)):
        rows = make(rng, n, groups)
        got = tied_records(frame(spark, rows), "rid", keys())
        assert sorted((r.root, r.id) for r in got.collect()) == brute(rows)


def test_long_chain_and_hot_key(spark):
    chain = [(i, i // 2, (i + 1) // 2 + 10_000, None, "a", "m") for i in range(1, 400)]  # ties alternate between two keys
    hot = [(i, None, None, "Lab", "a", "m") for i in range(1000, 1500)]
    got = tied_records(frame(spark, chain + hot), "rid", keys())
    assert sorted((r.root, r.id) for r in got.collect()) == brute(chain + hot)


def test_splits(spark):
    rows = make(random.Random(7), 1500, 4000)
    got = assign_splits(frame(spark, rows + rows[:3]), "rid", keys(), {"attack": F.col("attack"), "model": F.col("model")}, SPLITS).collect()
    assert len(got) == len(rows) and len({r.record_id for r in got}) == len(rows)
    assert all(len({s.split_name for s in got if s.root_id == r}) == 1 for r in {r.root_id for r in got})
    roots = dict((b, a) for a, b in brute(rows))
    assert {r.record_id: r.root_id for r in got} == {r[0]: roots.get(r[0], r[0]) for r in rows}
    share = Counter(r.split_name for r in got)
    for name, want in SPLITS.items():
        assert abs(share[name] / len(rows) - want) < 0.01, share
    attack = {r[0]: r[4] for r in rows}
    for a in ("none", "pgd", "bim", None):
        own = Counter(r.split_name for r in got if attack[r.record_id] == a)
        assert abs(own["train"] / sum(own.values()) - 0.7) < 0.06, own


def test_giant_component_is_not_cut(spark):
    rows = [(i, 1 if i <= 400 else None, None, None, "a", "m") for i in range(1, 1001)]
    got = assign_splits(frame(spark, rows), "rid", keys(), {"attack": F.col("attack")}, SPLITS).collect()
    assert len({r.split_name for r in got if r.root_id == 1}) == 1
    share = Counter(r.split_name for r in got)
    assert all(abs(share[s] / 1000 - w) < 0.03 for s, w in SPLITS.items()), share


def test_many_strata_and_shards(spark, monkeypatch):
    """Ten thousand strata over several shards: the tree's tasks stay small and the shares hold."""
    from tidegate.llm import grouping as g

    seen = []
    monkeypatch.setattr(g, "FAN", 32)
    monkeypatch.setattr(g, "materialize", lambda df, name, real=g.materialize: (seen.append((name, out := real(df, name))), out)[1])
    rows = [(i, None, None, None, f"a{i % 10_000}", "m") for i in range(12_000)]
    got = assign_splits(frame(spark, rows), "rid", keys(), {"attack": F.col("attack")}, SPLITS, shard_components=5000).cache()
    assert got.count() == len(rows) and got.select("record_id").distinct().count() == len(rows)
    share = {r.split_name: r["count"] / len(rows) for r in got.groupBy("split_name").count().collect()}
    assert all(abs(share[s] - w) < 0.001 for s, w in SPLITS.items()), share
    sizes = [df.groupBy("parent_stratum", "parent_shard").agg(F.count_distinct("stratum", "shard").alias("n")).agg(F.max("n")).first()[0] for name, df in seen if name == "moves"]
    assert len(sizes) >= 4 and max(sizes) < 3 * 32, sizes


def test_empty(spark):
    assert assign_splits(frame(spark, []), "rid", keys(), {"attack": F.col("attack")}, SPLITS).count() == 0
    assert tied_records(frame(spark, []), "rid", keys()).count() == 0
    assert tied_records(frame(spark, [(None, 1, 1, "x", "a", "m"), (2, 1, 1, "x", "a", "m")]), "rid", keys()).count() == 0


def test_difference():
    rng = np.random.default_rng(0)
    w = rng.integers(1, 1000, 500).tolist()
    bins = difference(w, 20)
    sums = np.bincount(bins, weights=w, minlength=20)
    assert sums.sum() == sum(w) and sums.max() - sums.min() <= 3
    assert list(np.bincount(difference([5, 5, 4, 3, 3], 2), weights=[5, 5, 4, 3, 3])) in ([10, 10], [9, 11], [11, 9])
    assert len(difference([], 4)) == 0 and len(set(difference([1, 1, 1], 5))) == 3
    moves = combine([{0: 9.0, 1: 1.0}, {0: 8.0, 1: 2.0}], 2)
    assert sorted(moves[0]) == sorted(moves[1]) == [0, 1] and moves[0][0] == moves[1][1]
    assert Counter(allocate([5.0] * 20, [0.7, 0.15, 0.15])) == {0: 14, 1: 3, 2: 3}
