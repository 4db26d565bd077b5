import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidegate.llm.packing import byte_tokens, fills, pack, sum_of_squares


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_sum_of_squares_choice(sizes):
    """Every item goes where a recomputed sum of squares is smallest among the open containers that fit."""
    got, gaps = sum_of_squares(np.array(sizes, dtype=int), 30), {}

    def squares(g):
        return sum(sum(1 for x in g.values() if x == v) ** 2 for v in set(g.values()) if v)

    for size, to in zip(sizes, got):
        options = {b: squares({**gaps, b: g - size}) for b, g in gaps.items() if g >= size}
        if options:
            assert to in gaps and options[to] == min(options.values())
        else:
            assert to not in gaps
        gaps[to] = gaps.get(to, 30) - size
    assert all(g >= 0 for g in gaps.values())


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, tokens int, bin_kind string")


def bins(spark, rows):
    return spark.createDataFrame(rows, "bin_kind string, capacity long, purpose string")


def check(spark, texts, kinds, **kw):
    placed = pack(docs(spark, texts), bins(spark, kinds), byte_tokens(F.col("text")), **kw)
    rows = placed.collect()
    for kind, capacity, _ in kinds:
        if not kind or not capacity or capacity <= 0:
            continue
        sizes, used = {}, {}
        for r in rows:
            if r.bin_kind == kind:
                sizes.setdefault(r.doc_id, []).append((r.piece, r.pieces, r.size))
                used[r.bin_id] = used.get(r.bin_id, 0) + r.size
        assert all(u <= capacity for u in used.values())
        for i, t in enumerate(texts):
            n = len(t.encode()) + 1 if t else 0
            own = sorted(sizes.get(i, []))
            assert sum(s for _, _, s in own) == n and len(own) == -(-n // capacity)
            assert [p for p, _, _ in own] == list(range(len(own))) and all(k == len(own) for _, k, _ in own)
    assert {r.bin_kind for r in rows} <= {k for k, c, _ in kinds if k and c and c > 0}
    assert all(f.used + f.unused == f.capacity for f in fills(placed).collect())
    return rows


def test_cuts_only_long_documents(spark):
    check(spark, ["a" * 9, "a" * 10, "é" * 5, "", None, "a" * 19, "b" * 100, "x"], [("k", 10, ""), ("m", 1000, ""), (None, 5, ""), ("z", 0, ""), ("n", None, "")])


def test_shards_and_second_round(spark):
    texts = ["a" * (7 + (i * 7919) % 240) for i in range(900)]
    rows = check(spark, texts, [("k", 256, "")], shard_items=200)
    used = sum(len(t) + 1 for t in texts)
    assert len({r.bin_id for r in rows}) <= used / 256 * 1.12
    assert any(r.bin_id.startswith("b-") for r in rows)


def test_very_long_and_empty(spark):
    check(spark, ["z" * 1_000_000], [("k", 2048, "")])
    assert check(spark, [], [("k", 10, "")]) == [] and check(spark, ["a"], []) == [] and check(spark, [None, ""], [("k", 10, "")]) == []
