"""Records of evaluation splits that also stand, exactly or almost, in the training split.

A record's canonical form is its cell in a logarithmic grid over all features (sign and step of ln|x|; 0 and -0 are
one cell): what case, punctuation and blanks are to a text, differences below the tolerance are to a vector. Records
are joined by the hash of that form. A training record has one hash; an evaluation record also gets those of the
neighbouring cells that a value within the tolerance could lie in, so no pair is lost at a cell's edge. Grid steps
are a hundred times the tolerance, so a record has 1.4 hashes on average.

Only distinct vectors are hashed and joined (copies are counted away before the shuffle), and only 24 bytes of each;
whole vectors are read again for those that have a partner, compared exactly, and their copies joined back.

A cell is much wider than the tolerance, so uniform traffic may put very many different vectors into one. Cells with
more than ``DENSE`` pairs are therefore cut again, feature by feature in steps of four tolerances, those that tell
most apart first, until no more than so many pairs are left or all features are used; then nearly all pairs are true.
A row whose values lie near the edges of many cells would probe every combination; beyond ``MAX_PROBES`` it is
instead looked up by the half of its features with fewer edges.

Defined cases: a null, NaN or infinite feature takes a record out; so does a null split or id. Repeated ids are rows
of their own. Empty tables give empty results. Other columns are carried only where asked for.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidegate.scratch import materialize
from tidegate.sources.tables import bounded

STEP = 0.1
FINER = 4.0  # tolerances a step of a dense cell's own grid
DENSE = 1 << 16  # pairs of distinct vectors of one cell that are compared as they are
MAX_PROBES = 1 << 10
MAX_BROADCAST = 200_000  # dense cells, and probes of rows near many edges, that are sent to every executor
SHIFT = 0.37  # keeps 1 and other common constants away from a cell's edge


@dataclass
class Overlap:
    """``rows``: (id, side, h0, h1 = hash of the vector, c_* = carried columns) of records that may have a partner; ``vectors``: matching pairs of
    vector hashes (train t0, t1; evaluation e0, e1) with ``exact``."""

    rows: DataFrame
    vectors: DataFrame

    def pairs(self, *columns: str) -> DataFrame:
        """All pairs of rows: ``train_id``, ``eval_id``, ``exact`` and the carried columns as train_*/eval_*."""

        def side(name: str, a: str, b: str) -> DataFrame:
            kept = [F.col("id").alias(f"{name}_id"), *(F.col(f"c_{c}").alias(f"{name}_{c}") for c in columns)]
            return self.rows.where(F.col("side") == name).select(F.col("h0").alias(a), F.col("h1").alias(b), *kept)

        return self.vectors.join(side("train", "t0", "t1"), ["t0", "t1"]).join(side("eval", "e0", "e1"), ["e0", "e1"]).drop("t0", "t1", "e0", "e1")


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def _cell(c: Column, slack: float = 0.0, step: float = STEP) -> Column:
    """Signed grid cell of a value whose magnitude is moved by ``slack`` in the logarithm; 0 has a cell of its own."""
    at = F.floor((F.log(F.abs(c)) + F.lit(slack)) / F.lit(step) + F.lit(SHIFT)).cast("int")
    return F.when(c == 0, F.lit(-(1 << 30))).otherwise(at * 2 + F.when(c > 0, 1).otherwise(0))


def _sides(feature: str, slack: float, step: float = STEP) -> Column:
    """The one or two cells that a value within the tolerance can lie in."""
    return F.array_distinct(F.array(_cell(F.col(feature), -slack, step), _cell(F.col(feature), slack, step)))


def _probes(sides: Column, seed: int = 42) -> Column:
    """Hashes of every combination of cells that values within the tolerance can lie in."""
    # Built up feature by feature: each known combination is continued with one or both cells.
    start = F.array(F.lit(seed).cast("long"))
    step = lambda hashes, two: F.flatten(F.transform(hashes, lambda h: F.transform(two, lambda c: F.xxhash64(h, c))))
    return F.aggregate(sides, start, step)


def _edges(sides: Column) -> Column:
    """Number of features that lie near a cell's edge."""
    return F.size(F.flatten(sides)) - F.size(sides)


def _key(features: Sequence[str], seed: int = 42) -> Column:
    return reduce(lambda h, f: F.xxhash64(h, _cell(F.col(f))), features, F.lit(seed).cast("long"))


def _dense(t: DataFrame, e: DataFrame) -> DataFrame:
    """Keys whose distinct vectors make more than ``DENSE`` pairs."""
    sides = t.select("key", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(e.select("key", F.lit(0).alias("a"), F.lit(1).alias("b")))
    return sides.groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") * F.col("b") > DENSE).select("key")


def _paired(t: DataFrame, e: DataFrame) -> DataFrame:
    return t.join(e, "key").select("t0", "t1", "e0", "e1")


def _refined(t: DataFrame, e: DataFrame, features: Sequence[str], slack: float) -> DataFrame:
    """Pairs of the dense cells' rows; ``t`` and ``e`` are (t0, t1 or e0, e1, key, features), each row once a key."""
    step = FINER * slack
    spread = t.agg(*(F.approx_count_distinct(_cell(F.col(f), 0.0, step)).alias(f) for f in features)).first()
    order = sorted((f for f in features if (spread[f] or 0) > 1), key=lambda f: -spread[f])
    out = None
    for i, f in enumerate(order):
        rest = order[i + 1 :]
        t = materialize(t.withColumn("key", F.xxhash64("key", _cell(F.col(f), 0.0, step))).select("t0", "t1", "key", *rest), "dense")
        e = e.withColumn("_c", F.explode(_sides(f, slack, step))).withColumn("key", F.xxhash64("key", "_c"))
        e = materialize(e.select("e0", "e1", "key", *rest), "dense")
        dense = materialize(_dense(t, e), "cells")
        cells = bounded(dense, MAX_BROADCAST)
        pairs = materialize(_paired(t.join(cells, "key", "left_anti"), e.join(cells, "key", "left_anti")), "candidates")
        out = pairs if out is None else out.unionByName(pairs)
        if dense.isEmpty():
            return out
        t, e = t.join(cells, "key", "left_semi"), e.join(cells, "key", "left_semi")
    return _paired(t, e) if out is None else out.unionByName(_paired(t, e))


def _candidates(base: DataFrame, features: Sequence[str], slack: float) -> DataFrame:
    """(t0, t1, e0, e1): pairs of distinct vectors of a training and an evaluation row in one cell."""

    def rows(df: DataFrame, which: str, p: str, keys: Column, *keep: str) -> DataFrame:
        own = df.where(F.col("side") == which)
        return own.select(F.col("h0").alias(f"{p}0"), F.col("h1").alias(f"{p}1"), keys.alias("key"), *keep)

    most = MAX_PROBES.bit_length() - 1
    sided = base.withColumn("_sides", F.array(*(_sides(f, slack) for f in features)))
    probes = F.when(_edges(F.col("_sides")) <= most, _probes(F.col("_sides")))
    t = materialize(rows(base, "train", "t", _key(features)).distinct(), "train")
    # Outer: a row near too many edges stays, without a key.
    every = materialize(rows(sided, "eval", "e", F.explode_outer(probes)).distinct(), "eval")
    e = every.where("key is not null")
    dense = materialize(_dense(t, e), "cells")
    if dense.isEmpty():
        out = _paired(t, e)
    else:
        cells = bounded(dense, MAX_BROADCAST)
        wide = lambda df, which, p, keys: materialize(rows(df, which, p, keys, *features).join(cells, "key", "left_semi").dropDuplicates([f"{p}0", f"{p}1", "key"]), "dense")
        out = _paired(t.join(cells, "key", "left_anti"), e.join(cells, "key", "left_anti"))
        out = out.unionByName(_refined(wide(base, "train", "t", _key(features)), wide(sided, "eval", "e", F.explode_outer(probes)), features, slack))

    many = every.where("key is null").select(F.col("e0").alias("h0"), F.col("e1").alias("h1"))
    if many.isEmpty():
        return out
    halves = features[: len(features) // 2], features[len(features) // 2 :]
    # At most half of the edges lie in the better half: its probes are at most the root of all.
    first, second = (F.slice("_sides", at + 1, len(half)) for at, half in zip((0, len(halves[0])), halves))
    keys = F.when(_edges(first) <= _edges(second), _probes(first, 1)).otherwise(_probes(second, 2))
    few = sided.where(F.col("side") == "eval").join(bounded(many, MAX_BROADCAST), ["h0", "h1"])
    few = few.select(F.col("h0").alias("e0"), F.col("h1").alias("e1"), F.explode_outer(keys).alias("key")).distinct()
    both = rows(base, "train", "t", F.explode(F.array(_key(halves[0], 1), _key(halves[1], 2))))
    return out.unionByName(_paired(both, bounded(materialize(few, "edges"), MAX_BROADCAST)).distinct())


def cross_split_overlap(
    df: DataFrame, id_col: str, split_col: str, features: Sequence[str], tolerance: float = 0.001,
    train: Sequence[str] = ("train",), evaluation: Sequence[str] = ("val", "test"), carry: Sequence[str] = (),
) -> Overlap:
    """Pairs of a training and an evaluation row whose features differ by at most ``tolerance`` of the larger magnitude."""
    slack = -math.log1p(-tolerance) * 1.01  # beyond rounding of the logarithm
    plain = [(F.col(f) + F.lit(0.0)).alias(f"f{i}") for i, f in enumerate(features)]  # -0 becomes 0
    kept = [F.col(c).alias(f"c_{c}") for c in carry]
    side = F.when(F.col(split_col).isin(list(train)), "train").when(F.col(split_col).isin(list(evaluation)), "eval")
    ok = reduce(lambda a, f: a & _finite(F.col(f)), features, side.isNotNull() & F.col(id_col).isNotNull())
    base = df.where(ok).select(F.col(id_col).alias("id"), side.alias("side"), *kept, *plain)
    features = [f"f{i}" for i in range(len(features))]
    base = base.withColumn("h0", F.xxhash64(*features)).withColumn("h1", F.xxhash64(F.lit(7), *features))

    candidates = materialize(_candidates(base, features, slack), "candidates")

    wanted = candidates.select(F.col("t0").alias("h0"), F.col("t1").alias("h1"), F.lit("train").alias("side")).unionByName(
        candidates.select(F.col("e0").alias("h0"), F.col("e1").alias("h1"), F.lit("eval").alias("side"))
    )
    rows = materialize(base.join(wanted.distinct(), ["h0", "h1", "side"]), "rows")

    def vectors(which: str, p: str) -> DataFrame:
        own = rows.where(F.col("side") == which).groupBy(F.col("h0").alias(f"{p}0"), F.col("h1").alias(f"{p}1"))
        return own.agg(*(F.first(f).alias(f"{p}_{f}") for f in features))

    def close(f: str) -> Column:
        a, b = F.col(f"t_{f}"), F.col(f"e_{f}")
        return F.abs(a - b) <= F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b))

    compared = candidates.join(vectors("train", "t"), ["t0", "t1"]).join(vectors("eval", "e"), ["e0", "e1"])
    exact = reduce(lambda a, f: a & (F.col(f"t_{f}") == F.col(f"e_{f}")), features, F.lit(True))
    matches = compared.where(reduce(lambda a, f: a & close(f), features, F.lit(True))).select("t0", "t1", "e0", "e1", exact.alias("exact"))
    return Overlap(rows.drop(*features), materialize(matches, "matches"))


def overlap_report(overlap: Overlap, split_col: str, source_col: str) -> DataFrame:
    """Per evaluation split and source: rows that stand in train exactly, almost, and in all (carried columns).

    Counted on the evaluation side of the vector pairs; pairs of rows are not made."""
    best = overlap.vectors.groupBy(F.col("e0").alias("h0"), F.col("e1").alias("h1")).agg(F.max("exact").alias("exact"))
    rows = overlap.rows.where("side = 'eval'").join(best, ["h0", "h1"])
    return rows.groupBy(F.col(f"c_{split_col}").alias(split_col), F.col(f"c_{source_col}").alias(source_col)).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("exact").alias("n_exact"), F.count_if(~F.col("exact")).alias("n_almost")
    )
