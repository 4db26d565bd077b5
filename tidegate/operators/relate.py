"""Relations between tables and columns: train/test overlap, correlated columns, single-column probes, reliance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegate.operators.order import running_sums
from tidegate.operators.scan import float32


def _bit(label: Column) -> Column:
    """A label as one bit; one outside 0..62, which would fall onto another's bit, fails the job."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), label.cast("int"))
    outside = F.raise_error(F.concat(F.lit("labels must lie in 0..62, not "), label.cast("string"))).cast("long")
    return F.when(label.between(0, 62) | label.isNull(), bit).otherwise(outside)


def overlap_by_label(train: DataFrame, test: DataFrame, features: Sequence[str], y_col: str, by: str) -> DataFrame:
    """Per group of test rows: rows, those whose float32 vector stands in train, with the same label, only with others.

    Train is reduced to one row per vector with the set of its labels as bits (labels 0..62) before the join."""
    keys = [f"_k{i}" for i in range(len(features))]
    named = lambda df: df.withColumns(dict(zip(keys, float32(features))))
    masks = named(train).groupBy(*keys).agg(F.bit_or(_bit(F.col(y_col))).alias("_mask"))
    joined = named(test).select(*keys, by, F.col(y_col).cast("int").alias("_y")).join(masks, keys, "left")
    same = F.col("_mask").bitwiseAND(_bit(F.col("_y"))) != 0
    return joined.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_mask").isNotNull()).alias("n_in_train"),
        F.count_if(same).alias("n_same_label"), F.count_if(F.col("_mask").isNotNull() & ~same).alias("n_other_label_only"),
    )


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_a, column_b, r) of all column pairs in one aggregation; a constant column's NaN becomes 0."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    clean = lambda c: F.when(F.isnan(c) | c.isNull(), 0.0).otherwise(c)
    cells = (F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), clean(F.col(f"r{i}")).alias("r")) for i, (a, b) in enumerate(pairs))
    return row.select(F.inline(F.array(*cells)))


def correlated_groups(pairs: DataFrame, columns: Sequence[str], above: float = 0.95) -> list[list[str]]:
    """Connected components of columns with |r| > above; the pairs of a schema's columns fit the driver."""
    group = {c: {c} for c in columns}
    for r in pairs.where(F.abs("r") > above).collect():
        merged = group[r.column_a] | group[r.column_b]
        for c in merged:
            group[c] = merged
    return sorted({tuple(sorted(g)) for g in group.values()})


def best_stumps(df: DataFrame, columns: Sequence[str], y: Column) -> DataFrame:
    """Per column the best balanced accuracy of a rule x <= t or x > t, its distinct values, and a leak suspicion.

    Runs on (column, value) counts, summed up in blocks of each column's range."""
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), (F.col(c).cast("double") + 0.0).alias("x")) for c in columns))
    counts = df.select(F.inline(cells), y.cast("int").alias("y")).groupBy("column_name", "x").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("neg", F.col("n") - F.col("pos"))
    whole = df.agg(F.sum(y.cast("int")).alias("p"), F.count_if(y == 0).alias("m"))
    run = running_sums(counts, ["column_name"], "x", {"tp": "pos", "fp": "neg"}, few_groups=True).join(F.broadcast(whole))
    low = (F.coalesce(F.try_divide("tp", "p"), F.lit(0.0)) + F.coalesce(F.try_divide(F.col("m") - F.col("fp"), "m"), F.lit(0.0))) / 2.0
    best = run.groupBy("column_name").agg(F.max(F.greatest(low, 1.0 - low)).alias("balanced_accuracy"), F.count(F.lit(1)).alias("n_distinct"))
    return best.withColumn("suspect", F.col("balanced_accuracy") >= 0.99)


def permutation_importance(df: DataFrame, score: Callable[[DataFrame], Column], groups: Sequence[Sequence[str]], y: str, id_col: str, repeats: int = 3, seed: int = 42) -> DataFrame:
    """Per group of columns the drop in balanced accuracy when they are shuffled together: mean and deviation.

    Row i takes the columns of row pi(i), both numbered by random rank; numbers come from range-partitioned sorts
    (``monotonically_increasing`` blocks with offsets), not from one global window. The groups of a repeat share the
    permutation, so a repeat is one join and one aggregation."""

    def balanced(pred: str) -> Column:
        hit = lambda v: F.coalesce(F.avg(F.when(F.col(y) == v, (F.col(pred) == v).cast("double"))), F.lit(0.0))
        return (hit(1) + hit(0)) / 2.0

    start = df.withColumn("_pred", score(df)).agg(balanced("_pred")).first()[0]
    shuffled, drops = sorted({c for group in groups for c in group}), []
    for k in range(repeats):
        left = numbered(df, F.xxhash64(F.lit(seed), F.lit(2 * k), F.col(id_col)))
        right = numbered(df.select(id_col, *shuffled), F.xxhash64(F.lit(seed), F.lit(2 * k + 1), F.col(id_col))).select("_n", *(F.col(c).alias(f"_s_{c}") for c in shuffled))
        mixed = left.join(right, "_n").withColumns({f"_o_{c}": F.col(c) for c in shuffled})
        for i, group in enumerate(groups):
            moved = mixed.withColumns({c: F.col(f"_s_{c}") for c in group})
            mixed = moved.withColumn(f"_pred{i}", score(moved)).withColumns({c: F.col(f"_o_{c}") for c in group})
        drops.append([start - v for v in mixed.agg(*(balanced(f"_pred{i}").alias(f"b{i}") for i in range(len(groups)))).first()])
    out = []
    for group, own in zip(groups, zip(*drops)):
        mean = sum(own) / repeats
        out.append(("+".join(group), mean, (sum((d - mean) ** 2 for d in own) / repeats) ** 0.5))
    return df.sparkSession.createDataFrame(out, "column_group string, importance double, deviation double")


def numbered(df: DataFrame, order: Column) -> DataFrame:
    """Add ``_n`` = 0..n-1 by ``order``: hash blocks, their running sizes, and a rank inside each block."""
    rows = df.withColumn("_o", order).withColumn("_b", F.shiftrightunsigned("_o", 52))  # 4,096 blocks
    sizes = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_k"))
    before = F.sum("_k").over(Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_k")
    joined = rows.join(sizes.select(F.col("_b").alias("_c"), before.alias("_before")), F.col("_b") == F.col("_c"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_o")) - 1
    return joined.withColumn("_n", F.col("_before") + rank).drop("_o", "_b", "_c", "_before")
