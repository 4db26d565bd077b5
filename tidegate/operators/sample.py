"""Samples and splits by random rank, without positions: a row's rank is that of md5('seed:id') in its stratum.

The same rows come out in any engine and for any partitioning. A stratum may hold any share of the table, so ranks
are not taken by one window per stratum: ``ranked`` first finds, on counts of hash prefixes, the prefix in which the
quota falls, and only ranks the rows of that prefix.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegate.functions.numeric import md5_order

PREFIX = 4  # hex digits: 65,536 prefixes a stratum


def ranked(df: DataFrame, strata: Sequence[str], id_col: str, quota: Column, seed: int) -> DataFrame:
    """The ``quota`` rows of each stratum with the smallest md5 of 'seed:id'.

    ``quota`` may refer to ``n_stratum``, the stratum's size. Null strata values form strata. The table of prefix
    counts is bounded by strata x 65,536; the last prefix holds a 65,536th of the stratum."""
    order = md5_order(seed, F.col(id_col))
    rows = df.withColumn("_order", order).withColumn("_prefix", F.substring("_order", 1, PREFIX))
    keys = [F.col(c).alias(f"_s{i}") for i, c in enumerate(strata)] or [F.lit(0).alias("_s0")]
    names = [f"_s{i}" for i in range(len(keys))]
    counts = rows.groupBy(*keys, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy(*names)
    counts = counts.withColumn("n_stratum", F.sum("_n").over(within)).withColumn("_quota", quota.cast("long"))
    counts = counts.withColumn("_upto", F.sum("_n").over(within.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)))
    below = F.col("_upto") - F.col("_n")
    edges = counts.where((F.col("_quota") > below)).groupBy(*names).agg(
        F.max(F.struct("_prefix", (F.col("_quota") - below).alias("rest"))).alias("_edge")
    )
    own = [F.col(c) for c in strata] or [F.lit(0)]
    on = [a.eqNullSafe(F.col(n)) for a, n in zip(own, names)]
    cut = rows.join(edges, on, "inner").where(F.col("_prefix") <= F.col("_edge._prefix"))
    inner = cut.where(F.col("_prefix") < F.col("_edge._prefix"))
    rank = F.row_number().over(Window.partitionBy(*names, "_prefix").orderBy("_order", id_col))
    last = cut.where(F.col("_prefix") == F.col("_edge._prefix")).withColumn("_rank", rank).where("_rank <= _edge.rest").drop("_rank")
    return inner.unionByName(last).select(*df.columns)


def capped(df: DataFrame, code_col: str, id_col: str, cap: int, keep_all: Sequence[int] = (), seed: int = 42) -> DataFrame:
    """At most ``cap`` rows per class, classes in ``keep_all`` whole."""
    quota = F.when(F.col("_s0").isin(list(keep_all)), F.col("n_stratum")).otherwise(F.lit(cap)) if keep_all else F.lit(cap)
    return ranked(df, [code_col], id_col, quota, seed)


def smoke(df: DataFrame, code_col: str, id_col: str, share: float, least: int = 20, seed: int = 42) -> DataFrame:
    """min(n, max(least, int(n x share))) rows per class."""
    return ranked(df, [code_col], id_col, F.least("n_stratum", F.greatest(F.lit(least), F.floor(F.col("n_stratum") * share))), seed)


def stratified(df: DataFrame, code_col: str, id_col: str, n: int, seed: int = 42, whole_if_small: bool = True) -> DataFrame:
    """About n rows with the classes' shares kept (half-even rounding), at least one row each."""
    size = df.count()
    if whole_if_small and size <= n:
        return df
    share = F.rint(F.col("n_stratum") * F.lit(float(n)) / F.lit(float(max(size, 1))))
    return ranked(df, [code_col], id_col, F.least("n_stratum", F.greatest(F.lit(1), share)), seed)


def per_category(df: DataFrame, category_col: str, id_col: str, n: int, eligible: Column, benign: str, seed: int = 42) -> DataFrame:
    """Up to n eligible rows of every category but the benign one."""
    return ranked(df.where(eligible & (F.col(category_col) != benign)), [category_col], id_col, F.lit(n), seed)


def exactly(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows; a smaller table raises."""
    if (size := df.limit(n).count()) < n:
        raise ValueError(f"{n} rows wanted, {size} available")
    return ranked(df, [], id_col, F.lit(n), seed)


def fraction(df: DataFrame, id_col: str, share: float, seed: int = 42) -> DataFrame:
    return ranked(df, [], id_col, F.floor(F.col("n_stratum") * share), seed)


def stratified_split(df: DataFrame, code_col: str, id_col: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """Every row with ``split_name``: per class the first round(n x share) rows by random rank, and so on.

    Shares are train, val, test and must sum to 1; a class needs ceil(2 / (val + test)) rows, else ValueError. Cuts
    are taken by nested quotas, each through ``ranked``, so no class is ranked in one task."""
    if abs(sum(shares.values()) - 1.0) > 1e-9:
        raise ValueError(f"shares must sum to 1: {shares}")
    (train, a), (val, b), (test, c) = shares.items()
    least = math.ceil(2 / (b + c))
    small = df.groupBy(code_col).count().where(F.col("count") < least).limit(20).collect()
    if small:
        raise ValueError(f"classes with fewer than {least} rows: {[(r[0], r[1]) for r in small]}")
    return assign_by_quota(df, code_col, id_col, [(train, a), (val, a + b), (test, 1.0)], seed)


def assign_by_quota(df: DataFrame, code_col: str, id_col: str, upto: Sequence[tuple[str, float]], seed: int) -> DataFrame:
    """Name every row by its rank: rank <= rint(n x upto) takes the first name that fits.

    The rank is that of the hash prefix's block plus the rank inside the block, which is a 65,536th of a class."""
    rows = df.withColumn("_order", md5_order(seed, F.col(id_col))).withColumn("_prefix", F.substring("_order", 1, PREFIX))
    counts = rows.groupBy(F.col(code_col).alias("_c"), F.col("_prefix").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy("_c")
    before = F.sum("_n").over(within.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    blocks = counts.withColumn("_size", F.sum("_n").over(within)).withColumn("_before", before).drop("_n")
    joined = rows.join(blocks, F.col(code_col).eqNullSafe(F.col("_c")) & (F.col("_prefix") == F.col("_p")))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_c", "_p").orderBy("_order", id_col))
    name = F.lit(upto[-1][0])
    for split, share in reversed(list(upto[:-1])):
        name = F.when(F.col("_rank") <= F.rint(F.col("_size") * share), split).otherwise(name)
    return joined.withColumn("_rank", rank).withColumn("split_name", name).select(*df.columns, "split_name")


def grouped_holdout(df: DataFrame, group_col: str, test_share: float, seed: int = 42) -> DataFrame:
    """Every row with ``in_test``: ceil(test_share x groups) groups, by random rank, are test as a whole.

    A null group is a group."""
    name = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-"))
    groups = df.select(name.alias("_g")).distinct()
    test = ranked(groups, [], "_g", F.ceil(F.col("n_stratum") * test_share), seed).select("_g", F.lit(True).alias("_test"))
    keyed = df.withColumn("_g", name)
    return keyed.join(test, "_g", "left").withColumn("in_test", F.coalesce("_test", F.lit(False))).drop("_g", "_test")


def leave_one_out(df: DataFrame, group_col: str, field: str, held: str, positive: Column, test_share: float, seed: int = 42) -> DataFrame:
    """``grouped_holdout`` in which positives of the held value stand only in test and others' only in train.

    Rows that fit neither side are left out; an unknown value raises."""
    if not df.where(positive & (F.col(field) == held)).limit(1).count():
        raise ValueError(f"{field} has no positive row with {held!r}")
    split = grouped_holdout(df, group_col, test_share, seed)
    own = F.coalesce(F.col(field) == held, F.lit(False))
    return split.where(~positive | (F.col("in_test") == own))
