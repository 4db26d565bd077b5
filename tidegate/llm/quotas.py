"""Samples whose groups meet target shares and minimums, with integer quotas that keep both margins.

Per plan the fractional two-way table group x stratum is rounded by a maximum flow with lower bounds: every cell
becomes its floor or ceiling, and so do every group's and every stratum's total, while the grand total is the
sample size. What a population cannot give is reported per group. The quotas are then taken exactly: each row has a
random key, the cutoff of a cell is found on counts of key intervals, and only the rows of the interval in which it
falls are ranked, so a cell of any size is spread over all tasks.

Defined cases: groups are compared as slugs; a null group or stratum value is no group, respectively the stratum
''. Copies of a row (by the population's key) count once, the smallest id stands for them. A group asked for twice
in a plan is two lines, judged each by itself, and gets the sum in the sample. A null target is 0. Empty tables
give empty results. A plan's minimums may make its sample larger than its size.
"""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegate.functions.text import slug
from tidegate.scratch import materialize
from tidegate.sources.tables import bounded

KEY_BITS = 20
MAX_BROADCAST = 100_000  # quota cells (plans x groups x strata) sent to every executor


# -- controlled rounding ----------------------------------------------------------------------------------------


class _Flow:
    """Maximum flow by shortest augmenting paths in levels."""

    def __init__(self, n: int) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def edge(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        total = 0
        while True:
            level = {s: 0}
            queue = deque([s])
            while queue:
                a = queue.popleft()
                for e in self.out[a]:
                    if self.room[e] and self.to[e] not in level:
                        level[self.to[e]] = level[a] + 1
                        queue.append(self.to[e])
            if t not in level:
                return total
            at = [0] * len(self.out)
            while pushed := self._push(s, t, 1 << 62, level, at):
                total += pushed

    def _push(self, s: int, t: int, most: int, level: dict[int, int], at: list[int]) -> int:
        path: list[int] = []
        a = s
        while a != t:
            while at[a] < len(self.out[a]):
                e = self.out[a][at[a]]
                if self.room[e] and level.get(self.to[e], -1) == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(self.out[a]):
                path.append(e)
                a = self.to[e]
            elif path:
                a = self.to[path.pop() ^ 1]
                at[a] += 1
            else:
                return 0
        pushed = min([most, *(self.room[e] for e in path)])
        for e in path:
            self.room[e] -= pushed
            self.room[e ^ 1] += pushed
        return pushed


def controlled_rounding(
    cells: list[list[float]], row_bounds: list[tuple[int, int]], col_bounds: list[tuple[int, int]], room: list[list[int]], total: int
) -> list[list[int]] | None:
    """Integer table with every cell at the floor or ceiling of ``cells`` (at most ``room``), row and column sums
    within their bounds and, as far as the bounds allow, the given total; None if there is no such table."""
    rows, cols = len(cells), len(col_bounds)
    s, t, ss, tt = rows + cols, rows + cols + 1, rows + cols + 2, rows + cols + 3
    flow, need, place = _Flow(rows + cols + 4), 0, {}
    demand = [0] * (rows + cols + 2)

    def bounded_edge(a: int, b: int, low: int, high: int) -> tuple[int, int]:
        demand[b] += low
        demand[a] -= low
        return flow.edge(a, b, high - low), low

    for i, (low, high) in enumerate(row_bounds):
        bounded_edge(s, i, low, high)
    for j, (low, high) in enumerate(col_bounds):
        bounded_edge(rows + j, t, low, high)
    for i in range(rows):
        for j in range(cols):
            low = min(room[i][j], math.floor(cells[i][j] + 1e-9))
            high = min(room[i][j], math.ceil(cells[i][j] - 1e-9))
            place[i, j] = bounded_edge(i, rows + j, low, max(low, high))
    bounded_edge(t, s, total, total)
    for v, d in enumerate(demand):
        if d > 0:
            flow.edge(ss, v, d)
            need += d
        elif d < 0:
            flow.edge(v, tt, -d)
    if flow.run(ss, tt) < need:
        return None
    return [[place[i, j][1] + flow.room[place[i, j][0] ^ 1] for j in range(cols)] for i in range(rows)]


def plan_quotas(lines: list[dict], strata: list[str], size: int) -> list[list[int]]:
    """Quotas of one plan. A line has ``need_low``/``need_high`` (target share rounded down and up, both at least the
    minimum) and ``have``, its available rows per stratum."""
    have = [[line["have"].get(s, 0) for s in strata] for line in lines]
    low = [min(line["need_low"], sum(h)) for line, h in zip(lines, have)]
    high = [min(line["need_high"], sum(h)) for line, h in zip(lines, have)]
    total = max(sum(low), min(sum(high), size))
    middle = [max(lo, min(hi, line["target"])) for line, lo, hi in zip(lines, low, high)]
    cells = [[m * x / sum(h) if sum(h) else 0.0 for x in h] for m, h in zip(middle, have)]
    sums = [sum(c) for c in zip(*cells)] if cells else []
    cols = [(math.floor(c + 1e-9), math.ceil(c - 1e-9)) for c in sums]
    rows = list(zip(low, high))
    free = [(0, sum(h)) for h in zip(*have)] if have else []
    # A table that also keeps the strata's totals exists unless minimums or shortages moved a group's total off its share.
    for columns, given in ((cols, cells), (free, cells)):
        if (table := controlled_rounding(given, rows, columns, have, total)) is not None:
            return table
    out = []
    for (lo, hi), h, c in zip(rows, have, cells):
        take, want = [min(math.floor(x), y) for x, y in zip(c, h)], lo
        for j in sorted(range(len(h)), key=lambda j: math.floor(c[j]) - c[j]):
            add = min(h[j] - take[j], max(0, want - sum(take)), 1)
            take[j] += add
        out.append(take)
    return out


# -- populations, quotas, sample --------------------------------------------------------------------------------


def population(df: DataFrame, name: str, keys: list[Column], id_col: Column, group: Column, stratum: Column) -> DataFrame:
    """(population, id, grp_slug, stratum): rows that can be drawn, each key once.

    The minimum is taken before the shuffle too, so a row delivered any number of times stays one row per task.
    """
    row = F.min(F.struct(id_col.alias("id"), slug(group).alias("grp_slug"), F.coalesce(stratum.cast("string"), F.lit("")).alias("stratum")))
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    return df.where(group.isNotNull()).groupBy(*named).agg(row.alias("r")).select(F.lit(name).alias("population"), "r.*")


def availability(rows: DataFrame) -> DataFrame:
    return rows.groupBy("population", "grp_slug", "stratum").agg(F.count(F.lit(1)).alias("n"))


QUOTA = "plan_id long, population string, grp string, grp_slug string, stratum string, target double, min_rows long, needed long, available long, quota long"


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["grp_slug", "line"], kind="stable")
    pdf["have"] = [dict(zip(s, n)) for s, n in zip(pdf["have_s"], pdf["have_n"])]
    strata = sorted({s for m in pdf["have"] for s in m})
    # Lines that ask for one group are one row of the table: what they ask for is summed, and dealt out again below.
    groups: dict[tuple[str, str], dict] = {}
    for r in pdf.itertuples():
        floor = r.sample_size * r.target_ppm // 1_000_000
        g = groups.setdefault((r.population, r.grp_slug), {"target": 0.0, "need_low": 0, "need_high": 0, "have": r.have})
        g["target"] += r.sample_size * r.target_ppm / 1_000_000
        g["need_low"] += max(r.min_rows, floor)
        g["need_high"] += r.needed
    table = dict(zip(groups, plan_quotas(list(groups.values()), strata, int(pdf["sample_size"].max()))))
    asked = {key: len(own) for key, own in pdf.groupby(["population", "grp_slug"])["line"]}
    rows = []
    for r in pdf.itertuples():
        key, available = (r.population, r.grp_slug), int(sum(r.have.values()))
        asked[key] -= 1
        left = r.needed if asked[key] else sum(table[key])  # the last line takes what the others left
        for i, s in enumerate(strata or [""]):
            q = min(left, table[key][i]) if strata else 0
            if strata:
                table[key][i] -= q
            left -= q
            rows.append((r.plan_id, r.population, r.grp, r.grp_slug, s, r.sample_size * r.target_ppm / 1e6, r.min_rows, r.needed, available, q))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in QUOTA.split(", ")])


def quotas(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Integer quota of every plan line and stratum; one task per plan, whose table has groups x strata cells."""
    zero = F.lit(0).cast("long")
    lines = targets.select(
        "plan_id", "population", "grp", slug(F.col("grp")).alias("grp_slug"),
        F.coalesce("target_ppm", zero).alias("target_ppm"), F.coalesce("min_rows", zero).alias("min_rows"),
        F.coalesce("sample_size", zero).alias("sample_size"),
    ).where("grp_slug is not null")
    share = F.col("sample_size").cast("decimal(20,0)") * F.col("target_ppm").cast("decimal(10,0)") / 1_000_000
    lines = lines.withColumn("needed", F.greatest("min_rows", F.ceil(share).cast("long")))
    lines = lines.withColumn("line", F.xxhash64("grp", "target_ppm", "min_rows"))
    have = counts.groupBy("population", "grp_slug").agg(F.sort_array(F.collect_list(F.struct("stratum", "n"))).alias("have"))
    have = have.select("population", "grp_slug", F.col("have.stratum").alias("have_s"), F.col("have.n").alias("have_n"))
    lines = lines.join(have, ["population", "grp_slug"], "left")
    lines = lines.withColumn("have_s", F.coalesce("have_s", F.array().cast("array<string>")))
    lines = lines.withColumn("have_n", F.coalesce("have_n", F.array().cast("array<bigint>")))
    return lines.groupBy("plan_id").applyInPandas(_solve, QUOTA)


def unmet(quota: DataFrame) -> DataFrame:
    """Plan lines whose population is too small, with what was needed, available and given."""
    line = ["plan_id", "grp", "grp_slug", "target", "min_rows", "needed", "available"]
    # Two lines with equal values are told apart by nothing; the count restores them.
    per = quota.groupBy(*line, "stratum").agg(F.sum("quota").alias("quota"), F.count(F.lit(1)).alias("times"))
    per = per.groupBy(*line).agg(F.sum("quota").alias("quota"), F.max("times").alias("times")).where("available < needed")
    return per.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("_i", "times")


def draw(rows: DataFrame, quota: DataFrame, seed: int = 42) -> DataFrame:
    """(plan_id, population, grp_slug, stratum, id): exactly the quota of every cell, by smallest random keys.

    All plans share a row's key, so samples of the same population overlap as far as their quotas allow. Cells with
    a quota are sent to every executor if their number is within ``MAX_BROADCAST``, else joined by a shuffle.
    """
    cell = ["population", "grp_slug", "stratum"]
    key = F.xxhash64(F.lit(seed), F.col("population"), F.col("id"))
    keyed = rows.withColumn("key", key).withColumn("slot", F.shiftrightunsigned("key", 64 - KEY_BITS))
    keyed = materialize(keyed, "keyed")
    wanted = quota.groupBy("plan_id", *cell).agg(F.sum("quota").alias("quota")).where("quota > 0")
    wanted = materialize(wanted, "quotas")
    slots = keyed.groupBy(*cell, "slot").agg(F.count(F.lit(1)).alias("n"))  # at most 2^20 a cell
    upto = F.sum("n").over(Window.partitionBy(*cell).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    slots = slots.withColumn("upto", upto).withColumn("below", F.col("upto") - F.col("n"))
    slots = slots.withColumn("total", F.sum("n").over(Window.partitionBy(*cell)))
    edge = slots.join(bounded(wanted, MAX_BROADCAST), cell).withColumn("quota", F.least("quota", "total")).where("below < quota and quota <= upto")
    edge = materialize(edge.select("plan_id", *cell, F.col("slot").alias("edge"), (F.col("quota") - F.col("below")).alias("rest")), "edges")
    cuts = bounded(edge, MAX_BROADCAST)
    out = ["plan_id", *cell, "id"]
    whole = keyed.join(cuts, cell).where("slot < edge").select(out)
    last = keyed.join(cuts, [*(keyed[c] == cuts[c] for c in cell), keyed["slot"] == cuts["edge"]]).select("plan_id", *(keyed[c] for c in cell), "id", "key", "rest")
    rank = F.row_number().over(Window.partitionBy("plan_id", *cell).orderBy("key", "id"))
    return whole.unionByName(last.withColumn("_r", rank).where("_r <= rest").select(out))
