"""Rules mined from trusted rows, and the validator that judges rows by them.

Rules are data: one record list compiles to residual columns, which mining, calibration, the hard check and the soft
penalties all share. Families: range, integrality, dependency, distribution (per protocol group). All of it is
column arithmetic on the scan's own columns; fitted parameters come back as one small row per fit.

A row with a NaN or infinite feature passes range, integrality and dependency checks only where the comparison is
false as in IEEE arithmetic; filter bad rows first where that is not wanted.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tidegate.functions.numeric import any_of, total
from tidegate.operators.order import exact_quantiles
from tidegate.operators.scaling import Scaling
from tidegate.scratch import materialize

# What the reference's mining uses.
RANGE_TOLERANCE = 0.01
INTEGRAL_REL_TOL, INTEGRAL_CAP, LOG_INTEGRAL_TOL = 1e-6, 0.25, 1e-5
HEADROOM, TOL_FLOOR, MAX_TOL = 10.0, 1e-6, 0.05
MIN_GROUP_ROWS, MIN_GROUP_VAL_ROWS = 100, 200
Z_CLIP, MAD_SCALE, MAD_FLOOR, SPAN_FLOOR = 50.0, 1.4826, 1e-3, 1e-9
FAMILIES = ["range", "integrality", "dependency", "distribution"]
OTHER = "other"


def gt(a: Column, b: Column | float) -> Column:
    """a > b as in IEEE arithmetic: false for NaN and null."""
    return F.coalesce(~F.isnan(a) & (a > b), F.lit(False))


def lt(a: Column, b: Column | float) -> Column:
    return F.coalesce(~F.isnan(a) & (a < b), F.lit(False))


# -- dependency rules -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """kind: ordering (lo, mid, hi), equal (a, b), product (total, count, mean) or linear_le (lhs <= rhs + const)."""

    kind: str
    name: str
    columns: list[str] = field(default_factory=list)
    lhs: dict[str, float] = field(default_factory=dict)
    rhs: dict[str, float] = field(default_factory=dict)
    const: float = 0.0
    tolerance: float | None = None

    def uses(self) -> list[str]:
        return [*self.columns, *self.lhs, *self.rhs]


def declared(columns: Sequence[str], candidates: Sequence[Rule]) -> list[Rule]:
    """The candidates whose columns all exist."""
    return [r for r in candidates if set(r.uses()) <= set(columns)]


def relative_residual(actual: Column, expected: Column) -> Column:
    return F.abs(actual - expected) / (F.abs(expected) + 1.0)


def residual(rule: Rule) -> Column:
    c = F.col
    if rule.kind == "ordering":
        lo, mid, hi = (c(x) for x in rule.columns)
        return F.greatest(lo - mid, mid - hi, F.lit(0.0)) / (F.abs(hi) + 1.0)
    if rule.kind == "equal":
        return relative_residual(*(c(x) for x in rule.columns))
    if rule.kind == "product":
        whole, count, mean = (c(x) for x in rule.columns)
        return relative_residual(whole, count * mean)
    if rule.kind == "linear_le":
        left = total([c(x) * k for x, k in rule.lhs.items()])
        bound = total([c(x) * k for x, k in rule.rhs.items()]) + rule.const
        return F.greatest(left - bound, F.lit(0.0)) / (F.abs(bound) + 1.0)
    raise ValueError(f"unknown rule kind {rule.kind!r}")


def dependency_calibration(rows: DataFrame, rules: Sequence[Rule], percentile: float = 0.999) -> DataFrame:
    """Per rule the residual's percentiles, tolerance max(10 x p99.9, 1e-6) and whether it is pruned (> 0.05)."""
    cells = F.array(*(F.struct(F.lit(r.name).alias("rule"), residual(r).alias("r")) for r in rules))
    long = rows.select(F.inline(cells))
    per = long.groupBy("rule").agg(F.max("r").alias("max"), F.avg((F.col("r") > 0).cast("double")).alias("share_positive"))
    per = per.join(exact_quantiles(long, ["rule"], "r", [0.5, 0.99, percentile], few_groups=True), "rule")
    tol = F.greatest(HEADROOM * F.col("q")[2], F.lit(TOL_FLOOR))
    return per.select("rule", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p99"), F.col("q")[2].alias("p999"), "max", "share_positive",
                      tol.alias("tolerance"), (tol > MAX_TOL).alias("pruned"))


# -- groups and distribution ------------------------------------------------------------------------------------


def protocol_group(indicators: Sequence[str]) -> Column:
    """Name of the first indicator with the greatest value if that is at least 0.5, else 'other'."""
    top = F.greatest(*(F.col(c) for c in indicators)) if len(indicators) > 1 else F.col(indicators[0])
    out = F.lit(OTHER)
    for c in reversed(indicators):
        out = F.when(F.col(c) == top, c).otherwise(out)
    return F.when(gt(top, 0.5) | F.coalesce(top == 0.5, F.lit(False)), out).otherwise(F.lit(OTHER))


def group_profiles(rows: DataFrame, columns: Sequence[str], group_col: str = "grp") -> dict[str | None, dict]:
    """Median and MAD of every column per group and, under None, over all rows.

    Two dependent passes over (group, column, value) cells: exact medians, then those of the distances to them. Only
    groups x columns numbers reach the driver."""
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns))
    twice = F.explode(F.array(F.col(group_col), F.lit(None).cast("string"))).alias("_of")
    long = rows.select(twice, cells.alias("_cells")).select("_of", F.inline("_cells"))
    spans = long.groupBy("_of", "column_name").agg((F.max("x") - F.min("x")).alias("span"), F.count("x").alias("n_rows"))
    by = ["_of", "column_name"]
    meds = {(r._of, r.column_name): r.q[0] for r in exact_quantiles(long, by, "x", [0.5], few_groups=True).collect()}
    middle = rows.sparkSession.createDataFrame([(g, c, m) for (g, c), m in meds.items()], "_g string, _c string, med double")
    centre = F.broadcast(middle)  # groups x columns rows
    away = long.join(centre, long["_of"].eqNullSafe(centre["_g"]) & (long["column_name"] == centre["_c"])).withColumn("x", F.abs(F.col("x") - F.col("med")))
    mads = {(r._of, r.column_name): r.q[0] for r in exact_quantiles(away, by, "x", [0.5], few_groups=True).collect()}
    out: dict[str | None, dict] = {}
    for r in spans.collect():
        g = out.setdefault(r._of, {"n_rows": r.n_rows, "median": {}, "mad": {}})
        key = (r._of, r.column_name)
        g["median"][r.column_name] = meds[key]
        g["mad"][r.column_name] = max(MAD_SCALE * mads[key], MAD_FLOOR * max(r.span, SPAN_FLOOR))
    return out


# -- the mined rule set -----------------------------------------------------------------------------------------


@dataclass
class RuleSet:
    columns: list[str]
    low: dict[str, float]
    high: dict[str, float]
    span: dict[str, float]
    integral: dict[str, float]  # column -> tolerance
    unverifiable: list[str]
    dependencies: list[Rule]
    pruned: list[str]
    indicators: list[str]
    groups: dict[str, dict]  # name -> n_rows, median, mad, own
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold_source: dict[str, str] = field(default_factory=dict)
    provenance: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> RuleSet:
        d = json.loads(text)
        return cls(**(d | {"dependencies": [Rule(**r) for r in d["dependencies"]]}))


def integer_columns(rows: DataFrame, columns: Sequence[str], scaling: Scaling) -> DataFrame:
    """Per column whether all rows are integral within its tolerance, the tolerance and its use.

    Tolerance: max(1e-6, 1e-6 x range); columns under log1p are tested at 1e-5 x max(1, |x|) and never usable, since
    their precision is relative; a tolerance of 0.25 or more cannot be checked."""
    ranges = dict(zip(scaling.names, scaling.data_range))
    tol = {c: max(INTEGRAL_REL_TOL, ranges[c] * INTEGRAL_REL_TOL) for c in columns}

    def off(c: str) -> Column:
        limit = LOG_INTEGRAL_TOL * F.greatest(F.lit(1.0), F.abs(F.col(c))) if c in scaling.log1p else F.lit(tol[c])
        return F.max(F.abs(F.col(c) - F.rint(c)) / limit).alias(c)

    cells = [
        F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c) <= 1.0, F.lit(False)).alias("integral"), F.lit(tol[c]).alias("tolerance"),
                 F.lit(c not in scaling.log1p and tol[c] < INTEGRAL_CAP).alias("checkable"))
        for c in columns
    ]
    return rows.agg(*(off(c) for c in columns)).select(F.inline(F.array(*cells)))


def mine(trusted: DataFrame, scaling: Scaling, candidates: Sequence[Rule], indicators: Sequence[str], percentile: float = 0.999) -> RuleSet:
    """Rules from trusted training rows (raw units).

    The trusted rows' columns are written once: the dependent fits below read them a dozen times."""
    columns = scaling.names
    trusted = materialize(trusted.select(*columns, protocol_group(indicators).alias("grp")), "trusted")
    edge = trusted.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max)))).first()
    span = {c: edge[f"hi_{c}"] - edge[f"lo_{c}"] for c in columns}
    slack = {c: RANGE_TOLERANCE * max(span[c], SPAN_FLOOR) for c in columns}
    whole = integer_columns(trusted, columns, scaling).where("integral").collect()
    rules = declared(columns, candidates)
    measured = {r.rule: r for r in dependency_calibration(trusted, rules, percentile).collect()} if rules else {}
    found = group_profiles(trusted, columns)
    everyone = found.pop(None)
    groups = {}
    for g in [*indicators, OTHER]:
        own = g in found and found[g]["n_rows"] >= MIN_GROUP_ROWS
        base = found[g] if own else everyone
        groups[g] = {"n_rows": found.get(g, {"n_rows": 0})["n_rows"], "median": base["median"], "mad": base["mad"], "own": own}
    return RuleSet(
        columns=list(columns),
        low={c: edge[f"lo_{c}"] - slack[c] for c in columns},
        high={c: edge[f"hi_{c}"] + slack[c] for c in columns},
        span=span,
        integral={r.column_name: r.tolerance for r in whole if r.checkable},
        unverifiable=[r.column_name for r in whole if not r.checkable],
        dependencies=[Rule(**(asdict(r) | {"tolerance": measured[r.name].tolerance})) for r in rules if not measured[r.name].pruned],
        pruned=[r.name for r in rules if measured[r.name].pruned],
        indicators=list(indicators),
        groups=groups,
        provenance={"rows": everyone["n_rows"], "percentile": percentile},
    )


# -- validator --------------------------------------------------------------------------------------------------


class Validator:
    """Checks of a rule set as columns over rows in raw units."""

    def __init__(self, rules: RuleSet) -> None:
        self.rules = rules

    def group(self) -> Column:
        return protocol_group(self.rules.indicators)

    def _per_group(self, values: dict[str, float], group: Column) -> Column:
        if len(set(values.values())) == 1:
            return F.lit(next(iter(values.values())))
        out = F.lit(values[OTHER])
        for g, v in values.items():
            if g != OTHER:
                out = F.when(group == g, F.lit(v)).otherwise(out)
        return out

    def check_range(self) -> Column:
        r = self.rules
        return any_of([lt(F.col(c), r.low[c]) | gt(F.col(c), r.high[c]) for c in r.columns])

    def check_integrality(self) -> Column:
        return any_of([gt(F.abs(F.col(c) - F.rint(c)), t) for c, t in self.rules.integral.items()])

    def check_dependency(self) -> Column:
        return any_of([gt(residual(r), r.tolerance) for r in self.rules.dependencies])

    def score(self, group: Column | None = None) -> Column:
        """Mean over columns of |x - median| / MAD of the row's group, each at most 50."""
        group = self.group() if group is None else group
        columns = self.rules.columns

        def of(profile: dict) -> Column:
            far = [F.least(F.abs(F.col(c) - profile["median"][c]) / profile["mad"][c], F.lit(Z_CLIP)) for c in columns]
            return total(far) / float(len(columns))

        out = of(self.rules.groups[OTHER])
        for g, profile in self.rules.groups.items():
            if g != OTHER:
                out = F.when(group == g, of(profile)).otherwise(out)
        return out

    def threshold(self, group: Column | None = None) -> Column:
        return self._per_group(self.rules.thresholds, self.group() if group is None else group)

    def check_distribution(self) -> Column:
        return gt(self.score(), self.threshold())

    def check(self, df: DataFrame, families: Sequence[str] = FAMILIES) -> DataFrame:
        """Add ``grp``, ``rej_<family>`` and ``reject``; unknown families raise."""
        if unknown := set(families) - set(FAMILIES):
            raise ValueError(f"unknown families: {sorted(unknown)}")
        out = df.withColumn("grp", self.group())
        for f in families:
            made = gt(self.score(F.col("grp")), self.threshold(F.col("grp"))) if f == "distribution" else getattr(self, f"check_{f}")()
            out = out.withColumn(f"rej_{f}", made)
        return out.withColumn("reject", any_of([F.col(f"rej_{f}") for f in families]))


def calibrate_distribution(rules: RuleSet, val: DataFrame, budget: float = 0.01, train: DataFrame | None = None) -> RuleSet:
    """Set each group's outlier threshold to the (1 - budget) percentile of trusted validation scores.

    Groups with fewer than 200 validation rows pool train and validation if that makes 100, else take the global one."""
    v = Validator(rules)

    def scored(df: DataFrame, src: str) -> DataFrame:
        return df.withColumn("grp", v.group()).select("grp", v.score(F.col("grp")).alias("s"), F.lit(src).alias("src"))

    both = scored(val, "val") if train is None else scored(val, "val").unionByName(scored(train, "train"))
    both = materialize(both, "scores")  # three numbers a row, read for every quantile below
    name = lambda *parts: F.concat_ws("|", *parts)
    val_only = F.when(F.col("src") == "val", F.array(name(F.col("grp"), F.lit("val")), F.lit("|val"))).otherwise(F.array().cast("array<string>"))
    keyed = both.select("s", F.explode(F.concat(F.array(name(F.col("grp"), F.lit("all"))), val_only)).alias("key"))
    found = {r.key: (r.n_values, r.q[0]) for r in exact_quantiles(keyed, ["key"], "s", [1.0 - budget], few_groups=True).collect()}
    if "|val" not in found:
        raise ValueError("no trusted validation row to calibrate on")
    for g in rules.groups:
        (n_val, own), (n_all, pooled) = found.get(f"{g}|val", (0, None)), found.get(f"{g}|all", (0, None))
        if n_val >= MIN_GROUP_VAL_ROWS:
            rules.thresholds[g], rules.threshold_source[g] = own, "val"
        elif train is not None and n_all >= MIN_GROUP_ROWS:
            rules.thresholds[g], rules.threshold_source[g] = pooled, "train+val"
        else:
            rules.thresholds[g], rules.threshold_source[g] = found["|val"][1], "global"
    return rules


def family_rates(checked: DataFrame, *by: str) -> DataFrame:
    """Rows, reject rate and rate per family, in percent."""
    rate = lambda c: (100.0 * F.avg(F.col(c).cast("double")))
    return checked.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), rate("reject").alias("reject_pct"), *(rate(f"rej_{f}").alias(f"{f}_pct") for f in FAMILIES))


def sole_family_rates(checked: DataFrame, *by: str) -> DataFrame:
    """Share of rows that exactly one family rejects, per family, in percent."""
    fired = sum((F.col(f"rej_{f}").cast("int") for f in FAMILIES), F.lit(0))
    alone = [(100.0 * F.avg((F.col(f"rej_{f}") & (fired == 1)).cast("double"))).alias(f"sole_{f}_pct") for f in FAMILIES]
    return checked.groupBy(*by).agg(*alone)


class SoftValidator(Validator):
    """Hinge penalties that are zero exactly where the hard check passes (integrality: where values are integral)."""

    def penalties(self, group: Column | None = None) -> dict[str, Column]:
        r = self.rules
        relu = lambda c: F.greatest(c, F.lit(0.0))
        spans = {c: max(r.high[c] - r.low[c], SPAN_FLOOR) for c in r.columns}
        return {
            "range": total([(relu(F.lit(r.low[c]) - F.col(c)) + relu(F.col(c) - r.high[c])) / spans[c] for c in r.columns]),
            "integrality": total([F.pow(F.sin(F.lit(3.141592653589793) * F.col(c)), 2) for c in r.integral]),
            "dependency": total([relu(residual(d) - d.tolerance) for d in r.dependencies]),
            "distribution": relu(self.score(group) - self.threshold(group)),
        }

    def total(self, weights: dict[str, float] | None = None, group: Column | None = None) -> Column:
        """Weighted sum of the families, weight 1 where none is given."""
        return total([(weights or {}).get(f, 1.0) * p for f, p in self.penalties(group).items()])
