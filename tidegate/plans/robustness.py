"""Queries: perturbations under declared scorers, the realism projection, physical levers, searches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegate.functions.numeric import norms
from tidegate.operators import networks as N, perturb as P, realism as Z, sample
from tidegate.operators.metrics import perturbation_summary
from tidegate.operators.report import population
from tidegate.operators.scaling import Scaling
from tidegate.operators.search import ArrayValidator, Searcher, search
from tidegate.plans.base import FLOWS_SQL, PARAMS_SQL, SCALED_SQL, LOG1P, SAMPLE, every, flows, logit_sql, member, mined, rounded, scaling, vectors
from tidegate.schema import FEATURES

WIDTH = len(FEATURES)
GRID = [0.01, 0.02, 0.05, 0.1, 0.2]

# Classes of the columns, size cap, flow-age modes, functional floors.
REALISM = {
    "classes": {
        "immutable": ["protocol_type", "syn_flag_number", "ack_flag_number", "http", "tcp", "udp", "icmp", "pkt_std", "variance"],
        "increase_only": ["pkt_min", "pkt_avg", "pkt_max", "tot_size"],
        "decrease_only": ["rate"],
        "free_bounded": {"duration": [1.0, 255.0]},
        "flow_age": ["flow_duration", "header_length", "rst_count"],
        "derived": {"srate": {"kind": "equal", "base": "rate"}, "tot_sum": {"kind": "scale_with", "base": "pkt_avg"}},
    },
    "size_cap": 1514.0,
    "flow_age_specs": {"A": {"mode": "immutable"}, "B": {"mode": "scaled", "min": 1.0, "max": 5.0}, "C": {"mode": "scaled", "min": 0.2, "max": 5.0}},
    "max_slowdown": 20.0,
    "floors": {"default": 0.0, "DDoS": 0.5, "DoS": 0.5, "Mirai": 0.5},
}
THETA = {"pad": 120.0, "dttl": -30.0, "slow": 0.4, "stretch": 1.5}  # a declared setting of the levers


def _vectors(spark: SparkSession, d: str, split: str = "test") -> DataFrame:
    rows = flows(spark, d)
    s = scaling(rows.where("split_name = 'train'"))
    return rows.where((F.col("split_name") == split) & (F.col("y") == 1)).select("row_id", "class_name", "category", "y", s.vector().alias("x"))


def _effect(rows: DataFrame, adv: Column, name: str) -> DataFrame:
    s = member(name)
    moved = rows.withColumn("adv", adv)
    out = moved.select("row_id", s.logit(F.col("x")).alias("logit_clean"), s.logit(F.col("adv")).alias("logit_adv"), *(c.alias(n) for n, c in norms(F.col("x"), F.col("adv")).items()))
    return rounded(out)


def fgsm_linear(spark: SparkSession, d: str) -> DataFrame:
    return _effect(_vectors(spark, d), P.perturb("fgsm", F.col("x"), F.col("y"), member("mlp"), eps=0.1), "mlp")


def bim_linear(spark: SparkSession, d: str) -> DataFrame:
    return _effect(_vectors(spark, d), P.perturb("bim", F.col("x"), F.col("y"), member("cnn"), eps=0.1), "cnn")


def pgd_linear(spark: SparkSession, d: str) -> DataFrame:
    return _effect(_vectors(spark, d), P.perturb("pgd", F.col("x"), F.col("y"), member("lstm"), F.col("row_id"), eps=0.1), "lstm")


def deepfool_linear(spark: SparkSession, d: str) -> DataFrame:
    return _effect(_vectors(spark, d), P.perturb("deepfool", F.col("x"), F.col("y"), member("mlp")), "mlp")


ATTACKS = {"fgsm": {"eps": 0.1}, "bim": {"eps": 0.1}, "pgd": {"eps": 0.1}, "deepfool": {}}


def perturbation_cells(spark: SparkSession, d: str) -> DataFrame:
    """Per attack and member the accuracy, evasion and norms over all test attack rows: 4 x 3 cells from one scan, as
    an array of cells in each row."""
    rows, cells = _vectors(spark, d), []
    for m in ("mlp", "cnn", "lstm"):
        s = member(m)
        for a, settings in ATTACKS.items():
            adv = F.col(f"{a}_{m}")
            rows = rows.withColumn(f"{a}_{m}", P.perturb(a, F.col("x"), F.col("y"), s, F.col("row_id"), **settings))
            marks = {"attack": F.lit(a), "model": F.lit(m), "pred_clean": (s.logit(F.col("x")) >= 0).cast("int"), "pred_adv": (s.logit(adv) >= 0).cast("int"), **norms(F.col("x"), adv)}
            cells.append(F.struct(*(c.alias(k) for k, c in marks.items())))
    return rounded(perturbation_summary(rows.select("y", F.inline(F.array(*cells)))))


def network_cells(spark: SparkSession, d: str) -> DataFrame:
    """The same 4 x 3 cells against networks trained on a bounded sample, with gradients through each of them."""
    train, _ = vectors(spark, d)
    networks = N.fitted_each(("mlp", "cnn", "lstm"), train, "row_id", "x", "y", max_rows=SAMPLE)
    rows = _vectors(spark, d).repartition(spark.sparkContext.defaultParallelism, "row_id")  # a row costs far more than its size
    return rounded(perturbation_summary(N.perturbation_cells(rows, networks, ATTACKS, "row_id", "x", "y")))


def eps_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Share still detected per eps: the grid is an array in each row, not a join."""
    s = member("mlp")
    rows = _vectors(spark, d)
    cells = F.array(*(F.struct(F.lit(e).alias("eps"), (s.logit(P.fgsm(F.col("x"), F.col("y"), s, e)) >= 0).alias("found")) for e in GRID))
    return rounded(rows.select(F.inline(cells)).groupBy("eps").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col("found").cast("double")).alias("detected")))


# -- realism ----------------------------------------------------------------------------------------------------


def _projector(rows: DataFrame, spec: str) -> Z.Projector:
    return Z.Projector(Z.RealismSpec.from_dict(REALISM, spec), scaling(rows.where("split_name = 'train'")))


def _original() -> dict[str, Column]:
    return {c: F.col(c) for c in FEATURES}


def _candidate(o: dict[str, Column]) -> dict[str, Column]:
    """A declared wild candidate: every column times 1.4 plus 7."""
    return {c: v * 1.4 + 7.0 for c, v in o.items()}


SHOWN = ["flow_duration", "header_length", "duration", "rate", "srate", "tot_sum", "pkt_min", "pkt_avg", "pkt_max", "tot_size", "variance"]


def _projection(spark: SparkSession, d: str, spec: str) -> DataFrame:
    rows = flows(spark, d)
    p, o = _projector(rows, spec), _original()
    floor = p.spec.rate_floor(F.col("category"))
    out = p.project(_candidate(o), o, floor, Z.COLUMNS)
    return rounded(rows.where("split_name = 'test'").select("row_id", *(out[c].alias(c) for c in SHOWN)), 6)


def projection_spec_a(spark: SparkSession, d: str) -> DataFrame:
    return _projection(spark, d, "A")


def projection_spec_b(spark: SparkSession, d: str) -> DataFrame:
    return _projection(spark, d, "B")


def projection_spec_c(spark: SparkSession, d: str) -> DataFrame:
    return _projection(spark, d, "C")


def projection_violation(spark: SparkSession, d: str) -> DataFrame:
    """Rows per category whose wild candidate, original and projected form are off the allowed set. No projected one may
    be; an original is where it breaks a derived column itself (srate unlike rate) or was clipped by the scaling."""
    rows = flows(spark, d)
    p = _projector(rows, "C")
    floor = p.spec.rate_floor(F.col("category"))
    s = {c: p.scaling.scaled(c, F.col(c)) for c in FEATURES}
    named = rows.where("split_name = 'test'").select("category", *(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)).alias(c) for c, v in s.items()))
    x = _original()
    wild = {c: F.least(v * 1.2 + 0.05, F.lit(1.0)) for c, v in x.items()}
    moved = named.select("category", *FEATURES, *(v.alias(f"w_{c}") for c, v in wild.items()))
    w = {c: F.col(f"w_{c}") for c in FEATURES}
    done = p.project_scaled(w, x, floor, Z.COLUMNS)
    shown = moved.select("category", *FEATURES, *w.values(), *(v.alias(f"p_{c}") for c, v in done.items()))
    off = lambda v: F.count_if(p.violation(v, x, floor) > Z.ON_LINE)
    return shown.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"), off(w).alias("n_wild"), off(x).alias("n_original"), off({c: F.col(f"p_{c}") for c in FEATURES}).alias("n_projected"))


def _levers(spark: SparkSession, d: str, spec: str) -> tuple[DataFrame, Z.Projector, Z.Primitives, dict, dict, Column]:
    rows = flows(spark, d)
    p = _projector(rows, spec)
    g, o, floor = Z.Primitives(p), _original(), p.spec.rate_floor(F.col("category"))
    low, high = g.bounds(o, floor, Z.COLUMNS)
    return rows.where("split_name = 'test'"), p, g, low, high, floor


def theta_bounds(spark: SparkSession, d: str) -> DataFrame:
    rows, _, _, low, high, _ = _levers(spark, d, "C")
    return rounded(rows.select("row_id", *(low[t].alias(f"lo_{t}") for t in Z.THETA), *(high[t].alias(f"hi_{t}") for t in Z.THETA)))


def _applied(spark: SparkSession, d: str) -> tuple[DataFrame, Z.Primitives, dict, Column]:
    """Test rows with a declared theta, clipped to each row's box, applied: columns a_<feature>."""
    rows, _, g, low, high, floor = _levers(spark, d, "C")
    theta = {t: F.least(F.greatest(F.lit(v), low[t]), high[t]) for t, v in THETA.items()}
    boxed = rows.withColumns({f"t_{t}": v for t, v in theta.items()})
    out = g.apply(_original(), {t: F.col(f"t_{t}") for t in Z.THETA}, floor, Z.COLUMNS)
    return boxed.select("row_id", "category", *FEATURES, *(F.col(f"t_{t}") for t in Z.THETA), *(v.alias(f"a_{c}") for c, v in out.items())), g, {c: F.col(f"a_{c}") for c in FEATURES}, floor


def theta_apply(spark: SparkSession, d: str) -> DataFrame:
    rows, _, a, _ = _applied(spark, d)
    return rounded(rows.select("row_id", *(a[c].alias(c) for c in SHOWN)), 6)


def theta_cost(spark: SparkSession, d: str) -> DataFrame:
    rows, g, a, _ = _applied(spark, d)
    costs = g.cost(_original(), a, Z.COLUMNS)
    return rounded(rows.select("category", *(v.alias(n) for n, v in costs.items())).groupBy("category").agg(*(F.avg(n).alias(n) for n in costs)), 4)


def floor_ok(spark: SparkSession, d: str) -> DataFrame:
    rows, g, a, floor = _applied(spark, d)
    return rows.select("category", g.floor_ok(_original(), a, floor).alias("ok")).groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("ok").alias("n_ok"))


def lever_usage(spark: SparkSession, d: str) -> DataFrame:
    """Share of rows whose box lets each lever take its declared setting in full, per category."""
    rows, _, _, _ = _applied(spark, d)
    return rounded(rows.groupBy("category").agg(*(F.avg((F.col(f"t_{t}") == v).cast("double")).alias(t) for t, v in THETA.items())))


FLOORS = (0.0, 0.25, 0.5, 0.75)


def floor_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Rate kept of attack rows for several functional floors: each row slowed down by 70 %, or as far as its box at
    that floor allows, and projected."""
    rows, p, g, _, _, _ = _levers(spark, d, "C")
    o, cells = _original(), []
    for f in FLOORS:
        low, high = g.bounds(o, F.lit(f), Z.COLUMNS)
        theta = dict.fromkeys(Z.THETA, F.lit(0.0)) | {"slow": F.least(F.greatest(F.lit(0.7), low["slow"]), high["slow"])}
        cells.append(F.struct(F.lit(f).alias("floor"), g.apply(o, theta, F.lit(f), Z.COLUMNS)["rate"].alias("after")))
    long = rows.where("y = 1").select("category", "rate", F.inline(F.array(*cells)))
    kept = F.when(F.col("rate") > 0, F.col("after") / F.col("rate")).otherwise(1.0)
    return rounded(long.groupBy("floor", "category").agg(F.avg(kept).alias("share_kept"), F.count_if(F.col("after") >= 10.0).alias("n_fast")))


# -- searches: on the reference's selection of rows, with its settings -------------------------------------------

ATTACKED = ["mlp", "cnn"]
PER_CATEGORY = 900
# Settings tried on validation rows (search, steps, step, restarts).
GRID_ROWS = 100
TUNING = [
    ("feature", 100, 0.01, 0), ("feature", 300, 0.01, 0), ("feature", 100, 0.03, 0), ("feature", 100, 0.01, 3), ("feature", 300, 0.03, 3), ("feature", 100, 0.01, 10), ("feature", 100, 0.01, 30),
    ("primitive", 100, 0.05, 0), ("primitive", 300, 0.05, 0), ("primitive", 100, 0.2, 0), ("primitive", 100, 0.05, 3), ("primitive", 300, 0.1, 3), ("primitive", 100, 0.05, 10), ("primitive", 100, 0.05, 30),
]


def _chosen(rows: DataFrame, p: Z.Projector, s: Scaling, split: str, per_category: int) -> DataFrame:
    """Rows of a split that every attacked member detects, up to so many a category; spread anew, as a search costs
    far more than its row."""
    at = rows.where(F.col("split_name") == split).select("row_id", "category", "y", s.vector().alias("x"), p.spec.rate_floor(F.col("category")).alias("floor"))
    eligible = every([F.col("y") == 1, *(member(m).detects(F.col("x")) for m in ATTACKED)])
    return sample.per_category(at, "category", "row_id", per_category, eligible, "Benign").repartition(rows.sparkSession.sparkContext.defaultParallelism, "row_id")


def _search(spark: SparkSession, d: str, kind: str, **settings: object) -> DataFrame:
    rows = flows(spark, d)
    rules, s = mined(rows), scaling(rows.where("split_name = 'train'"))
    p = Z.Projector(Z.RealismSpec.from_dict(REALISM, "C"), s)
    seeker = Searcher(p, [member(m) for m in ATTACKED], ArrayValidator(rules))
    found = search(_chosen(rows, p, s, "test", PER_CATEGORY), seeker, kind, "row_id", "x", "floor", ["category"], **settings)
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("won").alias("n_won"), F.avg("detail").alias("detail"))


def feature_search(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "feature", steps=100, step=0.01, restarts=10)


def primitive_search(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "primitive", steps=100, step=0.05, restarts=10)


def adaptive_search(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "adaptive_feature", steps=100, step=0.01, restarts=10)


def blackbox_search(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "blackbox", queries=1000)


def search_tuning(spark: SparkSession, d: str) -> DataFrame:
    """The 14 settings on validation rows (up to 100 a category, spec A): rows that evade the members, and that also
    pass the validator; in all and per window population."""
    rows = flows(spark, d)
    rules, s = mined(rows), scaling(rows.where("split_name = 'train'"))
    p = Z.Projector(Z.RealismSpec.from_dict(REALISM, "A"), s)
    models, check = [member(m) for m in ATTACKED], ArrayValidator(rules)
    chosen = _chosen(rows, p, s, "val", GRID_ROWS)
    judge = Searcher(p, models, check)

    def run(batches):
        for pdf in batches:
            ids, x, floor = pdf["row_id"].to_numpy(), np.stack(pdf["x"].to_numpy()).astype(float), pdf["floor"].to_numpy(float)
            for kind, steps, step, restarts in TUNING:
                blind = Searcher(p, models)  # the settings are compared without the validator in the loop
                adv = getattr(blind, f"{kind}_search")(ids, x, floor, steps, step, restarts=restarts)[0]
                evades = judge.wins(adv, need_validator=False)
                yield pd.DataFrame({"search": kind, "steps": steps, "step": step, "restarts": restarts, "category": pdf["category"], "evades": evades, "passes": judge.wins(adv)})

    made = chosen.mapInPandas(run, "search string, steps int, step double, restarts int, category string, evades boolean, passes boolean")
    share = lambda c: 100.0 * F.avg(c.cast("double"))
    of = lambda name: share(F.when(population(F.col("category")) == name, F.col("passes")))
    return made.groupBy("search", "steps", "step", "restarts").agg(
        F.count(F.lit(1)).alias("n_rows"), share(F.col("evades")).alias("evasion_pct"), share(F.col("passes")).alias("pass_and_evade_pct"),
        of("10-pkt").alias("pass_and_evade_10pkt_pct"), of("100-pkt").alias("pass_and_evade_100pkt_pct"),
    )


def network_search(spark: SparkSession, d: str) -> DataFrame:
    """The feature search against a trained dense network: test rows it detects, up to 900 a category."""
    train, _ = vectors(spark, d)
    network = N.fitted("mlp", train, "row_id", "x", "y", max_rows=SAMPLE)
    rows = flows(spark, d)
    rules, s = mined(rows), scaling(rows.where("split_name = 'train'"))
    p = Z.Projector(Z.RealismSpec.from_dict(REALISM, "C"), s)
    at = rows.where("split_name = 'test'").select("row_id", "category", "y", s.vector().alias("x"), p.spec.rate_floor(F.col("category")).alias("floor"))
    judged = N.scored(at, "x", network)
    chosen = sample.per_category(judged, "category", "row_id", PER_CATEGORY, (F.col("y") == 1) & (F.col("prob") >= 0.5), "Benign").repartition(rows.sparkSession.sparkContext.defaultParallelism, "row_id")
    found = search(chosen, Searcher(p, [network], ArrayValidator(rules)), "feature", "row_id", "x", "floor", ["category"], steps=100, step=0.01, restarts=10)
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("won").alias("n_won"))


QUERIES = {f.__name__: f for f in (
    fgsm_linear, bim_linear, pgd_linear, deepfool_linear, perturbation_cells, network_cells, eps_sweep, projection_spec_a, projection_spec_b, projection_spec_c, projection_violation,
    theta_bounds, theta_apply, theta_cost, floor_ok, lever_usage, floor_sweep, feature_search, primitive_search, adaptive_search, blackbox_search, network_search,
)}

# -- SQL --------------------------------------------------------------------------------------------------------

_VEC = f"{FLOWS_SQL}, {PARAMS_SQL}, {SCALED_SQL}, v AS (SELECT * FROM scaled WHERE split_name = 'test' AND y = 1)"


def _w(name: str) -> str:
    return "[" + ", ".join(f"({w})::DOUBLE" for w in member(name).weights) + "]"


def _zip(a: str, b: str, f: str) -> str:
    """list of f over positions i of lists a and b."""
    return f"list_transform(range(1, {WIDTH + 1}), lambda i: {f.format(a=f'{a}[i]', b=f'{b}[i]')})"


def _moved(step: float, eps: float, origin: str, x: str, w: str) -> str:
    return f"list_transform(range(1, {WIDTH + 1}), lambda i: least(greatest(least(greatest({x}[i] - sign({w}[i]) * {step}, {origin}[i] - {eps}), {origin}[i] + {eps}), 0.0), 1.0))"


def _effect_sql(name: str, ctes: str, source: str) -> str:
    return f"""WITH {_VEC}, {ctes}, n AS (SELECT row_id, {logit_sql(name)} AS c, {logit_sql(name, 'adv')} AS a, {_zip('adv', 'x', '{a} - {b}')} AS delta FROM {source})
        SELECT row_id, round(c, 6) AS logit_clean, round(a, 6) AS logit_adv, round(list_max(list_transform(delta, lambda v: abs(v))), 6) AS linf,
          round(sqrt(list_sum(list_transform(delta, lambda v: v * v))), 6) AS l2, len(list_filter(delta, lambda v: v <> 0)) AS n_changed FROM n"""


def _attack_sql(attack: str, m: str) -> str:
    """CTE <attack>_<member> with the perturbed vector ``adv``, one more CTE per step."""
    w, name = _w(m), f"{attack}_{m}"
    if attack == "fgsm":
        return f"{name} AS (SELECT *, {_moved(0.1, 0.1, 'x', 'x', w)} AS adv FROM v)"
    if attack == "deepfool":
        norm = sum(v * v for v in member(m).weights)
        step = f"list_transform(range(1, {WIDTH + 1}), lambda i: least(greatest(adv[i] - {w}[i] * (f * 1.02 / {norm!r}), 0.0), 1.0))"
        parts = [f"{name}_0 AS (SELECT *, x AS adv, {logit_sql(m)} AS f FROM v)"]
        for k in range(1, 11):
            moved = f"SELECT * REPLACE (CASE WHEN f < 0 THEN adv ELSE {step} END AS adv) FROM {name}_{k - 1}"
            parts.append(f"{name}_{k} AS (SELECT * REPLACE ({logit_sql(m, 'adv')} AS f) FROM ({moved}))")
        return ", ".join([*parts, f"{name} AS (SELECT * FROM {name}_10)"])
    unit = "((('0x' || substr(md5('0:' || row_id || ':' || (i - 1)), 1, 8))::BIGINT % 2000001) / 1000000.0::DOUBLE - 1)"
    start = "x" if attack == "bim" else f"list_transform(range(1, {WIDTH + 1}), lambda i: least(greatest(x[i] + {unit} * 0.1::DOUBLE, 0.0), 1.0))"
    steps = [f"{name}_{k} AS (SELECT * REPLACE ({_moved(0.02, 0.1, 'x', 'adv', w)} AS adv) FROM {name}_{k - 1})" for k in range(1, 11)]
    return ", ".join([f"{name}_0 AS (SELECT *, {start} AS adv FROM v)", *steps, f"{name} AS (SELECT * FROM {name}_10)"])


_F = {"A": False, "B": (1.0, 5.0), "C": (0.2, 5.0)}
_CAT_FLOOR = "CASE WHEN category IN ('DDoS', 'DoS', 'Mirai') THEN 0.5 ELSE 0.0 END"


def _fit(c: str, v: str) -> str:
    """Clip to what the scaler can represent: the raw values of scaled 0 and 1."""
    back = (lambda y: f"sign({y}) * (exp(abs({y})) - 1)") if c in LOG1P else (lambda y: y)
    return f"least(greatest({v}, {back(f'lo_{c}')}), {back(f'(lo_{c} + span_{c})')})"


def _project_sql(source: str, spec: str) -> str:
    """CTEs p1..p3 over ``source`` with columns o_<c>, a_<c>, floor and the scaling's parameters."""
    age = _F[spec]
    free = lambda c: f"least(greatest(a_{c}, o_{c}), greatest(o_{c}, 1514.0))"
    first = {c: f"o_{c}" for c in FEATURES}
    first |= {c: free(c) for c in ("pkt_min", "pkt_avg", "pkt_max", "tot_size")}
    first["duration"] = "least(greatest(a_duration, least(o_duration, 1.0)), greatest(o_duration, 255.0))"
    if age:
        first["rate"] = "greatest(least(a_rate, o_rate), floor * o_rate)"
        first |= {c: f"least(greatest(a_{c}, {age[0]} * o_{c}), {age[1]} * o_{c})" for c in ("flow_duration", "header_length", "rst_count")}
    p1 = ", ".join(f"{v} AS m_{c}" for c, v in first.items() if c not in ("srate", "tot_sum"))
    p2 = "* REPLACE (greatest(m_pkt_max, m_pkt_min - greatest(o_pkt_min - o_pkt_max, 0.0)) AS m_pkt_max)"
    p3 = "* REPLACE (least(greatest(m_pkt_avg, m_pkt_min - greatest(o_pkt_min - o_pkt_avg, 0.0)), m_pkt_max + greatest(o_pkt_avg - o_pkt_max, 0.0)) AS m_pkt_avg)"
    base = ", ".join(f"{_fit(c, 'm_' + c)} AS r_{c}" for c in FEATURES if c not in ("srate", "tot_sum"))
    total = "CASE WHEN r_pkt_avg = o_pkt_avg THEN o_tot_sum WHEN o_pkt_avg > 0 THEN o_tot_sum * r_pkt_avg / o_pkt_avg ELSE o_tot_sum + (r_pkt_avg - o_pkt_avg) END"
    return f"""p1 AS (SELECT *, {p1} FROM {source}), p2 AS (SELECT {p2} FROM p1), p3 AS (SELECT {p3} FROM p2), p4 AS (SELECT *, {base} FROM p3),
        p5 AS (SELECT *, {_fit('srate', 'r_rate')} AS r_srate, {_fit('tot_sum', total)} AS r_tot_sum FROM p4)"""


_ORIG = ", ".join(f"{c} AS o_{c}" for c in FEATURES)
_TEST = f"{FLOWS_SQL}, {PARAMS_SQL}, t AS (SELECT row_id, category, {_CAT_FLOOR} AS floor, {_ORIG}, params.* FROM flows, params WHERE split_name = 'test')"
_SHOW = ", ".join(f"round(r_{c}, 6) AS {c}" for c in SHOWN)
_WILD = f"{_TEST}, w AS (SELECT *, {', '.join(f'o_{c} * 1.4 + 7 AS a_{c}' for c in FEATURES)} FROM t)"
_BOX = {
    "pad": ("0.0", "greatest(0.0, 1514.0 - o_pkt_max)"), "dttl": ("least(0.0, 1.0 - o_duration)", "greatest(0.0, 255.0 - o_duration)"),
    "slow": ("0.0", "least(greatest(1.0 - greatest(floor, 0.05), 0.0), 1.0)"), "stretch": ("-0.8", "4.0"),
}
_LEVER = f"""{_TEST}, b AS (SELECT *, {', '.join(f'least(greatest(({v})::DOUBLE, {_BOX[t][0]}), {_BOX[t][1]}) AS t_{t}' for t, v in THETA.items())} FROM t),
    w AS (SELECT *, {', '.join(f'o_{c} + t_pad AS a_{c}' for c in ('pkt_min', 'pkt_avg', 'pkt_max', 'tot_size'))}, o_duration + t_dttl AS a_duration, o_rate * (1 - t_slow) AS a_rate,
      o_header_length * (1 + t_stretch) AS a_header_length, o_rst_count * (1 + t_stretch) AS a_rst_count, o_flow_duration * (1 + t_stretch) / greatest(1 - t_slow, 1e-6) AS a_flow_duration FROM b),
    {_project_sql('w', 'C')}"""
_R = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 1 END"

SQL = {
    "fgsm_linear": _effect_sql("mlp", f"m AS (SELECT *, {_moved(0.1, 0.1, 'x', 'x', _w('mlp'))} AS adv FROM v)", "m"),
    "bim_linear": _effect_sql("cnn", "m0 AS (SELECT *, x AS adv FROM v), " + ", ".join(
        f"m{k} AS (SELECT * REPLACE ({_moved(0.02, 0.1, 'x', 'adv', _w('cnn'))} AS adv) FROM m{k - 1})" for k in range(1, 11)), "m10"),
    "pgd_linear": _effect_sql("lstm", _attack_sql("pgd", "lstm"), "pgd_lstm"),
    "deepfool_linear": _effect_sql("mlp", _attack_sql("deepfool", "mlp"), "deepfool_mlp"),
    "perturbation_cells": f"WITH {_VEC}, " + ", ".join(_attack_sql(a, m) for a in ATTACKS for m in ("mlp", "cnn", "lstm")) + ", cells AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS attack, '{m}' AS model, y, ({logit_sql(m)} >= 0)::INT AS pred_clean, ({logit_sql(m, 'adv')} >= 0)::INT AS pred_adv, {_zip('adv', 'x', '{a} - {b}')} AS delta FROM {a}_{m}" for a in ATTACKS for m in ("mlp", "cnn", "lstm")) + """),
        n AS (SELECT *, list_max(list_transform(delta, lambda v: abs(v))) AS linf, sqrt(list_sum(list_transform(delta, lambda v: v * v))) AS l2, len(list_filter(delta, lambda v: v <> 0)) AS n_changed FROM cells)
        SELECT attack, model, count(*) AS n_rows, round(avg((pred_clean = y)::INT), 6) AS acc_clean, round(avg((pred_adv = y)::INT), 6) AS acc_adv,
          round(coalesce(avg((pred_adv = 0)::INT) FILTER (WHERE y = 1 AND pred_clean = 1), 0), 6) AS evasion, round(coalesce(avg((pred_adv = 0)::INT) FILTER (WHERE y = 1), 0), 6) AS success_rate,
          count(*) FILTER (WHERE pred_clean <> pred_adv) AS n_flipped, round(avg(linf), 6) AS mean_linf, round(max(linf), 6) AS max_linf, round(avg(l2), 6) AS mean_l2, round(avg(n_changed), 6) AS mean_changed
        FROM n GROUP BY attack, model""",
    "eps_sweep": f"WITH {_VEC}, " + ", ".join(f"e{k} AS (SELECT {e} AS eps, {_moved(e, e, 'x', 'x', _w('mlp'))} AS adv FROM v)" for k, e in enumerate(GRID))
    + ", u AS (" + " UNION ALL ".join(f"SELECT eps::DOUBLE AS eps, adv FROM e{k}" for k in range(len(GRID))) + f") SELECT eps, count(*) AS n_rows, round(avg(({logit_sql('mlp', 'adv')} >= 0)::INT), 6) AS detected FROM u GROUP BY eps",
    **{f"projection_spec_{s.lower()}": f"WITH {_WILD}, {_project_sql('w', s)} SELECT row_id, {_SHOW} FROM p5" for s in "ABC"},
    "theta_bounds": f"WITH {_TEST} SELECT row_id, " + ", ".join(f"round(({v[k]})::DOUBLE, 6) AS {n}_{t}" for t, v in _BOX.items() for k, n in enumerate(("lo", "hi"))) + " FROM t",
    "theta_apply": f"WITH {_LEVER} SELECT row_id, {_SHOW} FROM p5",
    "theta_cost": f"""WITH {_LEVER} SELECT category, round(avg(r_pkt_avg - o_pkt_avg), 4) AS pad_bytes, round(avg(100 * (r_pkt_avg - o_pkt_avg) / greatest(o_pkt_avg, 1)), 4) AS byte_overhead_pct,
        round(avg(r_duration - o_duration), 4) AS ttl_change, round(avg(100 * (1 - {_R('r_rate', 'o_rate')})), 4) AS rate_loss_pct, round(avg({_R('r_flow_duration', 'o_flow_duration')}), 4) AS lifetime_factor FROM p5 GROUP BY category""",
    "floor_ok": f"WITH {_LEVER} SELECT category, count(*) AS n_rows, count(*) FILTER (WHERE r_rate >= floor * o_rate * (1 - 1e-6) - 1e-9) AS n_ok FROM p5 GROUP BY category",
    "lever_usage": f"WITH {_LEVER} SELECT category, " + ", ".join(f"round(avg((t_{t} = ({v})::DOUBLE)::INT), 6) AS {t}" for t, v in THETA.items()) + " FROM b GROUP BY category",
    "floor_sweep": f"""WITH {FLOWS_SQL}, {PARAMS_SQL}, g AS (SELECT unnest({list(FLOORS)})::DOUBLE AS floor),
        m AS (SELECT floor, category, rate, greatest(least(rate * (1 - least(0.7::DOUBLE, greatest(1 - greatest(floor, 0.05::DOUBLE), 0))), rate), floor * rate) AS moved, params.* FROM flows, params, g WHERE split_name = 'test' AND y = 1),
        k AS (SELECT *, {_fit('rate', 'moved')} AS after FROM m)
        SELECT floor, category, round(avg(CASE WHEN rate > 0 THEN after / rate ELSE 1 END), 6) AS share_kept, count(*) FILTER (WHERE after >= 10) AS n_fast FROM k GROUP BY ALL""",
}
