"""Bounded perturbations of scaled vectors under a declared linear scorer, away from each row's true label.

Everything is array arithmetic in the JVM; iterations are folds over a sequence, so a row never leaves its task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidegate.functions.numeric import clamp
from tidegate.operators.scorers import Linear

# Defaults of the perturbation settings.
EPS, STEPS, STEP_SIZE, OVERSHOOT = 0.1, 10, 0.02, 0.02


def _sign(scorer: Linear, y: Column) -> Column:
    """Per feature the direction that moves the logit away from the label."""
    away = F.when(y == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.transform(F.array(*(F.lit(float((w > 0) - (w < 0))) for w in scorer.weights)), lambda s: s * away)


def _move(x: Column, direction: Column, size: Column | float, origin: Column, eps: float) -> Column:
    size = size if isinstance(size, Column) else F.lit(size)
    moved = F.zip_with(x, direction, lambda v, d: v + d * size)
    return F.zip_with(moved, origin, lambda v, o: clamp(clamp(v, o - eps, o + eps), 0.0, 1.0))


def fgsm(x: Column, y: Column, scorer: Linear, eps: float = EPS) -> Column:
    return _move(x, _sign(scorer, y), eps, x, eps)


def bim(x: Column, y: Column, scorer: Linear, eps: float = EPS, steps: int = STEPS, step: float = STEP_SIZE, start: Column | None = None) -> Column:
    direction = _sign(scorer, y)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x if start is None else start, lambda v, _: _move(v, direction, step, x, eps))


def pgd(x: Column, y: Column, scorer: Linear, row_id: Column, eps: float = EPS, steps: int = STEPS, step: float = STEP_SIZE, seed: int = 0) -> Column:
    """``bim`` from a random point of the eps-box; the point follows from the md5 of seed, row and feature, so that
    any engine draws the same."""
    mark = lambda i: F.substring(F.md5(F.concat_ws(":", F.lit(seed), row_id, i)), 1, 8)
    unit = lambda i: F.conv(mark(i), 16, 10).cast("long") % 2_000_001 / 1_000_000.0 - 1.0
    start = F.transform(x, lambda v, i: clamp(v + unit(i) * eps, 0.0, 1.0))
    return bim(x, y, scorer, eps, steps, step, start)


def deepfool(x: Column, y: Column, scorer: Linear, steps: int = STEPS, overshoot: float = OVERSHOOT) -> Column:
    """Smallest step to the decision boundary, repeated while clipping keeps the row on its side; a row that is
    already on the other side stays."""
    w = F.array(*(F.lit(v) for v in scorer.weights))
    norm = sum(v * v for v in scorer.weights) or 1.0

    def again(v: Column, _: Column) -> Column:
        f = F.aggregate(F.zip_with(v, w, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t) + (scorer.bias - scorer.tau())
        wrong = F.when(y == 1, f < 0).otherwise(f >= 0)
        moved = F.zip_with(v, w, lambda a, b: clamp(a - b * (f * (1.0 + overshoot) / norm), 0.0, 1.0))
        return F.when(wrong, v).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, again)


ATTACKS: dict[str, Callable] = {"fgsm": fgsm, "bim": bim, "pgd": pgd, "deepfool": deepfool}


def perturb(name: str, x: Column, y: Column, scorer: Linear, row_id: Column | None = None, **settings: float) -> Column:
    """By name; an unknown name, or eps for deepfool, raises."""
    if name not in ATTACKS:
        raise ValueError(f"unknown attack {name!r}; known: {sorted(ATTACKS)}")
    if name == "deepfool" and "eps" in settings:
        raise ValueError("deepfool has no eps")
    return pgd(x, y, scorer, row_id, **settings) if name == "pgd" else ATTACKS[name](x, y, scorer, **settings)


def select_attack_rows(df: DataFrame, y: str, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n attack rows at random; raises if there are fewer."""
    from tidegate.operators.sample import exactly

    return exactly(df.where(F.col(y) == 1), id_col, n, seed)
