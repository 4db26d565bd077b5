"""Numeric expressions: unit transforms, residuals, norms. All are built-in expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

INF = float("inf")


def finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite; never null itself."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(INF))


def all_finite(columns: Sequence[str]) -> Column:
    return reduce(lambda a, c: a & finite(F.col(c)), columns, F.lit(True))


def any_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def total(parts: Sequence[Column]) -> Column:
    """Sum in the order given (part of the result: floating point)."""
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def clamp(c: Column, low: Column | float, high: Column | float) -> Column:
    lift = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.least(F.greatest(c, lift(low)), lift(high))


def signed_log1p(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def inverse_signed_log1p(c: Column) -> Column:
    return F.signum(c) * F.expm1(F.abs(c))


def relative_error(actual: Column, expected: Column) -> Column:
    return F.abs(actual - expected) / (F.abs(expected) + 1e-9)


def logit(p: Column, tiny: float = 1e-12) -> Column:
    inside = clamp(p, tiny, 1.0 - tiny)
    return F.log(inside / (1.0 - inside))


def sigmoid(f: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-f))


def one_hot(y: Column) -> Column:
    return F.array(1 - y, y)


def percent(condition: Column) -> Column:
    """100 x the share of rows for which the condition holds."""
    return 100.0 * F.avg(condition.cast("double"))


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def norms(clean: Column, moved: Column) -> dict[str, Column]:
    """Largest, Euclidean and count norm of the difference of two vectors; a pair with a null vector has null norms."""
    delta = F.zip_with(moved.cast("array<double>"), clean.cast("array<double>"), lambda a, b: a - b)
    return {
        "linf": F.array_max(F.transform(delta, lambda d: F.abs(d))),
        "l2": F.sqrt(F.aggregate(delta, F.lit(0.0), lambda s, d: s + d * d)),
        "n_changed": F.size(F.filter(delta, lambda d: d != 0)),
    }


def md5_order(seed: int, key: Column) -> Column:
    """Text that orders rows at random, the same in every engine: md5 of 'seed:key'."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
