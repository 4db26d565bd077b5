"""Formulas as data, rendered to Spark columns or evaluated on numpy arrays.

A formula is a tree over named values in spaces (``value("original", "rate")``). One tree therefore serves the plan
of a query and the inner loop of an Arrow-batched search, and the two cannot drift apart.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Mapping
from typing import Any

import numpy as np
from pyspark.sql import functions as F

from tidegate.functions.numeric import inverse_signed_log1p, signed_log1p


class Formula:
    __slots__ = ("op", "args")

    def __init__(self, op: str, *args: Any) -> None:
        self.op, self.args = op, args

    def __add__(self, other: Any) -> Formula:
        return Formula("+", self, formula(other))

    def __radd__(self, other: Any) -> Formula:
        return Formula("+", formula(other), self)

    def __sub__(self, other: Any) -> Formula:
        return Formula("-", self, formula(other))

    def __rsub__(self, other: Any) -> Formula:
        return Formula("-", formula(other), self)

    def __mul__(self, other: Any) -> Formula:
        return Formula("*", self, formula(other))

    def __rmul__(self, other: Any) -> Formula:
        return Formula("*", formula(other), self)

    def __truediv__(self, other: Any) -> Formula:
        return Formula("/", self, formula(other))

    def __gt__(self, other: Any) -> Formula:
        return Formula(">", self, formula(other))

    def __ge__(self, other: Any) -> Formula:
        return Formula(">=", self, formula(other))

    def same(self, other: Any) -> Formula:
        return Formula("==", self, formula(other))


def formula(x: Any) -> Formula:
    return x if isinstance(x, Formula) else Formula("const", float(x))


def value(space: str, name: str) -> Formula:
    return Formula("value", space, name)


def least(*of: Any) -> Formula:
    return Formula("least", *map(formula, of))


def greatest(*of: Any) -> Formula:
    return Formula("greatest", *map(formula, of))


def clamped(x: Any, low: Any, high: Any) -> Formula:
    return greatest(least(x, high), low)


def choose(condition: Formula, a: Any, b: Any) -> Formula:
    return Formula("choose", condition, formula(a), formula(b))


def apply(name: str, x: Any) -> Formula:
    """sqrt, abs, log (signed log1p) or exp (its inverse)."""
    return Formula(name, formula(x))


_SHARED: dict[str, Callable] = {
    "+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, ">": operator.gt, ">=": operator.ge, "==": operator.eq,
}


class Carrier:
    """What values are made of, and the functions on them."""

    def __init__(self, const: Callable, **functions: Callable) -> None:
        self.const, self.functions = const, _SHARED | functions

    def render(self, f: Formula, spaces: Mapping[str, Any], known: dict[int, Any] | None = None) -> Any:
        """Value of ``f``; a part that occurs twice is computed once per ``known``."""
        known = {} if known is None else known
        if id(f) not in known:
            if f.op == "const":
                known[id(f)] = self.const(f.args[0])
            elif f.op == "value":
                space, name = f.args
                known[id(f)] = spaces[space][name]
            else:
                known[id(f)] = self.functions[f.op](*(self.render(a, spaces, known) for a in f.args))
        return known[id(f)]

    def render_all(self, formulas: Mapping[str, Formula], **spaces: Any) -> dict[str, Any]:
        known: dict[int, Any] = {}
        return {name: self.render(f, spaces, known) for name, f in formulas.items()}


def _each(f: Callable) -> Callable:
    return lambda first, *rest: f(first, _each(f)(*rest)) if rest else first


COLUMNS = Carrier(
    F.lit, least=F.least, greatest=F.greatest, sqrt=F.sqrt, abs=F.abs, log=signed_log1p, exp=inverse_signed_log1p, choose=lambda c, a, b: F.when(c, a).otherwise(b)
)
ARRAYS = Carrier(
    float, least=_each(np.minimum), greatest=_each(np.maximum), sqrt=np.sqrt, abs=np.abs, choose=np.where,
    log=lambda x: np.sign(x) * np.log1p(np.abs(x)), exp=lambda y: np.sign(y) * np.expm1(np.abs(y)),
)
