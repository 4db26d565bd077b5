"""Fit on training rows, apply anywhere: signed log1p on some columns, then min-max to [0, 1]. No pickles: JSON."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tidegate.functions.numeric import clamp, inverse_signed_log1p, signed_log1p


@dataclass(frozen=True)
class Scaling:
    names: list[str]
    data_min: list[float]
    data_range: list[float]
    log1p: list[str] = field(default_factory=list)

    @classmethod
    def fit(cls, train: DataFrame, names: Sequence[str], log1p: Sequence[str] = ()) -> Scaling:
        """One aggregation; one row comes back."""
        y = {c: signed_log1p(F.col(c)) if c in log1p else F.col(c) for c in names}
        row = train.agg(*(f(y[c]).alias(f"{n}_{i}") for i, c in enumerate(names) for n, f in (("lo", F.min), ("hi", F.max)))).first()
        low = [row[f"lo_{i}"] for i in range(len(names))]
        if any(v is None for v in low):
            raise ValueError("no training row to fit the scaling on")
        return cls(list(names), low, [row[f"hi_{i}"] - v for i, v in enumerate(low)], [c for c in names if c in log1p])

    @classmethod
    def from_dict(cls, d: dict) -> Scaling:
        """Accepts the spellings minmax_min / minmax_range and data_min / data_range."""
        pick = lambda end: d.get(f"data_{end}", d.get(f"minmax_{end}"))
        names = d.get("names") or d["feature_names"]
        logs = d.get("log1p") if "log1p" in d else [names[i] for i in d.get("log1p_indices", [])]
        return cls(list(names), list(pick("min")), list(pick("range")), list(logs or []))

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    def _of(self, name: str) -> tuple[float, float, bool]:
        i = self.names.index(name)
        return self.data_min[i], self.data_range[i], name in self.log1p

    def scaled(self, name: str, raw: Column) -> Column:
        """Not clipped; a column without range is 0."""
        low, span, log = self._of(name)
        return ((signed_log1p(raw) if log else raw) - F.lit(low)) / F.lit(span) if span else raw * 0.0

    def raw(self, name: str, scaled: Column) -> Column:
        low, span, log = self._of(name)
        y = scaled * F.lit(span) + F.lit(low)
        return inverse_signed_log1p(y) if log else y

    def transform(self, df: DataFrame, as_float: bool = True) -> DataFrame:
        """Columns clipped to [0, 1], stored at model precision."""
        out = {c: clamp(self.scaled(c, F.col(c)), 0.0, 1.0) for c in self.names}
        return df.withColumns({c: v.cast("float") if as_float else v for c, v in out.items()})

    def out_of_range(self, df: DataFrame) -> DataFrame:
        """Per column the cells outside [0, 1] before clipping."""
        counts = [F.count_if((self.scaled(c, F.col(c)) < 0) | (self.scaled(c, F.col(c)) > 1)).alias(c) for c in self.names]
        rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_outside")) for c in self.names))
        return df.agg(*counts).select(F.inline(rows))

    def vector(self) -> Column:
        """All scaled columns, clipped, as one array."""
        return F.array(*(clamp(self.scaled(c, F.col(c)), 0.0, 1.0) for c in self.names))
