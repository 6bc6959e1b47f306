"""Predicates: conjunctions of equality-shaped conditions, which an index can answer, and of any others, which it can't."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


def _is_zero(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and value == 0


def _equals(column: str, values: tuple, kind: str | None) -> Column:
    """column = value, or IN several.

    Parquet's statistics and dictionaries tell -0.0 from 0.0, so an equality with zero must not reach them: it is written as a
    range. kind is the column's type, if known; a string compared with a float column may be a zero too.
    """
    c, floats = F.col(column), kind in ("float", "double")
    if floats and any(isinstance(v, str) for v in values):
        c = c + F.lit(0.0).cast(kind)  # makes zeros alike, and keeps the scan from pushing the condition down
        return c == F.lit(values[0]) if len(values) == 1 else c.isin(list(values))
    zero = [v for v in values if _is_zero(v) and (floats or (isinstance(v, float) and kind is None))]
    others = [v for v in values if v not in zero] if zero else list(values)
    out = (c == F.lit(others[0]) if len(others) == 1 else c.isin(others)) if others else None
    if zero:
        near = c.between(F.lit(-0.0), F.lit(0.0))
        out = near if out is None else out | near
    return out


@dataclass(frozen=True)
class Eq:
    """column = value; null equals nothing."""

    column: str
    value: object

    def condition(self, kind: str | None = None) -> Column:
        return F.lit(False) if self.value is None else _equals(self.column, (self.value,), kind)


@dataclass(frozen=True)
class In:
    """column IN values: repeats count once, nulls match nothing, an empty list matches nothing."""

    column: str
    values: tuple

    def __init__(self, column: str, values):
        object.__setattr__(self, "column", column)
        object.__setattr__(self, "values", tuple(dict.fromkeys(v for v in values if v is not None)))

    def condition(self, kind: str | None = None) -> Column:
        return _equals(self.column, self.values, kind) if self.values else F.lit(False)


@dataclass(frozen=True)
class IsNull:
    column: str

    def condition(self, kind: str | None = None) -> Column:
        return F.col(self.column).isNull()


@dataclass(frozen=True)
class IsNotNull:
    column: str

    def condition(self, kind: str | None = None) -> Column:
        return F.col(self.column).isNotNull()


@dataclass(frozen=True)
class Residual:
    """Any other condition, as SQL or as a Column: ranges, <>, NOT IN, LIKE, OR. Only a scan answers it."""

    expression: str | Column

    def condition(self, kind: str | None = None) -> Column:
        return F.expr(self.expression) if isinstance(self.expression, str) else self.expression


Condition = Eq | In | IsNull | IsNotNull | Residual


@dataclass(frozen=True)
class And:
    """All of the conditions; none at all is true of every row. Conditions on one column intersect."""

    parts: tuple[Condition, ...] = field(default=())

    def condition(self, kinds: dict[str, str] | None = None) -> Column:
        """kinds: types of columns by name, as far as they are known."""
        out = F.lit(True)
        for p in self.parts:
            out = out & p.condition((kinds or {}).get(getattr(p, "column", "")))
        return out

    def indexable(self, keys: dict[str, str]) -> bool:
        """Whether an index over these keys can answer the whole."""
        return bool(self.parts) and all(not isinstance(p, Residual) and p.column in keys for p in self.parts)

    def pinned(self) -> dict[str, object]:
        """Columns of which the predicate fixes the value: by = or IS NULL, not by IN or IS NOT NULL."""
        return {p.column: p.value if isinstance(p, Eq) else None for p in self.parts if isinstance(p, (Eq, IsNull))}


def all_of(*parts: Condition) -> And:
    return And(tuple(parts))
