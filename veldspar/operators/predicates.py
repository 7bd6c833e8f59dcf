"""Closed predicate algebra over document columns, compiled to two-valued Spark conditions.

A leaf on a null (or, for comparisons, NaN) is false, never unknown; so Not(Eq(x, 5)) includes rows
without x. Leaves at the top of a conjunction are emitted plain, so that Parquet can filter on them;
only below a Not are they wrapped.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PredicateError(ValueError):
    """The predicate doesn't fit the schema."""


@dataclass(frozen=True)
class Bound:
    value: Any
    inclusive: bool = True


@dataclass(frozen=True)
class Eq:
    column: str
    value: Any


@dataclass(frozen=True)
class In:
    column: str
    values: Sequence[Any]


@dataclass(frozen=True)
class Range:
    column: str
    lower: Bound | None = None
    upper: Bound | None = None


@dataclass(frozen=True)
class Exists:
    column: str


@dataclass(frozen=True)
class IsNull:
    column: str


@dataclass(frozen=True)
class And:
    parts: Sequence[Any] = ()


@dataclass(frozen=True)
class Or:
    parts: Sequence[Any] = ()


@dataclass(frozen=True)
class Not:
    part: Any


def not_eq(column: str, value: Any) -> Not:
    return Not(Eq(column, value))


def not_in(column: str, values: Sequence[Any]) -> Not:
    return Not(In(column, values))


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.FloatType, T.DoubleType)
REAL = (T.FloatType, T.DoubleType)


def _fits(kind: T.DataType, value: Any) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, int):
        return isinstance(kind, NUMERIC) and not isinstance(kind, REAL)
    if isinstance(value, float):
        return isinstance(kind, REAL)
    return isinstance(value, str) and isinstance(kind, T.StringType)


def validate(predicate: Any, schema: T.StructType) -> None:
    """Refuse unknown columns, values of another type (never coerced) and ranges over anything but numbers."""
    kinds = {f.name: f.dataType for f in schema.fields}
    stack = [predicate]
    while stack:
        p = stack.pop()
        if isinstance(p, And | Or):
            stack.extend(p.parts)
            continue
        if isinstance(p, Not):
            stack.append(p.part)
            continue
        if not isinstance(p, Eq | In | Range | Exists | IsNull):
            raise PredicateError(f"not a predicate: {p!r}")
        if p.column not in kinds:
            raise PredicateError(f"unknown column {p.column}")
        kind = kinds[p.column]
        values = [p.value] if isinstance(p, Eq) else list(p.values) if isinstance(p, In) else [b.value for b in (p.lower, p.upper) if b] if isinstance(p, Range) else []
        if isinstance(p, Range) and not isinstance(kind, NUMERIC):
            raise PredicateError(f"range over {p.column}, which is {kind.simpleString()}")
        for v in values:
            if not _fits(kind, v):
                raise PredicateError(f"{v!r} doesn't fit {p.column}, which is {kind.simpleString()}")


def _leaf(p: Any, kinds: dict[str, T.DataType]) -> Column:
    c = F.col(f"`{p.column}`")
    real = isinstance(kinds[p.column], REAL)
    nan = lambda v: isinstance(v, float) and v != v
    if isinstance(p, Eq):
        return F.lit(False) if nan(p.value) else c == F.lit(p.value)
    if isinstance(p, In):
        values = [v for v in p.values if not nan(v)]
        return c.isin(*values) if values else F.lit(False)
    if isinstance(p, Range):
        if any(b and nan(b.value) for b in (p.lower, p.upper)):
            return F.lit(False)
        parts = [c.isNotNull()]
        if p.lower:
            parts.append(c >= F.lit(p.lower.value) if p.lower.inclusive else c > F.lit(p.lower.value))
        if p.upper:
            parts.append(c <= F.lit(p.upper.value) if p.upper.inclusive else c < F.lit(p.upper.value))
        if real:
            parts.append(~F.isnan(c))
        return reduce(and_, parts)
    return c.isNotNull() if isinstance(p, Exists) else c.isNull()


def compile_predicate(predicate: Any, schema: T.StructType) -> Column:
    validate(predicate, schema)
    kinds = {f.name: f.dataType for f in schema.fields}

    def build(p: Any, exact: bool) -> Column:
        if isinstance(p, And):
            return reduce(and_, [build(x, exact) for x in p.parts], F.lit(True)) if p.parts else F.lit(True)
        if isinstance(p, Or):
            return reduce(or_, [build(x, exact) for x in p.parts]) if p.parts else F.lit(False)
        if isinstance(p, Not):
            return ~build(p.part, True)
        return F.coalesce(_leaf(p, kinds), F.lit(False)) if exact else _leaf(p, kinds)

    return build(predicate, False)


def where(df: DataFrame, predicate: Any = None, ts_range: tuple[int, int] | None = None, ts: str = "ts", eligible: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Rows that match the predicate, lie in the half-open range of ts, and whose key is in `eligible` (one column)."""
    if predicate is not None:
        df = df.where(compile_predicate(predicate, df.schema))
    if ts_range is not None:
        df = df.where((F.col(ts) >= F.lit(ts_range[0])) & (F.col(ts) < F.lit(ts_range[1])))
    if eligible is not None:
        ids = eligible.select(F.col(eligible.columns[0]).alias(key)).distinct()
        df = df.join(ids, key, "left_semi")
    return df
