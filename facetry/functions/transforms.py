"""The closed set of transforms: thirteen scalar functions and five aggregates, with their domains."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..shapes import BOOLEAN, IRI, NUMERIC, TEMPORAL, TEXT, Dictionary, Embedded, Range, Reference, Scalar, ShapeError, date, decimal, integer, string, time
from .values import Value, tier


@dataclass(frozen=True)
class Transform:
    accepts: Callable[[Range], bool]
    result: Callable[[Range], Scalar]
    apply: Callable[[Range, Column], Column]


def _text(r: Range) -> bool:
    return isinstance(r, Dictionary) or (isinstance(r, Scalar) and r.tier == TEXT)


def _tier(k: int) -> Callable[[Range], bool]:
    return lambda r: isinstance(r, Scalar) and r.tier == k


def _same(r: Range) -> Scalar:
    return r if isinstance(r, Scalar) else string


def _absent(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _day_part(f: Callable[[Column], Column]) -> Callable[[Range, Column], Column]:
    """A part of a date; a time has none."""
    return lambda r, c: _absent("long") if r == time else f(c).cast("long")


def _clock_part(f: Callable[[Column], Column], at: int) -> Callable[[Range, Column], Column]:
    """A part of a time of day; a date has none."""
    return lambda r, c: _absent("long") if r == date else F.substring(c, at, 2).cast("long") if r == time else f(c).cast("long")


def _seconds(r: Range, c: Column) -> Column:
    """Seconds with their fraction."""
    if r == date:
        return _absent("double")
    return F.substring(c, 7, 20).cast("double") if r == time else F.extract(F.lit("SECOND"), c).cast("double")


def _integral(f: Callable[[Column], Column]) -> Callable[[Range, Column], Column]:
    return lambda _, c: f(c).cast("long")


SCALARS: dict[str, Transform] = {
    "length": Transform(_text, lambda _: integer, lambda _, c: F.length(c).cast("long")),
    "lower": Transform(_text, lambda _: string, lambda _, c: F.lower(c)),
    "upper": Transform(_text, lambda _: string, lambda _, c: F.upper(c)),
    "abs": Transform(_tier(NUMERIC), _same, lambda _, c: F.abs(c)),
    "floor": Transform(_tier(NUMERIC), lambda _: integer, _integral(F.floor)),
    "ceil": Transform(_tier(NUMERIC), lambda _: integer, _integral(F.ceil)),
    # ties go up, unlike the built-in's ties away from zero
    "round": Transform(_tier(NUMERIC), lambda _: integer, _integral(lambda c: F.floor(c + F.lit(0.5)))),
    "year": Transform(_tier(TEMPORAL), lambda _: integer, _day_part(F.year)),
    "month": Transform(_tier(TEMPORAL), lambda _: integer, _day_part(F.month)),
    "day": Transform(_tier(TEMPORAL), lambda _: integer, _day_part(F.dayofmonth)),
    "hours": Transform(_tier(TEMPORAL), lambda _: integer, _clock_part(F.hour, 1)),
    "minutes": Transform(_tier(TEMPORAL), lambda _: integer, _clock_part(F.minute, 4)),
    "seconds": Transform(_tier(TEMPORAL), lambda _: decimal, _seconds),
}


def _literals(r: Range) -> bool:
    return not isinstance(r, Reference | Embedded) and tier(r) in (BOOLEAN, NUMERIC, TEMPORAL, TEXT)


AGGREGATES: dict[str, Transform] = {
    "count": Transform(lambda _: True, lambda _: integer, lambda _, c: F.count(c)),
    "sum": Transform(_tier(NUMERIC), _same, lambda r, c: F.coalesce(F.sum(c), F.lit(0).cast("long" if r.spark.simpleString() in ("bigint", "tinyint", "int") else "double"))),
    "avg": Transform(_tier(NUMERIC), lambda _: decimal, lambda _, c: F.avg(c.cast("double"))),
    "min": Transform(_literals, _same, lambda _, c: F.min(c)),
    "max": Transform(_literals, _same, lambda _, c: F.max(c)),
}


def split_pipe(pipe: tuple[str, ...]) -> tuple[list[str], str | None, list[str]]:
    """(transforms before, the aggregate, transforms after), each in the order they are applied."""
    inner_first = list(reversed(pipe))
    for name in inner_first:
        if name not in SCALARS and name not in AGGREGATES:
            raise ShapeError(f"unknown transform {name!r}")
    found = [k for k, name in enumerate(inner_first) if name in AGGREGATES]
    if len(found) > 1:
        raise ShapeError(f"more than one aggregate in {':'.join(pipe)}")
    if not found:
        return inner_first, None, []
    return inner_first[: found[0]], inner_first[found[0]], inner_first[found[0] + 1 :]


def scalar(v: Value, names: list[str]) -> Value:
    """A value through scalar transforms; of a union the variants in the domain are kept."""
    for name in names:
        t = SCALARS[name]
        kept = [(r, c) for r, c in v.parts if t.accepts(r)]
        if not kept:
            raise ShapeError(f"{name} takes none of the types of its operand")
        v = Value(tuple((t.result(r), t.apply(r, c)) for r, c in kept), v.many)
        if len(v.parts) > 1 and len({r for r, _ in v.parts}) == 1:
            v = Value(((v.parts[0][0], F.coalesce(*(c for _, c in v.parts))),), v.many)
    return v


def domain(v: Value, name: str, marker: bool = False) -> Value | None:
    """The part of a value that an aggregate reduces; None if it is undefined on all of it, an error on references.

    `marker`: the path ends in `id` or `type`, on which all aggregates but count are undefined instead."""
    t = AGGREGATES[name]
    kept = [(r, c) for r, c in v.parts if t.accepts(r)]
    if kept:
        return v.only(kept)
    if marker:
        return None
    raise ShapeError(f"{name} takes none of the types of its operand")


def reduced(v: Value, name: str) -> tuple[Scalar, Column]:
    """The range of an aggregate over a value, and the aggregating column."""
    t = AGGREGATES[name]
    if name == "count":
        return integer, F.count(F.when(v.present, F.lit(1))) if len(v.parts) > 1 else t.apply(*v.parts[0])
    if len(v.parts) == 1:
        return t.result(v.parts[0][0]), t.apply(*v.parts[0])
    if name in ("sum", "avg"):
        both = F.coalesce(*(c.cast("double") for _, c in v.parts))
        return decimal, t.apply(decimal, both)
    return _same(v.parts[0][0]), t.apply(v.parts[0][0], v.column)


def partial(v: Value, name: str) -> tuple[Scalar, list[Column], Callable[[list[Column], Column], Column]]:
    """The range of an aggregate over a value, the aggregates that stand for a part of its rows, and what they come to
    when each row of a part counts as often as a weight says (a function of their columns and the weight)."""
    r, whole = reduced(v, name)
    if name == "count":
        return r, [whole], lambda p, w: F.coalesce(F.sum(p[0] * w), F.lit(0).cast("long"))
    if name in ("min", "max"):
        return r, [whole], lambda p, _: (F.min if name == "min" else F.max)(p[0])
    own = v.parts[0][1] if len(v.parts) == 1 else F.coalesce(*(c.cast("double") for _, c in v.parts))
    if name == "sum":
        zero = F.lit(0).cast("long" if r.spark.simpleString() in ("bigint", "tinyint", "int") else "double")
        return r, [F.sum(own)], lambda p, w: F.coalesce(F.sum(p[0] * w), zero)
    return r, [F.sum(own.cast("double")), F.count(own)], lambda p, w: F.sum(p[0] * w) / F.sum(p[1] * w)


def identifies(r: Range) -> bool:
    return tier(r) == IRI
