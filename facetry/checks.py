"""Answers checked against their shapes, as frames: what a model asks for is compared with what its classes declare.

Every constraint on a member that the model shows, on records within and on members of collections, is one condition on
a row.  All of them are evaluated in one pass: as a report, a row for each constraint that is broken, or as a guard in
the plan itself, which fails with the first breach.  No row comes to the driver for it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .plans.analyze import MARKERS
from .plans.grammar import parse, tag_ranges
from .shapes import Dictionary, Embedded, Property, Range, Reference, Scalar, Shape
from .validate import breaks

#: (path, what is wrong, whether it is so in a row)
Constraint = tuple[str, str, Column]


def _kind(kind: T.DataType) -> str:
    """What values of a column type are, as far as a range tells them apart."""
    for own, name in ((T.BooleanType, "boolean"), (T.NumericType, "number"), (T.StringType, "text"), (T.DateType, "date"), (T.TimestampType | T.TimestampNTZType, "moment"), (T.ArrayType, "list"), (T.StructType, "record"), (T.MapType, "map")):
        if isinstance(kind, own):
            return name
    return kind.simpleString()


def constraints(shape: Shape, model: Mapping[str, Any], kind: T.StructType, access: Callable[[str], Column], where: str = "") -> Iterator[Constraint]:
    """The constraints on a record of a class under a template; access: its members by name."""
    for name, m in parse(dict(model)).template.items():
        if name in MARKERS and name not in shape.properties or name not in kind.fieldNames():
            continue
        yield from _member(shape.property(name), m or {}, kind[name].dataType, access(name), f"{where}.{name}" if where else name)


def _member(p: Property, model: Mapping[str, Any], kind: T.DataType, value: Column, path: str) -> Iterator[Constraint]:
    q = parse(dict(model)) if not isinstance(p.range, Dictionary) else None
    if q is not None and (q.bindings or q.alternatives):
        return
    if not p.many:
        if p.least:
            yield path, "is missing", value.isNull()
        yield from _value(p.range, model, kind, value, path)
        return
    if not isinstance(kind, T.ArrayType):
        yield path, "is no list", F.lit(True)
        return
    n = F.coalesce(F.size(value), F.lit(0))
    if q is None or not (q.criteria or q.offset or q.limit is not None):  # else what is shown is a choice
        if p.least:
            yield path, f"has fewer than {p.least}", n < p.least
        if p.most is not None:
            yield path, f"has more than {p.most}", n > p.most
    # what holds of each member holds of none that breaks it
    each = lambda x: list(_value(p.range, model, kind.elementType, x, f"{path}[]"))
    for k, (at, reason, _) in enumerate(each(F.lit(None))):
        yield at, reason, F.coalesce(F.exists(value, _nth(each, k)), F.lit(False))


def _nth(each: Callable[[Column], list[Constraint]], k: int) -> Callable[[Column], Column]:
    return lambda x: F.coalesce(each(x)[k][2], F.lit(False))


def _value(r: Range, model: Mapping[str, Any], kind: T.DataType, value: Column, path: str) -> Iterator[Constraint]:
    if isinstance(r, Scalar):
        if _kind(kind) != _kind(r.spark):
            yield path, f"is no {r.name}", value.isNotNull()
        elif r.limits:
            yield path, f"breaks {dict(r.limits)}", breaks(r.limits, value)
    elif isinstance(r, Dictionary):
        if not tag_ranges(model) and not r.many and r.limits:
            yield path, f"breaks {dict(r.limits)}", breaks(r.limits, value)
    elif isinstance(r, Reference | Embedded) and parse(dict(model)).template:
        if not isinstance(kind, T.StructType):
            yield path, "is no record", value.isNotNull()
            return
        for at, reason, bad in constraints(r.shape, model, kind, lambda n: value[n], path):
            yield at, reason, value.isNotNull() & bad


def _own(shape: Shape, model: Mapping[str, Any], df: DataFrame) -> list[Constraint]:
    return [(at, reason, F.coalesce(bad, F.lit(False))) for at, reason, bad in constraints(shape, model, df.schema, lambda n: F.col(n))]


def breaches(shape: Shape, model: Mapping[str, Any], df: DataFrame) -> DataFrame:
    """(path, reason, n_rows, example) of the constraints that rows of an answer break: how many do, and the smallest id
    of one (null if the model doesn't show ids).  One pass over the answer; an answer that fits gives no rows."""
    found = _own(shape, model, df)
    key = F.col("id").cast("string") if "id" in df.columns else F.lit(None).cast("string")
    if not found:
        return df.sparkSession.createDataFrame([], "path string, reason string, n_rows long, example string")
    sums = df.agg(*(F.struct(F.lit(at).alias("path"), F.lit(reason).alias("reason"), F.count_if(bad).alias("n_rows"), F.min(F.when(bad, key)).alias("example")).alias(f"c{k}") for k, (at, reason, bad) in enumerate(found)))
    return sums.select(F.inline(F.array(*(f"c{k}" for k in range(len(found)))))).where("n_rows > 0")


def guarded(shape: Shape, model: Mapping[str, Any], df: DataFrame) -> DataFrame:
    """The answer, which fails when a row that breaks its shape is read, and says how."""
    for at, reason, bad in _own(shape, model, df):
        df = df.where(F.assert_true(~bad, F.lit(f"{shape.name}: {at} {reason}")).isNull())
    return df
