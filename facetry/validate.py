"""Checks of entries and states against shapes."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Mapping
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .plans.grammar import parse, tag_ranges
from .shapes import BOOLEAN, NUMERIC, TEMPORAL, Dictionary, Embedded, InColumn, Property, Range, Reference, Scalar, Shape, ShapeError, Union, duration, time, year


class EntryError(ValueError):
    """A malformed id, or one that does not fit its place."""


def entry_of(entry: str) -> str:
    """An id: an absolute IRI or path, without query and fragment."""
    if not isinstance(entry, str) or not re.fullmatch(r"([A-Za-z][A-Za-z0-9+.-]*:|/)[^\s?#<>\"{}|\\^`]*", entry):
        raise EntryError(f"{entry!r} is not an absolute id without ? and #")
    return entry


def mint(entry: str, shape: Shape, state: Mapping[str, Any]) -> str:
    """The id of a resource to be created under an entry: given, made of the shape's pattern, or random.

    {name} in the pattern is the state's member of that name, one path segment; * at its end, or no pattern, is a UUID."""
    own = state.get("id")
    if own is not None:
        entry_of(own)
        if not own.startswith(entry.rstrip("/") + "/"):
            raise EntryError(f"{own} is not under {entry}")
        return own
    base = entry.rstrip("/")
    if not shape.pattern:
        return f"{base}/{uuid.uuid4()}"

    def fill(m: re.Match) -> str:
        value = state.get(m[1])
        if value is None:
            return str(uuid.uuid4())
        if not re.fullmatch(r"[^/?#\s]+", str(value)):
            raise EntryError(f"{m[1]} is not a single path segment: {value!r}")
        return str(value)

    path = re.sub(r"\{(\w+)\}", fill, shape.pattern)
    path = path[:-1] + str(uuid.uuid4()) if path.endswith("*") else path
    root = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/]+", base)
    return (root[0] if root else "") + path


def _limits(limits: tuple[tuple[str, Any], ...], value: Any, where: str) -> None:
    for name, bound in limits:
        ok = {
            "min_length": lambda: len(value) >= bound, "max_length": lambda: len(value) <= bound, "pattern": lambda: re.search(bound, value) is not None, "one_of": lambda: value in bound,
            "min_inclusive": lambda: value >= bound, "max_inclusive": lambda: value <= bound, "min_exclusive": lambda: value > bound, "max_exclusive": lambda: value < bound,
        }[name]
        if not ok():
            raise ShapeError(f"{where}: {value!r} breaks {name} {bound!r}")


def _temporal(r: Scalar, value: Any) -> Any:
    if r == time:
        if isinstance(value, str) and re.fullmatch(r"\d\d:\d\d:\d\d(\.\d+)?", value):
            return value
        return None
    try:
        if isinstance(r.spark, T.DateType):
            return value if type(value) is dt.date else dt.date.fromisoformat(value)
        out = value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(value)
    except (TypeError, ValueError):
        return None
    if r.name == "timestamp" and (out.tzinfo is None or out.utcoffset()):
        return None
    if r.name == "local":
        return out if out.tzinfo is None else None
    return out if out.tzinfo else out.replace(tzinfo=dt.UTC)


def value_of(r: Range, value: Any, where: str) -> Any:
    """A member's value as it is stored; an error if the range does not admit it."""
    match r:
        case Scalar():
            if r.tier == BOOLEAN:
                out = value if isinstance(value, bool) else None
            elif r.tier == NUMERIC:
                good = isinstance(value, int | float | Decimal) and not isinstance(value, bool) and (isinstance(r.spark, T.DoubleType) or value == int(value))
                out = (float(value) if isinstance(r.spark, T.DoubleType) else int(value)) if good else None
            elif r.tier == TEMPORAL:
                out = _temporal(r, value)
            else:
                out = value if isinstance(value, str) else None
                if out is not None and ((r.name == year.name and not re.fullmatch(r"-?\d{4,}", out)) or (r.name == duration.name and not re.fullmatch(r"-?P(?=.)(\d+Y)?(\d+M)?(\d+D)?(T(?=\d)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?", out))):
                    out = None
            if out is None:
                raise ShapeError(f"{where}: {value!r} is not a {r.name}")
            _limits(r.limits, out, where)
            return out
        case Dictionary():
            if not isinstance(value, Mapping) or any(v in (None, "", [], ()) for v in value.values()):
                raise ShapeError(f"{where}: localised text is a mapping of tags to texts that are not empty")
            many = {isinstance(v, list | tuple) for v in value.values()}
            if len(many) > 1 or (value and many != {r.many}):
                raise ShapeError(f"{where}: each tag has {'a list of texts' if r.many else 'one text'}")
            for tag, texts in value.items():
                for t in texts if r.many else [texts]:
                    if not isinstance(t, str) or not t:
                        raise ShapeError(f"{where}: {t!r} under {tag} is not a text")
                    _limits(r.limits, t, where)
            return {k: list(dict.fromkeys(v)) if r.many else v for k, v in value.items()}
        case Reference():
            own = value.get("id") if isinstance(value, Mapping) else value
            if own is None or isinstance(own, bool | list):
                raise ShapeError(f"{where}: {value!r} is not a reference")
            return own
        case Embedded():
            return members_of(r.shape, value, where)
        case Union():
            errors = []
            for k, v in enumerate(r.variants):
                try:
                    own = value_of(v, value, where)
                    return {f"v{j}": own if j == k else None for j in range(len(r.variants))}
                except ShapeError as e:
                    errors.append(str(e))
            raise ShapeError("; ".join(errors))
    raise ShapeError(f"{where}: unknown range")


def _empty(value: Any) -> bool:
    return value is None or (isinstance(value, Mapping | list | tuple) and not value)


def members_of(shape: Shape, state: Any, where: str = "") -> dict[str, Any]:
    """The stored values of a state's members by property; what is empty is left out."""
    if not isinstance(state, Mapping):
        raise ShapeError(f"{where or shape.name}: a state is a mapping, not {state!r}")
    unknown = [k for k in state if k not in shape.properties and k not in ("id", "type")]
    if unknown:
        raise ShapeError(f"{where or shape.name}: no property {unknown[0]!r}")
    out: dict[str, Any] = {}
    for name, p in shape.properties.items():
        at, value = f"{where}.{name}" if where else name, state.get(name)
        if p.foreign:
            if not _empty(value):
                raise ShapeError(f"{at} belongs to the other side")
            continue
        if _empty(value):
            if p.least:
                raise ShapeError(f"{at} is required")
            continue
        out[name] = _many(p, value, at) if p.many else value_of(p.range, value, at)
        if isinstance(p.range, Embedded) and not p.many and not out[name]:
            del out[name]
    return out


def _many(p: Property, value: Any, at: str) -> list[Any]:
    items = [value_of(p.range, v, at) for v in (value if isinstance(value, list | tuple) else [value]) if not _empty(v)]
    own: list[Any] = []
    for v in items:  # a collection is a set
        if v not in own:
            own.append(v)
    if len(own) < p.least or (p.most is not None and len(own) > p.most):
        raise ShapeError(f"{at} takes {p.least} to {p.most or 'any number of'} values")
    return own



# --- many states at once


def breaks(limits: tuple[tuple[str, Any], ...], value: Column) -> Column:
    out = F.lit(False)
    for name, bound in limits:
        out = out | {
            "min_length": lambda: F.length(value) < bound, "max_length": lambda: F.length(value) > bound, "pattern": lambda: ~value.rlike(bound), "one_of": lambda: ~value.isin(*bound),
            "min_inclusive": lambda: value < bound, "max_inclusive": lambda: value > bound, "min_exclusive": lambda: value <= bound, "max_exclusive": lambda: value >= bound,
        }[name]()
    return out


def violation(shape: Shape, rows: DataFrame) -> str | None:
    """What a frame of states breaks of a class's columns, required members, numbers of values and limits of scalars; None
    if nothing.  One pass over the frame."""
    wanted = {shape.key, *(p.storage.name for p in shape.properties.values() if isinstance(p.storage, InColumn) and not p.foreign)}
    if missing := sorted(wanted - set(rows.columns)):
        return f"{shape.name}: no column {missing[0]!r}"
    checks = {f"{shape.key} is missing or repeated": F.count(F.lit(1)) != F.count_distinct(shape.key)}
    for name, p in shape.properties.items():
        if not isinstance(p.storage, InColumn) or p.foreign:
            continue
        value = F.col(p.storage.name)
        n = F.coalesce(F.size(value), F.lit(0)) if p.many else value.isNotNull().cast("int")
        if p.least:
            checks[f"{name} takes at least {p.least}"] = F.bool_or(n < p.least)
        if p.many and p.most is not None:
            checks[f"{name} takes at most {p.most}"] = F.bool_or(n > p.most)
        limits = p.range.limits if isinstance(p.range, Scalar) else ()
        if limits:
            checks[f"{name} breaks {dict(limits)}"] = F.bool_or(F.coalesce(F.exists(value, lambda x, own=limits: breaks(own, x)) if p.many else breaks(limits, value), F.lit(False)))
    found = rows.agg(*(c.alias(f"c{k}") for k, c in enumerate(checks.values()))).first()
    return next((f"{shape.name}: {text}" for text, bad in zip(checks, found) if bad), None)


# --- answers


def conforms(shape: Shape, model: Mapping[str, Any], answer: Any, where: str = "") -> None:
    """Raises unless an answer holds only what a template asks for, in values that the shape admits; members may be absent."""
    if not isinstance(answer, Mapping):
        raise ShapeError(f"{where or shape.name}: {answer!r} is no record")
    for name, value in answer.items():
        at = f"{where}.{name}" if where else name
        if name in ("id", "type") and name not in shape.properties:
            if not isinstance(value, str):
                raise ShapeError(f"{at}: {value!r} is not a text")
        elif name not in model or name not in shape.properties:
            raise ShapeError(f"{at} was not asked for")
        else:
            _conforms(shape.property(name), model[name] or {}, value, at)


def _conforms(p: Property, model: Mapping[str, Any], value: Any, at: str) -> None:
    q = parse(model) if not isinstance(p.range, Dictionary) else None
    if q is not None and q.bindings:  # a projection: rows with its cells
        cells = {b.alias for b in q.bindings}
        for row in value if isinstance(value, list | tuple) else [value]:
            if not isinstance(row, Mapping) or not set(row) <= cells:
                raise ShapeError(f"{at}: {row!r} is no row of {sorted(cells)}")
        return
    if p.many != isinstance(value, list | tuple):
        raise ShapeError(f"{at}: {value!r} is {'no' if p.many else 'a'} list")
    for item in value if p.many else [value]:
        errors = []
        for r in p.range.variants if isinstance(p.range, Union) else (p.range,):
            for own in q.alternatives.values() if q is not None and q.alternatives else [model]:
                try:
                    _fits(r, own, item, at)
                    break
                except ShapeError as e:
                    errors.append(str(e))
            else:
                continue
            break
        else:
            raise ShapeError(errors[0])


def _fits(r: Range, model: Mapping[str, Any], value: Any, at: str) -> None:
    if isinstance(r, Dictionary):
        if tag_ranges(model):
            value_of(r, value, at)
        elif not (isinstance(value, list | tuple) and all(isinstance(t, str) for t in value) if r.many else isinstance(value, str)):
            raise ShapeError(f"{at}: {value!r} is no text")
    elif isinstance(r, Scalar):
        value_of(Scalar(r.name, r.tier, r.spark), value, at)  # limits are those of writes
    elif isinstance(value, Mapping):
        conforms(r.shape, parse(model).template, value, at)
    elif isinstance(r, Embedded) or parse(model).template or not isinstance(value, str):
        raise ShapeError(f"{at}: {value!r} is no record")
