"""Typed values: a column for each variant that a value may be in."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shapes import BOOLEAN, IRI, NUMERIC, TEMPORAL, TEXT, Dictionary, Embedded, Range, Reference, Scalar, Union, date, time


def tier(r: Range) -> int:
    match r:
        case Scalar():
            return r.tier
        case Dictionary():
            return TEXT
        case _:
            return IRI


def variants(r: Range) -> tuple[Range, ...]:
    return r.variants if isinstance(r, Union) else (r,)


@dataclass(frozen=True)
class Value:
    """What a path resolves to in a row: for each variant a range and a column that is null where another holds.

    Localised text is read through `maps`, its raw tag maps; its own column is the coalesced label."""

    parts: tuple[tuple[Range, Column], ...]
    many: bool = False
    maps: tuple[Column | None, ...] = ()

    @property
    def tiers(self) -> set[int]:
        return {tier(r) for r, _ in self.parts}

    @property
    def present(self) -> Column:
        out = self.parts[0][1].isNotNull()
        for _, c in self.parts[1:]:
            out = out | c.isNotNull()
        return out

    def of(self, *tiers: int) -> list[tuple[Range, Column]]:
        return [(r, c) for r, c in self.parts if tier(r) in tiers]

    def only(self, parts: list[tuple[Range, Column]]) -> Value:
        return replace(self, parts=tuple(parts), maps=())

    @property
    def column(self) -> Column:
        """The value as one column: plain if all variants have one type, else tagged."""
        if len(self.parts) == 1:
            return self.parts[0][1]
        kinds = {r.spark.simpleString() if isinstance(r, Scalar) else "string" if isinstance(r, Dictionary) else type(r).__name__ for r, _ in self.parts}
        if len(kinds) == 1:
            return F.coalesce(*(c for _, c in self.parts))
        return tagged(self)

    @property
    def order(self) -> list[Column]:
        """Columns to sort by: the tier first where there are several."""
        if len(self.parts) == 1:
            return [self.parts[0][1]]
        if len(self.tiers) == 1 and len({type(r.spark) for r, _ in self.parts if isinstance(r, Scalar)}) <= 1:
            return [F.coalesce(*(c for _, c in self.parts))]
        return [tagged(self)]


def tagged(v: Value) -> Column:
    """tier, b, n, t, s, ref: a struct that sorts and groups by tier and then by value; null where nothing is held."""
    fields: dict[str, list[Column]] = {k: [] for k in ("b", "n", "t", "s", "ref")}
    number: list[tuple[Column, int]] = []
    for r, c in v.parts:
        k = tier(r)
        number.append((c, k))
        if k == TEMPORAL and isinstance(r, Scalar) and isinstance(r.spark, T.StringType):
            fields["s"].append(c)
        else:
            kind = {BOOLEAN: ("b", "boolean"), NUMERIC: ("n", "double"), TEMPORAL: ("t", "timestamp"), TEXT: ("s", "string"), IRI: ("ref", "string")}[k]
            fields[kind[0]].append(c.cast(kind[1]) if not isinstance(r, Embedded) else F.to_json(c))
    types = {"b": "boolean", "n": "double", "t": "timestamp", "s": "string", "ref": "string"}
    which = F.when(number[0][0].isNotNull(), number[0][1])
    for c, k in number[1:]:
        which = which.when(c.isNotNull(), k)
    own = F.struct(which.alias("tier"), *((F.coalesce(*cs) if cs else F.lit(None).cast(types[n])).alias(n) for n, cs in fields.items()))
    return F.when(v.present, own)


def tier_of(operand: Any) -> set[int]:
    """The tiers that an operand can be compared in."""
    if isinstance(operand, bool):
        return {BOOLEAN}
    if isinstance(operand, int | float | Decimal):
        return {NUMERIC}
    if isinstance(operand, dt.date | dt.datetime):
        return {TEMPORAL}
    if isinstance(operand, str):
        return {TEMPORAL, TEXT}
    return set()


def moment(r: Range, operand: Any) -> Any:
    """An operand as a date or date-time of a temporal range; None if it is none."""
    if isinstance(operand, str):
        try:
            return dt.date.fromisoformat(operand) if r == date else dt.datetime.fromisoformat(operand)
        except ValueError:
            return None
    return None if r == date and isinstance(operand, dt.datetime) else operand


def literal(r: Range, operand: Any) -> Column | None:
    """An operand as a literal of a range; None if it is of another type."""
    k = tier(r)
    if k == IRI:
        return None if isinstance(operand, bool | dict | list) or operand is None else F.lit(operand)
    if k not in tier_of(operand):
        return None
    if k == TEMPORAL:
        if r == time:
            return F.lit(operand) if isinstance(operand, str) else None
        own = moment(r, operand)
        return None if own is None else F.lit(own.isoformat()).cast(r.spark)
    return F.lit(float(operand) if isinstance(operand, Decimal) else operand)


def matches(v: Value, option: Any) -> Column:
    """Whether a value is an option; another type is no match (false or null) and never an error."""
    if option is None:
        return ~v.present
    if isinstance(option, dict):
        return _tagged_text(v, option)
    found = F.lit(False)
    for r, c in v.parts:
        own = literal(r, option)
        if own is not None and not isinstance(r, Embedded):
            found = found | (c == own)
    return found


def _tagged_text(v: Value, option: dict[str, Any]) -> Column:
    """Whether the raw tag maps hold one of the texts under its tag, whatever the locale."""
    found = F.lit(False)
    for (r, _), m in zip(v.parts, v.maps or (None,) * len(v.parts)):
        if not isinstance(r, Dictionary) or m is None:
            continue
        for tag, texts in option.items():
            for text in texts if isinstance(texts, list | tuple) else [texts]:
                at = m[tag]
                found = found | F.coalesce(F.array_contains(at, text) if r.many else at == text, F.lit(False))
    return found


def reference(r: Range) -> bool:
    return isinstance(r, Reference | Embedded)
