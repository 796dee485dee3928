"""Shapes: what classes, properties and values a query may speak of.

A shape is declared, never inferred.  Its properties have a range (a scalar type, localised text, a reference, an embedded
shape or a union of these), a cardinality and a storage that says where the values lie in the class's DataFrame.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

#: Order of the tiers of a mixed value: booleans, numbers, temporals, other text.  References are outside.
BOOLEAN, NUMERIC, TEMPORAL, TEXT, IRI = range(5)


class ShapeError(ValueError):
    """A model or a state that the shape does not admit."""


@dataclass(frozen=True)
class Scalar:
    """A literal type.  `limits` are the constraints that writes are checked against."""

    name: str
    tier: int
    spark: T.DataType
    limits: tuple[tuple[str, Any], ...] = ()

    def limited(self, **limits: Any) -> Scalar:
        return Scalar(self.name, self.tier, self.spark, (*self.limits, *limits.items()))


boolean = Scalar("boolean", BOOLEAN, T.BooleanType())
decimal = Scalar("decimal", NUMERIC, T.DoubleType())
number = Scalar("number", NUMERIC, T.DoubleType())
integer = Scalar("integer", NUMERIC, T.LongType())
byte = Scalar("byte", NUMERIC, T.ByteType())
string = Scalar("string", TEXT, T.StringType())
email = Scalar("email", TEXT, T.StringType())
phone = Scalar("phone", TEXT, T.StringType())
url = Scalar("url", TEXT, T.StringType())
#: Opaque text: neither a year nor a duration takes part in temporal comparison.
year = Scalar("year", TEXT, T.StringType())
duration = Scalar("duration", TEXT, T.StringType())
date = Scalar("date", TEMPORAL, T.DateType())
timestamp = Scalar("timestamp", TEMPORAL, T.TimestampType())
instant = Scalar("instant", TEMPORAL, T.TimestampType())
local = Scalar("local", TEMPORAL, T.TimestampNTZType())
#: HH:mm:ss text, whose order is the order of times.
time = Scalar("time", TEMPORAL, T.StringType())
iri = Scalar("iri", IRI, T.StringType())


@dataclass(frozen=True)
class Dictionary:
    """Localised text: a map from language tags to a text, or to several (`many`)."""

    many: bool = False
    limits: tuple[tuple[str, Any], ...] = ()


@dataclass(frozen=True)
class Reference:
    """A link to a resource that lives on its own."""

    target: Callable[[], Shape]
    captive: bool = False

    @property
    def shape(self) -> Shape:
        return self.target()


@dataclass(frozen=True)
class Embedded:
    """A nested record without an identity of its own."""

    shape: Shape


@dataclass(frozen=True)
class Union:
    """A value in exactly one of several variants; stored as a struct of fields v0, v1, ... of which one is set."""

    variants: tuple[Any, ...]


Range = Scalar | Dictionary | Reference | Embedded | Union


# --- storage


@dataclass(frozen=True)
class InColumn:
    """A column (or SQL expression) of the class's frame; an array if the property has many values."""

    name: str


@dataclass(frozen=True)
class InVariants:
    """One SQL expression for each variant of a union, null where the value is in another."""

    names: tuple[str, ...]


@dataclass(frozen=True)
class Reversed:
    """The target's rows whose column holds the owner's key."""

    column: str


@dataclass(frozen=True)
class Linked:
    """Rows of a link table: a column with the owner's key and one with the target's."""

    table: str
    owner: str
    item: str


Storage = InColumn | InVariants | Reversed | Linked


@dataclass(frozen=True)
class Property:
    range: Range
    storage: Storage
    least: int = 0
    most: int | None = 1
    foreign: bool = False
    hidden: bool = False

    @property
    def many(self) -> bool:
        return self.most != 1 and not isinstance(self.range, Dictionary)


def required(range_: Range, column: str | Storage, **more: Any) -> Property:
    return Property(range_, InColumn(column) if isinstance(column, str) else column, 1, 1, **more)


def optional(range_: Range, column: str | Storage, **more: Any) -> Property:
    return Property(range_, InColumn(column) if isinstance(column, str) else column, 0, 1, **more)


def multiple(range_: Range, column: str | Storage, least: int = 0, most: int | None = None, **more: Any) -> Property:
    return Property(range_, InColumn(column) if isinstance(column, str) else column, least, most, **more)


@dataclass(eq=False)
class Shape:
    """A class: its name, the column with its key (None: rows without identity), its superclasses and properties.

    `pattern` is the template of its ids on creation, e.g. "/products/{sku}"."""

    name: str
    properties: dict[str, Property] = field(default_factory=dict)
    key: str | None = "id"
    key_type: T.DataType = field(default_factory=T.StringType)
    parents: tuple[Shape, ...] = ()
    pattern: str | None = None

    def __post_init__(self) -> None:
        inherited: dict[str, Property] = {}
        for p in self.parents:
            inherited |= p.properties
        self.properties = inherited | self.properties

    @property
    def lineage(self) -> list[str]:
        out = [self.name]
        for p in self.parents:
            out += [n for n in p.lineage if n not in out]
        return out

    def property(self, name: str) -> Property:
        if name not in self.properties:
            raise ShapeError(f"{self.name} has no property {name!r}")
        return self.properties[name]


def spark_type(r: Range, many: bool = False) -> T.DataType:
    """The column type that holds a range."""
    match r:
        case Scalar():
            own = r.spark
        case Dictionary():
            own = T.MapType(T.StringType(), T.ArrayType(T.StringType()) if r.many else T.StringType())
        case Reference():
            own = r.shape.key_type
        case Embedded():
            own = schema(r.shape, embedded=True)
        case Union():
            own = T.StructType([T.StructField(f"v{i}", spark_type(v)) for i, v in enumerate(r.variants)])
    return T.ArrayType(own) if many else own


def schema(shape: Shape, embedded: bool = False) -> T.StructType:
    """The columns of a class's frame; what its properties are is kept in the fields' metadata."""
    fields = [] if embedded or not shape.key else [T.StructField(shape.key, shape.key_type, False, {"kind": "iri"})]
    for name, p in shape.properties.items():
        if isinstance(p.storage, InColumn) and re.fullmatch(r"\w+", p.storage.name):
            meta = {"property": name, "kind": type(p.range).__name__.lower(), "foreign": p.foreign, "hidden": p.hidden}
            fields.append(T.StructField(p.storage.name, spark_type(p.range, p.many), True, meta))
    return T.StructType(fields)
