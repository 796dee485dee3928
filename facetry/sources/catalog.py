"""A catalog binds classes to DataFrames: parquet folders, tables or frames in memory."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shapes import InColumn, InVariants, Property, Shape
from .textindex import TextIndex

#: Which of some distinct pairs (a link table's columns) the table holds; None if that can't be told.
Among = Callable[[DataFrame], DataFrame | None]
#: A link table without some pairs (None: all of it).
Less = Callable[[DataFrame | None], DataFrame]

#: The column of a frame that holds the classes of its rows, their own first.
LINEAGE = "__lineage"


def columns(p: Property) -> tuple[str, ...]:
    """The columns of the holder's frame that a property is read from."""
    match p.storage:
        case InColumn(name):
            return (name,)
        case InVariants(names):
            return names
    return ()


class Source(Protocol):
    """Where classes come from: any store of tables that Spark reads."""

    def frame(self, shape: Shape) -> DataFrame:
        """The rows of a class, in the columns that its properties name."""

    def table(self, link: str) -> DataFrame:
        """The rows of a link table."""


class Catalog:
    """Frames by class and link tables by name; frames are made when they are first read and never cached here.

    Schemas of parquet tables are, as finding one costs a job: `schemas` holds them by path, and catalogs may share it.
    A table whose columns change needs a new one."""

    def __init__(self, spark: SparkSession, schemas: dict[str, StructType] | None = None):
        self.spark = spark
        self.schemas = {} if schemas is None else schemas
        self._classes: dict[str, tuple[Shape, Callable[[], DataFrame]]] = {}
        self._links: dict[str, Callable[[], DataFrame]] = {}
        self._among: dict[str, Among] = {}
        self._less: dict[str, Less] = {}
        self._indexes: dict[tuple[str, str], TextIndex] = {}

    def bind(self, shape: Shape, frame: DataFrame | Callable[[], DataFrame]) -> Catalog:
        """Binds a class to its frame; indexes of what it was bound to before are dropped."""
        self._classes[shape.name] = (shape, frame if callable(frame) else lambda: frame)
        self._indexes = {k: v for k, v in self._indexes.items() if k[0] != shape.name}
        return self

    def indexed(self, shape: Shape, name: str, index: TextIndex) -> Catalog:
        """Lets searches in a text property of a class go through an index of its column, made of the bound frame."""
        self._indexes[shape.name, name] = index
        return self

    def index(self, shape: Shape, name: str) -> TextIndex | None:
        """The index of a property, if it covers all rows of the class."""
        return self._indexes.get((shape.name, name)) if self.concrete(shape) == [shape] else None

    def link(self, name: str, frame: DataFrame | Callable[[], DataFrame], among: Among | None = None, less: Less | None = None) -> Catalog:
        """Binds a link table.  For one that is made of other tables and repeats no pair: `among`, how to look pairs up in those,
        and `less`, how to make it without some pairs."""
        self._links[name] = frame if callable(frame) else lambda: frame
        for known, own in ((self._among, among), (self._less, less)):
            known.pop(name, None)
            if own is not None:
                known[name] = own
        return self

    def among(self, name: str) -> Among:
        return self._among.get(name, lambda pairs: None)

    def less(self, name: str) -> Less | None:
        return self._less.get(name)

    def serve(self, source: Source, *shapes: Shape, links: tuple[str, ...] = ()) -> Catalog:
        """Binds classes and link tables to a source, which is asked for them when they are read."""
        for shape in shapes:
            self.bind(shape, lambda s=shape: source.frame(s))
        for name in links:
            self.link(name, lambda n=name: source.table(n))
        return self

    def parquet(self, folder: str, tables: Mapping[str, Shape]) -> Catalog:
        """Binds each class to `folder`/<table>.parquet; columns and filters reach the scan through the plans made of it."""
        for table, shape in tables.items():
            self.bind(shape, lambda t=table: self.read(f"{folder}/{t}.parquet"))
        return self

    def read(self, path: str) -> DataFrame:
        """A parquet table; its files are listed anew each time."""
        if path in self.schemas:
            return self.spark.read.schema(self.schemas[path]).parquet(path)
        found = self.spark.read.parquet(path)
        self.schemas[path] = found.schema
        return found

    def copy(self) -> Catalog:
        own = Catalog(self.spark, self.schemas)
        own._classes, own._links, own._indexes, own._among, own._less = dict(self._classes), dict(self._links), dict(self._indexes), dict(self._among), dict(self._less)
        return own

    def shapes(self) -> list[Shape]:
        return [s for s, _ in self._classes.values()]

    def frame(self, shape: Shape) -> DataFrame:
        """The rows stored for a class itself, without subclasses."""
        if shape.name not in self._classes:
            raise KeyError(f"no frame is bound to {shape.name}")
        return self._classes[shape.name][1]()

    def table(self, link: str) -> DataFrame:
        return self._links[link]()

    def links(self) -> dict[str, Callable[[], DataFrame]]:
        return dict(self._links)

    def concrete(self, shape: Shape) -> list[Shape]:
        """The bound classes that are a shape or descend from it."""
        return [s for s, _ in self._classes.values() if shape.name in s.lineage]

    def extent(self, shape: Shape) -> DataFrame:
        """All rows of a class, those of its subclasses included, with their lineage."""
        concrete = self.concrete(shape)
        frames = [self.frame(s).withColumn(LINEAGE, F.lit(list(s.lineage))) for s in concrete]
        if not frames:
            raise KeyError(f"no frame is bound to {shape.name} or a subclass")
        if concrete != [shape]:  # of subclasses, what they share
            own = [shape.key, *(c for p in shape.properties.values() for c in columns(p)), LINEAGE]
            frames = [f.select(*dict.fromkeys(c for c in own if c in f.columns)) for f in frames]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out
