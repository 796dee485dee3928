"""Rows of a collection with the values that paths lead to.

Paths become joins, one for each edge of the trie: criteria that share a prefix share its join and so speak of the same
value, and each multi-valued step multiplies the rows.  Columns of a joined class get a prefix of their own, and only
those that are used survive Catalyst's pruning down to the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import label
from ..functions.values import Value, variants
from ..plans.analyze import MARKERS, joined, property_of
from ..shapes import Dictionary, Embedded, InColumn, InVariants, Linked, Property, Range, Reference, Reversed, Shape, ShapeError, Union, iri
from ..sources.catalog import LINEAGE, Catalog

Access = Callable[[str], Column]


@dataclass
class Node:
    """What a path resolves to: its value, and for each shape of it how to reach that shape's columns."""

    range: Range
    value: Value
    access: list[tuple[Shape, Access | None, Column]]
    #: The key of the resource that holds the value.
    owner: Column | None = None


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*(prefix + c for c in df.columns))


class Rows:
    """A frame with the nodes that have been joined to it so far."""

    def __init__(self, catalog: Catalog, df: DataFrame, root: Node, locale: Sequence[str] | None = None, required: set[tuple[str, ...]] = frozenset()):
        self.catalog, self.df, self.locale, self.required = catalog, df, locale, required
        self.nodes: dict[tuple[str, ...], Node] = {(): root}
        self.fanned = False
        self._count = 0

    @classmethod
    def over(cls, catalog: Catalog, df: DataFrame, shape: Shape, **more) -> Rows:
        """Over a class's frame (columns as they are); they get the root's prefix."""
        return cls(catalog, prefixed(df, "r_"), root_node(shape, lambda c: F.col(f"r_{c}")), **more)

    def _name(self) -> str:
        self._count += 1
        return f"n{self._count}_"

    def node(self, path: tuple[str, ...]) -> Node:
        if path not in self.nodes:
            self.nodes[path] = self._step(self.node(path[:-1]), path)
        return self.nodes[path]

    def _reach(self, node: Node, k: int, path: tuple[str, ...]) -> Access:
        """Columns of the k-th shape that a node may be, joined when first asked for."""
        shape, access, key = node.access[k]
        if access is None:
            p = self._name()
            target = prefixed(self.catalog.extent(shape), p)
            how = "inner" if path in self.required and len(node.access) == 1 else "left"
            self.df = self.df.join(target, key == F.col(p + shape.key), how)
            access = lambda c: F.col(p + c)
            node.access[k] = (shape, access, key)
        return access

    def _step(self, at: Node, path: tuple[str, ...]) -> Node:
        name = path[-1]
        if name in MARKERS and not any(name in s.properties for s, _, _ in at.access):
            return self._marker(at, path)
        property_of(at.range, name)
        found = []
        for k, (shape, _, key) in enumerate(at.access):
            if name in shape.properties:
                prop = shape.properties[name]
                # a foreign edge starts from the key and needs none of the holder's columns
                access = None if isinstance(prop.storage, Reversed | Linked) else self._reach(at, k, path[:-1])
                found.append(self._stored(prop, access, key, path))
        if len(found) == 1:
            return found[0]
        parts, maps = [], []
        for n in found:
            parts += n.value.parts
            maps += n.value.maps or (None,) * len(n.value.parts)
        return Node(joined([n.range for n in found]), Value(tuple(parts), any(n.value.many for n in found), tuple(maps)), [a for n in found for a in n.access], F.coalesce(*(n.owner for n in found if n.owner is not None)))

    def _marker(self, at: Node, path: tuple[str, ...]) -> Node:
        if path[-1] == "id":
            keys = [key for _, _, key in at.access]
            return Node(iri, Value(((iri, F.coalesce(*keys) if len(keys) > 1 else keys[0]),), at.value.many), [], None)
        parts = F.coalesce(*(self._reach(at, k, path[:-1])(LINEAGE) for k in range(len(at.access))))
        return Node(iri, Value(((iri, parts),), at.value.many), [], None)

    def _stored(self, prop: Property, access: Access | None, owner: Column, path: tuple[str, ...]) -> Node:
        how = "inner" if path in self.required else "left"
        match prop.storage:
            case Reversed(column):
                shape, p = prop.range.shape, self._name()
                self.df = self.df.join(prefixed(self.catalog.extent(shape), p), owner == F.col(p + column), how)
                self.fanned = self.fanned or prop.many
                return Node(prop.range, Value(((prop.range, F.col(p + shape.key)),), prop.many), [(shape, lambda c: F.col(p + c), F.col(p + shape.key))], owner) if shape.key else self._rows_node(prop, shape, p, owner)
            case Linked(table, own, item):
                p = self._name()
                self.df = self.df.join(prefixed(self.catalog.table(table).select(own, item), p), owner == F.col(p + own), how)
                self.fanned = True
                own = F.col(p + item)
                return self._held(prop.range, [own[f"v{i}"] for i in range(len(prop.range.variants))] if isinstance(prop.range, Union) else [own], True, owner)
            case InVariants(names):
                return self._held(prop.range, [access(n) for n in names], False, owner)
            case InColumn(column):
                own = access(column)
                if isinstance(prop.range, Dictionary):
                    return self._text(prop.range, own, owner, path)
                if prop.many:
                    p = self._name() + "item"
                    self.df = self.df.withColumn(p, F.explode(own) if how == "inner" else F.explode_outer(own))
                    self.fanned, own = True, F.col(p)
                cols = [own[f"v{i}"] for i in range(len(prop.range.variants))] if isinstance(prop.range, Union) else [own]
                return self._held(prop.range, cols, prop.many, owner)
        raise ShapeError(f"unknown storage {prop.storage!r}")

    def _rows_node(self, prop: Property, shape: Shape, p: str, owner: Column) -> Node:
        """Rows without identity: present where their link to the owner is."""
        here = F.col(p + prop.storage.column)
        return Node(prop.range, Value(((prop.range, here),), True), [(shape, lambda c: F.col(p + c), here)], owner)

    def _text(self, r: Dictionary, tags: Column, owner: Column, path: tuple[str, ...]) -> Node:
        own = label(tags, self.locale, r.many)
        if r.many:
            p = self._name() + "text"
            self.df = self.df.withColumn(p, F.explode_outer(own))
            self.fanned, own = True, F.col(p)
        return Node(r, Value(((r, own),), r.many, (tags,)), [], owner)

    def _held(self, r: Range, cols: list[Column], many: bool, owner: Column) -> Node:
        parts, maps, access = [], [], []
        for v, c in zip(variants(r), cols):
            if isinstance(v, Dictionary):
                parts.append((v, label(c, self.locale, v.many)))
                maps.append(c)
                continue
            if isinstance(v, Reference):
                access.append((v.shape, None, c))
            elif isinstance(v, Embedded):
                access.append((v.shape, lambda n, c=c: c[n], c))
            parts.append((v, c))
            maps.append(None)
        return Node(r, Value(tuple(parts), many, tuple(maps)), access, owner)


def root_node(shape: Shape, access: Access, range_: Range | None = None) -> Node:
    key = access(shape.key) if shape.key else F.lit(1)
    r = range_ or Reference(lambda: shape)
    return Node(r, Value(((r, key),)), [(shape, access, key)], None)
