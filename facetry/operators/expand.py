"""Retrieval: the columns that templates, cells and nested collections ask for.

Content is joined after a collection has been filtered, ordered and sliced.  Each nested collection is compiled for all
owners at once and gathered into one array per owner before it is joined, so several of them add up and never multiply.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import in_ranges, label
from ..functions.values import Value, variants
from ..plans.analyze import MARKERS
from ..plans.grammar import Query, parse, tag_ranges
from ..shapes import Dictionary, Embedded, InColumn, InVariants, Linked, Property, Range, Reference, Reversed, Shape, ShapeError, Union
from ..sources.catalog import Catalog
from .rows import Access, Node, prefixed, root_node
from .select import OWNER, RANK, Result, Scope, Select, pick, window


class Expander:
    """Adds columns to a frame; names of its own never clash, as it counts them."""

    def __init__(self, catalog: Catalog, df: DataFrame, scope: Scope):
        self.catalog, self.df, self.scope = catalog, df, scope
        #: The frame without the collections joined to it: what owners of further collections are read from.
        self.bare = df
        self._count = 0

    def name(self, kind: str) -> str:
        self._count += 1
        return f"__{kind}{self._count}"

    # --- values

    def cell(self, r: Range, column: Column, model: dict[str, Any], held: Column | None = None) -> Column:
        """A single value under a model; `column` holds it, or the key of the resource that does."""
        if isinstance(r, Dictionary):
            ranges = tag_ranges(model)
            return in_ranges(held if held is not None else column, ranges) if ranges else column
        q = parse(model)
        if isinstance(r, Union):
            raise ShapeError("a union is expanded by its variants")
        if q.plain or not q.template:
            if q.bindings:
                raise ShapeError("a single value has no projection")
            return column
        if isinstance(r, Embedded):
            return self.embedded(r.shape, column, q)
        if isinstance(r, Reference):
            p = self.name("t")
            target = prefixed(self.catalog.extent(r.shape), p)
            on = column == F.col(p + r.shape.key)
            self.df, self.bare = self.df.join(target, on, "left"), self.bare.join(target, on, "left")
            here = F.col(p + r.shape.key)
            return F.when(here.isNotNull(), self.record(r.shape, lambda c: F.col(p + c), here, q))
        raise ShapeError(f"a {r.name} has no members")

    def embedded(self, shape: Shape, column: Column, q: Query) -> Column:
        return F.when(column.isNotNull(), self.record(shape, lambda c: column[c], column, q))

    def record(self, shape: Shape, access: Access, key: Column, q: Query) -> Column:
        return F.struct(*(c.alias(n) for n, c in self.members(shape, access, key, q)))

    def members(self, shape: Shape, access: Access, key: Column, q: Query) -> list[tuple[str, Column]]:
        out = []
        for name, model in q.template.items():
            if name in MARKERS and name not in shape.properties:
                out.append((name, key if name == "id" else F.lit(shape.name)))
            else:
                out.append((name, self.property(shape.property(name), access, key, model)))
        return out

    def property(self, p: Property, access: Access, key: Column, model: dict[str, Any]) -> Column:
        if p.many and isinstance(p.range, Embedded) and isinstance(p.storage, InColumn) and self._simple(model):
            q, own, held = parse(model), p.range.shape, access(p.storage.name)
            if self.scope.limit:
                held = F.slice(held, 1, self.scope.limit)
            return F.transform(held, lambda x: self.record(own, lambda c: x[c], x, q)) if q.template else held
        if p.many:
            return self.collection(p, access, key, model)
        match p.storage:
            case InVariants(names):
                return self.union(p.range, [access(n) for n in names], model)
            case InColumn(column) if isinstance(p.range, Union):
                return self.union(p.range, [access(column)[f"v{k}"] for k in range(len(p.range.variants))], model)
            case InColumn(column) if isinstance(p.range, Dictionary):
                return self.cell(p.range, label(access(column), self.scope.locale, p.range.many), model, access(column))
            case InColumn(column):
                return self.cell(p.range, access(column), model)
            case Reversed() | Linked():
                return F.get(self.collection(p, access, key, model), 0)
        raise ShapeError(f"unknown storage {p.storage!r}")

    def _simple(self, model: dict[str, Any]) -> bool:
        """Whether a nested record can be built in place: no criteria and no collections of other rows."""
        q = parse(model)
        return not (q.criteria or q.offset or q.limit is not None or q.bindings or q.alternatives) and all(self._simple(m) for m in q.template.values() if isinstance(m, dict))

    def union(self, r: Range, columns: list[Column], model: dict[str, Any]) -> Column:
        """A value in one of several variants: a struct with a field for each requested one, null where none holds.

        Without alternatives all literals and bare references are asked for."""
        if not isinstance(r, Union):
            return self.cell(r, columns[0], model)
        q = parse(model)
        chosen = pick(r, q.alternatives) if q.alternatives else pick(r, {0: model}) if q.template else {k: {} for k, v in enumerate(r.variants) if not isinstance(v, Embedded)}
        fields, present = [], F.lit(False)
        for k, own in sorted(chosen.items()):
            v, c = r.variants[k], columns[k]
            value = self.cell(v, label(c, self.scope.locale, v.many), own, c) if isinstance(v, Dictionary) else self.cell(v, c, own)
            fields.append(value.alias(f"v{k}"))
            present = present | value.isNotNull()
        return F.when(present, F.struct(*fields))

    # --- collections

    def collection(self, p: Property, access: Access, key: Column, model: dict[str, Any]) -> Column:
        """The array of a collection's members (null if it has none), of all owners in one plan."""
        own, o = self.name("c"), self.name("o")
        base, root = members_of(self.catalog, p, self.bare, access, key)
        found = gather(self.catalog, base, root, model, self.scope).select(F.col(OWNER).alias(o), F.col("items").alias(own))
        self.df = self.df.join(found, key == F.col(o), "left")
        return F.col(own)


def members_of(catalog: Catalog, p: Property, df: DataFrame, access: Access, key: Column) -> tuple[DataFrame, Node]:
    """The members of a property for all owners of a frame, with OWNER."""
    match p.storage:
        case Reversed(column):
            shape = p.range.shape
            owners = df.select(key.alias(OWNER))
            rows = prefixed(catalog.extent(shape), "r_")
            base = rows.withColumn(OWNER, F.col("r_" + column)).join(owners, OWNER, "left_semi")
            return base, root_node(shape, lambda c: F.col(f"r_{c}"), p.range)
        case Linked(table, own, item):
            owners = df.select(key.alias(OWNER))
            links = catalog.table(table).select(F.col(own).alias(OWNER), F.col(item).alias("r___item")).join(owners, OWNER, "left_semi").distinct()
            return _items(catalog, links, p.range)
        case InColumn(column):
            values = df.select(key.alias(OWNER), F.explode(F.array_distinct(access(column)) if not isinstance(p.range, Embedded) else access(column)).alias("r___item"))
            return _items(catalog, values, p.range)
    raise ShapeError(f"{p.storage!r} holds no collection")


def _items(catalog: Catalog, df: DataFrame, r: Range) -> tuple[DataFrame, Node]:
    item = F.col("r___item")
    if isinstance(r, Reference):
        rows = prefixed(catalog.extent(r.shape), "r_")
        return df.join(rows, item == F.col("r_" + r.shape.key)), root_node(r.shape, lambda c: F.col(f"r_{c}"), r)
    cols = [item[f"v{k}"] for k in range(len(r.variants))] if isinstance(r, Union) else [item]
    parts, access = [], []
    for v, c in zip(variants(r), cols):
        parts.append((v, c))
        if isinstance(v, Embedded):
            access.append((v.shape, lambda n, c=c: c[n], c))
        elif isinstance(v, Reference):
            access.append((v.shape, None, c))
    return df, Node(r, Value(tuple(parts)), access)


def items_of(catalog: Catalog, base: DataFrame, root: Node, model: dict[str, Any], scope: Scope, flat: bool = False) -> tuple[DataFrame, Column, list[str]]:
    """The members of all owners' collections under a model, a row each: the frame with OWNER, the item, and the names of the
    columns whose values order the members of an owner."""
    s = Select(catalog, base, root, model, scope, owned=True, nested=True)
    result = s.compile()
    df = window(result, s.plan, True, flat)
    by = [RANK]
    if RANK not in df.columns:
        by = [f"__tie{k}" for k in range(len(result.tie))]
        df = df.withColumns(dict(zip(by, result.tie)))
    df, cells = contents(catalog, df, result, s, scope)
    item = F.struct(*(c.alias(n) for n, c in cells)) if not (len(cells) == 1 and cells[0][0] == "") else cells[0][1]
    return df, item, by


def gather(catalog: Catalog, base: DataFrame, root: Node, model: dict[str, Any], scope: Scope) -> DataFrame:
    """(OWNER, items): each owner's collection under a model as one array, ordered and sliced on its own.

    A collection becomes one value, so a limit in the model, or a cap of the request, bounds its size."""
    df, item, by = items_of(catalog, base, root, model, scope)

    order = "0"
    for n in reversed(by):
        order = f"CASE WHEN a.{n} IS NULL AND b.{n} IS NULL THEN {order} WHEN a.{n} IS NULL OR a.{n} < b.{n} THEN -1 WHEN b.{n} IS NULL OR a.{n} > b.{n} THEN 1 ELSE {order} END"
    rows = df.select(OWNER, F.struct(*by, item.alias("item")).alias("x"))
    return rows.groupBy(OWNER).agg(F.expr(f"transform(array_sort(collect_list(x), (a, b) -> {order}), x -> x.item)").alias("items"))


def contents(catalog: Catalog, df: DataFrame, result: Result, s: Select, scope: Scope) -> tuple[DataFrame, list[tuple[str, Column]]]:
    """The columns of a windowed collection: its cells, its members' template, or the bare members (named "")."""
    e = Expander(catalog, df, scope)
    q = s.plan.query
    if q.bindings:
        out = []
        for alias, column, node, model in result.cells:
            if node is None:
                out.append((alias, column))
            elif isinstance(node.range, Union):
                out.append((alias, e.union(node.range, [c for _, c in node.value.parts], model) if model and not s.plan.grouped else column))
            elif isinstance(node.range, Dictionary):
                out.append((alias, e.cell(node.range, node.value.column if tag_ranges(model) else column, model, node.value.maps[0])))
            else:
                p = parse(model)
                nested = p.template and isinstance(node.range, Reference)
                if nested or not p.template:
                    out.append((alias, e.cell(node.range, column, model)))
                else:
                    out.append((alias, e.embedded(node.range.shape, column, p)))
        return e.df, out
    if q.alternatives:
        own = e.union(s.root.range, [c for _, c in s.root.value.parts], {str(k): m for k, m in q.alternatives.items()})
        return e.df, [("", own)]
    if q.template:
        shape, access, key = s.root.access[0]
        if access is None:
            own = e.cell(s.root.range, key, dict(q.template))
            return e.df, [("", own)]
        out = e.members(shape, access, key, q)
        return e.df, out
    if isinstance(s.root.range, Union):
        own = e.union(s.root.range, [c for _, c in s.root.value.parts], {})
        return e.df, [("", own)]
    return e.df, [("", s.root.value.column)]

