"""Entry points for reading: collections as DataFrames, single resources as plain values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from types import MappingProxyType
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .checks import guarded
from .functions.values import variants
from .operators.expand import Expander, contents, gather, items_of, members_of
from .operators.rows import prefixed, root_node
from .operators.select import OWNER, RANK, Scope, Select, window
from .plans.analyze import aggregates, plan
from .plans.grammar import parse
from .shapes import Reference, Shape, ShapeError
from .sources.catalog import Catalog


def select(catalog: Catalog, shape: Shape, model: Mapping[str, Any], locale: Sequence[str] | None = None, plain: bool = False, depth: int | None = None, limit: int | None = None, checked: bool = False) -> DataFrame:
    """The extent of a class under a model: one row per member (template), or per combination of cells (projection).

    A bare model gives the members' keys as `id`.  Rows are in order if the model asks for one or for a slice.
    checked: reading a member that breaks its shape is an error."""
    scope = Scope(locale, plain, depth, limit)
    base, root = prefixed(catalog.extent(shape), "r_"), root_node(shape, lambda c: F.col(f"r_{c}"))
    s = Select(catalog, base, root, dict(model), scope)
    result = s.compile()
    df, cells = contents(catalog, window(result, s.plan, False), result, s, scope)
    out = df.select(*(c.alias(n or "id") for n, c in cells))
    return guarded(shape, model, out) if checked and not s.plan.projection else out


def members(catalog: Catalog, shape: Shape, name: str, model: Mapping[str, Any], owners: DataFrame | None = None, locale: Sequence[str] | None = None, flat: bool = False, plain: bool = False, depth: int | None = None, limit: int | None = None) -> DataFrame:
    """(owner, items): a collection of all resources of a class (or of those in `owners`, a frame of keys named `id`),
    each ordered and sliced on its own.  A query without groupings gives an owner without members its empty aggregate.

    flat: (owner, rank, item), a row for each member instead of an array for each owner, so that no collection has to fit
    in a row; rank is null where the model asks for neither order nor slice."""
    scope, p = Scope(locale, plain, depth, limit), shape.property(name)
    df = prefixed(catalog.extent(shape), "r_")
    key = F.col("r_" + shape.key)
    if owners is not None:
        df = df.join(owners.select(F.col("id").alias("__id")), key == F.col("__id"), "left_semi")
    base, root = members_of(catalog, p, df, lambda c: F.col(f"r_{c}"), key)
    query = parse(dict(model))
    own = plan(root.range, query, plain, depth, limit)
    if flat:
        rows, item, by = items_of(catalog, base, root, dict(model), scope, flat=True)
        return rows.select(F.col(OWNER).alias("owner"), (F.col(RANK) if by == [RANK] else F.lit(None)).cast("int").alias("rank"), item.alias("item"))
    found = gather(catalog, base, root, dict(model), scope)
    if own.grouped and not own.grouping and not own.query.criteria:
        every = df.select(key.alias("__k")).join(found, F.col("__k") == F.col(OWNER), "left")
        none = F.array(F.struct(*(F.lit(0 if b.expression.pipe[-1] in ("count", "sum") else None).cast(found.schema["items"].dataType.elementType[b.alias].dataType).alias(b.alias) for b in query.bindings)))
        return every.select(F.col("__k").alias("owner"), F.coalesce("items", none).alias("items"))
    return found.select(F.col(OWNER).alias("owner"), "items")


def lookup_many(catalog: Catalog, shape: Shape, entries: DataFrame | Sequence[Any], model: Mapping[str, Any], locale: Sequence[str] | None = None, plain: bool = False, depth: int | None = None, limit: int | None = None) -> DataFrame:
    """Resources by key, one row each, with `id` and the template's members; unknown entries have no row.

    One plan serves all entries; entries given as a frame are joined, so their number does not grow the plan.  plain, depth
    and limit bound nested collections as they bound select."""
    q = parse(dict(model))
    if q.bindings or q.criteria or q.alternatives:
        raise ShapeError("a resource is looked up with a template")
    plan(root_node(shape, lambda c: F.lit(None)).range, q, plain, depth)
    df = prefixed(catalog.extent(shape), "r_")
    key = F.col("r_" + shape.key)
    if isinstance(entries, DataFrame):
        df = df.join(entries.select(F.col("id").alias("__id")), key == F.col("__id"), "left_semi")
    else:
        df = df.where(key.isin(list(entries)))
    e = Expander(catalog, df, Scope(locale, plain, depth, limit))
    own = e.members(shape, lambda c: F.col(f"r_{c}"), key, q)
    cols = [c.alias(n) for n, c in own]
    return e.df.select(*([] if "id" in q.template else [key.alias("id")]), *cols)


def virtual(catalog: Catalog, entry: Any, shape: Shape, model: Mapping[str, Any], locale: Sequence[str] | None = None, plain: bool = False, depth: int | None = None, limit: int | None = None) -> dict[str, Any]:
    """A resource that need not be held: `id` and `type` come from the request, single values from whatever is held, and a
    collection of references is the extent of its class under its own model, as a DataFrame (a list of them, if the
    references are of several classes), so that nothing of it comes to the driver before it is asked for."""
    q, out = parse(dict(model)), {}
    plan(root_node(shape, lambda c: F.lit(None)).range, q, plain, depth)
    single = {n: m for n, m in q.template.items() if n not in ("id", "type") and not shape.property(n).many}
    held = lookup_many(catalog, shape, [entry], single, locale, plain, depth, limit).limit(1).collect() if single and catalog.concrete(shape) else []
    own = decode(held[0]) if held else {}
    for name, m in q.template.items():
        if name in ("id", "type") and name not in shape.properties:
            out[name] = entry if name == "id" else shape.name
        elif name in single:
            if name in own:
                out[name] = own[name]
        else:
            found = [select(catalog, v.shape, m, locale, plain, None, limit) for v in variants(shape.property(name).range) if isinstance(v, Reference)]
            out[name] = found[0] if len(found) == 1 else found
    return out


def bounded(model: Mapping[str, Any], limit: int | None) -> bool:
    """Whether a collection under a model is of a size to be read at once: it has a limit, or is one row of aggregates."""
    q = parse(dict(model))
    return bool(limit or q.limit) or (bool(q.bindings) and all(aggregates(b.expression) for b in q.bindings))


def detect(catalog: Catalog, shape: Shape, entries: DataFrame) -> DataFrame:
    """(id, present) for a frame of keys named `id`: whether a resource of the class or a subclass bears it."""
    own = catalog.extent(shape).select(F.col(shape.key).alias("__id")).distinct()
    return entries.select("id").join(own, F.col("id") == F.col("__id"), "left").select("id", F.col("__id").isNotNull().alias("present"))


def frozen(value: Any) -> Any:
    """Plain values that cannot be changed: mapping views and tuples."""
    if isinstance(value, dict):
        return MappingProxyType({k: frozen(v) for k, v in value.items()})
    return tuple(frozen(v) for v in value) if isinstance(value, list) else value


def decode(value: Any) -> Any:
    """A row as plain values: absent members are left out, unions are their one value."""
    if isinstance(value, Row):
        value = value.asDict()
    if isinstance(value, dict):
        if value and all(k[:1] == "v" and k[1:].isdigit() for k in value):
            return next((decode(x) for x in value.values() if x is not None), None)
        out = {k: decode(x) for k, x in value.items() if x is not None}
        return {k: x for k, x in out.items() if x is not None and x != []}
    if isinstance(value, list):
        return [decode(x) for x in value if x is not None]
    return value
