"""Collection queries: selection, projection, grouping, order and windows of the members of a collection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_tokens, in_ranges
from ..functions.transforms import domain, partial, reduced, scalar, split_pipe
from ..functions.values import Value, literal, matches, tier
from ..plans.analyze import Plan, admits_absent, aggregates, options, plan
from ..plans.grammar import Binding, Criterion, Expression, parse, tag_ranges
from ..shapes import TEMPORAL, TEXT, Dictionary, Range, Reference, Shape, ShapeError, Union
from ..sources.catalog import Catalog
from ..sources.folders import kept
from .optionsets import INLINE, LISTED, OptionSet
from .rows import Node, Rows

OWNER, RANK = "__owner", "__rank"


@dataclass
class Scope:
    """What holds for a whole request: language priority and caps."""

    locale: Sequence[str] | None = None
    plain: bool = False
    depth: int | None = None
    limit: int | None = None


@dataclass
class Result:
    """A collection's rows in the making: the frame, how to order it, and the cells still to be expanded."""

    df: DataFrame
    order: list[Column]
    rows: Rows
    #: What tells rows apart, most significant first: their order where none is asked for.
    tie: list[Column] = field(default_factory=list)
    #: alias, column with the cell's key or value, node, model
    cells: list[tuple[str, Column, Node | None, Any]] = field(default_factory=list)


def compare(v: Value, op: str, operand: Any) -> Column:
    """Whether some variant compares so (null or false if not: what a filter takes for no, and a scan can evaluate);
    a bound picks the variants of its tier, others fail."""
    found, kinds = F.lit(False), set()
    for r, c in sorted(v.parts, key=lambda p: tier(p[0])):
        own = literal(r, operand)
        if own is None or (kinds and tier(r) == TEXT and TEMPORAL in kinds):
            continue
        kinds.add(tier(r))
        found = found | {"<": c < own, ">": c > own, "<=": c <= own, ">=": c >= own}[op]
    return found


def condition(v: Value, c: Criterion, lineage: bool = False) -> Column:
    """A criterion on one value; `lineage`: the value is a row's classes."""
    match c.op:
        case "~":
            found = F.lit(False)
            for _, column in v.of(TEXT):
                found = found | has_tokens(column, c.value)
            return found
        case "?" | "+":
            own = options(c.value)
            if lineage:
                return F.coalesce(F.arrays_overlap(v.parts[0][1], F.array(*map(F.lit, own))), F.lit(False))
            return _any(v, own)
        case "!":
            return _all(v, options(c.value), lineage)
        case _:
            return compare(v, c.op, c.value)


def long(c: Criterion) -> bool:
    """Whether a criterion has more options than a condition is made of."""
    return c.op in "?!+" and len(options(c.value)) > INLINE


def _any(v: Value, own: list[Any]) -> Column:
    if len(own) > 1 and len(v.parts) == 1 and not any(isinstance(o, dict) or o is None for o in own) and not v.maps:
        r, column = v.parts[0]
        known = [x for x in (literal(r, o) for o in own) if x is not None]
        return column.isin(*known) if known else F.lit(False)
    found = F.lit(False)
    for o in own:
        found = found | matches(v, o)
    return found


def _all(v: Value, own: list[Any], lineage: bool) -> Column:
    if lineage:
        held = F.coalesce(v.parts[0][1], F.array().cast("array<string>"))
        return F.lit(None not in own) & (F.size(F.array_except(F.array(*(F.lit(o) for o in own if o is not None)), held)) == 0)
    found = F.lit(True)
    for o in own:
        found = found & matches(v, o)
    return found


class Select:
    """Compiles one query over a base frame whose columns bear the root's prefix; OWNER splits it into collections."""

    def __init__(self, catalog: Catalog, base: DataFrame, root: Node, model: dict[str, Any], scope: Scope, owned: bool = False, nested: bool = False):
        self.catalog, self.base, self.root, self.scope, self.owned = catalog, base, root, scope, owned
        # depth is checked once, for the whole request
        self.plan: Plan = plan(root.range, parse(model), scope.plain, None if nested else scope.depth, scope.limit)
        self.rows = self._rows(self.plan.required)
        self._sets = 0
        #: Marks of long focuses, by expression.
        self._marks: dict[str, Column] = {}

    def _rows(self, required: set) -> Rows:
        fresh = Node(self.root.range, self.root.value, list(self.root.access), self.root.owner)
        return Rows(self.catalog, self.base, fresh, self.scope.locale, required)

    @property
    def keys(self) -> list[Column]:
        return [F.col(OWNER)] if self.owned else []

    def same(self, own: Column, other: Column) -> Column:
        """Equality of items: plain on keys, which are never null, so a grouping by key is a partitioning that its join takes."""
        return own == other if self.root.access and self.root.access[0][0].key and len(self.root.value.parts) == 1 else own.eqNullSafe(other)

    @property
    def item(self) -> Column:
        return self.root.value.parts[0][1] if len(self.root.value.parts) == 1 else self.root.value.column

    # --- criteria

    def value(self, rows: Rows, e: Expression) -> Value:
        """The value that an expression's aggregate (or the expression, without one) reads."""
        return scalar(rows.node(e.path).value, split_pipe(e.pipe)[0])

    def _options(self, c: Criterion) -> OptionSet:
        self._sets += 1
        return OptionSet(self.catalog.spark, options(c.value), f"__s{self._sets}")

    def _where(self, df: DataFrame, v: Value, c: Criterion, lineage: bool = False) -> DataFrame:
        """The rows whose value meets a criterion: a condition, or a join with the options if there are many."""
        if not long(c) or lineage:
            return df.where(condition(v, c, lineage))
        own = options(c.value)
        if c.op == "!":
            return self._options(c).all_of(df, v)
        if len(own) <= LISTED and len(v.parts) == 1 and not v.maps and None not in own:
            return df.where(_any(v, own))
        return self._options(c).any_of(df, v)

    def _focused(self, df: DataFrame, values: dict[str, Value]) -> DataFrame:
        """Marks the rows that long focuses put first."""
        for c in self.plan.focusing:
            if long(c) and str(c.expression) in values and not self._lineage(c.expression):
                df, self._marks[str(c.expression)] = self._options(c).marked(df, values[str(c.expression)])
        return df

    def _filtered(self, rows: Rows, under: tuple[str, ...] | None = None) -> Rows:
        """Applies the criteria on rows; `under`: only those that share a multi-valued step with that path."""
        values = []
        for c in self.plan.filters:
            path = c.expression.path
            if under is not None and self._fan(path) and not self._shares(path, under):
                continue
            values.append((self.value(rows, c.expression), c))
        for v, c in sorted(values, key=lambda x: long(x[1])):  # conditions that scans take come first
            rows.df = self._where(self._candidates(rows, c), v, c, self._lineage(c.expression))
        return rows

    def _candidates(self, rows: Rows, c: Criterion) -> DataFrame:
        """The rows that a search may find, by an index of the text if there is one."""
        path = c.expression.path
        if c.op != "~" or not path or c.expression.pipe:
            return rows.df
        holders = [(shape, key) for shape, _, key in rows.node(path[:-1]).access if path[-1] in shape.properties]
        index = self.catalog.index(holders[0][0], path[-1]) if len(holders) == 1 and holders[0][0].key else None
        found = index.candidates(c.value) if index else None
        return rows.df if found is None else rows.df.join(found.withColumnRenamed("key", "__found"), holders[0][1] == F.col("__found"), "left_semi")

    def _lineage(self, e: Expression) -> bool:
        return bool(e.path) and e.path[-1] == "type" and self.plan.root.at(e.path).marker

    def _fan(self, path: tuple[str, ...]) -> bool:
        return self.plan.root.at(path).many

    def _shares(self, a: tuple[str, ...], b: tuple[str, ...]) -> bool:
        """Whether two paths go through the same multi-valued step."""
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        return self._fan(a[:k])

    def _divided(self, rows: Rows) -> Rows:
        """`!` criteria: on a single value a conjunction; else each option must be among the item's values."""
        for c in self.plan.of("!", aggregate=False):
            own = options(c.value)
            if not own:
                continue
            tagged = long(c) and any(isinstance(o, dict) for o in own)
            if not self._fan(c.expression.path) and not tagged:
                rows.df = self._where(rows.df, self.value(rows, c.expression), c, self._lineage(c.expression))
                continue
            names = [n for n, k in (("__k", True), (OWNER, self.owned)) if k]

            def held(walked: Rows, cond: Column) -> DataFrame:
                cols = [self.item.alias("__k"), *([F.col(OWNER)] if self.owned else [])]
                return walked.df.where(cond).select(*cols)

            walk = self._rows(frozenset())
            v = self.value(walk, c.expression)
            given = [o for o in own if o is not None]
            on = lambda right: self.same(self.item, right["__k"]) & (F.col(OWNER) == right["__o"] if self.owned else F.lit(True))
            if admits_absent(c):
                some = held(walk, v.present).distinct()
                some = some.withColumnRenamed(OWNER, "__o") if self.owned else some
                rows.df = rows.df.join(some, on(some), "left_anti")
            if given and long(c):
                some = self._options(c).met(walk.df, v, [self.item.alias("__k"), *self.keys], names)
                some = some.withColumnRenamed(OWNER, "__o") if self.owned else some
                rows.df = rows.df.join(some, on(some), "left_semi")
            elif given:
                found = [matches(v, o) for o in given]
                hit = found[0]
                for m in found[1:]:
                    hit = hit | m
                # relational division: a bit for each option, joined by or in one aggregation
                bits = {f"__b{at}": (found[at : at + 62], (1 << len(found[at : at + 62])) - 1) for at in range(0, len(found), 62)}
                marked = walk.df.where(hit).select(self.item.alias("__k"), *self.keys, *(sum((F.when(m, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, m in enumerate(ms)), F.lit(0).cast("long")).alias(n) for n, (ms, _) in bits.items()))
                some = marked.groupBy(*names).agg(*(F.bit_or(n).alias(n) for n in bits))
                for n, (_, full) in bits.items():
                    some = some.where(F.col(n) == full).drop(n)
                some = some.withColumnRenamed(OWNER, "__o") if self.owned else some
                rows.df = rows.df.join(some, on(some), "left_semi")
        return rows

    # --- reductions of single items

    def _reductions(self, rows: Rows) -> dict[str, Value]:
        """Aggregates in the criteria of a query that doesn't group: each item's own values, reduced and joined to it."""
        by_path: dict[tuple[str, ...], dict[tuple, Expression]] = {}
        for c in self.plan.query.criteria:
            if aggregates(c.expression):
                before, name, _ = split_pipe(c.expression.pipe)
                by_path.setdefault(c.expression.path, {})[(tuple(before), name)] = c.expression
        out: dict[str, Value] = {}
        for k, (path, wanted) in enumerate(by_path.items()):
            own = self._rows(frozenset())
            if self._fan(path):
                self._filtered(own, under=path)
            aggs, ranges = [], {}
            for j, ((before, name), e) in enumerate(wanted.items()):
                v = domain(self.value(own, Expression((), path)) if not before else scalar(own.node(path).value, list(before)), name, self._marker(path))
                if v is None:
                    continue
                r, column = reduced(v, name)
                aggs.append(column.alias(f"a{k}_{j}"))
                ranges[before, name] = (r, f"a{k}_{j}")
            if not aggs:
                continue
            by = [self.item.alias(f"k{k}"), *([F.col(OWNER).alias(f"o{k}")] if self.owned else [])]
            found = own.df.groupBy(*by).agg(*aggs)
            on = self.same(self.item, found[f"k{k}"])
            if self.owned:
                on = on & (F.col(OWNER) == found[f"o{k}"])
            rows.df = rows.df.join(found, on, "left")
            for c in self.plan.query.criteria:
                before, name, after = split_pipe(c.expression.pipe)
                if c.expression.path == path and name and (tuple(before), name) in ranges:
                    r, column = ranges[tuple(before), name]
                    out[str(c.expression)] = scalar(Value(((r, F.col(column)),)), after)
        return out

    def _marker(self, path: tuple[str, ...]) -> bool:
        return not path or self.plan.root.at(path).marker

    # --- the query

    def compile(self) -> Result:
        return self._grouped() if self.plan.grouped else self._ungrouped()

    def _ordered(self, values: dict[str, Value], tie: list[Column]) -> list[Column]:
        first = lambda c: self._marks[str(c.expression)] if str(c.expression) in self._marks else condition(values[str(c.expression)], c, self._lineage(c.expression))
        keys = [F.when(first(c), 0).otherwise(1) for c in self.plan.focusing]
        for c in self.plan.ordering:
            if str(c.expression) in values:
                keys += [k.asc_nulls_first() if c.value > 0 else k.desc_nulls_last() for k in values[str(c.expression)].order]
        return [*keys, *(t.asc_nulls_first() for t in tie)]

    def _ungrouped(self) -> Result:
        rows, p = self.rows, self.plan
        branches = self._branches(p.query.bindings) if p.projection else []
        if branches and self._plain():
            return self._crossed(branches)
        admitted = self._admitted(rows)
        self._divided(self._filtered(rows))
        if admitted is not None:
            rows.df = rows.df.where(admitted)
        if rows.fanned and not p.projection:
            rows = self.rows = self._matched(rows)
        for c in (*p.ordering, *p.focusing):
            if not aggregates(c.expression):
                rows.node(c.expression.path)
        reductions = self._reductions(rows) if p.itemised else {}
        for c in p.of("<", ">", "<=", ">=", "~", "?", "!", aggregate=True):
            if str(c.expression) in reductions:
                if options(c.value) if c.op in "?!" else True:
                    rows.df = self._where(rows.df, reductions[str(c.expression)], c)
            else:
                rows.df = rows.df.where(F.lit(None in options(c.value)) if c.op in "?!" else F.lit(False))
        values = {str(c.expression): reductions[str(c.expression)] if str(c.expression) in reductions else self.value(rows, c.expression) for c in (*p.ordering, *p.focusing) if not aggregates(c.expression) or str(c.expression) in reductions}
        rows.df = self._focused(rows.df, values)
        tie = self.root.value.order
        if not p.projection:
            return Result(rows.df, self._ordered(values, tie), rows, tie)
        cells = [self._cell(rows, b) for b in p.query.bindings]
        order = self._ordered(values, tie)
        alone = not rows.fanned and self.root.access and self.root.access[0][0].key and any(not b.expression.pipe and b.expression.path in ((), ("id",)) for b in p.query.bindings)
        if alone:
            return Result(rows.df, order, rows, tie, cells)
        if p.sorted or p.sliced or self.owned:
            rows.df = self._first(rows.df, [*self.keys, *(k for _, k, _, _ in cells)], order)
        elif any(n is not None and m and isinstance(n.range, Dictionary | Union) for _, _, n, m in cells):
            rows.df = self._first(rows.df, [k for _, k, _, _ in cells], None)
        else:  # the cells are all that is needed of a row, so they alone are made distinct
            names = [f"__c{k}" for k in range(len(cells))]
            rows.df = rows.df.select(*(key.alias(n) for n, (_, key, _, _) in zip(names, cells))).distinct()
            cells = [(alias, F.col(n), node, model) for n, (alias, _, node, model) in zip(names, cells)]
        return Result(rows.df, order, rows, tie, cells)

    def _plain(self) -> bool:
        """Whether a projection is a set of cells and no more: nothing orders, cuts or reduces its rows, and no cell needs their columns."""
        p = self.plan
        narrowed = any(b.model and isinstance(p.root.at(b.expression.path).range, Dictionary | Union) for b in p.query.bindings)
        return not (p.ordering or p.focusing or p.sorted or p.sliced or narrowed or any(aggregates(c.expression) for c in p.query.criteria))

    def _crossed(self, branches: list[tuple[str, ...]]) -> Result:
        """Distinct cells along independent branches: those of each branch are made distinct by member, and only they meet."""
        p = self.plan
        used = [x.expression for x in (*p.query.bindings, *p.query.criteria) if not (isinstance(x, Criterion) and x.op == "!")]
        cells: dict[int, tuple[str, Column, Node | None, Any]] = {}
        df = None
        for at, branch in enumerate([None, *branches]):
            rows = self._walk(branch, used)
            if branch is None:
                self._divided(rows)
            own = {k: self._cell(rows, b) for k, b in enumerate(p.query.bindings) if self._branch(b.expression.path) == branch}
            met = rows.df.select(self.item.alias(f"__k{at}"), *(key.alias(f"__c{k}") for k, (_, key, _, _) in own.items())).distinct()
            df = met if df is None else df.join(met, F.col("__k0") == F.col(f"__k{at}"))
            cells |= {k: (alias, F.col(f"__c{k}"), node, model) for k, (alias, _, node, model) in own.items()}
        self.rows.df = df.select(*(f"__c{k}" for k in sorted(cells))).distinct()
        return Result(self.rows.df, [], self.rows, self.root.value.order, [cells[k] for k in sorted(cells)])

    def _matched(self, rows: Rows) -> Rows:
        """The members that some row of a fan-out speaks for: their keys are made distinct on their own, which combines
        on the map side, and the members' columns meet them in a semi-join."""
        own = rows.df.select(self.item.alias("__k"), *([F.col(OWNER).alias("__o")] if self.owned else [])).distinct()
        on = self.same(self.item, own["__k"])
        if self.owned:
            on = on & (F.col(OWNER) == own["__o"])
        fresh = self._rows(frozenset())
        fresh.df = fresh.df.join(own, on, "left_semi")
        return fresh

    def _first(self, df: DataFrame, by: list[Column], order: list[Column] | None) -> DataFrame:
        """One row for each combination of keys: the first in order, any if none is asked for."""
        names = [f"__d{k}" for k in range(len(by))]
        keyed = df.withColumns(dict(zip(names, by)))
        if order is None:
            return keyed.dropDuplicates(names).drop(*names)
        w = Window.partitionBy(*names).orderBy(*order)
        return keyed.withColumn("__first", F.row_number().over(w)).where("__first = 1").drop("__first", *names)

    def _admitted(self, rows: Rows) -> Column | None:
        """A union collection keeps members of the requested variants only, before it is windowed."""
        if not (self.plan.query.alternatives and isinstance(self.root.range, Union)):
            return None
        chosen = pick(self.root.range, self.plan.query.alternatives)
        keep = F.lit(False)
        for k in chosen:
            keep = keep | self.root.value.parts[k][1].isNotNull()
        return keep

    def _cell(self, rows: Rows, b: Binding) -> tuple[str, Column, Node | None, Any]:
        node = rows.node(b.expression.path)
        if b.expression.pipe:
            return (b.alias, self.value(rows, b.expression).column, None, {})
        if b.expression.path and b.expression.path[-1] == "type" and self.plan.root.at(b.expression.path).marker:
            return (b.alias, node.value.parts[0][1][0], None, {})
        if isinstance(node.range, Dictionary) and tag_ranges(b.model):
            return (b.alias, node.owner, node, b.model)
        return (b.alias, node.value.column, node, b.model)

    # --- groups

    def _branch(self, path: tuple[str, ...]) -> tuple[str, ...] | None:
        """The first multi-valued step of a path; None if there is none."""
        return next((path[:k] for k in range(1, len(path) + 1) if self._fan(path[:k])), None)

    def _branches(self, cells: Sequence[Binding]) -> list[tuple[str, ...]]:
        """The independent multi-valued steps that a query goes through, if its rows can be reduced along each of them on
        its own; else none.  Members must be told apart by their keys, and cells that tags narrow need rows."""
        p = self.plan
        keyed = self.root.access and self.root.access[0][0].key and len(self.root.value.parts) == 1 and not self.owned
        maps = any(isinstance(self.plan.root.at(b.expression.path).range, Dictionary) and tag_ranges(b.model) for b in cells)
        if not keyed or maps:
            return []
        used = [x.expression for x in (*p.query.bindings, *p.query.criteria) if not (isinstance(x, Criterion) and x.op == "!" and not aggregates(x.expression))]
        found = list(dict.fromkeys(b for b in (self._branch(e.path) for e in used) if b is not None))
        return found if len(found) > 1 else []

    def _walk(self, branch: tuple[str, ...] | None, used: list[Expression]) -> Rows:
        """Rows of the members along one branch (None: none of them), narrowed by the criteria that hold there."""
        rows = self._rows(self.plan.required)
        for e in used:
            if self._branch(e.path) == branch:
                rows.node(e.path)
        values = []
        for c in self.plan.filters:
            if self._branch(c.expression.path) in (None, branch):
                values.append((self.value(rows, c.expression), c))
        for v, c in sorted(values, key=lambda x: long(x[1])):
            rows.df = self._where(self._candidates(rows, c), v, c, self._lineage(c.expression))
        return rows

    def _factorised(self, branches: list[tuple[str, ...]], cells: list, wanted: dict[tuple, tuple[Expression, list[str]]]) -> tuple[DataFrame, dict[tuple, Range]]:
        """Groups without the product of independent branches: each is reduced to partial results by member (and by the
        group keys that lie in it) and to how many rows it has; a branch's part then counts as often as the others have rows.

        cells: the group keys, as (name, binding); wanted: aggregates by key.  Returns the groups and the aggregates' ranges."""
        p, item = self.plan, "__k"
        used = [x.expression for x in (*p.query.bindings, *p.query.criteria) if not (isinstance(x, Criterion) and x.op == "!")]
        base = self._walk(None, used)
        self._divided(base)
        key_of = lambda rows, b: self._cell(rows, b)[1]
        parts: dict[tuple, tuple[list[str], Callable, int | None]] = {}
        ranges: dict[tuple, Range] = {}
        frames, own_names = [], []
        for at, branch in enumerate([None, *branches]):
            rows = base if branch is None else self._walk(branch, used)
            keys = [(n, b) for n, b in cells if self._branch(b.expression.path) == branch]
            columns = []
            for key, (e, before) in wanted.items():
                if self._branch(e.path) != branch:
                    continue
                v = domain(scalar(rows.node(e.path).value, before), key[2], self._marker(e.path))
                ranges[key], own, total = partial(v, key[2])
                names = [f"p{at}_{len(columns) + k}" for k in range(len(own))]
                columns += [c.alias(n) for n, c in zip(names, own)]
                parts[key] = (names, total, at)
            by = [self.item.alias(f"{item}{at}"), *(key_of(rows, b).alias(n) for n, b in keys)]
            frames.append(rows.df.groupBy(*by).agg(F.count(F.lit(1)).alias(f"m{at}"), *columns))
            own_names.append(f"{item}{at}")
        df = frames[0]
        for frame, name in zip(frames[1:], own_names[1:]):
            df = df.join(frame, F.col(own_names[0]) == F.col(name))
        weights = {at: F.col(f"m{at}") for at in range(len(frames))}

        def others(at: int) -> Column:
            out = F.lit(1).cast("long")
            for k, m in weights.items():
                out = out if k == at else out * m
            return out

        aggs = [total([F.col(n) for n in names], others(at)).alias(f"a{k}") for k, (names, total, at) in enumerate(parts[key] for key in wanted)]
        return df.groupBy(*(n for n, _ in cells)).agg(*aggs), ranges

    def _grouped(self) -> Result:
        rows, p = self.rows, self.plan
        branches = self._branches(p.grouping)
        for x in (*p.query.bindings, *p.query.criteria):
            if not (isinstance(x, Criterion) and x.op == "!"):
                rows.node(x.expression.path)
        cells = [self._cell(rows, b) for b in p.grouping]
        names = [f"g{k}" for k in range(len(cells))]
        aggs: dict[tuple, Column] = {}
        wanted: dict[tuple, tuple[Expression, list[str]]] = {}
        after_of: dict[str, tuple[Range, str, list[str]] | None] = {}
        for e in (x.expression for x in (*p.query.bindings, *p.query.criteria) if aggregates(x.expression)):
            before, name, after = split_pipe(e.pipe)
            v = domain(scalar(rows.node(e.path).value, before), name, self._marker(e.path))
            if v is None:
                after_of[str(e)] = None
                continue
            r, column = reduced(v, name)
            key = (e.path, tuple(before), name)
            if key not in aggs:
                aggs[key], wanted[key] = column.alias(f"a{len(aggs)}"), (e, before)
            after_of[str(e)] = (r, f"a{list(aggs).index(key)}", after)
        # cells that are attached to a group's key after grouping need their maps
        carried = [F.first(n.value.maps[0]).alias(f"m{k}") for k, (_, _, n, m) in enumerate(cells) if n is not None and isinstance(n.range, Dictionary) and tag_ranges(m)]
        # group keys may be tagged structs or references, and null is a key
        if branches and wanted:
            df, _ = self._factorised(branches, list(zip(names, p.grouping)), wanted)
        else:
            self._divided(self._filtered(rows))
            rows.df = rows.df.withColumns({n: key for n, (_, key, _, _) in zip(names, cells)})
            df = rows.df.groupBy(*self.keys, *names).agg(*(list(aggs.values()) or [F.count(F.lit(1)).alias("a0")]), *carried)
        values: dict[str, Value] = {}
        for text, own in after_of.items():
            if own is not None:
                r, column, after = own
                values[text] = scalar(Value(((r, F.col(column)),)), after)
        for n, b in zip(names, p.grouping):
            at = rows.node(b.expression.path)
            v = self.value(rows, b.expression) if b.expression.pipe else at.value
            if len(v.parts) == 1:
                values[str(b.expression)] = Value(((v.parts[0][0], F.col(n)),))
            else:
                values[str(b.expression)] = Value(((v.parts[0][0], F.col(n)),))
        for c in p.of("<", ">", "<=", ">=", "~", "?", "!", aggregate=True):
            if c.op in "?!" and not options(c.value):
                continue
            df = self._where(df, values[str(c.expression)], c) if str(c.expression) in values else df.where(F.lit(c.op in "?!" and None in options(c.value)))
        df = self._focused(df, values)
        order = self._ordered({k: v for k, v in values.items()}, [F.col(n) for n in names])
        out = []
        for b in p.query.bindings:
            if aggregates(b.expression):
                own = values.get(str(b.expression))
                out.append((b.alias, own.column if own else F.lit(None).cast("string"), None, {}))
            else:
                k = p.grouping.index(b)
                alias, _, node, model = cells[k]
                if node is not None and isinstance(node.range, Dictionary) and tag_ranges(model):
                    out.append((alias, in_ranges(F.col(f"m{k}"), tag_ranges(model)), None, {}))
                else:
                    out.append((alias, F.col(names[k]), node, model))
        rows.df = df
        return Result(df, order, rows, [F.col(n) for n in names], out)


#: Rows that a page may reach to before ranks are found range by range; it is cut from the top by each task till then.
DEEP = 100_000


def ranked(df: DataFrame, order: list[Column], columns: list[Column], owned: bool) -> DataFrame:
    """`columns` of a frame's rows and their RANK in order, of the whole or of their owner's part, without one task for all.

    Rows are partitioned by ranges of (owner and) order and sorted there, which numbers them within their range; the ranges'
    counts, one row for each range and owner, add up to where each begins.  The numbered rows are written, as ranges are
    drawn anew by every job."""
    by = [F.col(OWNER)] if owned else []
    keys = [*([F.col(OWNER).asc()] if owned else []), *order]
    at = F.monotonically_increasing_id().alias("__at")  # the partition in the upper bits, the place in it in the lower 33
    rows = kept(df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*columns, *by, at), "ranks")
    rows = rows.withColumns({"__part": F.shiftright("__at", 33), "__place": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__at")
    parts = rows.groupBy(*([OWNER] if owned else []), "__part").agg(F.min("__place").alias("__first"), F.count("*").alias("__n"))
    if owned:
        before = Window.partitionBy(OWNER).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select(F.col(OWNER).alias("__of"), F.col("__part").alias("__p"), "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
        on = (F.col("__part") == F.col("__p")) & F.col(OWNER).eqNullSafe(F.col("__of"))
    else:  # as many rows as there are partitions
        total, starts = 0, []
        for r in sorted(parts.collect(), key=lambda r: r["__part"]):
            starts.append((r["__part"], 0, total))
            total += r["__n"]
        parts = F.broadcast(df.sparkSession.createDataFrame(starts, "__p long, __first long, __before long"))
        on = F.col("__part") == F.col("__p")
    met = rows.join(parts, on)
    return met.withColumn(RANK, F.col("__place") - F.col("__first") + F.col("__before") + 1).drop("__part", "__place", "__p", "__of", "__first", "__before")


def _paged(result: Result, p: Plan, owned: bool) -> DataFrame:
    """A slice by distributed ranks.  Of members with keys only keys are sorted and written, and meet their columns after
    the slice; other rows, which are narrow as a rule, are written whole."""
    df, root = result.df, result.rows.nodes[()]
    late = not result.cells and root.access and root.access[0][0].key and len(result.tie) == 1
    rows = ranked(df, result.order, [result.tie[0].alias("__id")] if late else [F.col(c) for c in df.columns if c != OWNER], owned)
    rows = rows.where(F.col(RANK) > p.offset)
    rows = rows.where(F.col(RANK) <= p.offset + p.limit) if p.limit else rows
    if late:
        on = result.tie[0] == F.col("__id")
        if owned:
            rows = rows.withColumnRenamed(OWNER, "__o")
            on = on & F.col(OWNER).eqNullSafe(F.col("__o"))
        rows = df.join(rows, on).drop("__id", "__o")
    return rows if owned else rows.orderBy(RANK)


def window(result: Result, p: Plan, owned: bool, flat: bool = False) -> DataFrame:
    """Order and slice: of the whole frame, or of each owner's part, whose rows get their RANK.  Where a model asks for
    neither, rows of an owner are not numbered.  Slices that reach deep, or have no end, are found by distributed ranks; of
    owners only if their members are rows (`flat`), as an array is one value anyway."""
    df, order = result.df, result.order
    deep = bool(order) and (flat if owned else p.offset) and not (p.limit and p.offset + p.limit <= DEEP)
    if owned:
        if not order or not (p.sorted or p.sliced):
            return df
        if deep:
            return _paged(result, p, True)
        df = df.withColumn(RANK, F.row_number().over(Window.partitionBy(OWNER).orderBy(*order)))
        if p.offset:
            df = df.where(F.col(RANK) > p.offset)
        return df.where(F.col(RANK) <= p.offset + p.limit) if p.limit else df
    if deep:
        return _paged(result, p, False)
    if order and (any(c.op in "^+" for c in p.query.criteria) or p.sliced):  # a whole aggregate is one row
        df = df.orderBy(*order)
    if p.offset:
        df = df.offset(p.offset)
    return df.limit(p.limit) if p.limit else df


def pick(r: Union, alternatives: dict[int, Any]) -> dict[int, Any]:
    """The variants that alternatives ask for, with their models: a structured one fits the shapes that have its members,
    an atomic one the literals and references; several on one variant are merged, the structured one wins."""
    out: dict[int, Any] = {}
    for model in alternatives.values():
        q = parse(model)
        names = [*q.template, *(b.expression.path[0] for b in q.bindings if b.expression.path)]
        fits = []
        for k, v in enumerate(r.variants):
            if names:
                own: Shape | None = getattr(v, "shape", None)
                ok = own is not None and all(n in ("id", "type") or n in own.properties for n in names)
                if isinstance(v, Dictionary) and own is None:
                    ok = True
            else:
                ok = getattr(v, "shape", None) is None or isinstance(v, Reference)
            if ok:
                fits.append(k)
        if not fits:
            raise ShapeError(f"no variant fits the alternative {model!r}")
        for k in fits:
            out[k] = {**out.get(k, {}), **model} if names or k not in out else out[k]
    return out

