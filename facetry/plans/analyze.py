"""Typing and admissibility: a parsed query becomes a trie of branches, or is rejected before Spark sees it."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..functions.transforms import AGGREGATES, SCALARS, split_pipe
from ..functions.values import literal, tier, tier_of, variants
from ..shapes import IRI, TEXT, Dictionary, Embedded, Property, Range, Reference, Shape, ShapeError, Union, integer, iri
from .grammar import Binding, Criterion, Expression, Query, parse

MARKERS = ("id", "type")
_COMPARISONS = ("<", ">", "<=", ">=")


@dataclass
class Branch:
    """A node of the path trie: what a step leads to, and the criteria and bindings that sit on it.

    All criteria on one branch, or under it, speak of the same value of that branch."""

    path: tuple[str, ...]
    range: Range
    many: bool = False
    marker: bool = False
    steps: dict[str, Branch] = field(default_factory=dict)
    criteria: list[Criterion] = field(default_factory=list)
    bindings: list[Binding] = field(default_factory=list)

    def at(self, path: tuple[str, ...]) -> Branch:
        own = self
        for step in path:
            own = own.steps[step]
        return own


def shapes_of(r: Range) -> list[Shape]:
    return [v.shape for v in variants(r) if isinstance(v, Reference | Embedded)]


def property_of(r: Range, name: str) -> list[Property]:
    """The declarations of a property in the shapes a range may be; several are one property with a wider range."""
    found = [s.properties[name] for s in shapes_of(r) if name in s.properties]
    if not found:
        raise ShapeError(f"no property {name!r} in {', '.join(s.name for s in shapes_of(r)) or 'a literal'}")
    return found


def joined(ranges: list[Range]) -> Range:
    """One range for the values of several."""
    flat = list(dict.fromkeys(v for r in ranges for v in variants(r)))
    return flat[0] if len(flat) == 1 else Union(tuple(flat))


def step(at: Branch, name: str) -> Branch:
    """The branch one step on; grown if it isn't there yet."""
    if name in at.steps:
        return at.steps[name]
    if at.marker:
        raise ShapeError(f"nothing follows {at.path[-1]}")
    if name in MARKERS and shapes_of(at.range) and not any(name in s.properties for s in shapes_of(at.range)):
        b = Branch((*at.path, name), iri, at.many, True)
    else:
        found = property_of(at.range, name)
        b = Branch((*at.path, name), joined([p.range for p in found]), at.many or any(p.many or (isinstance(p.range, Dictionary) and p.range.many) for p in found))
    at.steps[name] = b
    return b


def grow(root: Branch, path: tuple[str, ...]) -> Branch:
    at = root
    for name in path:
        at = step(at, name)
    return at


def effective(b: Branch, e: Expression) -> tuple[Range | None, str | None]:
    """The range of an expression's result (None: undefined for all values) and its aggregate."""
    before, aggregate, after = split_pipe(e.pipe)
    own: list[Range] = list(variants(b.range))

    def through(names: list[str]) -> None:
        nonlocal own
        for n in names:
            own = list(dict.fromkeys(SCALARS[n].result(r) for r in own if SCALARS[n].accepts(r)))
            if not own:
                raise ShapeError(f"{n} takes none of the types of {e}")

    through(before)
    if aggregate:
        t = AGGREGATES[aggregate]
        kept = [r for r in own if t.accepts(r)]
        if not kept:
            if not (b.marker or not e.path):
                raise ShapeError(f"{aggregate} takes none of the types of {e}")
            return None, aggregate
        own = [integer] if aggregate == "count" else list(dict.fromkeys(t.result(r) for r in kept))
        through(after)
    return joined(own), aggregate


def aggregates(e: Expression) -> bool:
    return any(p in AGGREGATES for p in e.pipe)


def options(value: Any) -> list[Any]:
    """The options of a set criterion: one, or a list; a mapping is one."""
    return list(value) if isinstance(value, list | tuple | set | frozenset) else [value]


def admits_absent(c: Criterion) -> bool:
    """Whether a set criterion takes the absence of a value for one of its options."""
    return c.op in "?!+" and any(o is None for o in options(c.value))


@dataclass
class Plan:
    """A typed query: its trie, and its form."""

    query: Query
    root: Branch
    #: The largest limit that a request may have.
    most: int | None = None

    @property
    def grouped(self) -> bool:
        """Some binding aggregates, so the others are the grouping."""
        return any(aggregates(b.expression) for b in self.query.bindings)

    @property
    def itemised(self) -> bool:
        """Aggregates in criteria only: each item's own values are reduced."""
        return not self.grouped and any(aggregates(c.expression) for c in self.query.criteria)

    @property
    def projection(self) -> bool:
        return bool(self.query.bindings)

    def of(self, *ops: str, aggregate: bool | None = None) -> list[Criterion]:
        return [c for c in self.query.criteria if c.op in ops and aggregate in (None, aggregates(c.expression))]

    @property
    def ordering(self) -> list[Criterion]:
        """Sort keys, most significant first; 0 is no key."""
        return sorted((c for c in self.of("^") if c.value), key=lambda c: abs(c.value))

    @property
    def focusing(self) -> list[Criterion]:
        return [c for c in self.of("+") if options(c.value)]

    @property
    def offset(self) -> int:
        return self.query.offset

    @property
    def limit(self) -> int:
        """The limit that holds: the model's, or the largest one if there is a cap; 0 is none."""
        return self.query.limit or self.most or 0

    @property
    def sliced(self) -> bool:
        return bool(self.limit or self.offset)

    @property
    def sorted(self) -> bool:
        """Whether the model asks for an order."""
        return bool(self.ordering or self.focusing)

    @property
    def grouping(self) -> list[Binding]:
        return [b for b in self.query.bindings if not aggregates(b.expression)]

    @property
    def filters(self) -> list[Criterion]:
        """The criteria that narrow rows before they are grouped; `!` speaks of an item's values and isn't one."""
        return [c for c in self.of("<", ">", "<=", ">=", "~", "?", aggregate=False) if c.op != "?" or options(c.value)]

    @property
    def required(self) -> set[tuple[str, ...]]:
        """Paths that some criterion needs a value on, and all before them: joined inner."""
        out: set[tuple[str, ...]] = set()
        for c in self.filters:
            if admits_absent(c):
                continue
            for k in range(1, len(c.expression.path) + 1):
                out.add(c.expression.path[:k])
        return out


def plan(r: Range, query: Query, plain: bool = False, depth: int | None = None, most: int | None = None) -> Plan:
    """Types a query over members of a range.

    plain: no aggregates; depth: the steps of paths and nested templates that may follow one another; most: the largest
    limit, which is also the one where none is given, and with which none may be waived by 0."""
    root = Branch((), r)
    own = Plan(query, root, most)
    for b in query.bindings:
        at = grow(root, b.expression.path)
        at.bindings.append(b)
        effective(at, b.expression)
    for c in query.criteria:
        at = grow(root, c.expression.path)
        at.criteria.append(c)
        _admit(at, c, own)
    for name, model in query.template.items():
        if name not in MARKERS or any(name in s.properties for s in shapes_of(r)):
            step(root, name)
        if model is not None and not isinstance(model, dict):
            raise ShapeError(f"{name} takes a model")
    if own.grouped:
        keys = {str(b.expression) for b in own.grouping}
        for c in (*own.ordering, *own.focusing):
            if not aggregates(c.expression) and str(c.expression) not in keys:
                raise ShapeError(f"{c.op}{c.expression} is not a grouping of the projection")
    if plain and any(aggregates(x.expression) for x in (*query.bindings, *query.criteria)):
        raise ShapeError("aggregates are not allowed")
    if depth is not None:
        _within(root, query, depth)
    if most and query.limit is not None and not 0 < query.limit <= most:
        raise ShapeError(f"a limit of {query.limit} is not allowed: at most {most}")
    return own


def _within(at: Branch, query: Query, depth: int) -> None:
    """Whether no chain of path steps and nested templates is longer than `depth`; references and values cost nothing."""
    for x in (*query.bindings, *query.criteria):
        if len(x.expression.path) > depth:
            raise ShapeError(f"{x.expression} goes deeper than {depth}")
    nested = [(step(at, n).range, m, 0) for n, m in query.template.items() if n in at.steps]
    nested += [(at.at(b.expression.path).range, b.model, len(b.expression.path)) for b in query.bindings]
    nested += [(at.range, m, -1) for m in query.alternatives.values()]
    for r, model, steps in nested:
        q = parse(model) if shapes_of(r) and model else None
        if q is None or (q.plain and not q.criteria):
            continue
        left = depth - steps - (not q.plain)
        if left < 0:
            raise ShapeError(f"templates nested deeper than {depth} are not allowed")
        below = Branch((), r)
        for x in (*q.bindings, *q.criteria):
            grow(below, x.expression.path)
        for name in q.template:
            if name not in MARKERS or any(name in s.properties for s in shapes_of(r)):
                step(below, name)
        _within(below, q, left)


def _admit(at: Branch, c: Criterion, own: Plan) -> None:
    result, aggregate = effective(at, c.expression)
    if result is None:
        return
    kinds = {tier(v) for v in variants(result)}
    single = not at.many or aggregate or own.grouped
    if c.op in _COMPARISONS:
        if kinds == {IRI}:
            raise ShapeError(f"{c.op}{c.expression}: references have no order")
        if not kinds & tier_of(c.value):
            raise ShapeError(f"{c.op}{c.expression} can't be compared with {c.value!r}")
        if TEXT not in kinds and isinstance(c.value, str) and literals_none(result, c.value):
            raise ShapeError(f"{c.op}{c.expression} can't be compared with {c.value!r}")
    elif c.op == "~":
        if TEXT not in kinds:
            raise ShapeError(f"~{c.expression}: there is no text to search")
        if not isinstance(c.value, str):
            raise ShapeError(f"~{c.expression} takes a text")
    elif c.op in ("^", "+") and not single:
        raise ShapeError(f"{c.op}{c.expression}: an order needs a single value")
    elif c.op == "^" and kinds == {IRI} and c.value and not at.marker and any(isinstance(v, Embedded) for v in variants(result)):
        raise ShapeError(f"^{c.expression}: nested records have no order")
    if c.op in "?!+":
        for o in options(c.value):
            if isinstance(o, dict):
                for tag, texts in o.items():
                    if not isinstance(tag, str) or not all(isinstance(t, str) for t in (texts if isinstance(texts, list | tuple) else [texts])):
                        raise ShapeError(f"{c.op}{c.expression}: malformed tagged option {o!r}")


def literals_none(r: Range, operand: Any) -> bool:
    return all(literal(v, operand) is None for v in variants(r))
