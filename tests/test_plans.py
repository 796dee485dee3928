"""Models taken apart and typed, without Spark plans."""

import pytest
from voyages import Port, Ship, Voyage

from facetry.plans.analyze import admits_absent, plan
from facetry.plans.grammar import Expression, expression, parse, tag_ranges
from facetry.shapes import IRI, Dictionary, Reference, ShapeError, Union, date, integer, schema, time


def typed(model, shape=Voyage, **caps):
    return plan(Reference(lambda: shape), parse(model), **caps)


def test_keys():
    assert expression("round:avg:ship.insured") == Expression(("round", "avg"), ("ship", "insured"))
    assert expression("count:") == Expression(("count",), ()) and expression("") == Expression((), ())
    q = parse({"a=b.c": {}, ">=x": 1, "?y": [None], "^z": "desc", "@": 3, "#": 4, "gone": None})
    assert [b.alias for b in q.bindings] == ["a"] and [(c.op, str(c.expression), c.value) for c in q.criteria] == [(">=", "x", 1), ("?", "y", [None]), ("^", "z", -1)]
    assert (q.offset, q.limit, q.template) == (3, 4, {}) and parse({}).limit is None and parse({"#": 0}).limit == 0
    assert parse({"0": {}, "1": {"x": {}}}).alternatives == {0: {}, 1: {"x": {}}}
    assert tag_ranges({"en": {}, "*": {}, "~": "x"}) == ["en", "*"]
    for bad in ("a b", "a..b", ":a", "a:1", "1a"):
        with pytest.raises(ShapeError):
            expression(bad)


def test_forms():
    assert typed({"s=ship": {}, "n=count:id": {}}).grouped and typed({">count:papers": 1}).itemised
    assert not typed({"s=ship": {}, ">count:papers": 1}).grouped
    own = typed({"^tide": 2, "^number": -1, "^kind": 0, "+kind": ["liner"], "+number": []})
    assert [str(c.expression) for c in own.ordering] == ["number", "tide"] and [str(c.expression) for c in own.focusing] == ["kind"]


def test_limits():
    assert [typed(m, most=9).limit for m in ({}, {"#": 4}, {"#": 9})] == [9, 4, 9] and [typed(m).limit for m in ({}, {"#": 0}, {"#": 4})] == [0, 0, 4]
    q = parse({})
    assert plan(Reference(lambda: Voyage), q, most=5).limit == 5 and q.limit is None
    for bad in (0, 10):
        with pytest.raises(ShapeError):
            typed({"#": bad}, most=9)


def test_branches():
    own = typed({"c=calls": {}, "m=month:sails": {}, "t=max:tide": {}, "?ship.built": ["1990", None], "~remark": "x", "?notes": {"en": "a"}, "!papers": []})
    at = lambda *p: own.root.at(p)
    assert at("calls").many and not at("sails").many and isinstance(at("remark").range, Union) and isinstance(at("notes").range, Dictionary)
    assert [c.op for c in own.filters] == ["?", "~", "?"] and not any(c.op == "!" for c in own.filters)
    assert [admits_absent(c) for c in own.query.criteria] == [True, False, False, False] and admits_absent(typed({"!tide": None}).query.criteria[0])
    assert typed({"?papers": []}).filters == [] and typed({">=max:tide": 1}).filters == []
    assert own.required == {("remark",), ("notes",)} and own.grouped and [b.alias for b in own.grouping] == ["c", "m"]


def test_cardinality_composes():
    own = typed({"a=calls.code": {}, "b=ship.log.knots": {}, "c=ship.sign": {}, "d=ship.home.spokes": {}})
    assert [own.root.at(b.expression.path).many for b in own.query.bindings] == [True, True, False, True]


def test_schema_carries_what_properties_are():
    kinds = {f.name: f.metadata["kind"] for f in schema(Voyage).fields}
    assert kinds["notes"] == "dictionary" and kinds["ship"] == "reference" and kinds["fare"] == "union" and {f.name: f.metadata["kind"] for f in schema(Ship).fields}["log"] == "embedded"
    assert (time.tier, date.tier, integer.tier) == (2, 2, 1) and IRI == 4
    assert [f.name for f in schema(Voyage)["cargo"].dataType.elementType.fields] == ["v0", "v1"] and "spokes" not in schema(Port).fieldNames()
