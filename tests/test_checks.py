"""Answers that break their shapes are told, as a report, as an error of the plan and by the store."""

import pytest
import voyages
from voyages import Port, Ship, Voyage

from facetry.checks import breaches
from facetry.engine import select
from facetry.shapes import ShapeError
from facetry.store import Store


@pytest.fixture
def broken(spark):
    """A fleet with one ship of a bad sign and a log that is too fast, a port without a code, and a voyage of four papers."""
    c = voyages.catalog(spark)
    ships = c.frame(Ship)
    c.bind(Ship, ships.selectExpr("*", "if(id = '/ships/S1', 'low', sign) as s2").drop("sign").withColumnRenamed("s2", "sign"))
    c.bind(Port, c.frame(Port).selectExpr("*", "if(id = '/ports/P04', null, code) as c2").drop("code").withColumnRenamed("c2", "code"))
    c.bind(Voyage, c.frame(Voyage).selectExpr("*", "if(id = '/voyages/101', array('a', 'b', 'c', 'd'), papers) as p2").drop("papers").withColumnRenamed("p2", "papers"))
    return c


def report(c, shape, model):
    return {(r["path"], r["reason"], r["n_rows"], r["example"]) for r in breaches(shape, model, select(c, shape, model)).collect()}


def test_reports(spark, broken):
    assert report(broken, Ship, {"id": {}, "sign": {}, "home": {}}) == {("sign", "breaks {'pattern': '^[A-Z]'}", 1, "/ships/S1")}
    assert report(broken, Ship, {"id": {}, "home": {}}) == set()
    assert report(broken, Voyage, {"id": {}, "papers": {}}) == {("papers", "has more than 3", 1, "/voyages/101")}
    assert report(broken, Voyage, {"id": {}, "papers": {"#": 3}}) == set()
    nested = report(broken, Voyage, {"id": {}, "ship": {"sign": {}}, "calls": {"code": {}}})
    calls = {v["id"] for v in voyages.VOYAGES if "/ports/P04" in v["calls"]}
    assert {x[:3] for x in nested} == {("ship.sign", "breaks {'pattern': '^[A-Z]'}", sum(v["ship"] == "/ships/S1" for v in voyages.VOYAGES)), ("calls[].code", "is missing", len(calls))}
    assert report(voyages.catalog(spark), Voyage, {"id": {}, "number": {}, "kind": {}, "ship": {"sign": {}, "log": {"knots": {}}}, "calls": {"code": {}}, "papers": {}}) == set()


def test_kinds(spark):
    c = voyages.catalog(spark)
    c.bind(Port, c.frame(Port).selectExpr("*", "cast(ice as string) as i2").drop("ice").withColumnRenamed("i2", "ice"))
    assert {x[:2] for x in report(c, Port, {"id": {}, "ice": {}})} == {("ice", "is no boolean")}


def test_a_checked_answer_fails_when_it_is_read(broken):
    df = select(broken, Ship, {"id": {}, "sign": {}, "^sign": 1}, checked=True)
    with pytest.raises(Exception, match="Ship: sign breaks"):
        df.collect()
    assert select(broken, Ship, {"id": {}, "sign": {}, "?id": "/ships/S0"}, checked=True).count() == 1
    store = Store(broken, checked=True)
    with pytest.raises(ShapeError, match="/ships/S1: sign breaks"):
        store.lookup("/ships/S1", Ship, {"sign": {}})
    assert store.lookup("/ships/S1", Ship, {"home": {}}) and store.lookup("/ships/S0", Ship, {"sign": {}})
    with pytest.raises(Exception, match="sign breaks"):
        store.members(Ship, {"sign": {}})
    assert Store(broken).lookup("/ships/S1", Ship, {"sign": {}}) == {"sign": "low"}
