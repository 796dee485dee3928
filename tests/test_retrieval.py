"""Retrieval over the shipping line against a plain reading of its rows."""

import math
from collections import Counter

import pytest
import voyages
from pyspark.sql import functions as F
from voyages import PORTS, SHIPS, VOYAGES, Asset, Guest, Port, Ship, Voyage

from facetry.engine import decode, lookup_many, members, select, virtual
from facetry.shapes import Linked, Reference, Shape, ShapeError, multiple


@pytest.fixture(scope="module")
def catalog(spark):
    return voyages.catalog(spark)


@pytest.fixture(scope="module")
def ask(catalog):
    return lambda shape, model, locale=None, **more: [decode(r) for r in select(catalog, shape, model, locale, **more).collect()]


SHIP, PORT = {s["id"]: s for s in SHIPS}, {p["id"]: p for p in PORTS}


def numbers(rows):
    return sorted(r["number"] for r in rows)


def log(v):
    return SHIP[v["ship"]]["log"]


def number(v, key="fare"):
    x = v.get(key)
    return x if isinstance(x, int | float) and not isinstance(x, bool) else None


CRITERIA = {
    # comparisons: numbers, text, dates, times, booleans, unions by the operand's tier
    "<tide": (0, lambda v: v.get("tide", 1) < 0), ">=number": (110, lambda v: v["number"] >= 110), ">kind": ("liner", lambda v: v["kind"] > "liner"), ">=sails": ("2031-06-01", lambda v: v.get("sails", "") >= "2031-06-01"),
    "<ship.built": ("2000", lambda v: SHIP[v["ship"]].get("built", "9") < "2000"), ">fare": (10, lambda v: (number(v) or 0) > 10), "<=fare": ("z", lambda v: v.get("fare") == "on request"), "<calls.ice": (True, lambda v: any(not PORT[p]["ice"] for p in v["calls"])),
    # several values: one of them is enough
    ">papers": ("doc-1", lambda v: len(v["papers"]) == 3), ">=ship.log.knots": (15, lambda v: any(w["knots"] >= 15 for w in log(v))), ">calls.draught": (14, lambda v: any(PORT[p].get("draught", 0) > 14 for p in v["calls"])),
    # words
    "~ship.owner": ("hands PRIV", lambda v: v["ship"] == "/ships/S0"), "~kind": ("E", lambda v: "e" in v["kind"]),
    # any of
    "?tide": ([None, -2.5], lambda v: v.get("tide") in (None, -2.5)), "?kind": (["ferry", 5, True], lambda v: v["kind"] == "ferry"), "?sails": (["2031-02-02", "x"], lambda v: v.get("sails") == "2031-02-02"), "?id": (["/voyages/103", "/none"], lambda v: v["number"] == 103),
    "?calls.hub.hub.code": ("P00", lambda v: any(PORT[PORT.get(PORT[p].get("hub"), {}).get("hub")]["code"] == "P00" for p in v["calls"] if PORT.get(PORT[p].get("hub"), {}).get("hub"))), "?notes": ({"no": "rolig"}, lambda v: "no" in v["notes"]),
    "?cargo.berth": ("B1", lambda v: v["number"] == 101), "?cargo.bound.code": ("P02", lambda v: v["number"] == 102), "?papers": ([], lambda v: True), "?ship.log.at": (["2031-03-01T07:00:00+02:00"], lambda v: v["ship"] == "/ships/S1"), "?cargo": (["/guests/0"], lambda v: v["number"] == 100),
    # all of
    "!kind": (["liner", "ferry"], lambda v: False), "!papers": (["doc-0", "doc-2"], lambda v: len(v["papers"]) == 3), "!ship.log.officer": ([None], lambda v: not log(v)), "!calls": (["/ports/P01", "/ports/P04"], lambda v: {"/ports/P01", "/ports/P04"} <= set(v["calls"])),
    # through transforms and aggregates
    ">=month:sails": (7, lambda v: int(v.get("sails", "0000-00")[5:7]) >= 7), "?round:fare": ([3, 19], lambda v: number(v) is not None and math.floor(number(v) + 0.5) in (3, 19)), ">=hours:ship.bell": (9, lambda v: v["ship"] == "/ships/S1"), "!abs:tide": (2.5, lambda v: v.get("tide") in (2.5, -2.5)),
    ">=sum:ship.log.knots": (20, lambda v: sum(w["knots"] for w in log(v)) >= 20), "<count:papers": (1, lambda v: not v["papers"]), ">=count:calls": (2, lambda v: len(v["calls"]) > 1), "!max:ship.log.knots": ([7], lambda v: max((w["knots"] for w in log(v)), default=0) == 7),
}


@pytest.mark.parametrize("key", CRITERIA)
def test_criteria(ask, key):
    value, test = CRITERIA[key]
    want = [v["number"] for v in VOYAGES if test(v)]
    assert numbers(ask(Voyage, {"number": {}, key: value})) == want


def test_criteria_under_one_path_speak_of_one_value(ask):
    one = lambda s: any(w["knots"] >= 7 and w["officer"] == "O1" for w in s["log"])
    some = lambda s: any(w["knots"] >= 7 for w in s["log"]) and any(w["officer"] == "O1" for w in s["log"])
    assert [s["id"] for s in SHIPS if one(s)] != [s["id"] for s in SHIPS if some(s)]
    assert sorted(r["id"] for r in ask(Ship, {"id": {}, ">=log.knots": 7, "?log.officer": "O1"})) == [s["id"] for s in SHIPS if one(s)]


def test_criteria_on_localised_text_read_one_label(ask):
    label = lambda p: p["names"].get("no", p["names"]["en"])
    assert sorted(r["code"] for r in ask(Port, {"code": {}, "~names": "HAVN"}, ["no", "en"])) == [p["code"] for p in PORTS if "havn" in label(p).lower()]
    assert not ask(Port, {"code": {}, "~names": "harbour"}) and not ask(Port, {"code": {}, "~names": "harbour"}, [])
    assert numbers(ask(Voyage, {"number": {}, "~remark": "seas"}, ["en"])) == [v["number"] for v in VOYAGES if "remark" in v]
    own = ask(Port, {"code": {}, "?names": {"no": ["Havn 1", "Havn 3"], "en-GB": "Dock 10"}})
    assert sorted(r["code"] for r in own) == [p["code"] for p in PORTS if p["names"].get("no") in ("Havn 1", "Havn 3") or p["names"].get("en-GB") == "Dock 10"]


# --- cells and groups


def bag(rows):
    return Counter(tuple(sorted((k, str(v)) for k, v in r.items())) for r in rows)


def test_several_valued_cells_multiply(ask):
    want = [{"n": v["number"], "c": c, "p": p} for v in VOYAGES if v["papers"] for c in v["calls"] for p in v["papers"]]
    have = ask(Voyage, {"n=number": {}, "c=calls": {}, "p=papers": {}})
    assert bag(r for r in have if "p" in r) == bag(want) and bag(r for r in have if "p" not in r) == bag({"n": v["number"], "c": c} for v in VOYAGES if not v["papers"] for c in v["calls"])


def test_groups(ask):
    have = ask(Voyage, {"kind=kind": {}, "n=count:number": {}, "sum=sum:tide": {}, "mean=avg:tide": {}, "first=min:sails": {}, "chars=sum:length:papers": {}, "top=round:max:tide": {}})
    assert len(have) == 3
    for r in have:
        own = [v for v in VOYAGES if v["kind"] == r["kind"]]
        rows = [v for v in own for _ in v["papers"] or [None]]
        tides = [v["tide"] for v in rows if "tide" in v]
        assert r["n"] == len(rows) and r["sum"] == pytest.approx(sum(tides)) and r.get("mean") == (pytest.approx(sum(tides) / len(tides)) if tides else None)
        assert str(r["first"]) == min(v["sails"] for v in own if "sails" in v) and r["chars"] == sum(len(p) for v in own for p in v["papers"])
        assert r.get("top") == (math.floor(max(tides) + 0.5) if tides else None)


def test_what_is_absent_is_a_group(ask):
    months = ask(Voyage, {"m=month:sails": {}, "n=count:number": {}})
    assert {r.get("m"): r["n"] for r in months} == Counter(int(v["sails"][5:7]) if "sails" in v else None for v in VOYAGES)
    fares = ask(Voyage, {"f=fare": {}, "n=count:": {}})
    assert sum(r["n"] for r in fares if "f" not in r) == sum("fare" not in v for v in VOYAGES) and sum(r["n"] for r in fares) == len(VOYAGES)
    ports = Counter(p for v in VOYAGES for p in v["calls"])
    kept = ask(Voyage, {"p=calls": {}, "n=count:id": {}, ">=count:id": 4, "^count:id": -1})
    assert [(r["p"], r["n"]) for r in kept] == sorted(((p, n) for p, n in ports.items() if n >= 4), key=lambda x: (-x[1], x[0]))


def test_aggregates_of_everything_and_of_nothing(ask):
    assert ask(Voyage, {"n=count:": {}, "s=sum:tide": {}, "a=avg:tide": {}, ">number": 10**6}) == [{"n": 0, "s": 0.0}]
    assert ask(Ship, {"n=count:owner": {}, "low=min:id": {}, "c=count:length:owner": {}}) == [{"n": 3, "c": 2}]
    assert ask(Ship, {"h=hours:bell": {}, "m=minutes:bell": {}, "s=seconds:bell": {}, "y=year:bell": {}, "?id": "/ships/S0"}) == [{"h": 8, "m": 30, "s": 15.5}]


def test_cells_with_templates_and_locale_maps(ask):
    have = {r["n"]: r for r in ask(Voyage, {"n=number": {}, "s=ship": {"sign": {}, "home": {"code": {}}}, "t=notes": {"*": {}}, "?number": [100, 101]})}
    assert have[100] == {"n": 100, "s": {"sign": "S0", "home": {"code": "P00"}}, "t": VOYAGES[0]["notes"]} and have[101]["s"]["home"] == {"code": "P02"}
    per = ask(Ship, {"ship=": {"sign": {}}, "n=count:voyages": {}})
    assert {r["ship"]["sign"]: r["n"] for r in per} == {s["sign"]: sum(v["ship"] == s["id"] for v in VOYAGES) for s in SHIPS}


# --- templates


def test_templates_nest(catalog):
    model = {"type": {}, "ship": {"sign": {}, "log": {"knots": {}}, "owner": {"0": {"family": {}}, "1": {}}}, "calls": {"code": {}, "hub": {"code": {}}}, "cargo": {"0": {"tons": {}}, "1": {"berth": {}}}, "sails": {}}
    found = lookup_many(catalog, Voyage, ["/voyages/101", "/nowhere"], model).collect()
    assert len(found) == 1
    own = decode(found[0])
    assert own["type"] == "Voyage" and own["ship"] == {"sign": "S1", "log": [{"knots": 7}], "owner": {"family": "Berg"}} and str(own["sails"]) == "2031-02-02"
    assert sorted(map(str, own["calls"])) == sorted(map(str, [{"code": "P01"}, {"code": "P04", "hub": {"code": "P01"}}])) and sorted(map(str, own["cargo"])) == sorted(map(str, [{"tons": 10}, {"berth": "B1"}]))
    place = lambda k, m: decode(lookup_many(catalog, Port, [f"/ports/P{k:02}"], m).first())
    assert place(5, {"fix": {"north": {}}, "names": {"EN": {}}}) == {"id": "/ports/P05", "fix": {"north": 55.0}, "names": {"en": "Harbour 5", "en-GB": "Dock 5"}} and "fix" not in place(4, {"fix": {"north": {}}})


def test_labels(catalog):
    own = lambda k, locale: decode(lookup_many(catalog, Port, [f"/ports/P{k:02}"], {"names": {}}, locale).first()).get("names")
    assert [own(1, ["no", "en"]), own(2, ["no", "en"]), own(1, None), own(1, [])] == ["Havn 1", "Harbour 2", None, None]
    notes = decode(lookup_many(catalog, Voyage, ["/voyages/102"], {"notes": {}}, ["no", "en"]).first())
    assert notes["notes"] == ["rolig"]


def test_each_owner_has_its_own_slice(catalog):
    order = lambda s: sorted((v for v in VOYAGES if v["ship"] == s), key=lambda v: (-v.get("tide", -99), v["id"]))
    model = {"number": {}, "^tide": -1, "@": 1, "#": 2}
    for r in members(catalog, Ship, "voyages", model).collect():
        assert [x["number"] for x in r["items"]] == [v["number"] for v in order(r["owner"])[1:3]]
    flat = members(catalog, Ship, "voyages", model, flat=True).collect()
    assert sorted((r["owner"], r["rank"], r["item"]["number"]) for r in flat) == sorted((s["id"], k, v["number"]) for s in SHIPS for k, v in list(enumerate(order(s["id"]), 1))[1:3])
    papers = members(catalog, Voyage, "papers", {"^": -1, "#": 1}).collect()
    assert {r["owner"]: r["items"] for r in papers} == {v["id"]: [max(v["papers"])] for v in VOYAGES if v["papers"]}
    sums = members(catalog, Ship, "voyages", {"n=count:": {}, "s=sum:number": {}}).collect()
    assert {r["owner"]: (r["items"][0]["n"], r["items"][0]["s"]) for r in sums} == {s["id"]: (len(own := [v["number"] for v in VOYAGES if v["ship"] == s["id"]]), sum(own)) for s in SHIPS}


def test_owners_rows_are_numbered_only_for_an_order_or_a_slice(catalog, capsys):
    for model, numbered in (({"number": {}}, False), ({"number": {}, ">number": 3}, False), ({"number": {}, "^tide": 1}, True), ({"number": {}, "#": 2}, True)):
        members(catalog, Ship, "voyages", model, flat=True).explain()
        out = capsys.readouterr().out
        assert ("row_number" in out or "__at" in out) == numbered  # by a window, or by ranges that were sorted and counted
    flat = members(catalog, Ship, "voyages", {"number": {}}, flat=True)
    assert flat.where("rank is not null").count() == 0 and flat.count() == len(VOYAGES)
    plain = {r["owner"]: [x["number"] for x in r["items"]] for r in members(catalog, Ship, "voyages", {"number": {}}).collect()}
    assert plain == {s["id"]: [v["number"] for v in VOYAGES if v["ship"] == s["id"]] for s in SHIPS[:4]}


def test_a_union_collection_keeps_the_variants_asked_for(catalog):
    have = members(catalog, Voyage, "cargo", {"1": {"berth": {}}}).collect()
    assert {r["owner"]: decode(r["items"]) for r in have} == {f"/voyages/{100 + k}": [{"berth": f"B{k}"}] for k in range(3)}


def test_virtual_collections_are_frames(catalog):
    line = Shape("Line", {"ships": multiple(Reference(lambda: Ship), Linked("x", "a", "b")), "all": multiple(Reference(lambda: Port), Linked("x", "a", "b"))})
    out = virtual(catalog, "/line", line, {"id": {}, "type": {}, "ships": {"sign": {}, "^sign": -1}, "all": {"n=count:": {}}}, limit=2)
    assert (out["id"], out["type"]) == ("/line", "Line") and [r["sign"] for r in out["ships"].collect()] == ["S4", "S3"] and out["all"].first()["n"] == len(PORTS)


# --- order


def test_order(ask):
    of = lambda model: [r["number"] for r in ask(Voyage, {"number": {}, **model})]
    by = lambda key: [v["number"] for v in sorted(VOYAGES, key=lambda v: (*key(v), v["id"]))]
    assert of({"^kind": 1, "^tide": -2}) == by(lambda v: (v["kind"], -v.get("tide", -99)))
    assert of({"^tide": "desc", "@": 2, "#": 15}) == by(lambda v: (-v.get("tide", -99),))[2:17]
    assert of({"+kind": ["tramp"], "^count:papers": -1, "#": 0}) == by(lambda v: (v["kind"] != "tramp", -len(v["papers"])))


def test_mixed_values_are_ordered_by_tier(ask):
    tier = lambda v: 0 if "fare" not in v else 1 if isinstance(v["fare"], bool) else 2 if number(v) is not None else 3 if v["fare"][0] == "2" else 4
    want = sorted(VOYAGES, key=lambda v: (tier(v), number(v) or 0, v["id"]))
    assert [r["number"] for r in ask(Voyage, {"number": {}, "^fare": 1})] == [v["number"] for v in want]
    assert [r["id"] for r in ask(Port, {"id": {}, "^ice": 1, "#": 3})] == [p["id"] for p in PORTS if not p["ice"]][:3]


def test_supertypes(ask):
    assert len(ask(Asset, {"id": {}})) == len(SHIPS) + len(voyages.CRATES)
    assert sorted(r["id"] for r in ask(Asset, {"id": {}, "?type": ["Crate"], ">=insured": 5})) == [c["id"] for c in voyages.CRATES]


# --- what is turned away


@pytest.mark.parametrize(
    "model",
    [
        {"~number": "x"}, {"<ship": 1}, {"^calls": 1}, {"+ship.log.knots": [1]}, {">tide": "high"}, {">sails": "soon"}, {"odd": {}}, {"?odd": 1}, {"?odd:tide": 1}, {"?sum:max:tide": 1}, {"@": -1}, {"#": 1.5}, {"a=year:tide": {}}, {"a=length:tide": {}}, {"a=abs:kind": {}},
        {"a=kind": {}, "kind": {}}, {"a=id.kind": {}}, {"a=min:ship": {}}, {"a=sum:kind": {}}, {"a=kind": {}, "n=count:id": {}, "^tide": 1}, {"notes": {"no-*-x": {}}}, {"?notes": {"en": 5}}, {"cargo": {"0": {"odd": {}}}}, {"0": {}, "x=kind": {}}, {"a b": {}},
    ],
)
def test_rejections(ask, model):
    with pytest.raises(ShapeError):
        ask(Voyage, model)


@pytest.mark.parametrize(
    "model,caps",
    [
        ({"n=count:id": {}}, {"plain": True}), ({"calls": {"n=count:": {}}}, {"plain": True}), ({"a=ship.sign": {}}, {"depth": 1}), ({"ship": {"sign": {}}}, {"depth": 0}), ({"ship": {"home": {"code": {}}}}, {"depth": 1}), ({"calls": {"?hub.code": "x"}}, {"depth": 1}),
        ({"#": 50}, {"limit": 10}), ({"#": 0}, {"limit": 10}), ({"calls": {"#": 0}}, {"limit": 10}), ({"calls": {"code": {}, "#": 11}}, {"limit": 10}), ({"ship": {"voyages": {"#": 11}}}, {"limit": 10}),
    ],
)
def test_caps_reject(ask, catalog, model, caps):
    with pytest.raises(ShapeError):
        ask(Voyage, model, **caps)
    if not any(k[0] in "@#?" or "=" in k for k in model):
        with pytest.raises(ShapeError):
            lookup_many(catalog, Voyage, ["/voyages/100"], model, **caps)


def test_caps_hold_where_a_model_has_no_limit(ask, catalog):
    assert len(ask(Voyage, {"id": {}}, limit=7)) == 7 and len(ask(Voyage, {"id": {}, "#": 0})) == 20
    nested = ask(Ship, {"id": {}, "voyages": {"number": {}}, "log": {"knots": {}}}, limit=3)
    assert [[x["number"] for x in r["voyages"]] for r in nested] == [[100 + k, 104 + k, 108 + k] for k in range(3)] and [len(r.get("log", [])) for r in nested] == [0, 1, 2]
    one = decode(lookup_many(catalog, Ship, ["/ships/S4"], {"log": {}}, limit=2).first())
    assert len(one["log"]) == 2
    assert ask(Voyage, {"ship": {}, "calls": {}, "notes": {"en": {}}, "#": 1}, depth=0)[0]["ship"] == "/ships/S0"
    assert "home" in ask(Voyage, {"ship": {"home": {}}, "#": 1}, depth=1)[0]["ship"]


def test_link_tables_join_unions(spark, catalog):
    """A link table whose items are of two classes, along a path and as a collection."""
    own = Shape("Line", {"parts": multiple(voyages.Union((Reference(lambda: Ship), Reference(lambda: Guest))), Linked("parts", "line", "item"))})
    c = catalog.copy()
    c.bind(own, spark.createDataFrame([("/lines/1",)], "id string"))
    c.link("parts", spark.createDataFrame([("/lines/1", ("/ships/S1", None)), ("/lines/1", (None, "/guests/2"))], "line string, item struct<v0:string,v1:string>"))
    rows = select(c, own, {"sign=parts.sign": {}, "berth=parts.berth": {}}).collect()
    assert {(r["sign"], r["berth"]) for r in rows} == {("S1", None), (None, "B2")}
    assert [r["id"] for r in select(c, own, {"id": {}, "?parts.berth": "B2"}).collect()] == ["/lines/1"]
    flat = members(c, own, "parts", {"0": {"sign": {}}, "1": {"berth": {}}}, flat=True).select(F.col("item.v0.sign").alias("s"), F.col("item.v1.berth").alias("b")).collect()
    assert {tuple(r) for r in flat} == {("S1", None), (None, "B2")}
