"""A shipping line, made up for these tests: ports under their hubs, ships with a log, voyages with what they carry."""

import datetime as dt

from pyspark.sql import types as T

from facetry.shapes import (
    Dictionary,
    Embedded,
    InColumn,
    Linked,
    Property,
    Reference,
    Reversed,
    Shape,
    Union,
    boolean,
    byte,
    date,
    decimal,
    duration,
    instant,
    integer,
    multiple,
    optional,
    required,
    schema,
    string,
    time,
    year,
)
from facetry.sources.catalog import Catalog
from facetry.store import blank, blank_link
from facetry.validate import members_of


def to(name, captive=False):
    return Reference(lambda: SHAPES[name], captive)


Fix = Shape("Fix", {"north": required(decimal, "north"), "east": required(decimal, "east")}, key=None)
Watch = Shape("Watch", {"at": required(instant, "at"), "knots": required(byte.limited(max_inclusive=40), "knots"), "officer": required(string, "officer")}, key=None)
Holder = Shape("Holder", {"family": required(string, "family"), "shares": required(integer, "shares")}, key=None)
Port = Shape(
    "Port",
    {
        "code": required(string.limited(min_length=3, max_length=3), "code"), "names": required(Dictionary(limits=(("max_length", 12),)), "names"), "ice": required(boolean, "ice"), "draught": optional(decimal.limited(min_exclusive=0), "draught"),
        "fix": optional(Embedded(Fix), "fix"), "hub": optional(to("Port"), "hub"), "spokes": multiple(to("Port"), Reversed("hub"), foreign=True),
    },
    pattern="/ports/{code}",
)
#: What can be insured.
Asset = Shape("Asset", {"insured": optional(decimal, "insured")})
Ship = Shape(
    "Ship",
    {
        "sign": required(string.limited(pattern="^[A-Z]"), "sign"), "built": optional(year, "built"), "bell": optional(time, "bell"), "home": optional(to("Port"), "home"), "log": multiple(Embedded(Watch), "log"),
        "owner": optional(Union((Embedded(Holder), string)), "owner"), "voyages": multiple(to("Voyage", captive=True), Reversed("ship"), foreign=True),
    },
    parents=(Asset,), pattern="/ships/{sign}",
)
Crate = Shape("Crate", {"tons": required(integer, "tons"), "bound": optional(to("Port"), "bound")}, parents=(Asset,))
Guest = Shape("Guest", {"berth": required(string, "berth"), "stay": required(duration, "stay"), "speaks": multiple(string, "speaks")})
Voyage = Shape(
    "Voyage",
    {
        "number": required(integer, "number"), "kind": required(string.limited(one_of=("liner", "tramp", "ferry")), "kind"), "ship": required(to("Ship"), "ship"), "sails": optional(date, "sails"), "tide": optional(decimal, "tide"),
        "fare": optional(Union((boolean, decimal.limited(min_inclusive=0), date, string)), "fare"), "papers": multiple(string, "papers", 0, 3), "notes": optional(Dictionary(many=True), "notes"), "remark": Property(Union((string, Dictionary())), InColumn("remark"), 0, 1),
        "calls": multiple(to("Port"), Linked("calls", "voyage", "port")), "cargo": multiple(Union((to("Crate", captive=True), to("Guest", captive=True))), "cargo"),
    },
    pattern="/voyages/{number}",
)
SHAPES = {s.name: s for s in (Port, Ship, Crate, Guest, Voyage)}
CALLS = Voyage.properties["calls"].storage
FLEET = Linked("fleet", "line", "ship")


def carried(crate=None, guest=None):
    return {"v0": crate, "v1": guest}


def _port(k):
    hub = {} if k < 2 else {"hub": f"/ports/P{(k - 2) // 2:02}"}
    names = {"en": f"Harbour {k}", **({"no": f"Havn {k % 4}"} if k % 2 else {}), **({"en-GB": f"Dock {k}"} if k % 5 == 0 else {})}
    return {"id": f"/ports/P{k:02}", "code": f"P{k:02}", "names": names, "ice": k % 3 == 0, **({"draught": 4.5 + k} if k % 4 else {}), **({"fix": {"north": 50 + k, "east": 0.5 * k}} if k % 2 else {}), **hub}


def _ship(k):
    at = dt.datetime(2031, 3, 1, tzinfo=dt.UTC)
    return {
        "id": f"/ships/S{k}", "sign": f"S{k}", "insured": 1000.0 * k, **({"built": str(1988 + 7 * k)} if k != 3 else {}), **({"bell": ("08:30:15.5", "10:00:00")[k]} if k < 2 else {}), "home": f"/ports/P{2 * k:02}",
        "log": [{"at": at + dt.timedelta(hours=5 * (k + i)), "knots": (7 * k + 5 * i) % 20, "officer": f"O{(k + i) % 3}"} for i in range(k)], **({"owner": ("Private HANDS", {"family": "Berg", "shares": 60}, "State")[k]} if k < 3 else {}),
    }


def _voyage(k):
    calls = [f"/ports/P{k % 6:02}", *([f"/ports/P{(3 * k + 1) % 12:02}"] if k % 5 and (3 * k + 1) % 12 != k % 6 else [])]
    fares = [{"fare": 12.5 + k}, {"fare": True}, {"fare": "on request"}, {"fare": "2031-05-05"}, {}, {"fare": 3}]
    return {
        "id": f"/voyages/{100 + k}", "number": 100 + k, "kind": ("liner", "tramp", "ferry")[k % 3], "ship": f"/ships/S{k % 4}", **({"sails": f"2031-{1 + k % 12:02}-{1 + k:02}"} if k % 4 != 3 else {}), **({"tide": (k % 5) - 2.5} if k % 3 else {}), **fares[k % 6],
        "papers": [f"doc-{j}" for j in range(k % 4)], "notes": {"en": [f"n{k % 3}", *(["calm"] if k % 2 == 0 else [])], **({"no": ["rolig"]} if k % 2 == 0 else {})},
        **({"remark": "steady seas"} if k % 3 == 0 else {"remark": {"en": "rough seas", "no": "grov sjø"}} if k % 3 == 1 else {}), "calls": calls, **({"cargo": [carried(f"/crates/{k}"), carried(None, f"/guests/{k}")]} if k < 3 else {}),
    }


PORTS, SHIPS, VOYAGES = [_port(k) for k in range(12)], [_ship(k) for k in range(5)], [_voyage(k) for k in range(20)]
CRATES = [{"id": f"/crates/{k}", "tons": 10 * k, "insured": 5.0, "bound": f"/ports/P{k:02}"} for k in range(4)]
GUESTS = [{"id": f"/guests/{k}", "berth": f"B{k}", "stay": "P3D", "speaks": ["no", "en"][: k % 3]} for k in range(4)]
ROWS = {"Port": PORTS, "Ship": SHIPS, "Crate": CRATES, "Guest": GUESTS, "Voyage": VOYAGES}


def empty_catalog(spark):
    c = Catalog(spark)
    for s in SHAPES.values():
        c.bind(s, blank(s, spark))
    return c.link("calls", blank_link(CALLS, spark)).link("fleet", blank_link(FLEET, spark))


def frame(spark, shape, rows):
    """Rows as the frame of a class; what a voyage carries is given as it is stored."""
    kind = schema(shape)
    names = {p.storage.name: n for n, p in shape.properties.items() if isinstance(p.storage, InColumn)}
    data = []
    for r in rows:
        own = members_of(shape, {k: v for k, v in r.items() if k != "cargo"}) | ({"cargo": r["cargo"]} if "cargo" in r else {})
        data.append(tuple(r["id"] if f.name == "id" else own.get(names[f.name]) for f in kind.fields))
    return spark.createDataFrame(data, T.StructType([T.StructField(f.name, f.dataType) for f in kind.fields]))


def catalog(spark):
    c = empty_catalog(spark)
    for name, rows in ROWS.items():
        c.bind(SHAPES[name], frame(spark, SHAPES[name], rows).cache())
    return c.link("calls", spark.createDataFrame([(v["id"], p) for v in VOYAGES for p in v["calls"]], "voyage string, port string").cache())
