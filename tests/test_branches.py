"""Projections along independent multi-valued paths: distinct cells, without the product of the paths' rows."""

import re

import pytest

from facetry.engine import select
from facetry.sources.tables import Nation, Part, catalog

CUSTOMERS = "nation LEFT JOIN customer ON c_nationkey = n_nationkey"
BOTH = f"{CUSTOMERS} LEFT JOIN supplier ON s_nationkey = n_nationkey"
CASES = {
    "segments": (Nation, {"segment=customers.segment": {}, "supplier=suppliers": {}}, f"SELECT DISTINCT c_mktsegment AS segment, s_suppkey AS supplier FROM {BOTH}"),
    "filtered": (Nation, {"nation=name": {}, "segment=customers.segment": {}, "supplier=suppliers.name": {}, ">customers.acctbal": 5000, "<suppliers.acctbal": 5000}, f"SELECT DISTINCT n_name AS nation, c_mktsegment AS segment, s_name AS supplier FROM {BOTH} WHERE c_acctbal > 5000 AND s_acctbal < 5000"),
    "filter alone": (Nation, {"region=region.name": {}, "segment=customers.segment": {}, ">suppliers.acctbal": 0}, f"SELECT DISTINCT r_name AS region, c_mktsegment AS segment FROM {BOTH} JOIN region ON r_regionkey = n_regionkey WHERE s_acctbal > 0"),
    "same branch": (Nation, {"segment=customers.segment": {}, "priority=customers.orders.priority": {}, "n=suppliers.nation": {}}, f"SELECT DISTINCT c_mktsegment AS segment, o_orderpriority AS priority, s_nationkey AS n FROM {BOTH} LEFT JOIN orders ON o_custkey = c_custkey"),
    "divided": (Nation, {"nation=": {}, "segment=customers.segment": {}, "supplier=suppliers": {}, "!customers.segment": ["BUILDING", "MACHINERY"], "!region": 2}, f"SELECT DISTINCT n_nationkey AS nation, c_mktsegment AS segment, s_suppkey AS supplier FROM {BOTH} WHERE n_regionkey = 2 AND n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING') AND n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'MACHINERY')"),
    "linked": (Part, {"brand=brand": {}, "nation=suppliers.nation": {}, "flag=items.returnflag": {}}, "SELECT DISTINCT p_brand AS brand, s_nationkey AS nation, a.l_returnflag AS flag FROM part LEFT JOIN lineitem b ON b.l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = b.l_suppkey LEFT JOIN lineitem a ON a.l_partkey = p_partkey"),
    "ordered": (Nation, {"nation=": {}, "segment=customers.segment": {}, "supplier=suppliers": {}, "^name": 1, "#": 7}, None),
}


@pytest.mark.parametrize("name", [n for n, c in CASES.items() if c[2]])
def test_same_as_the_product(spark, sf_dir, name):
    import duckdb

    shape, model, sql = CASES[name]
    con = duckdb.connect()
    for t in ("nation", "region", "customer", "supplier", "orders", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    df = select(catalog(spark, sf_dir), shape, model)
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == sorted(map(repr, found.fetchall()))


def test_slices_are_as_before(spark, sf_dir):
    shape, model, _ = CASES["ordered"]
    assert select(catalog(spark, sf_dir), shape, model).count() == 7


def test_the_product_is_never_made(spark, sf_dir):
    """Cells of a branch are distinct below the join of the branches."""
    df = select(catalog(spark, sf_dir), Nation, {"nation=": {}, "segment=customers.segment": {}, "supplier=suppliers": {}})
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda x: re.search(r"[A-Z]", x).start()
    segment = next(k for k, x in enumerate(plan) if "Relation" in x and "c_mktsegment" in x)
    above, reach = [], depth(plan[segment])
    for x in reversed(plan[:segment]):
        if depth(x) < reach:
            above.append(x.strip(" :+-"))
            reach = depth(x)
    joins = [k for k, x in enumerate(above) if x.startswith("Join")]
    assert any(x.startswith("Aggregate") for x in above[: joins[1]]), "\n".join(plan)
