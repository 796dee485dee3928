"""Pairs that are many times their sides: what a person deals with, and links over them."""

from itertools import groupby

import pytest
from pyspark.sql import functions as F

from facetry.sources.tables import DEALINGS, Dealer, Person, ledger
from facetry.store import Store
from test_scale import rows_of


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """A folder with two lands, people and dealers, each table in one file."""
    folder = f"file://{tmp_path_factory.mktemp('world')}"
    one = lambda df, name: df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    one(spark.range(2).selectExpr("cast(id as int) n_nationkey", "concat('n', id) n_name", "cast(id as int) n_regionkey"), "nation")
    one(spark.range(400).selectExpr("id c_custkey", "concat('c', id) c_name", "cast(if(id = 7, null, id % 2) as int) c_nationkey", "0d c_acctbal", "'x' c_mktsegment"), "customer")
    one(spark.range(50).selectExpr("id s_suppkey", "concat('s', id) s_name", "cast(id % 2 as int) s_nationkey", "0d s_acctbal"), "supplier")
    one(spark.range(100).selectExpr("id o_orderkey", "id * 3 o_custkey", "'O' o_orderstatus", "1d o_totalprice", "timestamp'2000-01-01' o_orderdate", "'1-URGENT' o_orderpriority"), "orders")
    return folder


def test_pairs_of_one_file_and_few_lands_are_made_by_many_tasks(spark, world):
    df = ledger(spark, world).table("dealings")
    want = sorted((c, s) for c in range(400) for s in range(50) if c != 7 and c % 2 == s % 2)
    assert sorted((r["person"], r["dealer"]) for r in df.collect()) == want
    tasks = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 8 and max(tasks) < len(want) / 4


def state(catalog):
    return sorted((r["person"], r["dealer"]) for r in catalog.table("dealings").collect())


def numbers(spark, *pairs):
    return spark.createDataFrame(pairs, "person long, dealer long")


def test_links_are_added_and_taken_without_dealing_out_the_table(spark, world):
    store = Store(ledger(spark, world))
    want = set(state(store.catalog))
    steps = [((1, 2), (0, 2), (7, 1), (999, 1), (7, 1), (None, 1)), ((2, 4), (5, 5), (7, 1)), ((7, 1), (3, 3), (999, 1), (999, 2))]
    store.link_all(DEALINGS, numbers(spark, *steps[0]))
    want |= set(steps[0])
    key = lambda rows: sorted(rows, key=str)
    assert key((r["person"], r["dealer"]) for r in store.catalog.table("dealings").collect()) == key(want)
    store.link_all(DEALINGS, numbers(spark, *steps[1]), gone=True)
    want -= set(steps[1])
    store.remove_all(Dealer, spark.createDataFrame([(9,)], "id long"))
    store.remove_all(Person, spark.createDataFrame([(3,)], "id long"))
    want = {(p, d) for p, d in want if d != 9 and p != 3}
    store.link_all(DEALINGS, numbers(spark, *steps[2], (3, 9), (5, 9), (5, 5), (2, 6)))
    want |= {*steps[2], (3, 9), (5, 9), (5, 5), (2, 6)}
    df = store.catalog.table("dealings")
    assert key((r["person"], r["dealer"]) for r in df.collect()) == key(want)
    # all that is shuffled by person and dealer are the new pairs: the optimised plan groups nothing above the join of the sides
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = next(k for k, x in enumerate(plan) if "Join Inner" in x and "__part" in x)
    assert not any("Aggregate" in x for x in plan[:made])


def test_dealers_that_go_make_no_pairs(spark, world):
    """No operator hands on more rows than there are pairs left, so the product is never larger than the result."""
    store = Store(ledger(spark, world))
    store.remove_all(Dealer, store.catalog.frame(Dealer).where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("id")))
    want = [(c, s) for c in range(400) for s in range(50) if c != 7 and c % 2 == s % 2 and s % 3]
    assert state(store.catalog) == sorted(want)
    assert rows_of(store.catalog.table("dealings")) == len(want)


def test_repeated_keys_are_told_once(spark, world, tmp_path):
    """A person that stands twice in the file makes pairs twice; links are a set from the first addition on."""
    c = ledger(spark, world)
    people = c.read(f"{world}/customer.parquet")
    twice = f"file://{tmp_path}"
    people.unionByName(people.where("c_custkey = 1")).write.parquet(f"{twice}/customer.parquet")
    for name in ("nation", "supplier", "orders"):
        c.read(f"{world}/{name}.parquet").write.parquet(f"{twice}/{name}.parquet")
    store = Store(ledger(spark, twice))
    assert len(state(store.catalog)) == len(set(state(store.catalog))) + 25
    store.link_all(DEALINGS, numbers(spark, (1, 1), (1, 2)))
    assert state(store.catalog) == sorted({*state(c), (1, 2)})


@pytest.fixture
def apart(spark):
    """Nothing is broadcast, as if each table was large."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_links_that_go_are_left_out_where_pairs_are_made(spark, world, apart, monkeypatch):
    """However many they are, pairs are not shuffled to meet them."""
    monkeypatch.setattr("facetry.sources.tables.PARTS", 2, raising=False)
    monkeypatch.setattr("facetry.sources.tables.RUN", 8, raising=False)
    store = Store(ledger(spark, world))
    want = {(c, s) for c in range(400) for s in range(50) if c != 7 and c % 2 == s % 2}
    steps = [{p for p in want if p[1] == 2} | {p for p in want if p[0] == 5} | {(0, 1), (7, 7), (999, 2)}, {(4, 4), (1, 2), (12, 6)}]
    for gone in steps:
        store.link_all(DEALINGS, numbers(spark, *gone, (None, 3)), gone=True)
        want -= gone
        df = store.catalog.table("dealings")
        assert state(store.catalog) == sorted(want)
        plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
        made = next(k for k, x in enumerate(plan) if "Join" in x and "__part" in x)
        assert not any("Exchange" in x for x in plan[:made])
        more = {(1, 2), (9, 2), (4, 6)}  # the first is new, and goes in the second step
        store.link_all(DEALINGS, numbers(spark, *more))
        want |= more
        assert state(store.catalog) == sorted(want)
    store.remove_all(Dealer, spark.createDataFrame([(6,)], "id long"))
    store.remove_all(Person, spark.createDataFrame([(3,)], "id long"))
    store.link_all(DEALINGS, numbers(spark, (8, 8), (9, 2)), gone=True)
    assert state(store.catalog) == sorted((p, d) for p, d in want - {(8, 8), (9, 2)} if p != 3 and d != 6)


def test_dealers_meet_the_same_people_in_runs(spark, world, monkeypatch):
    """The order of pairs is what keeps them small when they are written."""
    monkeypatch.setattr("facetry.sources.tables.PARTS", 1, raising=False)
    monkeypatch.setattr("facetry.sources.tables.RUN", 8, raising=False)
    runs = {}
    for part in ledger(spark, world).table("dealings").rdd.glom().collect():
        for dealer, rows in groupby(part, lambda r: r["dealer"]):
            runs.setdefault(tuple(r["person"] for r in rows), []).append(dealer)
    assert sorted(len(people) for people in runs) == [7] + [8] * 49
    assert all(len(dealers) == 25 for dealers in runs.values())


def test_a_task_has_few_runs_of_many_people(spark, world, monkeypatch):
    """Also when a person goes, whose run gets shorter by one."""
    for name, value in (("PARTS", 1), ("RUN", 8), ("RUNS", 2)):
        monkeypatch.setattr(f"facetry.sources.tables.{name}", value, raising=False)
    store = Store(ledger(spark, world))
    store.remove_all(Person, numbers(spark, (8, 0), (-5, 0)).select(F.col("person").alias("id")))
    df = store.catalog.table("dealings")
    assert df.rdd.getNumPartitions() == 400 // 16
    runs = [tuple(r["person"] for r in rows) for part in df.rdd.glom().collect() for _, rows in groupby(part, lambda r: r["dealer"])]
    assert len(runs) == 50 * 25 and sorted({len(x) for x in runs}) == [7, 8]
    assert state(store.catalog) == sorted((c, s) for c in range(400) for s in range(50) if c not in (7, 8) and c % 2 == s % 2)
