"""One query for each operator over the driver tables, as a model, and SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batching import lookup_requests
from .checks import breaches
from .engine import detect, lookup_many, members, select, virtual
from .shapes import Linked, Reference, Shape, multiple
from .sources.tables import DEALINGS, Bill, Conversation, Customer, Dealer, Document, Event, Label, Land, LineItem, Nation, Order, Part, Party, Person, Region, Supplier, catalog, ledger
from .sources.textindex import TextIndex
from .store import Store
from .streaming.events import latest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _model(name: str, shape, model: dict, sql: str, locale: list[str] | None = None, rounded: tuple[str, ...] = (), **more) -> None:
    """Registers a model over a class; `rounded`: sums and averages of doubles, whose last bits depend on the order."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = select(catalog(spark, sf_dir), shape, model, locale, **more)
        return df.withColumns({c: F.round(c, 2) for c in rounded}) if rounded else df

    _QUERIES[name], _SQL[name] = run, sql


def _query(name: str, sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[name], _SQL[name] = f, sql
        return f

    return register


#: The flagship: orders by priority, filtered, reduced, ordered and cut.
FACET = {"priority=priority": {}, "cnt=count:id": {}, ">=total": 1000, ">=count:id": 2, "^count:id": -1, "^priority": 2, "#": 5}
_model("facet", Order, FACET, "SELECT o_orderpriority AS priority, count(*) AS cnt FROM orders WHERE o_totalprice >= 1000 GROUP BY 1 HAVING count(*) >= 2 ORDER BY cnt DESC, priority LIMIT 5")

# --- scans, templates, projections
_model("scan_template", Customer, {"id": {}, "name": {}, "acctbal": {}}, "SELECT c_custkey AS id, c_name AS name, c_acctbal AS acctbal FROM customer")
_model("scan_bare", Region, {}, "SELECT r_regionkey AS id FROM region")
_model("scan_subtypes", Party, {"id": {}, "name": {}}, "SELECT '/c/' || c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT '/s/' || s_suppkey, s_name FROM supplier")
_model("match_type", Party, {"id": {}, "acctbal": {}, "?type": ["Seller"]}, "SELECT '/s/' || s_suppkey AS id, s_acctbal AS acctbal FROM supplier")
_model("match_supertype", Party, {"n=count:": {}, "?type": ["Party"]}, "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n")
_model("type_marker", Order, {"id": {}, "type": {}, "?status": "F"}, "SELECT o_orderkey AS id, 'Order' AS type FROM orders WHERE o_orderstatus = 'F'")
_model("template_reference", Customer, {"id": {}, "nation": {}}, "SELECT c_custkey AS id, c_nationkey AS nation FROM customer")
_model("project_scalar", Part, {"id=": {}, "brand=brand": {}, "size=size": {}}, "SELECT p_partkey AS id, p_brand AS brand, CAST(p_size AS INTEGER) AS size FROM part")
_model("project_distinct", Part, {"brand=brand": {}, "ptype=ptype": {}}, "SELECT DISTINCT p_brand AS brand, p_type AS ptype FROM part")
_model("project_path", Order, {"order=": {}, "region=customer.nation.region.name": {}}, "SELECT o_orderkey AS \"order\", r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_model("project_computed", Order, {"year=year:date": {}, "month=month:date": {}}, "SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month FROM orders")


@_query("template_nested", "SELECT c_custkey AS id, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    out = select(catalog(spark, d), Customer, {"id": {}, "nation": {"name": {}, "region": {"name": {}}}})
    return out.select("id", F.col("nation.name").alias("nation"), F.col("nation.region.name").alias("region"))


@_query("template_cell", "SELECT DISTINCT c_nationkey AS id, n_name AS name, c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    out = select(catalog(spark, d), Customer, {"n=nation": {"id": {}, "name": {}}, "segment=segment": {}})
    return out.select("n.id", "n.name", "segment")


@_query("lookup_held", "SELECT c_custkey AS id, c_name AS name, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IN (3, 5, 8)")
def _(spark, d):
    out = lookup_many(catalog(spark, d), Customer, [3, 5, 8, -1], {"name": {}, "nation": {"name": {}}})
    return out.select("id", "name", F.col("nation.name").alias("nation"))


@_query("lookup_batched", "SELECT DISTINCT o_orderkey AS id, o_totalprice AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 45")
def _(spark, d):
    c = catalog(spark, d)
    entries = c.frame(LineItem).where("l_quantity >= 45").select(F.col("l_orderkey").alias("id"))
    return lookup_many(c, Order, entries, {"total": {}})


@_query("detect", "SELECT p_partkey * 3 AS id, p_partkey * 3 IN (SELECT o_orderkey FROM orders) AS present FROM part")
def _(spark, d):
    c = catalog(spark, d)
    return detect(c, Order, c.frame(Part).select((F.col("p_partkey") * 3).alias("id")))


# --- filters
for _name, _key, _value, _where in (
    ("filter_lt", "<total", 20000, "o_totalprice < 20000"), ("filter_gt", ">total", 480000, "o_totalprice > 480000"), ("filter_lte", "<=total", 20000.5, "o_totalprice <= 20000.5"), ("filter_gte", ">=total", 480000, "o_totalprice >= 480000"),
    ("filter_string_cmp", ">priority", "4", "o_orderpriority > '4'"), ("filter_temporal", ">=date", "1999-06-01", "o_orderdate >= TIMESTAMP '1999-06-01'"),
    ("filter_like_tokens", "~priority", "SPECIFIED not", "contains(lower(o_orderpriority), 'specified') AND contains(lower(o_orderpriority), 'not')"),
    ("filter_any", "?priority", ["1-URGENT", "2-HIGH", "none", 7], "o_orderpriority IN ('1-URGENT', '2-HIGH')"), ("filter_any_temporal", "?date", ["1998-10-03", "1997-05-28T00:00:00"], "o_orderdate IN (TIMESTAMP '1998-10-03', TIMESTAMP '1997-05-28')"),
    ("filter_id", "?id", [1, 2, 3, 10**9], "o_orderkey IN (1, 2, 3, 1000000000)"), ("filter_path", "?customer.nation.region.name", "ASIA", "o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')"),
    ("filter_transform", ">=year:date", 2000, "year(o_orderdate) >= 2000"), ("filter_empty_options", "?priority", [], "true"), ("filter_all_single", "!status", ["F"], "o_orderstatus = 'F'"), ("filter_all_unsatisfiable", "!status", ["F", "O"], "false"),
):
    _model(_name, Order, {"id": {}, "total": {}, _key: _value}, f"SELECT o_orderkey AS id, o_totalprice AS total FROM orders WHERE {_where}")
_model("filter_any_null", Document, {"id": {}, "?label.quality": [None, 0]}, "SELECT doc_id AS id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality = 0")
_model("filter_multi", Customer, {"id": {}, ">orders.total": 499000}, "SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 499000)")
_model("same_value_conjunction", Customer, {"id": {}, ">orders.total": 480000, "?orders.priority": "1-URGENT", "<year:orders.date": 1998}, "SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000 AND o_orderpriority = '1-URGENT' AND year(o_orderdate) < 1998)")
_model("all_of_values", Customer, {"id": {}, "!orders.priority": ["1-URGENT", "5-LOW"]}, "SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')")
_model("all_of_path", Customer, {"id": {}, "!year:orders.date": [1996, 1997, 1998]}, "SELECT o_custkey AS id FROM orders WHERE year(o_orderdate) IN (1996, 1997, 1998) GROUP BY 1 HAVING count(DISTINCT year(o_orderdate)) = 3")
_model("all_null", Order, {"id": {}, "!items": [None]}, "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
_model("all_of_aggregate", Customer, {"id": {}, "!count:orders": [10]}, "SELECT o_custkey AS id FROM orders GROUP BY 1 HAVING count(*) = 10")

# --- joins and fan-out
_model("join_required", LineItem, {"flag=returnflag": {}, "brand=part.brand": {}, "n=count:quantity": {}, "?part.size": [1, 2]}, "SELECT l_returnflag AS flag, p_brand AS brand, count(l_quantity) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size IN (1, 2) GROUP BY 1, 2")
_model("join_optional", Document, {"id=": {}, "quality=label.quality": {}}, "SELECT doc_id AS id, CAST(quality AS INTEGER) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
_model("join_reverse", Nation, {"nation=name": {}, "customer=customers": {}}, "SELECT DISTINCT n_name AS nation, c_custkey AS customer FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey")
_model("fanout_one", Customer, {"customer=": {}, "priority=orders.priority": {}}, "SELECT DISTINCT c_custkey AS customer, o_orderpriority AS priority FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
_model("fanout_cross", Nation, {"nation=": {}, "segment=customers.segment": {}, "supplier=suppliers": {}}, "SELECT DISTINCT n_nationkey AS nation, c_mktsegment AS segment, s_suppkey AS supplier FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey")

# --- many lookups as one plan
_ASKED = ({"name": {}}, {"name": {}, "acctbal": {}}, {"segment": {}, "nation": {"name": {}}}, {"nation": {"region": {"name": {}}}, "acctbal": {}}, {"id": {}, "segment": {}})


@_query("lookup_merged", """
    SELECT r AS request, c_custkey AS id, CASE WHEN r % 5 IN (0, 1) THEN c_name END AS name, CASE WHEN r % 5 IN (1, 3) THEN c_acctbal END AS acctbal, CASE WHEN r % 5 IN (2, 4) THEN c_mktsegment END AS segment,
        CASE WHEN r % 5 IN (2, 3) THEN n_name END AS nation, CASE WHEN r % 5 IN (2, 3) THEN r_name END AS region
    FROM range(0, 200) t(r) JOIN customer ON c_custkey = r * 3 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def _(spark, d):
    """Two hundred requests for customers under five templates, which merge into one; nation's record serves two of them."""
    (df,) = lookup_requests(catalog(spark, d), Customer, [(3 * k, _ASKED[k % 5]) for k in range(200)])
    return df.select("request", "id", "name", "acctbal", "segment", F.col("nation.name").alias("nation"), F.col("nation.region.name").alias("region"))


# --- text search through an index
@_query("text_index", "SELECT doc_id AS id, lang FROM documents WHERE contains(lower(text), 'thtion') AND contains(lower(text), 'anea')")
def _(spark, d):
    c = catalog(spark, d)
    c.indexed(Document, "text", TextIndex.build(c.frame(Document), "doc_id", "text", buckets=16))
    return select(c, Document, {"id": {}, "lang": {}, "~text": "THTION anea"})


# --- pages without an end or far down: ranks found range by range
_model("page_rest", Order, {"id": {}, "total": {}, "^total": -1, "@": 900}, "SELECT o_orderkey AS id, o_totalprice AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 900")
_model("page_rest_groups", Order, {"customer=customer": {}, "n=count:id": {}, "^count:id": -1, "@": 30}, "SELECT o_custkey AS customer, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, customer OFFSET 30")
_model("page_deep", LineItem, {"part=part": {}, "quantity=quantity": {}, "^quantity": 1, "^part": 2, "@": 90, "#": 200_000}, "SELECT DISTINCT l_partkey AS part, l_quantity AS quantity FROM lineitem ORDER BY quantity, part OFFSET 90 LIMIT 200000")


@_query("owner_rest", "SELECT o_custkey AS owner, CAST(k AS INTEGER) AS rank, o_orderkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k > 2")
def _(spark, d):
    """All but the two largest orders of each customer, with their ranks; a customer may have any share of all orders."""
    return members(catalog(spark, d), Customer, "orders", {"^total": -1, "@": 2}, flat=True).withColumnRenamed("item", "id")


# --- long option sets, which are relations
_KEYS = [*range(0, 700_000, 7), "none", 0.5, True]
_model("any_of_many", Order, {"id": {}, "total": {}, "?id": _KEYS}, "SELECT o_orderkey AS id, o_totalprice AS total FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey < 700000")
_model("any_of_many_null", Document, {"id": {}, "?label.quality": [None, *range(1, 3000)]}, "SELECT doc_id AS id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality BETWEEN 1 AND 2999")
_model("any_of_many_union", Event, {"n=count:id": {}, "?result": [*(k / 100 for k in range(0, 100_000, 3)), *(f"word {k}" for k in range(100)), "click"]}, "SELECT count(*) AS n FROM events WHERE event_type = 'click' OR (event_type IN ('purchase', 'view') AND value IN (SELECT CAST(i AS DOUBLE) / 100 FROM range(0, 100000, 3) t(i)))")
_model("any_of_many_tagged", Document, {"id": {}, "?titles": [*({"de": f"src{k}", "en": [f"src{k + 1}", "x"]} for k in range(0, 40, 2)), "odd"]}, "SELECT doc_id AS id FROM documents WHERE (lang = 'de' AND source IN (SELECT 'src' || i FROM range(0, 40, 2) t(i))) OR (lang = 'en' AND source IN (SELECT 'src' || (i + 1) FROM range(0, 40, 2) t(i))) OR doc_id % 2 = 1")
_model("all_of_many", Supplier, {"id": {}, "!items.quantity": list(range(1, 46))}, "SELECT l_suppkey AS id FROM lineitem WHERE l_quantity IN (SELECT i FROM range(1, 46) t(i)) GROUP BY 1 HAVING count(DISTINCT l_quantity) = 45")
_model("having_many", Customer, {"customer=": {}, "n=count:orders": {}, "?count:orders": list(range(0, 3000, 2))}, "SELECT c_custkey AS customer, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(o_orderkey) % 2 = 0")
_model("focus_many", Order, {"id": {}, "+id": list(range(5, 60_000, 5)), "#": 40}, "SELECT o_orderkey AS id FROM orders ORDER BY CASE WHEN o_orderkey % 5 = 0 AND o_orderkey BETWEEN 5 AND 59995 THEN 0 ELSE 1 END, o_orderkey LIMIT 40")

# --- aggregates along independent paths: as over their product, but reduced along each
_PRODUCT = "nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey"
_model("agg_two_paths", Nation, {"n=count:customers": {}, "m=count:suppliers": {}}, f"SELECT count(c_custkey) AS n, count(s_suppkey) AS m FROM {_PRODUCT}")
_model(
    "agg_three_paths", Nation, {"region=region.name": {}, "n=count:customers": {}, "s=sum:suppliers.acctbal": {}, "t=count:traders": {}, "high=max:customers.acctbal": {}, "low=min:suppliers.name": {}, "mean=avg:customers.acctbal": {}, ">customers.acctbal": 0, ">=count:suppliers": 1},
    f"""WITH traders AS (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)
    SELECT r_name AS region, count(c_custkey) AS n, round(coalesce(sum(s_acctbal), 0), 2) AS s, count(k) AS t, max(c_acctbal) AS high, min(s_name) AS low, round(avg(c_acctbal), 2) AS mean
    FROM {_PRODUCT} JOIN region ON n_regionkey = r_regionkey LEFT JOIN traders ON k = n_nationkey WHERE c_acctbal > 0 GROUP BY 1 HAVING count(s_suppkey) >= 1""",
    rounded=("s", "mean"),
)
_model("agg_paths_keyed", Nation, {"segment=customers.segment": {}, "supplier=suppliers.name": {}, "k=count:customers.orders": {}, "v=sum:customers.orders.total": {}, "n=count:id": {}, ">=suppliers.acctbal": 5000}, "SELECT c_mktsegment AS segment, s_name AS supplier, count(o_orderkey) AS k, round(coalesce(sum(o_totalprice), 0), 2) AS v, count(n_nationkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal >= 5000 GROUP BY 1, 2", rounded=("v",))
_model("agg_paths_linked", Part, {"brand=brand": {}, "n=count:suppliers": {}, "q=sum:items.quantity": {}, "^sum:items.quantity": -1, "#": 7}, "SELECT p_brand AS brand, count(supplier) AS n, round(coalesce(sum(l_quantity), 0), 2) AS q FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS of, l_suppkey AS supplier FROM lineitem) ON of = p_partkey LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 ORDER BY q DESC, brand LIMIT 7", rounded=("q",))

# --- grouping and aggregates
_model("agg_count", Order, {"n=count:id": {}, "?status": "F"}, "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
_model("agg_sum", LineItem, {"flag=returnflag": {}, "v=sum:quantity": {}}, "SELECT l_returnflag AS flag, round(sum(l_quantity), 2) AS v FROM lineitem GROUP BY 1", rounded=("v",))
_model("agg_avg", LineItem, {"flag=returnflag": {}, "status=linestatus": {}, "v=avg:price": {}}, "SELECT l_returnflag AS flag, l_linestatus AS status, round(avg(l_extendedprice), 2) AS v FROM lineitem GROUP BY 1, 2", rounded=("v",))
_model("agg_min", Order, {"priority=priority": {}, "low=min:total": {}, "first=min:date": {}, "s=min:status": {}}, "SELECT o_orderpriority AS priority, min(o_totalprice) AS low, min(o_orderdate) AS first, min(o_orderstatus) AS s FROM orders GROUP BY 1")
_model("agg_max", Order, {"priority=priority": {}, "high=max:total": {}, "last=max:date": {}}, "SELECT o_orderpriority AS priority, max(o_totalprice) AS high, max(o_orderdate) AS last FROM orders GROUP BY 1")
_model("agg_whole", Part, {"n=count:": {}, "low=min:price": {}, "high=max:size": {}}, "SELECT count(*) AS n, min(p_retailprice) AS low, CAST(max(p_size) AS INTEGER) AS high FROM part")
_model("agg_empty", Part, {"n=count:id": {}, "s=sum:price": {}, "m=avg:price": {}, "low=min:price": {}, ">price": 10**9}, "SELECT count(*) AS n, coalesce(sum(p_retailprice), 0) AS s, avg(p_retailprice) AS m, min(p_retailprice) AS low FROM part WHERE p_retailprice > 1000000000")
_model("agg_round_avg", Customer, {"segment=segment": {}, "v=round:avg:acctbal": {}}, "SELECT c_mktsegment AS segment, CAST(floor(avg(c_acctbal) + 0.5) AS BIGINT) AS v FROM customer GROUP BY 1")
_model("agg_sum_length", Part, {"brand=brand": {}, "v=sum:length:name": {}}, "SELECT p_brand AS brand, CAST(sum(length(p_name)) AS BIGINT) AS v FROM part GROUP BY 1")
_model("group_path", Order, {"nation=customer.nation.name": {}, "n=count:id": {}}, "SELECT n_name AS nation, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
_model("group_computed", Order, {"year=year:date": {}, "n=count:id": {}, "v=sum:total": {}}, "SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1", rounded=("v",))
_model("group_null_key", Document, {"quality=label.quality": {}, "n=count:id": {}}, "SELECT CAST(quality AS INTEGER) AS quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
_model("group_multivalued_key", Customer, {"priority=orders.priority": {}, "n=count:id": {}}, "SELECT o_orderpriority AS priority, count(c_custkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
_model("group_item", Customer, {"customer=": {}, "n=count:orders": {}, "v=sum:orders.total": {}}, "SELECT c_custkey AS customer, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS v FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1", rounded=("v",))
_model("group_sparse", Document, {"lang=lang": {}, "n=count:label.quality": {}, "low=min:label.quality": {}}, "SELECT lang, count(quality) AS n, CAST(min(quality) AS INTEGER) AS low FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
_model("having_count", Customer, {"nation=nation.name": {}, "n=count:id": {}, ">=count:id": 60}, "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) >= 60")
_model("having_any", Part, {"brand=brand": {}, "high=max:size": {}, "?max:size": [49, 50]}, "SELECT p_brand AS brand, CAST(max(p_size) AS INTEGER) AS high FROM part GROUP BY 1 HAVING max(p_size) IN (49, 50)")
_model("having_text", Part, {"brand=brand": {}, "first=min:name": {}, "~min:name": "BL"}, "SELECT p_brand AS brand, min(p_name) AS first FROM part GROUP BY 1 HAVING contains(lower(min(p_name)), 'bl')")
_model("having_unprojected", Order, {"priority=priority": {}, "n=count:id": {}, ">avg:total": 250000}, "SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1 HAVING avg(o_totalprice) > 250000")
_model("agg_marker", Region, {"n=count:id": {}, "low=min:id": {}}, "SELECT count(*) AS n, CAST(NULL AS VARCHAR) AS low FROM region")

# --- reductions of single items
_model("item_filter_count", Customer, {"id": {}, ">=count:orders": 15}, "SELECT c_custkey AS id FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) >= 15")
_model("item_filter_avg", Customer, {"id": {}, "<avg:orders.total": 200000}, "SELECT o_custkey AS id FROM orders GROUP BY 1 HAVING avg(o_totalprice) < 200000")
_model("item_sort_count_topk", Customer, {"id": {}, "^count:orders": -1, "#": 7}, "SELECT c_custkey AS id FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY count(o_orderkey) DESC, c_custkey LIMIT 7")
_model("item_project_distinct", Customer, {"segment=segment": {}, "nation=nation": {}, ">=count:orders": 14}, "SELECT DISTINCT c_mktsegment AS segment, c_nationkey AS nation FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 14)")
_model("item_filter_none", Customer, {"id": {}, "<count:orders": 1}, "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")

# --- order and slices
_model("sort_multi_key", Part, {"id": {}, "^brand": 2, "^size": -1, "#": 9}, "SELECT p_partkey AS id FROM part ORDER BY p_size DESC, p_brand, p_partkey LIMIT 9")
_model("sort_nulls", Document, {"id": {}, "^label.quality": 1, "#": 11}, "SELECT doc_id AS id FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality NULLS FIRST, doc_id LIMIT 11")
_model("sort_nulls_desc", Document, {"id": {}, "^label.quality": "desc", "#": 11}, "SELECT doc_id AS id FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS LAST, doc_id LIMIT 11")
_model("focus_value", Part, {"id": {}, "+brand": ["Brand#4", "Brand#2"], "^price": -1, "#": 25}, "SELECT p_partkey AS id FROM part ORDER BY CASE WHEN p_brand IN ('Brand#4', 'Brand#2') THEN 0 ELSE 1 END, p_retailprice DESC, p_partkey LIMIT 25")
_model("focus_null", Document, {"id": {}, "+label.quality": [None], "#": 20}, "SELECT doc_id AS id FROM documents LEFT JOIN labels USING (doc_id) ORDER BY CASE WHEN quality IS NULL THEN 0 ELSE 1 END, doc_id LIMIT 20")
_model("page_offset_limit", Order, {"id": {}, "^total": 1, "@": 20, "#": 10}, "SELECT o_orderkey AS id FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 20")
_model("page_past_end", Region, {"id": {}, "@": 50}, "SELECT r_regionkey AS id FROM region WHERE false")
_model("sort_transform", Part, {"id": {}, "^length:name": -1, "#": 5}, "SELECT p_partkey AS id FROM part ORDER BY length(p_name) DESC, p_partkey LIMIT 5")
_model("sort_path", Customer, {"id": {}, "^nation.region.name": -1, "^acctbal": 2, "#": 6}, "SELECT c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey ORDER BY r_name DESC, c_acctbal, c_custkey LIMIT 6")
_model("sort_unprojected", Part, {"brand=brand": {}, "^price": -1, "#": 6}, "SELECT brand FROM (SELECT p_brand AS brand, p_retailprice, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k = 1 ORDER BY p_retailprice DESC, p_partkey LIMIT 6")
_model("sort_group_aggregate", Order, {"status=status": {}, "priority=priority": {}, "n=count:id": {}, "^max:total": -1, "#": 4}, "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY max(o_totalprice) DESC, status, priority LIMIT 4")
_model("limit_injected", Order, {"id": {}, "^total": -1}, "SELECT o_orderkey AS id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 8", limit=8)

# --- windows of each owner, nested collections


@_query("owner_topk", "SELECT o_custkey AS owner, o_orderkey AS id, o_totalprice AS total, k FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k BETWEEN 2 AND 3")
def _(spark, d):
    out = members(catalog(spark, d), Customer, "orders", {"id": {}, "total": {}, "^total": -1, "@": 1, "#": 2})
    return out.select("owner", F.posexplode("items").alias("p", "x")).select("owner", "x.id", "x.total", (F.col("p") + 2).cast("long").alias("k"))


@_query("owner_aggregate", "SELECT c_custkey AS owner, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS v FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(spark, d):
    out = members(catalog(spark, d), Customer, "orders", {"n=count:": {}, "v=sum:total": {}})
    return out.select("owner", F.explode("items").alias("x")).select("owner", "x.n", F.round("x.v", 2).alias("v"))


@_query("nested_collection", "SELECT n_nationkey AS nation, c_custkey AS customer, s_n FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS s_n FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey WHERE n_regionkey = 2 AND c_acctbal >= 5000")
def _(spark, d):
    out = select(catalog(spark, d), Nation, {"id": {}, "customers": {"id": {}, ">=acctbal": 5000}, "suppliers": {}, "?region": 2})
    return out.select(F.col("id").alias("nation"), F.explode("customers").alias("c"), F.when(F.col("suppliers").isNotNull(), F.size("suppliers").cast("long")).alias("s_n")).select("nation", F.col("c.id").alias("customer"), "s_n")


@_query("nested_two_levels", "SELECT r_regionkey AS region, n_name AS nation, max(s_acctbal) AS best FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def _(spark, d):
    out = select(catalog(spark, d), Region, {"id": {}, "nations": {"name": {}, "suppliers": {"acctbal": {}, "^acctbal": -1, "#": 1}}})
    return out.select("id", F.explode("nations").alias("n")).where("n.suppliers is not null").select(F.col("id").alias("region"), F.col("n.name").alias("nation"), F.col("n.suppliers")[0]["acctbal"].alias("best"))


# --- unions and localised text
_model("union_compare", Event, {"id": {}, ">result": 300}, "SELECT event_id AS id FROM events WHERE event_type IN ('purchase', 'view') AND value > 300")
_model("union_text", Event, {"n=count:id": {}, "~result": "ERR"}, "SELECT count(*) AS n FROM events WHERE event_type = 'error'")
_model("union_any_null", Event, {"n=count:id": {}, "?result": [None, "click", 0.5]}, "SELECT count(*) AS n FROM events WHERE event_type NOT IN ('purchase', 'view', 'error', 'click') OR event_type = 'click' OR (event_type IN ('purchase', 'view') AND value = 0.5)")
_model("union_count", Event, {"n=count:result": {}, "m=count:length:result": {}, "s=sum:result": {}}, "SELECT count(*) FILTER (event_type IN ('purchase', 'view', 'error', 'click')) AS n, count(*) FILTER (event_type IN ('error', 'click')) AS m, round(sum(value) FILTER (event_type IN ('purchase', 'view')), 2) AS s FROM events", rounded=("s",))
_model("union_tier_order", Event, {"id": {}, "^result": -1, "#": 30}, "SELECT event_id AS id FROM events ORDER BY CASE WHEN event_type IN ('error', 'click') THEN 2 WHEN event_type IN ('purchase', 'view') THEN 1 ELSE 0 END DESC, CASE WHEN event_type IN ('error', 'click') THEN event_type END DESC, CASE WHEN event_type IN ('purchase', 'view') THEN value END DESC, event_id LIMIT 30")


@_query("union_group_key", "SELECT CASE WHEN event_type IN ('purchase', 'view') THEN value END AS number, CASE WHEN event_type IN ('error', 'click') THEN event_type END AS word, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    out = select(catalog(spark, d), Event, {"r=result": {}, "n=count:id": {}})
    return out.select(F.col("r.n").alias("number"), F.col("r.s").alias("word"), "n")


@_query("union_cell", "SELECT event_id AS id, CASE WHEN event_type IN ('purchase', 'view') THEN value END AS number, CASE WHEN event_type IN ('error', 'click') THEN event_type END AS word FROM events")
def _(spark, d):
    out = select(catalog(spark, d), Event, {"id": {}, "result": {}})
    return out.select("id", F.col("result.v0").alias("number"), F.col("result.v1").alias("word"))


_TITLE = "CASE WHEN lang = 'de' THEN source WHEN lang = 'fr' THEN source WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END"
_model("text_label", Document, {"id": {}, "titles": {}}, f"SELECT doc_id AS id, {_TITLE} AS titles FROM documents", locale=["de", "fr", "und"])
_model("text_default", Document, {"id": {}, "titles": {}}, "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS titles FROM documents")
_model("text_filter", Document, {"id": {}, "~titles": "SRC1"}, f"SELECT doc_id AS id FROM documents WHERE contains({_TITLE}, 'src1')", locale=["de", "fr", "und"])
_model("text_group", Document, {"t=titles": {}, "n=count:id": {}, "low=min:titles": {}}, f"SELECT {_TITLE} AS t, count(*) AS n, min({_TITLE}) AS low FROM documents GROUP BY 1", locale=["de", "fr", "und"])
_model("text_sort", Document, {"id": {}, "^titles": -1, "#": 12}, f"SELECT doc_id AS id FROM documents ORDER BY {_TITLE} DESC, doc_id LIMIT 12", locale=["de", "fr", "und"])
_model("text_tagged", Document, {"id": {}, "?titles": {"en": ["src1", "src2"], "de": "src3"}}, "SELECT doc_id AS id FROM documents WHERE (lang = 'en' AND source IN ('src1', 'src2')) OR (lang = 'de' AND source = 'src3')")


@_query("text_ranges", "SELECT doc_id AS id, lang AS tag, source AS title FROM documents WHERE lang IN ('de', 'es')")
def _(spark, d):
    out = select(catalog(spark, d), Document, {"id": {}, "titles": {"DE": {}, "es": {}}})
    return out.select("id", F.explode("titles").alias("tag", "title"))


# --- scalar functions
for _name, _shape, _key, _column, _expr, _table in (
    ("length", Part, "p_partkey", "name", "CAST(length(p_name) AS BIGINT)", "part"), ("lower", Supplier, "s_suppkey", "name", "lower(s_name)", "supplier"), ("upper", Part, "p_partkey", "name", "upper(p_name)", "part"),
    ("abs", Customer, "c_custkey", "acctbal", "abs(c_acctbal)", "customer"), ("floor", Customer, "c_custkey", "acctbal", "CAST(floor(c_acctbal) AS BIGINT)", "customer"), ("ceil", Customer, "c_custkey", "acctbal", "CAST(ceil(c_acctbal) AS BIGINT)", "customer"),
    ("round", Customer, "c_custkey", "acctbal", "CAST(floor(c_acctbal + 0.5) AS BIGINT)", "customer"), ("year", Event, "event_id", "ts", "CAST(year(ts) AS BIGINT)", "events"), ("month", Order, "o_orderkey", "date", "CAST(month(o_orderdate) AS BIGINT)", "orders"),
    ("day", Event, "event_id", "ts", "CAST(day(ts) AS BIGINT)", "events"), ("hours", Event, "event_id", "ts", "CAST(hour(ts) AS BIGINT)", "events"), ("minutes", Event, "event_id", "ts", "CAST(minute(ts) AS BIGINT)", "events"),
    ("seconds", Event, "event_id", "ts", "extract('microseconds' FROM ts) / 1e6", "events"), ("floor:abs", Customer, "c_custkey", "acctbal", "CAST(floor(abs(c_acctbal)) AS BIGINT)", "customer"), ("length:lower", Part, "p_partkey", "brand", "CAST(length(lower(p_brand)) AS BIGINT)", "part"),
):
    _model("fn_" + (_name if ":" not in _name else "pipe_" + _name.replace(":", "_")), _shape, {"id=": {}, f"v={_name}:{_column}": {}}, f"SELECT {_key} AS id, {_expr} AS v FROM {_table}")


# --- embedded records
_OPENINGS = "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations)"
_model("embedded_filter", Conversation, {"id": {}, "?opening.role": "user", ">=length:opening.text": 60}, f"SELECT conv_id AS id FROM {_OPENINGS} WHERE k = 1 AND role = 'user' AND length(text) >= 60")
_model("embedded_path", Conversation, {"conversation=": {}, "role=turns.role": {}}, "SELECT DISTINCT conv_id AS conversation, role FROM conversations")
_model("embedded_aggregate", Conversation, {"id": {}, ">=count:turns": 4}, "SELECT conv_id AS id FROM conversations GROUP BY 1 HAVING count(*) >= 4")


@_query("embedded_record", f"SELECT conv_id AS id, role, text FROM {_OPENINGS} WHERE k = 1")
def _(spark, d):
    return select(catalog(spark, d), Conversation, {"id": {}, "opening": {"role": {}, "text": {}}}).select("id", "opening.role", "opening.text")


@_query("embedded_collection", "SELECT conv_id AS id, role FROM conversations")
def _(spark, d):
    out = select(catalog(spark, d), Conversation, {"id": {}, "turns": {"role": {}}})
    return out.select("id", F.explode("turns").alias("t")).select("id", "t.role")


# --- unions of references and of texts, their variants and cells
_ABOUT = "FROM events LEFT JOIN customer ON event_type = 'purchase' AND c_custkey = user_id LEFT JOIN part ON event_type = 'view' AND p_partkey = event_id % 100 + 1"
_model("union_join", Event, {"id=": {}, "name=about.name": {}}, f"SELECT event_id AS id, coalesce(c_name, p_name) AS name {_ABOUT}")
_model("union_join_filter", Event, {"id": {}, ">about.acctbal": 5000}, f"SELECT event_id AS id {_ABOUT} WHERE c_acctbal > 5000")
_model("union_reference_filter", Event, {"n=count:id": {}, "?about.brand": ["Brand#1", "Brand#2"]}, f"SELECT count(*) AS n {_ABOUT} WHERE p_brand IN ('Brand#1', 'Brand#2')")
_CAPTION = "CASE WHEN doc_id % 2 = 0 OR lang = 'en' THEN source END"
_model("mixed_text_filter", Document, {"id": {}, "~caption": "SRC1"}, f"SELECT doc_id AS id FROM documents WHERE contains({_CAPTION}, 'src1')", locale=["en"])
_model("mixed_text_sort", Document, {"id": {}, "^caption": -1, "#": 15}, f"SELECT doc_id AS id FROM documents ORDER BY {_CAPTION} DESC NULLS LAST, doc_id LIMIT 15", locale=["en"])
_model("mixed_text_any", Document, {"id": {}, "?caption": ["src3", {"de": "src4"}]}, "SELECT doc_id AS id FROM documents WHERE (doc_id % 2 = 0 AND source = 'src3') OR (doc_id % 2 = 1 AND lang = 'de' AND source = 'src4')")


@_query("union_retrieval", f"SELECT event_id AS id, c_name AS customer, p_brand AS brand {_ABOUT}")
def _(spark, d):
    out = select(catalog(spark, d), Event, {"id": {}, "about": {"0": {"acctbal": {}, "name": {}}, "1": {"brand": {}}}})
    return out.select("id", F.col("about.v0.name").alias("customer"), F.col("about.v1.brand").alias("brand"))


@_query("union_retrieval_one", "SELECT event_id AS id, CASE WHEN event_type IN ('error', 'click') THEN event_type END AS word FROM events")
def _(spark, d):
    out = select(catalog(spark, d), Event, {"id": {}, "result": {"1": {}}})
    return out.select("id", F.col("result.v1").alias("word"))


@_query("union_binding", "SELECT event_id AS id, CASE WHEN event_type IN ('purchase', 'view') THEN value END AS number, CASE WHEN event_type IN ('error', 'click') THEN event_type END AS word FROM events")
def _(spark, d):
    out = select(catalog(spark, d), Event, {"id=": {}, "r=result": {"0": {}, "1": {}}})
    return out.select("id", F.col("r.v0").alias("number"), F.col("r.v1").alias("word"))


@_query("admitted_variants", "SELECT c_nationkey AS owner, c_name AS name, c_mktsegment AS segment FROM customer")
def _(spark, d):
    out = members(catalog(spark, d), Nation, "traders", {"0": {"name": {}, "segment": {}}}, flat=True)
    return out.select("owner", "item.v0.name", "item.v0.segment")


@_query("admitted_variants_topk", "SELECT owner, id FROM (SELECT c_nationkey AS owner, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) WHERE k <= 2")
def _(spark, d):
    out = members(catalog(spark, d), Nation, "traders", {"0": {"segment": {}, "id": {}}, "#": 2}, flat=True)
    return out.select("owner", F.col("item.v0.id").alias("id"))


@_query("text_arrays", "SELECT doc_id AS id, unnest(CASE WHEN lang IN ('de', 'fr') THEN [source, lang] WHEN doc_id % 2 = 0 THEN ['even'] ELSE ['odd'] END) AS tag FROM documents")
def _(spark, d):
    out = select(catalog(spark, d), Document, {"id": {}, "tags": {}}, ["de", "fr", "und"])
    return out.select("id", F.explode("tags").alias("tag"))


@_query("locale_cell", "SELECT doc_id AS id, lang AS tag, source AS title FROM documents WHERE lang IN ('de', 'es')")
def _(spark, d):
    out = select(catalog(spark, d), Document, {"id=": {}, "t=titles": {"de": {}, "es": {}}})
    return out.select("id", F.explode("t").alias("tag", "title"))


# --- booleans, joins with the class itself and through link tables
_model("filter_boolean_lt", Label, {"id": {}, "<harmful": True}, "SELECT doc_id AS id FROM labels WHERE toxic = 0")
_model("filter_boolean_gte", Label, {"id": {}, ">=harmful": True, "?quality": 1}, "SELECT doc_id AS id FROM labels WHERE toxic = 1 AND quality = 1")
_model("group_boolean", Label, {"harmful=harmful": {}, "n=count:id": {}, "low=min:harmful": {}}, "SELECT toxic = 1 AS harmful, count(*) AS n, min(toxic = 1) AS low FROM labels GROUP BY 1")
_model("join_self", Document, {"id=": {}, "source=lead.source": {}, "?lead.lang": "en"}, "SELECT d.doc_id AS id, l.source AS source FROM documents d JOIN documents l ON l.doc_id = d.doc_id - d.doc_id % 10 WHERE l.lang = 'en'")
_LINKS = "(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)"
_model("join_link", Part, {"part=": {}, "supplier=suppliers.name": {}, "?suppliers.nation": [3, 4]}, f"SELECT l_partkey AS part, s_name AS supplier FROM {_LINKS} JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey IN (3, 4)")
_model("join_link_count", Part, {"brand=brand": {}, "n=count:suppliers": {}}, f"SELECT p_brand AS brand, count(l_suppkey) AS n FROM part LEFT JOIN {_LINKS} ON l_partkey = p_partkey GROUP BY 1")
_model("join_link_all", Part, {"id": {}, "!suppliers": [1, 2]}, "SELECT p_partkey AS id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1) AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 2)")


@_query("link_topk", f"SELECT part, id FROM (SELECT l_partkey AS part, s_suppkey AS id, row_number() OVER (PARTITION BY l_partkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM {_LINKS} JOIN supplier ON s_suppkey = l_suppkey) WHERE k <= 2")
def _(spark, d):
    out = members(catalog(spark, d), Part, "suppliers", {"id": {}, "^acctbal": -1, "#": 2}, flat=True)
    return out.select(F.col("owner").alias("part"), "item.id")


# --- virtual resources, bare templates, caps, flat members
@_query("lookup_virtual", "SELECT '/world' AS world, 'World' AS kind, r_regionkey AS id, r_name AS name FROM region")
def _(spark, d):
    world = Shape("World", {"regions": multiple(Reference(lambda: Region), Linked("world_regions", "world", "region"))})
    out = virtual(catalog(spark, d), "/world", world, {"id": {}, "type": {}, "regions": {"id": {}, "name": {}}})
    return out["regions"].select(F.lit(out["id"]).alias("world"), F.lit(out["type"]).alias("kind"), "id", "name")


@_query("lookup_empty_template", "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity >= 49 AND l_orderkey IN (SELECT o_orderkey FROM orders)")
def _(spark, d):
    c = catalog(spark, d)
    return lookup_many(c, Order, c.frame(LineItem).where("l_quantity >= 49").select(F.col("l_orderkey").alias("id")), {})


@_query("limit_nested", "SELECT id, customer FROM (SELECT n_nationkey AS id, c_custkey AS customer, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS k FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey IN (SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 3)) WHERE k <= 3")
def _(spark, d):
    out = select(catalog(spark, d), Nation, {"id": {}, "customers": {"id": {}}}, limit=3)
    return out.select("id", F.explode("customers").alias("c")).select("id", F.col("c.id").alias("customer"))


@_query("limit_lookup", "SELECT id, part FROM (SELECT l_suppkey AS id, l_partkey AS part, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS k FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey IN (1, 2, 3))) WHERE k <= 2")
def _(spark, d):
    c = catalog(spark, d)
    own = Shape("Source", {"parts": multiple(Reference(lambda: Part), Linked("part_suppliers", "supplier", "part"))}, "s_suppkey", Supplier.key_type)
    c.bind(own, lambda: c.frame(Supplier))
    out = lookup_many(c, own, [1, 2, 3], {"parts": {"id": {}}}, limit=2)
    return out.select("id", F.explode("parts").alias("p")).select("id", F.col("p.id").alias("part"))


@_query("owner_flat", "SELECT o_custkey AS owner, o_orderkey AS id, o_totalprice AS total FROM orders WHERE o_orderstatus = 'P'")
def _(spark, d):
    out = members(catalog(spark, d), Customer, "orders", {"id": {}, "total": {}, "?status": "P"}, flat=True)
    return out.select("owner", "item.id", "item.total")


# --- writes: batches of resources, cascades, links, transactions
_NEW = "(SELECT s_suppkey + 1450 AS id, s_name AS name FROM supplier)"


def _people(store: Store) -> DataFrame:
    return store.catalog.frame(Person).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


def _new_people(store: Store) -> DataFrame:
    """Suppliers as people; some of the keys are taken."""
    return store.catalog.frame(Dealer).select((F.col("s_suppkey") + 1450).alias("c_custkey"), F.col("s_name").alias("c_name"), F.lit(0.0).alias("c_acctbal"), F.col("s_nationkey").alias("c_nationkey"))


@_query("write_create", f"SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT id, name FROM {_NEW} WHERE id NOT IN (SELECT c_custkey FROM customer)")
def _(spark, d):
    store = Store(ledger(spark, d))
    store.create_all(Person, _new_people(store))
    return _people(store)


@_query("write_update", f"SELECT c_custkey AS id, coalesce(n.name, c_name) AS name FROM customer LEFT JOIN {_NEW} n ON n.id = c_custkey")
def _(spark, d):
    store = Store(ledger(spark, d))
    store.update_all(Person, _new_people(store))
    return _people(store)


@_query("write_insert", f"SELECT id, name FROM {_NEW} UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT id FROM {_NEW})")
def _(spark, d):
    store = Store(ledger(spark, d))
    store.insert_all(Person, _new_people(store))
    return _people(store)


def _state(store: Store) -> DataFrame:
    """All that a store holds, a row each: class, key, and the reference that it bears."""
    c = store.catalog
    own = lambda s, ref: c.frame(s).select(F.lit(s.name).alias("class"), F.col(s.key).cast("long").alias("id"), ref.cast("long").alias("ref"))
    out = own(Land, F.lit(None)).unionByName(own(Person, F.col("c_nationkey"))).unionByName(own(Bill, F.col("o_custkey"))).unionByName(own(Dealer, F.col("s_nationkey")))
    return out.unionByName(c.table("dealings").select(F.lit("dealing").alias("class"), F.col("person").cast("long").alias("id"), F.col("dealer").cast("long").alias("ref")))


def _state_sql(lands: str = "true", people: str = "true", dealers: str = "true", emptied: str = "false") -> str:
    """The same, of what is left: conditions on n_nationkey, on c_custkey and c_nationkey, on s_suppkey; which dealers lose their land."""
    return f"""WITH p AS (SELECT * FROM customer WHERE {people}), s AS (SELECT * FROM supplier WHERE {dealers})
        SELECT 'Land' AS class, CAST(n_nationkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS ref FROM nation WHERE {lands}
        UNION ALL SELECT 'Person', c_custkey, c_nationkey FROM p UNION ALL SELECT 'Bill', o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM p)
        UNION ALL SELECT 'Dealer', s_suppkey, CASE WHEN {emptied} THEN NULL ELSE s_nationkey END FROM s
        UNION ALL SELECT 'dealing', c_custkey, s_suppkey FROM p JOIN s ON c_nationkey = s_nationkey"""


_GONE = "(SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"


@_query("write_cascade", _state_sql(f"n_nationkey NOT IN {_GONE}", f"c_nationkey NOT IN {_GONE}", "true", f"s_nationkey IN {_GONE}"))
def _(spark, d):
    store = Store(ledger(spark, d))
    store.remove_all(Land, store.catalog.frame(Land).where("n_regionkey = 2").select(F.col("n_nationkey").alias("id")))
    return _state(store)


@_query("write_delete", _state_sql(people="c_custkey <> 7"))
def _(spark, d):
    store = Store(ledger(spark, d))
    store.remove_all(Person, spark.createDataFrame([(7,), (-5,)], "id long"))
    return _state(store)


@_query("write_clear_references", _state_sql(dealers="s_suppkey % 3 <> 0"))
def _(spark, d):
    store = Store(ledger(spark, d))
    store.remove_all(Dealer, store.catalog.frame(Dealer).where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("id")))
    return _state(store)


@_query("write_links", "SELECT c_custkey AS person, s_suppkey AS dealer FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_suppkey <> 2 UNION SELECT c_custkey, 1 FROM customer")
def _(spark, d):
    store = Store(ledger(spark, d))
    store.link_all(DEALINGS, store.catalog.frame(Person).select(F.col("c_custkey").alias("person"), F.lit(1).cast("long").alias("dealer")))
    store.link_all(DEALINGS, store.catalog.table("dealings").where("dealer = 2"), gone=True)
    return store.catalog.table("dealings")


@_query("write_transaction", f"SELECT id, name FROM {_NEW} WHERE id <> 1451 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT id FROM {_NEW}) AND c_nationkey <> 4")
def _(spark, d):
    store = Store(ledger(spark, d))

    def task(s: Store) -> None:
        s.remove_all(Land, spark.createDataFrame([(4,)], "id int"))
        s.insert_all(Person, _new_people(s))
        s.remove_all(Person, spark.createDataFrame([(1451,)], "id long"))

    store.execute(task)
    return _people(store)


@_query("answers_checked", """
    WITH o AS (SELECT *, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_totalprice END AS total, CASE WHEN o_orderkey % 101 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders),
    p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 50 = 0 THEN '' ELSE c_name END AS name FROM customer),
    bad AS (
        SELECT 'bills[].total' AS path, 'is missing' AS reason, o_custkey AS k FROM o JOIN p ON k = o_custkey WHERE total IS NULL
        UNION ALL SELECT 'bills[].status', 'breaks {''one_of'': (''O'', ''F'', ''P'')}', o_custkey FROM o JOIN p ON k = o_custkey WHERE status = 'X'
        UNION ALL SELECT 'name', 'breaks {''min_length'': 1}', k FROM p WHERE name = '')
    SELECT path, reason, count(DISTINCT k) AS n_rows, min(CAST(k AS VARCHAR)) AS example FROM bad GROUP BY 1, 2""")
def _(spark, d):
    """Planted breaches, in people and in the bills nested in them, as a report of one pass over the answer."""
    c = ledger(spark, d)
    bills = c.frame(Bill).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 97 != 0, F.col("o_totalprice"))).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 101 == 0, "X").otherwise(F.col("o_orderstatus")))
    c.bind(Bill, bills).bind(Person, c.frame(Person).withColumn("c_name", F.when(F.col("c_custkey") % 50 == 0, "").otherwise(F.col("c_name"))))
    model = {"id": {}, "name": {}, "acctbal": {}, "bills": {"total": {}, "status": {}}}
    return breaches(Person, model, select(c, Person, model))


@_query("write_feed", f"""
    WITH gone AS (SELECT c_custkey FROM customer WHERE c_nationkey = 4), new AS (SELECT id FROM {_NEW})
    SELECT 'Land' AS class, '4' AS key, false AS held, 1 AS commits UNION ALL SELECT 'Person', CAST(c_custkey AS VARCHAR), c_custkey IN (SELECT id FROM new), 1 FROM gone
    UNION ALL SELECT 'Bill', CAST(o_orderkey AS VARCHAR), false, 1 FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone)
    UNION ALL SELECT 'Person', CAST(id AS VARCHAR), true, 1 FROM new WHERE id NOT IN (SELECT c_custkey FROM gone)""")
def _(spark, d):
    """What two commits have changed: a land with all it holds goes, people come; of each key the last change."""
    store = Store(ledger(spark, d), feed=True)
    store.remove_all(Land, spark.createDataFrame([(4,)], "id int"))
    store.insert_all(Person, _new_people(store))
    return latest(store.feed.read()).select("class", "key", F.col("exists").alias("held"), F.lit(1).alias("commits"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["facet"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
