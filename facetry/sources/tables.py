"""The driver tables as classes: shapes over plain parquet, bound as virtual collections."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shapes import Dictionary, Embedded, InVariants, Linked, Property, Reference, Reversed, Shape, Union, boolean, decimal, integer, local, multiple, optional, required, string
from .catalog import Catalog

_LONG, _INT = T.LongType(), T.IntegerType()


def _to(name: str):
    return Reference(lambda: SHAPES[name])


Region = Shape("Region", {"name": required(string, "r_name"), "nations": multiple(_to("Nation"), Reversed("n_regionkey"), foreign=True)}, "r_regionkey", _INT)
Nation = Shape(
    "Nation",
    {
        "name": required(string, "n_name"), "region": required(_to("Region"), "n_regionkey"),
        "customers": multiple(_to("Customer"), Reversed("c_nationkey"), foreign=True), "suppliers": multiple(_to("Supplier"), Reversed("s_nationkey"), foreign=True),
        # whoever trades there: a link table whose items are of two classes
        "traders": multiple(Union((_to("Customer"), _to("Supplier"))), Linked("nation_traders", "nation", "trader")),
    },
    "n_nationkey", _INT,
)
Customer = Shape("Customer", {"name": required(string, "c_name"), "acctbal": required(decimal, "c_acctbal"), "segment": required(string, "c_mktsegment"), "nation": required(_to("Nation"), "c_nationkey"), "orders": multiple(_to("Order"), Reversed("o_custkey"), foreign=True)}, "c_custkey", _LONG)
Supplier = Shape("Supplier", {"name": required(string, "s_name"), "acctbal": required(decimal, "s_acctbal"), "nation": required(_to("Nation"), "s_nationkey"), "items": multiple(_to("LineItem"), Reversed("l_suppkey"), foreign=True)}, "s_suppkey", _LONG)
Part = Shape("Part", {"name": required(string, "p_name"), "brand": required(string, "p_brand"), "ptype": required(string, "p_type"), "size": required(integer, "p_size"), "price": required(decimal, "p_retailprice"), "suppliers": multiple(_to("Supplier"), Linked("part_suppliers", "part", "supplier")), "items": multiple(_to("LineItem"), Reversed("l_partkey"), foreign=True)}, "p_partkey", _LONG)
Order = Shape(
    "Order",
    {
        "status": required(string, "o_orderstatus"), "total": required(decimal, "o_totalprice"), "date": required(local, "o_orderdate"), "priority": required(string, "o_orderpriority"),
        "customer": required(_to("Customer"), "o_custkey"), "items": multiple(_to("LineItem"), Reversed("l_orderkey"), foreign=True),
    },
    "o_orderkey", _LONG,
)
#: Rows without identity: (order, number) is not unique, so they are a bag.
LineItem = Shape(
    "LineItem",
    {
        "number": required(integer, "l_linenumber"), "quantity": required(decimal, "l_quantity"), "price": required(decimal, "l_extendedprice"), "discount": required(decimal, "l_discount"), "tax": required(decimal, "l_tax"),
        "returnflag": required(string, "l_returnflag"), "linestatus": required(string, "l_linestatus"), "shipdate": required(local, "l_shipdate"),
        "order": required(_to("Order"), "l_orderkey"), "part": required(_to("Part"), "l_partkey"), "supplier": required(_to("Supplier"), "l_suppkey"),
    },
    None, _LONG,
)
Event = Shape(
    "Event",
    {
        "ts": required(local, "ts"), "user": required(integer, "user_id"), "etype": required(string, "event_type"), "value": required(decimal, "value"), "props": required(string, "props"),
        # a number for purchases and views, a word for errors and clicks, nothing for the rest
        "result": Property(Union((decimal, string)), InVariants(("result_number", "result_word")), 0, 1),
        # a customer for purchases, a part for views
        "about": Property(Union((_to("Customer"), _to("Part"))), InVariants(("about_customer", "about_part")), 0, 1),
    },
    "event_id", _LONG,
)
Document = Shape(
    "Document",
    {
        "text": required(string, "text"), "lang": required(string, "lang"), "source": required(string, "source"), "chars": required(integer, "n_chars"),
        "label": Property(_to("Label"), Reversed("doc_id"), 0, 1, foreign=True), "titles": optional(Dictionary(), "titles"), "tags": optional(Dictionary(many=True), "tags"),
        # plain text for even ids, localised text for odd ones; and the first document of each ten
        "caption": Property(Union((string, Dictionary())), InVariants(("caption_plain", "caption_tagged")), 0, 1), "lead": optional(_to("Document"), "lead"),
    },
    "doc_id", _LONG,
)
Label = Shape("Label", {"quality": required(integer, "quality"), "toxic": required(integer, "toxic"), "harmful": required(boolean, "harmful")}, "doc_id", _LONG)
Turn = Shape("Turn", {"role": required(string, "role"), "text": required(string, "text")}, None)
Conversation = Shape("Conversation", {"turns": multiple(Embedded(Turn), "turns"), "opening": optional(Embedded(Turn), "opening")}, "conv_id", _LONG)
#: Whoever trades: what customers and suppliers have in common.
Party = Shape("Party", {"name": required(string, "name"), "acctbal": required(decimal, "acctbal"), "nation": required(_to("Nation"), "nation")}, "id", T.StringType())
Buyer = Shape("Buyer", {"segment": required(string, "segment")}, "id", T.StringType(), (Party,))
Seller = Shape("Seller", {}, "id", T.StringType(), (Party,))

SHAPES = {s.name: s for s in (Region, Nation, Customer, Supplier, Part, Order, LineItem, Event, Document, Label, Conversation, Party, Buyer, Seller)}


def _events(df: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    result = {"result_number": F.when(kind.isin("purchase", "view"), F.col("value")), "result_word": F.when(kind.isin("error", "click"), kind)}
    return df.withColumns({**result, "about_customer": F.when(kind == "purchase", F.col("user_id")), "about_part": F.when(kind == "view", F.col("event_id") % 100 + 1)})


def _documents(df: DataFrame) -> DataFrame:
    """Titles by language: the source under the document's own, and the id's parity under `und`."""
    even, lang, source = F.col("doc_id") % 2 == 0, F.col("lang"), F.col("source")
    parity = F.when(even, "even").otherwise("odd")
    return df.withColumns({
        "titles": F.create_map(lang, source, F.lit("und"), parity), "tags": F.create_map(lang, F.array(source, lang), F.lit("und"), F.array(parity)),
        "caption_plain": F.when(even, source), "caption_tagged": F.when(~even, F.create_map(lang, source)), "lead": F.col("doc_id") - F.col("doc_id") % 10,
    })


def _conversations(df: DataFrame) -> DataFrame:
    """A row for each conversation, with its turns as nested records in order."""
    turns = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    own = F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return turns.select("conv_id", own.alias("turns"), F.get(own, 0).alias("opening"))


#: The schemas of a folder's tables, which are fixed, by application and folder.
_SCHEMAS: dict[tuple[str, str], dict[str, T.StructType]] = {}


def _over(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(spark, _SCHEMAS.setdefault((spark.sparkContext.applicationId, sf_dir), {}))


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """All classes over a folder of driver tables."""
    own = _over(spark, sf_dir).parquet(sf_dir, {"region": Region, "nation": Nation, "customer": Customer, "supplier": Supplier, "part": Part, "orders": Order, "lineitem": LineItem})
    read = lambda name: own.read(f"{sf_dir}/{name}.parquet")
    own.bind(Event, lambda: _events(read("events"))).bind(Document, lambda: _documents(read("documents"))).bind(Conversation, lambda: _conversations(read("conversations")))
    own.bind(Label, lambda: read("labels").withColumn("harmful", F.col("toxic") == 1))
    own.link("part_suppliers", lambda: read("lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).distinct())
    trader = lambda df, nation, v0, v1: df.select(F.col(nation).alias("nation"), F.struct(v0.cast("long").alias("v0"), v1.cast("long").alias("v1")).alias("trader"))
    own.link("nation_traders", lambda: trader(read("customer"), "c_nationkey", F.col("c_custkey"), F.lit(None)).unionByName(trader(read("supplier"), "s_nationkey", F.lit(None), F.col("s_suppkey"))))
    party = lambda df, p, *more: df.select(F.concat(F.lit(f"/{p}/"), F.col(f"{p}_{'custkey' if p == 'c' else 'suppkey'}")).alias("id"), F.col(f"{p}_name").alias("name"), F.col(f"{p}_acctbal").alias("acctbal"), F.col(f"{p}_nationkey").alias("nation"), *more)
    own.bind(Buyer, lambda: party(read("customer"), "c", F.col("c_mktsegment").alias("segment"))).bind(Seller, lambda: party(read("supplier"), "s"))
    return own


# --- the same tables to write to: what lands hold captive goes with them


def _land():
    return Reference(lambda: Land)


Bill = Shape("Bill", {"total": required(decimal, "o_totalprice"), "status": required(string.limited(one_of=("O", "F", "P")), "o_orderstatus"), "person": optional(Reference(lambda: Person), "o_custkey")}, "o_orderkey", _LONG)
Person = Shape(
    "Person",
    {
        "name": required(string.limited(min_length=1), "c_name"), "acctbal": required(decimal.limited(min_inclusive=-100_000), "c_acctbal"), "land": optional(_land(), "c_nationkey"),
        "bills": multiple(Reference(lambda: Bill, captive=True), Reversed("o_custkey"), foreign=True), "dealers": multiple(Reference(lambda: Dealer), Linked("dealings", "person", "dealer")),
    },
    "c_custkey", _LONG,
)
Land = Shape("Land", {"name": required(string, "n_name"), "people": multiple(Reference(lambda: Person, captive=True), Reversed("c_nationkey"), foreign=True)}, "n_nationkey", _INT)
Dealer = Shape("Dealer", {"name": required(string, "s_name"), "land": optional(_land(), "s_nationkey")}, "s_suppkey", _LONG)
DEALINGS = Person.properties["dealers"].storage


#: Parts that the people of a land are dealt to; each meets all dealers of the land.
PARTS = 64
#: People of a part that a dealer meets in a run.  The next dealer meets the same people in the same order, so that columns of
#: pairs are written as runs and as short cycles; Parquet packs 504 values at once.
RUN = 504
#: Full runs that a task gets of many people.  It then sees few lands, and so few dealers that Parquet keeps numbers for them.
RUNS = 8


def _pairs(people: DataFrame, dealers: DataFrame, least: int, gone: DataFrame | None = None) -> DataFrame:
    """Each person with the dealers of a land, without the pairs `gone`.  Pairs are many times their sides, which may be one file
    or partition, and lands are few: so people are dealt out by land, part and run, and what a task makes doesn't depend on the
    sides' files.  Dealers stand in each run, which their size as a table doesn't show, so sides are merged, never broadcast.
    Pairs that are gone are told to the dealer in the run, as the people not to be met, so pairs are never shuffled.
    least: tasks at least."""
    spark = people.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, least)
    dealt = people.select("c_custkey", "c_nationkey", F.pmod(F.hash("c_custkey"), F.lit(PARTS)).alias("__part"))
    at = F.row_number().over(Window.partitionBy("c_nationkey", "__part").orderBy("c_custkey"))
    own = dealt.withColumn("__run", F.floor((at - 1) / RUN).cast("int"))
    runs = dealt.groupBy(F.col("c_nationkey").alias("__land"), F.col("__part").alias("__dealt")).agg(F.floor((F.count("*") - 1) / RUN).cast("int").alias("__last"))
    each = dealers.select("s_suppkey", "s_nationkey", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("__of"))
    each = each.join(runs.hint("merge"), (F.col("s_nationkey") == F.col("__land")) & (F.col("__of") == F.col("__dealt"))).select("s_suppkey", "s_nationkey", "__of", F.explode(F.sequence(F.lit(0), F.col("__last"))).alias("__in"))
    same = (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("__part") == F.col("__of")) & (F.col("__run") == F.col("__in"))
    if gone is not None:
        told = gone.select(F.col("person").alias("__person"), F.col("dealer").alias("__dealer")).join(own, F.col("__person") == F.col("c_custkey"))
        told = told.groupBy(F.col("__dealer"), F.col("c_nationkey").alias("__l"), F.col("__part").alias("__p"), F.col("__run").alias("__r")).agg(F.collect_set("c_custkey").alias("__not"))
        each = each.join(told, (F.col("s_suppkey") == F.col("__dealer")) & (F.col("s_nationkey") == F.col("__l")) & (F.col("__of") == F.col("__p")) & (F.col("__in") == F.col("__r")), "left").select("s_suppkey", "s_nationkey", "__of", "__in", "__not")
        same = same & (F.col("__not").isNull() | ~F.array_contains("__not", F.col("c_custkey")))
    met = each.join(own.repartition(n, "c_nationkey", "__part", "__run").hint("merge"), same)
    return met.select(F.col("c_custkey").alias("person"), F.col("s_suppkey").alias("dealer"))


def _among(people: DataFrame, dealers: DataFrame, pairs: DataFrame) -> DataFrame | None:
    """Those of some pairs that are among _pairs, by their sides; None if keys repeat, as pairs then may."""
    for df, key in ((people, "c_custkey"), (dealers, "s_suppkey")):
        if not df.groupBy(key).count().where("count > 1").isEmpty():
            return None
    met = pairs.join(people.select("c_custkey", "c_nationkey"), F.col("person") == F.col("c_custkey"))
    return met.join(dealers.select("s_suppkey", "s_nationkey"), (F.col("dealer") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).select(*pairs.columns)


def ledger(spark: SparkSession, sf_dir: str) -> Catalog:
    """Lands, people, their bills, dealers, and who deals with whom (each person with the dealers of a land)."""
    own = _over(spark, sf_dir).parquet(sf_dir, {"nation": Land, "customer": Person, "orders": Bill, "supplier": Dealer})
    sides = lambda: (own.read(f"{sf_dir}/customer.parquet"), own.read(f"{sf_dir}/supplier.parquet"))
    least = cache(lambda: sides()[0].count() // (RUN * RUNS))
    return own.link("dealings", lambda: _pairs(*sides(), least()), lambda pairs: _among(*sides(), pairs), lambda gone: _pairs(*sides(), least(), gone))
