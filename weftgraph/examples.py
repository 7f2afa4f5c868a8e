"""Graphs over the tables of the test data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.catalog import Catalog
from weftgraph.functions.keys import node_key
from weftgraph.graph import Graph
from weftgraph.store import GraphStore

REGION, NATION, CUSTOMER, SUPPLIER, PART = 1, 2, 3, 4, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def geo_catalog() -> Catalog:
    c = Catalog().role("source").role("target")
    for label in ("Region", "Nation", "Customer", "Supplier"):
        c = c.label(label)
    for t in ("CustomerIn", "SupplierIn", "PartOf"):
        c = c.relation_type(t)
    c = c.property_key("segment", "element", "text").property_key("name", "element", "text").property_key("solvent", "element", "boolean").property_key("nation", "element", "integer")
    c = c.graph_projection("geo", "source", "target").graph_projection("customers", "source", "target", ["CustomerIn"])
    c = c.hypergraph_projection("geo_hyper", ["source"], ["target"])
    return c.index("segment_eq", "equality", "segment").index("nation_range", "range", "nation").index("segment_nation", "composite", ["segment", "nation"]).index("suppliers", "label", "Supplier").index("customers_members", "projection", "customers")


def geo(spark: SparkSession, sf_dir: str) -> GraphStore:
    """customer -> nation, supplier -> nation, nation -> region. A relation has its source's id; its
    incidences twice that, plus one for the target."""
    region, nation, customer, supplier = (table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier"))
    ids = [
        region.select(node_key(REGION, F.col("r_regionkey")).alias("element_id"), F.lit(1).cast("long").alias("label_id")),
        nation.select(node_key(NATION, F.col("n_nationkey")).alias("element_id"), F.lit(2).cast("long").alias("label_id")),
        customer.select(node_key(CUSTOMER, F.col("c_custkey")).alias("element_id"), F.lit(3).cast("long").alias("label_id")),
        supplier.select(node_key(SUPPLIER, F.col("s_suppkey")).alias("element_id"), F.lit(4).cast("long").alias("label_id")),
    ]
    labels = _union(ids)
    moves = [
        customer.select(node_key(CUSTOMER, F.col("c_custkey")).alias("s"), node_key(NATION, F.col("c_nationkey")).alias("t"), F.lit(1).cast("long").alias("k")),
        supplier.select(node_key(SUPPLIER, F.col("s_suppkey")).alias("s"), node_key(NATION, F.col("s_nationkey")).alias("t"), F.lit(2).cast("long").alias("k")),
        nation.select(node_key(NATION, F.col("n_nationkey")).alias("s"), node_key(REGION, F.col("n_regionkey")).alias("t"), F.lit(3).cast("long").alias("k")),
    ]
    links = _union(moves)
    ends = F.explode(F.array(F.struct((F.col("s") * 2).alias("incidence_id"), F.col("s").alias("element_id"), F.lit(1).cast("long").alias("role_id")), F.struct((F.col("s") * 2 + 1).alias("incidence_id"), F.col("t").alias("element_id"), F.lit(2).cast("long").alias("role_id"))))
    incidences = links.select(F.col("s").alias("relation_id"), ends.alias("e")).select("e.incidence_id", "relation_id", "e.element_id", "e.role_id")

    def held(df: DataFrame, subject, key: int, **value) -> DataFrame:
        none = {"bool_value": F.lit(None).cast("boolean"), "int_value": F.lit(None).cast("long"), "text_value": F.lit(None).cast("string")} | value
        return df.select(F.lit(0).alias("subject_kind"), subject.alias("subject_id"), F.lit(key).cast("long").alias("key_id"), *[v.alias(k) for k, v in none.items()])

    c, s = node_key(CUSTOMER, F.col("c_custkey")), node_key(SUPPLIER, F.col("s_suppkey"))
    properties = _union([
        held(customer, c, 1, text_value=F.col("c_mktsegment")), held(nation, node_key(NATION, F.col("n_nationkey")), 2, text_value=F.col("n_name")),
        held(region, node_key(REGION, F.col("r_regionkey")), 2, text_value=F.col("r_name")), held(customer, c, 3, bool_value=F.col("c_acctbal") > 0),
        held(supplier, s, 3, bool_value=F.col("s_acctbal") > 0), held(customer, c, 4, int_value=F.col("c_nationkey").cast("long")), held(supplier, s, 4, int_value=F.col("s_nationkey").cast("long")),
    ])
    nothing = spark.createDataFrame([], "relation_id long, label_id long")
    return GraphStore(labels.select("element_id"), links.select(F.col("s").alias("relation_id"), F.col("k").alias("relation_type_id")), incidences, labels, nothing, properties, geo_catalog())


def supplies(spark: SparkSession, sf_dir: str) -> Graph:
    """Distinct supplier -> part pairs of lineitem; edge id: part key times 2^24 plus supplier key."""
    pairs = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("weight"))
    edges = pairs.select((F.shiftleft("l_partkey", 24) + F.col("l_suppkey")).alias("edge"), node_key(SUPPLIER, F.col("l_suppkey")).alias("src"), node_key(PART, F.col("l_partkey")).alias("dst"), "weight")
    return Graph.from_edges(edges)


def order_hyper(spark: SparkSession, sf_dir: str) -> GraphStore:
    """One relation for each order with lines: its customer as source, its distinct parts as targets."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("relation_id"), F.col("o_custkey").alias("c"))
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("relation_id"), F.col("l_partkey").alias("p")).distinct()
    known = parts.select("relation_id").distinct()
    relations = orders.join(known, "relation_id", "left_semi").select("relation_id", F.lit(1).cast("long").alias("relation_type_id"), "c")
    parts = parts.join(orders.select("relation_id"), "relation_id", "left_semi")
    source = relations.select(F.shiftleft("relation_id", 24).alias("incidence_id"), "relation_id", node_key(CUSTOMER, F.col("c")).alias("element_id"), F.lit(1).cast("long").alias("role_id"))
    target = parts.select((F.shiftleft("relation_id", 24) + F.col("p") + 1).alias("incidence_id"), "relation_id", node_key(PART, F.col("p")).alias("element_id"), F.lit(2).cast("long").alias("role_id"))
    incidences = source.unionByName(target)
    catalog = Catalog().role("customer").role("part").relation_type("Order").hypergraph_projection("orders", ["customer"], ["part"], ["Order"])
    empty = GraphStore.empty(spark, catalog)
    return GraphStore(incidences.select("element_id").distinct(), relations.select("relation_id", "relation_type_id"), incidences, empty.element_labels, empty.relation_labels, empty.properties, catalog)


def activity(spark: SparkSession, sf_dir: str) -> Graph:
    """user_id -> k of each event's props, one edge for each event; the value is its weight."""
    edges = table(spark, sf_dir, "events").select(F.col("event_id").alias("edge"), F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("long").alias("dst"), F.col("value").alias("weight"))
    return Graph.from_edges(edges)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log: sequence, action_type (1, 2, 3 or 5, and 4 once), arg0, arg1.

    Of each ten events six add an edge, two remove one, and two tombstone: users of
    every third number as nodes, else the edge whose number is the user's.
    """
    k = F.get_json_object("props", "$.k").cast("long")
    n = F.col("event_id") % 10
    action = F.when(F.col("event_id") == 40, 4).when(n < 6, 1).when(n < 8, 5).when((n == 9) & (F.col("user_id") % 3 == 0), 3).otherwise(2)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("sequence"), action.alias("action_type"), F.col("user_id").alias("arg0"), F.when(action.isin(1, 5), k).alias("arg1"))


def seeded_graph(spark: SparkSession, n: int = 10_000, degree: int = 3, seed: int = 42) -> Graph:
    """A graph of n nodes with hubs, the same for the same seed; every pair goes both ways.

    Node i draws degree partners among all nodes, its hash raised to a power, so that
    low numbers are drawn more often. It is made on the executors, at any size.
    """
    draws = spark.range(n * degree).select(F.col("id").alias("draw"), F.floor(F.col("id") / degree).alias("a"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)).alias("u"))
    pairs = draws.select("draw", "a", F.floor(F.pow("u", F.lit(3.0)) * n).cast("long").alias("b")).where("a <> b")
    ends = F.explode(F.array(F.struct((F.col("draw") * 2).alias("edge"), F.col("a").alias("src"), F.col("b").alias("dst")), F.struct((F.col("draw") * 2 + 1).alias("edge"), F.col("b").alias("src"), F.col("a").alias("dst"))))
    return Graph(pairs.select(ends.alias("e")).select("e.*"), spark.range(n).select(F.col("id").alias("element_id")))
