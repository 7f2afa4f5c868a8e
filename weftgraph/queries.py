"""Registered queries over the test tables, and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import examples as X
from weftgraph.catalog import Schema
from weftgraph.graph import HyperGraph
from weftgraph.operators.components import members, sizes
from weftgraph.session import numbered, shared_folder
from weftgraph.sources import layers
from weftgraph.sources.builders import GraphBuilder, HypergraphBuilder
from weftgraph.sources.relational import Config, Registry, RelationalGraph, captured, dense_nodes, edge_scan, overlay_state, resolved, sync_nodes
from weftgraph.store import GraphStore, merged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: 2^32: the table's place in a node key.
T = 4294967296

GEO = f"""
geo_label AS (
  SELECT {T}*1 + r_regionkey AS element_id, 1::BIGINT AS label_id FROM region UNION ALL SELECT {T}*2 + n_nationkey, 2 FROM nation
  UNION ALL SELECT {T}*3 + c_custkey, 3 FROM customer UNION ALL SELECT {T}*4 + s_suppkey, 4 FROM supplier),
geo_edge AS (
  SELECT {T}*3 + c_custkey AS edge, {T}*3 + c_custkey AS src, {T}*2 + c_nationkey AS dst, 1::BIGINT AS type FROM customer
  UNION ALL SELECT {T}*4 + s_suppkey, {T}*4 + s_suppkey, {T}*2 + s_nationkey, 2 FROM supplier
  UNION ALL SELECT {T}*2 + n_nationkey, {T}*2 + n_nationkey, {T}*1 + n_regionkey, 3 FROM nation),
geo_inc AS (
  SELECT 2*edge AS incidence_id, edge AS relation_id, src AS element_id, 1::BIGINT AS role_id FROM geo_edge
  UNION ALL SELECT 2*edge + 1, edge, dst, 2 FROM geo_edge)"""
SUPPLIES = f"sup AS (SELECT l_partkey*16777216 + l_suppkey AS edge, {T}*4 + l_suppkey AS src, {T}*5 + l_partkey AS dst, sum(l_quantity) AS weight FROM lineitem GROUP BY l_partkey, l_suppkey)"
ORDERS = f"""
orel AS (SELECT o_orderkey AS relation_id, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
side AS (
  SELECT relation_id, relation_id*16777216 AS incidence_id, {T}*3 + o_custkey AS element_id, 'source' AS side FROM orel
  UNION ALL SELECT DISTINCT l_orderkey, l_orderkey*16777216 + l_partkey + 1, {T}*5 + l_partkey, 'target' FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))"""


def activity_sql() -> str:
    return "act AS (SELECT event_id AS edge, user_id AS src, json_extract_string(props, '$.k')::BIGINT AS dst, value AS weight FROM events), node AS (SELECT DISTINCT unnest([src, dst]) AS id FROM act)"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# -- scans and lookups --------------------------------------------------------------------
@query(f"WITH {GEO} SELECT element_id FROM geo_label")
def scan_elements(spark, d):
    return X.geo(spark, d).query("MATCH ELEMENTS")


@query(f"WITH {GEO} SELECT edge AS relation_id FROM geo_edge")
def scan_relations(spark, d):
    return X.geo(spark, d).query("MATCH RELATIONS")


@query(f"WITH {GEO} SELECT * FROM geo_inc")
def scan_incidences(spark, d):
    return X.geo(spark, d).query("MATCH INCIDENCES")


@query("SELECT * FROM (VALUES (1::BIGINT, 'geo'), (2, 'customers'), (3, 'geo_hyper')) t(projection_id, name)")
def catalog_projections(spark, d):
    return X.geo(spark, d).query("CATALOG")


@query(f"WITH {GEO} SELECT element_id FROM geo_label WHERE label_id = 4")
def label_scan(spark, d):
    return X.geo(spark, d).query("MATCH ELEMENTS HAS LABEL Supplier")


@query(f"WITH {GEO} SELECT edge AS relation_id FROM geo_edge WHERE type = 2")
def type_scan(spark, d):
    return X.geo(spark, d).query("MATCH RELATIONS TYPE SupplierIn")


@query(f"SELECT {T}*3 + c_custkey AS element_id FROM customer WHERE c_mktsegment = 'BUILDING'")
def prop_equal(spark, d):
    return X.geo(spark, d).query("MATCH ELEMENTS WHERE segment = 'BUILDING'")


@query(f"SELECT 0 AS subject_kind, {T}*3 + c_custkey AS subject_id FROM customer WHERE c_nationkey BETWEEN 3 AND 7 UNION ALL SELECT 0, {T}*4 + s_suppkey FROM supplier WHERE s_nationkey BETWEEN 3 AND 7")
def prop_range(spark, d):
    return X.geo(spark, d).lookup("nation_range", between=(3, 7))


@query(f"SELECT 0 AS subject_kind, {T}*3 + c_custkey AS subject_id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 5")
def prop_composite(spark, d):
    return X.geo(spark, d).lookup("segment_nation", composite=["BUILDING", 5])


@query(f"""SELECT {T}*3 + c_custkey AS element_id FROM customer WHERE c_nationkey < 3 OR (c_mktsegment = 'BUILDING' AND c_nationkey >= 20) OR (c_acctbal > 0) = false
UNION ALL SELECT {T}*4 + s_suppkey FROM supplier WHERE s_nationkey < 3 OR (s_acctbal > 0) = false""")
def where_compound(spark, d):
    return X.geo(spark, d).query("MATCH ELEMENTS WHERE nation < 3 OR ( segment = 'BUILDING' AND nation >= 20 ) OR solvent = false")


@query(f"WITH {GEO} SELECT DISTINCT 0 AS subject_kind, unnest([src, dst]) AS subject_id FROM geo_edge WHERE type = 1 UNION ALL SELECT 1, edge FROM geo_edge WHERE type = 1")
def projection_members(spark, d):
    return X.geo(spark, d).lookup("customers_members")


@query(f"SELECT {T}*3 + min(c_custkey) AS element_id FROM customer WHERE c_mktsegment = 'BUILDING'")
def element_by_key(spark, d):
    return X.geo(spark, d).element_by_key("segment_eq", "BUILDING")


@query("SELECT n_name AS name, n_nationkey::BIGINT AS nation FROM nation WHERE n_nationkey = 7")
def point_read(spark, d):
    return X.geo(spark, d).element(2 * T + 7).select(F.col("properties")["name"].alias("name"), (F.col("element_id") - 2 * T).alias("nation"))


# -- projections and adjacency --------------------------------------------------------------
@query(f"WITH {GEO} SELECT edge, src, dst FROM geo_edge")
def graph_projection_edges(spark, d):
    return X.geo(spark, d).graph("geo").edges


@query(f"WITH {ORDERS} SELECT relation_id, incidence_id, element_id, side FROM side")
def hyper_projection_sides(spark, d):
    return X.order_hyper(spark, d).hypergraph("orders").sides


@query(f"WITH {GEO} SELECT * FROM geo_inc WHERE element_id = {T}*2 + 7")
def element_incidences(spark, d):
    return X.geo(spark, d).element_incidences(2 * T + 7)


@query(f"WITH {GEO} SELECT * FROM geo_inc WHERE relation_id = {T}*2 + 7")
def relation_incidences(spark, d):
    return X.geo(spark, d).relation_incidences(2 * T + 7)


@query(f"WITH {GEO} SELECT edge AS relation_id, src AS first, dst AS second FROM geo_edge")
def endpoints(spark, d):
    return X.geo(spark, d).endpoints()


def _neighbors(spark, d, direction):
    store = X.geo(spark, d)
    return store.neighbors(store.elements_with_label("Nation"), "SupplierIn", direction)


@query(f"WITH {GEO} SELECT DISTINCT dst AS element_id, src AS neighbor FROM geo_edge WHERE type = 2")
def neighbors_in(spark, d):
    return _neighbors(spark, d, "incoming")


@query(f"WITH {GEO} SELECT DISTINCT src AS element_id, dst AS neighbor FROM geo_edge WHERE type = 1")
def neighbors_out(spark, d):
    store = X.geo(spark, d)
    return store.neighbors(store.elements_with_label("Customer"), "CustomerIn", "outgoing")


@query(f"WITH {GEO} SELECT DISTINCT dst AS element_id, src AS neighbor FROM geo_edge WHERE type = 2")
def neighbors_both(spark, d):
    return _neighbors(spark, d, "both")


@query(f"WITH {activity_sql()} SELECT id AS element_id, count(edge) AS degree FROM node LEFT JOIN act ON id = src GROUP BY id")
def degrees_out(spark, d):
    return X.activity(spark, d).degrees()


@query(f"WITH {activity_sql()} SELECT id AS element_id, count(edge) AS degree FROM node LEFT JOIN act ON id = dst GROUP BY id")
def degrees_in(spark, d):
    return X.activity(spark, d).degrees("incoming")


@query(f"WITH {ORDERS} SELECT relation_id, count(*) AS participants FROM side GROUP BY relation_id")
def participant_counts(spark, d):
    return X.order_hyper(spark, d).hypergraph("orders").participant_counts()


@query(f"WITH {ORDERS} SELECT element_id, count(DISTINCT relation_id) AS relations FROM side GROUP BY element_id")
def incident_counts(spark, d):
    return X.order_hyper(spark, d).hypergraph("orders").incident_counts()


@query(f"WITH {ORDERS} SELECT DISTINCT a.element_id AS src, b.element_id AS dst FROM side a JOIN side b USING (relation_id) WHERE a.side = 'source' AND b.side = 'target'")
def hyper_successors(spark, d):
    return X.order_hyper(spark, d).hypergraph("orders").successors()


@query(f"WITH {activity_sql()} SELECT DISTINCT src, dst FROM act")
def unique_adjacency(spark, d):
    return X.activity(spark, d).unique_adjacency()


@query(f"WITH {activity_sql()} SELECT edge, dst AS src, src AS dst FROM act")
def transpose(spark, d):
    return X.activity(spark, d).transpose().edges.select("edge", "src", "dst")


@query(f"""WITH {ORDERS} SELECT DISTINCT 'in' AS kind, element_id AS src, relation_id AS dst FROM side WHERE side = 'source'
UNION ALL SELECT 'out', relation_id, element_id FROM side WHERE side = 'target'""")
def star_expansion(spark, d):
    return X.order_hyper(spark, d).hypergraph("orders").star_expansion()


@query(f"""WITH {activity_sql()}, p AS (SELECT src AS id, edge*2 AS p FROM act UNION ALL SELECT dst, edge*2 + 1 FROM act)
SELECT id AS element_id, row_number() OVER (ORDER BY min(p)) - 1 AS local_idx FROM p GROUP BY id""")
def local_ids(spark, d):
    return X.activity(spark, d).local_ids()


# -- traversals -------------------------------------------------------------------------------
def reach(direction: str, seeds: str, depth: int, keep_seeds: bool = True) -> str:
    moves = {"out": "SELECT DISTINCT src AS a, dst AS b FROM act", "in": "SELECT DISTINCT dst AS a, src AS b FROM act"}
    both = " UNION ".join(moves.values())
    return f"""mv AS ({moves.get(direction, both)}),
r AS (SELECT unnest({seeds})::BIGINT AS id, 0 AS depth UNION SELECT b, depth + 1 FROM r JOIN mv ON a = id WHERE depth < {depth}),
best AS (SELECT id AS element, min(depth)::INTEGER AS depth FROM r GROUP BY id)
SELECT * FROM best{'' if keep_seeds else ' WHERE depth > 0'}"""


ENDS = "[(SELECT min(src) FROM act), (SELECT max(src) FROM act)]"
FIRST = "[(SELECT min(src) FROM act)]"


def _ends(graph) -> list[int]:
    """The smallest and the greatest source: seeds that every scale has."""
    return list(graph.edges.agg(F.min("src"), F.max("src")).first())


@query(f"WITH RECURSIVE {activity_sql()}, {reach('out', ENDS, 3)}")
def bfs_out(spark, d):
    g = X.activity(spark, d)
    return g.bfs_bounded(_ends(g), 3, include_seeds=True)


@query(f"WITH RECURSIVE {activity_sql()}, {reach('in', ENDS, 3, False)}")
def bfs_in(spark, d):
    g = X.activity(spark, d)
    return g.bfs_bounded(_ends(g), 3, direction="incoming")


@query(f"WITH RECURSIVE {activity_sql()}, {reach('both', FIRST, 2)}")
def bfs_both(spark, d):
    g = X.activity(spark, d)
    return g.bfs_bounded(_ends(g)[:1], 2, include_seeds=True, direction="both")


@query(f"WITH RECURSIVE {activity_sql()}, {reach('both', ENDS, 2, False)}")
def bfs_multi_seed(spark, d):
    g = X.activity(spark, d)
    return g.bfs_bounded(_ends(g) * 2, 2, direction="both")


@query(f"WITH RECURSIVE {activity_sql()}, {reach('out', FIRST, 60)}".replace("AS depth FROM r GROUP", "AS hops FROM r GROUP"))
def sssp_hops(spark, d):
    g = X.activity(spark, d)
    return g.hops(_ends(g)[0])


@query(f"""WITH RECURSIVE {SUPPLIES}, act AS (SELECT * FROM sup), {reach('both', f'[{T}*4 + 1]', 2)}""")
def supplier_two_hops(spark, d):
    """Elements within two hops of supplier 1: the flagship query."""
    return X.supplies(spark, d).bfs_bounded([4 * T + 1], 2, include_seeds=True, direction="both")


@query(f"""WITH RECURSIVE {activity_sql()}, walked AS ({reach('out', FIRST, 2).replace('mv AS', 'WITH RECURSIVE mv AS')})
SELECT edge AS relation_id, src AS source, dst AS target FROM act WHERE src IN (SELECT element FROM walked) AND dst IN (SELECT element FROM walked)""")
def walk_internal_edges(spark, d):
    g = X.activity(spark, d)
    return g.walk(_ends(g)[:1], 2, include_start=True).edges


@query(f"WITH {GEO} SELECT dst AS element_id, 1 AS depth FROM geo_edge WHERE src = {T}*3 + 1 UNION ALL SELECT b.dst, 2 FROM geo_edge a JOIN geo_edge b ON a.dst = b.src WHERE a.src = {T}*3 + 1")
def walk_statement(spark, d):
    return X.geo(spark, d).query(f"GRAPH geo WALK FROM {3 * T + 1} DEPTH 2 DIRECTION outgoing")


@query(f"WITH {GEO} SELECT dst AS element_id, 1 AS depth FROM geo_edge WHERE src = {T}*4 + 3")
def neighbors_statement(spark, d):
    return X.geo(spark, d).query(f"GRAPH geo NEIGHBORS {4 * T + 3}")


# -- components and orders ----------------------------------------------------------------------
CLOSURE = "mv AS (SELECT DISTINCT src AS a, dst AS b FROM act{back}), cl AS (SELECT id AS s, id AS t FROM node UNION SELECT s, b FROM cl JOIN mv ON a = t)"


@query(f"WITH RECURSIVE {activity_sql()}, {CLOSURE.format(back=' UNION SELECT dst, src FROM act')} SELECT s AS element, min(t) AS component FROM cl GROUP BY s")
def wcc(spark, d):
    return X.activity(spark, d).weak_components()


@query(f"WITH RECURSIVE {activity_sql()}, {CLOSURE.format(back=' UNION SELECT dst, src FROM act')}, c AS (SELECT s, min(t) AS component FROM cl GROUP BY s) SELECT component, count(*) AS size FROM c GROUP BY component")
def component_members(spark, d):
    return sizes(X.activity(spark, d).weak_components())


@query(f"WITH RECURSIVE {activity_sql()}, {CLOSURE.format(back='')} SELECT a.s AS element, min(a.t) AS component FROM cl a JOIN cl b ON a.s = b.t AND a.t = b.s GROUP BY a.s")
def scc(spark, d):
    return X.activity(spark, d).strong_components()


DAG = f"WITH RECURSIVE {GEO}, r AS (SELECT element_id, 0 AS level FROM geo_label UNION SELECT dst, level + 1 FROM r JOIN geo_edge ON src = element_id)"


@query(f"{DAG} SELECT element_id AS element, max(level)::INTEGER AS level FROM r GROUP BY element_id")
def topo_levels(spark, d):
    g = X.geo(spark, d).graph("geo")
    return g.topological_levels(X.geo(spark, d).elements)


@query(f"{DAG} SELECT max(level)::BIGINT AS length FROM r")
def longest_path_length(spark, d):
    return X.geo(spark, d).graph("geo").longest_path().agg((F.count("*") - 1).alias("length"))


# -- PageRank -------------------------------------------------------------------------------------
ROUNDS = 20


def pagerank_sql(pre: str, states: str, edges: str, teleport: str, rounds: int = ROUNDS) -> str:
    """Chained CTEs; edges(src, dst, w), states(id), teleport(id, t)."""
    ctes = [
        f"st AS ({states})", f"ed0 AS ({edges})", "ed1 AS (SELECT src, dst, sum(w) AS w FROM ed0 WHERE src IN (SELECT id FROM st) AND dst IN (SELECT id FROM st) GROUP BY ALL)",
        "ed AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM ed1 WHERE w > 0)", f"tp0 AS ({teleport})",
        "tp AS (SELECT st.id, coalesce(t, 0.0) / (SELECT sum(t) FROM tp0) AS t FROM st LEFT JOIN tp0 ON st.id = tp0.id)", "r0 AS MATERIALIZED (SELECT id, t AS rank FROM tp)",
    ]
    for i in range(1, rounds + 1):
        ctes.append(f"g{i} AS (SELECT dst, sum(rank * share) AS got FROM ed JOIN r{i - 1} ON src = id GROUP BY dst)")
        ctes.append(f"r{i} AS MATERIALIZED (SELECT tp.id, 0.85 * coalesce(got, 0.0) + (0.15 + 0.85 * (SELECT coalesce(sum(rank), 0.0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM ed))) * t AS rank FROM tp LEFT JOIN g{i} ON tp.id = dst)")
    return f"WITH {pre}, " + ", ".join(ctes) + f" SELECT id AS element, round(rank, 6) AS rank FROM r{rounds}"


def _rounded(ranks: DataFrame, column: str = "element") -> DataFrame:
    return ranks.select(column, F.round("rank", 6).alias("rank"))


@query(pagerank_sql(activity_sql(), "SELECT id FROM node", "SELECT src, dst, 1.0::DOUBLE AS w FROM act", "SELECT id, 1.0::DOUBLE AS t FROM node"))
def pagerank_uniform(spark, d):
    return _rounded(X.activity(spark, d).pagerank(max_iterations=ROUNDS, fixed=True).ranks)


@query(pagerank_sql(activity_sql(), "SELECT id FROM node", "SELECT src, dst, abs(weight) AS w FROM act", "SELECT id, 1.0::DOUBLE AS t FROM node"))
def pagerank_weighted(spark, d):
    g = X.activity(spark, d)
    g = type(g)(g.edges.withColumn("weight", F.abs("weight")), g.vertices)
    return _rounded(g.pagerank(weight=True, max_iterations=ROUNDS, fixed=True).ranks)


@query(pagerank_sql(activity_sql(), "SELECT id FROM node", "SELECT src, dst, 1.0::DOUBLE AS w FROM act", "SELECT id, 1.0::DOUBLE AS t FROM node WHERE id IN (3, 8)"))
def pagerank_personalized(spark, d):
    return _rounded(X.activity(spark, d).personalized_pagerank([3, 8, 8, 10**9], max_iterations=ROUNDS, fixed=True))


@query(pagerank_sql(activity_sql(), "SELECT id FROM node WHERE id < 60", "SELECT src, dst, 1.0::DOUBLE AS w FROM act", "SELECT id, 1.0::DOUBLE AS t FROM node WHERE id < 60"))
def pagerank_visible_subset(spark, d):
    g = X.activity(spark, d)
    return _rounded(g.pagerank(visible=g.vertices.where("element_id < 60"), max_iterations=ROUNDS, fixed=True).ranks)


HYPER_ROUNDS = 8
HYPER_STATES = "SELECT DISTINCT element_id*2 AS id FROM side UNION ALL SELECT relation_id*2 + 1 FROM orel"
HYPER_EDGES = "SELECT DISTINCT element_id*2 AS src, relation_id*2 + 1 AS dst, {w}::DOUBLE AS w FROM side WHERE side = 'source' UNION ALL SELECT relation_id*2 + 1, element_id*2, 1.0 FROM side WHERE side = 'target'"


def hyper_sql(which: str, w: str = "1.0") -> str:
    body = pagerank_sql(ORDERS, HYPER_STATES, HYPER_EDGES.format(w=w), f"SELECT id, 1.0::DOUBLE AS t FROM ({HYPER_STATES})", HYPER_ROUNDS)
    head, tail = body.rsplit(" SELECT id AS element", 1)
    odd = 1 if which == "relation" else 0
    return f"{head} SELECT (id - {odd}) // 2 AS {which}, round(rank, 8) AS rank FROM r{HYPER_ROUNDS} WHERE id % 2 = {odd}"


def _hyper(spark, d, **more):
    return X.order_hyper(spark, d).hypergraph("orders").pagerank(max_iterations=HYPER_ROUNDS, fixed=True, **more)


@query(hyper_sql("element"))
def hyper_pagerank_elements(spark, d):
    return _hyper(spark, d).elements.select("element", F.round("rank", 8).alias("rank"))


@query(hyper_sql("relation"))
def hyper_pagerank_relations(spark, d):
    return _hyper(spark, d).relations.select("relation", F.round("rank", 8).alias("rank"))


@query(hyper_sql("element", "(1 + relation_id % 3)"))
def hyper_pagerank_weighted(spark, d):
    weights = X.order_hyper(spark, d).relations.select("relation_id", (1 + F.col("relation_id") % 3).alias("weight"))
    return _hyper(spark, d, relation_weights=weights).elements.select("element", F.round("rank", 8).alias("rank"))


# -- writing --------------------------------------------------------------------------------------
@query(f"SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + 2 AS elements, count(*) AS segments FROM (SELECT DISTINCT c_mktsegment FROM customer UNION ALL SELECT unnest(['NEW1', 'NEW2']))")
def upsert_merge(spark, d):
    values = X.table(spark, d, "customer").select(F.col("c_mktsegment").alias("value")).unionByName(spark.createDataFrame([("NEW1",), ("NEW2",)], "value string"))
    store, got = X.geo(spark, d).upsert_elements("segment_eq", values)
    return got.agg(F.count("*").alias("segments")).crossJoin(store.elements.agg(F.count("*").alias("elements")))


@query(f"WITH {GEO} SELECT element_id FROM geo_label WHERE label_id <> 4 OR element_id % 2 = 0")
def retain_complement(spark, d):
    store = X.geo(spark, d)
    keep = store.elements.where("element_id % 2 = 0").select(F.col("element_id").alias("subject_id"))
    return store.retain("suppliers", keep).elements


@query(f"WITH {GEO} SELECT * FROM geo_inc WHERE element_id NOT IN (SELECT element_id FROM geo_label WHERE label_id = 2)")
def tombstone_cascade(spark, d):
    store = X.geo(spark, d)
    gone = store.elements_with_label("Nation").select(F.col("element_id").alias("subject_id"))
    return store.without(0, gone).incidences


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 3 THEN 'CHANGED' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 10 <> 7""")
def overlay_merge(spark, d):
    base = X.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    delta = base.where("id % 10 IN (3, 7)").select("id", F.lit("CHANGED").alias("segment"), (F.col("id") % 10 == 7).alias("gone"))
    return merged(base, delta, ["id"])


@query("SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + 30 AS elements, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + 25 AS relations, 2 * ((SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + 25) AS incidences")
def store_stats(spark, d):
    return X.geo(spark, d).stats().select("elements", "relations", "incidences")


@query("SELECT count(*) AS violations FROM region WHERE false")
def store_validate(spark, d):
    return X.geo(spark, d).validate().agg(F.count("*").alias("violations"))


# -- relational graphs ------------------------------------------------------------------------------
REGISTRY = Registry().add_table("customer", "c_custkey").add_table("orders", "o_orderkey").add_edge("orders", "orders", "o_orderkey", "customer", "o_custkey")


def _tables(spark, d):
    return {n: X.table(spark, d, n) for n in ("customer", "orders")}


@query(f"SELECT {T}*2 + o_orderkey AS src, {T} + o_custkey AS dst FROM orders JOIN customer ON c_custkey = o_custkey")
def edge_scan_join(spark, d):
    return edge_scan(REGISTRY.edges[0], REGISTRY, _tables(spark, d))


@query(f"WITH e AS (SELECT {T}*2 + o_orderkey AS src, {T} + o_custkey AS dst FROM orders JOIN customer ON c_custkey = o_custkey), k AS (SELECT DISTINCT unnest([src, dst]) AS key FROM e) SELECT key, row_number() OVER (ORDER BY key) - 1 AS node FROM k")
def dense_ids(spark, d):
    return dense_nodes(edge_scan(REGISTRY.edges[0], REGISTRY, _tables(spark, d)))


@query(f"WITH {activity_sql()} SELECT (SELECT count(*) FROM node) AS nodes, (SELECT count(*) FROM act) AS edges")
def estimate_build(spark, d):
    return _events_graph(spark, d).estimate()


LOG = """log AS (
  SELECT event_id AS seq, CASE WHEN event_id = 40 THEN 4 WHEN event_id % 10 < 6 THEN 1 WHEN event_id % 10 < 8 THEN 5 WHEN event_id % 10 = 9 AND user_id % 3 = 0 THEN 3 ELSE 2 END AS a,
         user_id AS x, json_extract_string(props, '$.k')::BIGINT AS y FROM events),
live AS (SELECT * FROM log WHERE seq > coalesce((SELECT max(seq) FROM log WHERE a = 4), -1)),
added AS (SELECT x AS src, y AS dst, seq AS sequence FROM live i WHERE a = 1 AND NOT EXISTS (SELECT 1 FROM live r WHERE r.a = 5 AND r.x = i.x AND r.y = i.y AND r.seq > i.seq)),
dead_e AS (SELECT DISTINCT x AS edge FROM live WHERE a = 2), dead_n AS (SELECT DISTINCT x AS node FROM live WHERE a = 3)"""


def _events_graph(spark, d) -> RelationalGraph:
    g = X.activity(spark, d)
    return RelationalGraph(g.edges.select("edge", "src", "dst"), g.vertices.select(F.col("element_id").alias("node")))


def _with_overlay(spark, d) -> RelationalGraph:
    return _events_graph(spark, d).with_log(X.event_log(spark, d))


@query(f"WITH {LOG} SELECT * FROM added")
def sync_overlay_state(spark, d):
    return overlay_state(X.event_log(spark, d)).added


@query(f"WITH {LOG} SELECT (SELECT count(*) FROM added) AS overlay_edges, (SELECT count(*) FROM dead_e) AS tombstoned_edges, (SELECT count(DISTINCT x) FROM live WHERE a = 3) AS tombstoned_nodes")
def sync_health(spark, d):
    return overlay_state(X.event_log(spark, d)).health()


SEED = "[(SELECT min(id) FROM node WHERE id NOT IN (SELECT node FROM dead_n))]"


def traverse_sql(more: str) -> str:
    act = f"all_e AS (SELECT edge, src, dst FROM base WHERE edge NOT IN (SELECT edge FROM dead_e){more}), act AS (SELECT * FROM all_e WHERE src NOT IN (SELECT node FROM dead_n) AND dst NOT IN (SELECT node FROM dead_n))"
    base = activity_sql().replace("act AS", "base AS").replace("FROM act", "FROM base")
    return f"WITH RECURSIVE {base}, {LOG}, {act}, {reach('out', SEED, 3)}"


def _traverse(spark, d, **more) -> DataFrame:
    """From the smallest node that is not tombstoned, everything within three hops: no limit, no cap."""
    g = replace(_with_overlay(spark, d), config=Config(traverse_limit=None))
    return g.traverse([g.visible_nodes().agg(F.min("node")).first()[0]], None, max_depth=3, ordered=False, **more)


@query(traverse_sql(" UNION ALL SELECT 1000000000 + sequence, src, dst FROM added"))
def traverse_overlay_aware(spark, d):
    return _traverse(spark, d)


@query(traverse_sql(""))
def traverse_base_only(spark, d):
    return _traverse(spark, d, freshness="base_only")


@query(f"WITH {activity_sql()}, {LOG} SELECT id AS node FROM node WHERE id BETWEEN 30 AND 90 AND id NOT IN (SELECT node FROM dead_n) ORDER BY id LIMIT 25")
def search_range(spark, d):
    return _with_overlay(spark, d).search(90, 30, 25)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE -1.0 END AS value FROM customer")
def sparse_layer_total(spark, d):
    c = X.table(spark, d, "customer")
    return layers.total(c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value")), c.select("c_custkey"), -1.0)


@query("SELECT c.n - 1 - (row_number() OVER (ORDER BY c_custkey) - 1) AS id, c_acctbal AS value FROM customer, (SELECT count(*) AS n FROM customer) c")
def rekey_layer(spark, d):
    c = X.table(spark, d, "customer")
    local = numbered(c.select("c_custkey"), [F.desc("c_custkey")], "local_idx").select("local_idx", F.col("c_custkey").alias("canonical_id"))
    return layers.rekey(c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value")), local)


# -- orders, paths and members row by row ---------------------------------------------------------
@query(f"WITH RECURSIVE {activity_sql()}, {CLOSURE.format(back=' UNION SELECT dst, src FROM act')}, c AS (SELECT s AS element, min(t) AS component FROM cl GROUP BY s) SELECT component, row_number() OVER (PARTITION BY component ORDER BY element) - 1 AS pos, element FROM c")
def component_member_rows(spark, d):
    return members(X.activity(spark, d).weak_components())


@query(f"""WITH {GEO}, up AS (SELECT src, dst FROM geo_edge), top AS (
  SELECT element_id, coalesce(b.dst, a.dst, element_id) AS region FROM geo_label LEFT JOIN up a ON a.src = element_id LEFT JOIN up b ON b.src = a.dst)
SELECT element_id AS element, min(element_id) OVER (PARTITION BY region) AS component FROM top""")
def geo_components(spark, d):
    """A component for each region, with its nations, customers and suppliers."""
    store = X.geo(spark, d)
    return store.graph("geo").weak_components(store.elements)


@query(f"{DAG}, lv AS (SELECT element_id, max(level) AS level FROM r GROUP BY element_id) SELECT element_id AS element, row_number() OVER (ORDER BY level, element_id) - 1 AS pos FROM lv")
def topo_order(spark, d):
    store = X.geo(spark, d)
    return store.graph("geo").topological_order(store.elements)


@query(f"""{DAG}, lv AS (SELECT element_id, max(level) AS level FROM r GROUP BY element_id), p2 AS (SELECT min(element_id) AS e FROM lv WHERE level = 2),
p1 AS (SELECT min(src) AS e FROM geo_edge JOIN lv ON element_id = src WHERE level = 1 AND dst = (SELECT e FROM p2)), p0 AS (SELECT min(src) AS e FROM geo_edge JOIN lv ON element_id = src WHERE level = 0 AND dst = (SELECT e FROM p1))
SELECT 0 AS pos, e AS element FROM p0 UNION ALL SELECT 1, e FROM p1 UNION ALL SELECT 2, e FROM p2""")
def longest_path_rows(spark, d):
    return X.geo(spark, d).graph("geo").longest_path()


DISCOVERY = """s AS (SELECT {seed} AS id), l1 AS (SELECT {to} AS element, row_number() OVER (ORDER BY min(edge)) AS rank FROM e WHERE {at} = (SELECT id FROM s) AND {to} <> {at} GROUP BY {to}),
l2 AS (SELECT {to} AS element, min((rank, edge)) AS p FROM e JOIN l1 ON {at} = element WHERE {to} NOT IN (SELECT element FROM l1 UNION SELECT id FROM s) GROUP BY {to}),
found AS (SELECT id AS element, 0 AS depth, 0 AS rank FROM s UNION ALL SELECT element, 1, rank FROM l1 UNION ALL SELECT element, 2, (SELECT count(*) FROM l1) + row_number() OVER (ORDER BY p) FROM l2)"""


@query(f"WITH {activity_sql()}, e AS (SELECT * FROM act), {DISCOVERY.format(seed='(SELECT min(src) FROM act)', at='src', to='dst')} SELECT * FROM found")
def bfs_discovery_order(spark, d):
    g = X.activity(spark, d)
    return g.bfs_bounded(_ends(g)[:1], 2, include_seeds=True, ordered=True)


@query(f"WITH {GEO}, e AS (SELECT * FROM geo_edge), {DISCOVERY.format(seed=f'{T}*1 + 2', at='dst', to='src')} SELECT element AS element_id, depth FROM found WHERE rank BETWEEN 1 AND 40")
def walk_limit_statement(spark, d):
    return X.geo(spark, d).query(f"GRAPH geo WALK FROM {T + 2} DEPTH 2 DIRECTION incoming LIMIT 40")


@query(f"WITH {GEO}, e AS (SELECT * FROM geo_edge), {DISCOVERY.format(seed=f'{T}*1 + 2', at='dst', to='src')} SELECT element, depth, rank FROM found WHERE rank > 0")
def walk_nodes(spark, d):
    return X.geo(spark, d).graph("geo").walk([T + 2], 2, "incoming").nodes


# -- definitions, builders and writing ----------------------------------------------------------------
@query("""SELECT * FROM (VALUES ('roles', 'source', 1::BIGINT), ('roles', 'target', 2), ('labels', 'Region', 1), ('labels', 'Nation', 2), ('labels', 'Customer', 3), ('labels', 'Supplier', 4), ('relation_types', 'CustomerIn', 1), ('relation_types', 'SupplierIn', 2), ('relation_types', 'PartOf', 3),
('property_keys', 'segment', 1), ('property_keys', 'name', 2), ('property_keys', 'solvent', 3), ('property_keys', 'nation', 4), ('property_keys', 'rating', 5), ('projections', 'geo', 1), ('projections', 'customers', 2), ('projections', 'geo_hyper', 3),
('indexes', 'segment_eq', 1), ('indexes', 'nation_range', 2), ('indexes', 'segment_nation', 3), ('indexes', 'suppliers', 4), ('indexes', 'customers_members', 5), ('indexes', 'rating_eq', 6)) t(kind, name, id)""")
def catalog_definitions(spark, d):
    """Everything defined, after a schema that adds a key and an index was applied twice."""
    schema = Schema(labels=("Region",), property_keys=(("rating", "element", "integer"),), indexes=(("rating_eq", "equality", ("rating",)),))
    c = schema.apply(schema.apply(X.geo(spark, d).catalog))
    rows = [(kind, name, v if isinstance(v, int) else getattr(v, {"property_keys": "key_id", "projections": "projection_id", "indexes": "index_id"}[kind])) for kind in c.summary() for name, v in getattr(c, kind).items()]
    return spark.createDataFrame(rows, "kind string, name string, id long")


@query(f"WITH {GEO}, m AS (SELECT max(element_id) AS m FROM geo_label) SELECT m + n AS element_id, 'new' || n AS name FROM m, range(1, 4) t(n)")
def create_after_tombstone(spark, d):
    """The highest element goes; the next ones do not get its id again."""
    store = X.geo(spark, d)
    store = store.without(0, store.elements.agg(F.max("element_id").alias("subject_id")))
    return store.add_elements(spark.createDataFrame([(f"new{i}",) for i in (1, 2, 3)], "name string"), ["name"])[1].select("element_id", "name")


@query(f"WITH {GEO} SELECT edge AS relation_id, CASE WHEN type = 2 AND edge % 2 = 0 THEN 3 ELSE type END AS relation_type_id FROM geo_edge")
def relation_types_set(spark, d):
    """Two rows for each even supplier relation; the one with the greater seq wins."""
    store = X.geo(spark, d)
    even = store.relations_of_type("SupplierIn").where("relation_id % 2 = 0")
    return store.set_relation_type(even.select("relation_id", F.explode(F.array(F.struct(F.lit(2).alias("seq"), F.lit(3).cast("long").alias("relation_type_id")), F.struct(F.lit(1).alias("seq"), F.lit(1).cast("long").alias("relation_type_id")))).alias("r")).select("relation_id", "r.*")).relations


@query(f"WITH {GEO} SELECT element_id, label_id FROM geo_label UNION SELECT {T}*3 + c_custkey, 4 FROM customer WHERE c_nationkey = 7")
def labels_added(spark, d):
    store = X.geo(spark, d)
    more = store.lookup_equal("nation", 7).select(F.col("subject_id").alias("element_id"), F.lit(4).cast("long").alias("label_id"))
    return store.add_labels(0, more).element_labels


@query(f"SELECT {T}*3 + c_custkey AS subject_id, CASE WHEN c_nationkey = 7 THEN 'LAST' ELSE c_mktsegment END AS text_value FROM customer")
def properties_set(spark, d):
    """Of several values for one customer the last one counts."""
    store = X.geo(spark, d)
    of = F.explode(F.array(F.struct(F.lit(2).alias("seq"), F.lit("LAST").alias("value")), F.struct(F.lit(1).alias("seq"), F.lit("ZZZ").alias("value"))))
    store = store.set_properties("segment", store.lookup_equal("nation", 7).where("subject_id < 4 * 4294967296").select("subject_id", of.alias("v")).select("subject_id", "v.*"))
    return store.properties.where("key_id = 1").select("subject_id", "text_value")


@query(f"SELECT {T}*3 + c_custkey AS subject_id, c_mktsegment AS text_value FROM customer WHERE c_nationkey <> 7")
def properties_unset(spark, d):
    store = X.geo(spark, d)
    return store.unset_properties("segment", store.lookup_equal("nation", 7)).properties.where("key_id = 1").select("subject_id", "text_value")


@query(f"WITH {GEO}, seg AS (SELECT c_mktsegment AS value, dense_rank() OVER (ORDER BY c_mktsegment) AS n, c_custkey FROM customer), m AS (SELECT max(edge) AS m FROM geo_edge) SELECT DISTINCT value, m + n AS relation_id, {T}*3 + min(c_custkey) OVER (PARTITION BY value) AS element_id FROM seg, m")
def relations_upserted(spark, d):
    """A relation for each segment, from its first customer to itself; a second upsert finds them again."""
    store = X.geo(spark, d)
    store = store.with_catalog(store.catalog.property_key("code", "relation", "text").index("code_eq", "equality", "code"))
    first = X.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("value")).agg((F.min("c_custkey") + 3 * T).alias("element_id")).withColumn("role_id", F.lit(1).cast("long"))
    store, _ = store.upsert_relations("code_eq", first, "PartOf")
    store, got = store.upsert_relations("code_eq", first, "PartOf")
    return got.join(store.incidences.select("relation_id", "element_id"), "relation_id").select("value", "relation_id", "element_id")


@query("SELECT * FROM (VALUES ('created', 0, false, 0::BIGINT), ('filled', 1, false, 25), ('unchanged', 1, true, 25), ('failed', 1, false, 25), ('removed', 2, false, 20)) t(step, version, empty, elements)")
def write_versions(spark, d):
    """Transactions on a store in a folder: a commit, one without changes, one that fails, and another."""
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    nations = X.table(spark, d, "nation").select("n_name", "n_regionkey")
    store = GraphStore.create(spark, path)
    steps = [("created", 0, False, store.elements.count())]

    def fail(store: GraphStore) -> GraphStore:
        store.without(0, store.elements.select(F.col("element_id").alias("subject_id")))
        raise ArithmeticError

    for step, change in (("filled", lambda s: s.add_elements(nations, ["n_name"])[0]), ("unchanged", lambda s: s.add_elements(nations.limit(0), ["n_name"])[0]), ("failed", fail), ("removed", lambda s: s.without(0, s.elements.where("element_id <= 5").select(F.col("element_id").alias("subject_id"))))):
        try:
            done = GraphStore.write(spark, path, change)
            steps.append((step, done.version, done.empty, done.store.elements.count()))
        except ArithmeticError:
            steps.append((step, steps[-1][1], False, GraphStore.open(spark, path).elements.count()))
    return spark.createDataFrame(steps, "step string, version int, empty boolean, elements long")


@query("SELECT n_nationkey + 5 AS src, n_regionkey AS dst, n_nationkey::DOUBLE + 1 AS weight FROM nation")
def builder_edges(spark, d):
    """Regions and nations typed in through the builder; small tables only."""
    b = GraphBuilder(spark)
    for r in X.table(spark, d, "region").orderBy("r_regionkey").collect():
        b.add_node(r["r_name"])
    for n in X.table(spark, d, "nation").orderBy("n_nationkey").collect():
        b.add_edge(b.add_node(f"nation {n['n_name']}"), n["n_regionkey"])
    b.set_weights([i + 1 for i in range(len(b.edges))])
    return b.freeze().edges.select("src", "dst", "weight")


@query("WITH s AS (SELECT r_regionkey AS relation_id, r_regionkey AS incidence_id, r_regionkey AS element_id, 'source' AS side FROM region) SELECT * FROM s UNION ALL SELECT n_regionkey, (SELECT count(*) FROM region) + row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1, 5 + n_nationkey, 'target' FROM nation")
def builder_hyperedges(spark, d):
    """A hyperedge for each region: itself as source, its nations as targets."""
    b = HypergraphBuilder(spark)
    nations = X.table(spark, d, "nation").orderBy("n_nationkey").collect()
    regions = X.table(spark, d, "region").orderBy("r_regionkey").collect()
    for r in regions:
        b.add_vertex(r["r_name"])
    for n in nations:
        b.add_vertex(f"nation {n['n_name']}")
    for r in regions:
        b.add_hyperedge([r["r_regionkey"]], [5 + n["n_nationkey"] for n in nations if n["n_regionkey"] == r["r_regionkey"]])
    return b.freeze().sides.select("relation_id", "incidence_id", "element_id", "side")


@query(f"SELECT 1 AS subject_kind, {T}*4 + s_suppkey AS subject_id FROM supplier WHERE s_suppkey = 3")
def relation_point_read(spark, d):
    return X.geo(spark, d).relation(4 * T + 3).select(F.lit(1).alias("subject_kind"), F.col("relation_id").alias("subject_id"))


@query(f"WITH {GEO} SELECT DISTINCT 0 AS subject_kind, element_id AS subject_id FROM geo_inc UNION ALL SELECT DISTINCT 1, relation_id FROM geo_inc UNION ALL SELECT 2, incidence_id FROM geo_inc")
def hyper_projection_members(spark, d):
    return X.geo(spark, d).projection_members("geo_hyper")


@query("SELECT 'suppliers' AS name, (SELECT count(*) FROM supplier) AS members UNION ALL SELECT 'customers_members', (SELECT count(*) FROM customer) * 2 + (SELECT count(DISTINCT c_nationkey) FROM customer)")
def index_counts(spark, d):
    store = X.geo(spark, d)
    return spark.createDataFrame([(i, store.count(i)) for i in ("suppliers", "customers_members")], "name string, members long")


@query(f"SELECT {T}*3 + c_custkey AS subject_id, 1::BIGINT AS key_id, CASE WHEN c_nationkey = 3 THEN 'NEW' ELSE c_mktsegment END AS text_value FROM customer WHERE c_nationkey <> 4")
def property_scan_merged(spark, d):
    """Properties under a delta of changed and removed ones, by subject kind, subject and key."""
    base = X.geo(spark, d).properties.where("key_id = 1").select("subject_kind", "subject_id", "key_id", "text_value")
    of = X.table(spark, d, "customer").select((F.col("c_custkey") + 3 * T).alias("subject_id"), "c_nationkey")
    delta = base.join(of, "subject_id").where("c_nationkey IN (3, 4)").select("subject_kind", "subject_id", "key_id", F.lit("NEW").alias("text_value"), (F.col("c_nationkey") == 4).alias("gone"))
    return merged(base, delta, ["subject_kind", "subject_id", "key_id"]).select("subject_id", "key_id", "text_value")


@query(f"""WITH {GEO} SELECT 'incidence without element' AS what, count(*) AS n FROM geo_inc WHERE element_id % 7 = 0
UNION ALL SELECT 'label without element', count(*) FROM geo_label WHERE element_id % 7 = 0
UNION ALL SELECT 'property without subject', (SELECT 3 * count(*) FROM customer WHERE ({T}*3 + c_custkey) % 7 = 0) + (SELECT 2 * count(*) FROM supplier WHERE ({T}*4 + s_suppkey) % 7 = 0) + (SELECT count(*) FROM nation WHERE ({T}*2 + n_nationkey) % 7 = 0) + (SELECT count(*) FROM region WHERE ({T}*1 + r_regionkey) % 7 = 0)
UNION ALL SELECT 'repeated relation_id', count(*) FROM geo_edge WHERE type = 3""")
def store_violations(spark, d):
    """A store that lost elements without what hangs on them, and has relations twice."""
    store = X.geo(spark, d)
    broken = replace(store, elements=store.elements.where("element_id % 7 <> 0"), relations=store.relations.unionByName(store.relations.where("relation_type_id = 3")))
    return broken.validate().groupBy("what").agg(F.count("*").alias("n"))


@query(f"WITH {GEO}, m AS (SELECT max(element_id) AS m FROM geo_label) SELECT c_mktsegment AS value, {T}*3 + min(c_custkey) AS element_id FROM customer GROUP BY c_mktsegment UNION ALL SELECT 'NEW' || n, m + n FROM m, range(1, 3) t(n)")
def upserted_elements(spark, d):
    """The element of each value: the first that has it, or a new one."""
    values = X.table(spark, d, "customer").select(F.col("c_mktsegment").alias("value")).unionByName(spark.createDataFrame([("NEW1",), ("NEW2",)], "value string"))
    return X.geo(spark, d).upsert_elements("segment_eq", values)[1]


# -- more of hypergraphs ------------------------------------------------------------------------------
@query(f"WITH {ORDERS} SELECT DISTINCT b.element_id AS src, a.element_id AS dst FROM side a JOIN side b USING (relation_id) WHERE a.side = 'source' AND b.side = 'target'")
def hyper_predecessors(spark, d):
    return X.order_hyper(spark, d).hypergraph("orders").predecessors()


@query(f"WITH {ORDERS} SELECT relation_id, row_number() OVER (ORDER BY relation_id) - 1 AS local_idx FROM orel")
def relation_local_ids(spark, d):
    return X.order_hyper(spark, d).hypergraph("orders").local_ids("relation")


@query(f"WITH {ORDERS} SELECT incidence_id, row_number() OVER (ORDER BY incidence_id) - 1 AS local_idx FROM side")
def incidence_local_ids(spark, d):
    return X.order_hyper(spark, d).hypergraph("orders").local_ids("incidence")


def _hyper_seeded() -> str:
    body = pagerank_sql(ORDERS, HYPER_STATES, HYPER_EDGES.format(w="1.0"), f"SELECT id, 1.0::DOUBLE AS t FROM ({HYPER_STATES}) WHERE id IN ({2 * (3 * T + 1)}, {2 * (3 * T + 2)})", HYPER_ROUNDS)
    return body.rsplit(" SELECT id AS element", 1)[0] + f" SELECT id // 2 AS element, round(rank, 8) AS rank FROM r{HYPER_ROUNDS} WHERE id % 2 = 0"


@query(_hyper_seeded())
def hyper_pagerank_personalized(spark, d):
    got = X.order_hyper(spark, d).hypergraph("orders").personalized_pagerank([3 * T + 1, 3 * T + 2, 5], max_iterations=HYPER_ROUNDS, fixed=True)
    return got.elements.select("element", F.round("rank", 8).alias("rank"))


@query(hyper_sql("element").replace("element_id*2, 1.0 FROM side WHERE side = 'target'", "element_id*2, 1 + element_id % 3 FROM side WHERE side = 'target'"))
def hyper_pagerank_incidence_weights(spark, d):
    h = X.order_hyper(spark, d).hypergraph("orders")
    h = HyperGraph(h.sides.withColumn("weight", 1.0 + F.col("element_id") % 3), h.vertices, h.relations)
    return h.pagerank(max_iterations=HYPER_ROUNDS, fixed=True).elements.select("element", F.round("rank", 8).alias("rank"))


# -- more of relational graphs --------------------------------------------------------------------------
@query("SELECT * FROM (VALUES (1, 2, 1, 'orders', 'o_orderkey', 'o_custkey')) t(edge_id, source_table, target_table, name, source_column, target_column)")
def registration_rows(spark, d):
    """Registrations written as rows and read back."""
    return Registry.load(REGISTRY.rows(spark)).rows(spark)["edges"]


@query(f"WITH e AS (SELECT {T}*2 + o_orderkey AS src, {T} + o_custkey AS dst FROM orders JOIN customer ON c_custkey = o_custkey) SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge, src, dst FROM e")
def relational_build(spark, d):
    return RelationalGraph.build(REGISTRY, _tables(spark, d)).edges


@query(f"WITH {activity_sql()}, k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM node), e AS (SELECT a.n AS src, b.n AS dst FROM act JOIN k a ON a.id = src JOIN k b ON b.id = dst) SELECT (SELECT count(*) FROM node) AS nodes, count(*) AS edges, sum(src) AS sources, sum(dst) AS targets FROM e")
def dense_edges_graph(spark, d):
    e = X.activity(spark, d).edges.select("src", "dst")
    ids = dense_nodes(e)
    dense = e.join(ids.toDF("src", "a"), "src").join(ids.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    g = RelationalGraph.from_dense_edges(dense)
    return g.edges.agg(F.count("*").alias("edges"), F.sum("src").alias("sources"), F.sum("dst").alias("targets")).crossJoin(g.nodes.agg(F.count("*").alias("nodes")))  # one row each


@query(f"WITH {activity_sql()}, {LOG.split('live AS')[0].rstrip().rstrip(',')}, k AS (SELECT id FROM node UNION SELECT x FROM log WHERE a IN (1, 5) UNION SELECT y FROM log WHERE a IN (1, 5)), m AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM k) SELECT seq AS sequence, a AS action_type, CASE WHEN a IN (1, 5) THEN mx.n ELSE x END AS arg0, CASE WHEN a IN (1, 5) THEN my.n END AS arg1 FROM log LEFT JOIN m mx ON mx.id = x LEFT JOIN m my ON my.id = y")
def sync_resolved(spark, d):
    """The change log with dense ids for its node keys."""
    log = X.event_log(spark, d)
    return resolved(log, sync_nodes(X.activity(spark, d).edges, log))


@query(f"WITH c AS (SELECT 1 AS action_type, {T}*2 + o_orderkey AS arg0, {T} + o_custkey AS arg1 FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT 5, {T}*2 + o_orderkey, {T} + o_custkey FROM orders WHERE o_orderkey % 7 = 1) SELECT row_number() OVER (ORDER BY action_type, arg0, arg1) AS sequence, * FROM c")
def captured_changes(spark, d):
    """Orders written and deleted, as rows of the change log."""
    orders = X.table(spark, d, "orders")
    return captured(orders.where("o_orderkey % 7 = 0"), orders.where("o_orderkey % 7 = 1"), REGISTRY.edges[0])


@query(traverse_sql(" UNION ALL SELECT 1000000000 + sequence, src, dst FROM added").replace("SELECT DISTINCT src AS a, dst AS b FROM act", "SELECT DISTINCT dst AS a, src AS b FROM act"))
def traverse_incoming(spark, d):
    return _traverse(spark, d, direction="in")


@query(f"WITH {activity_sql()}, e AS (SELECT * FROM act), {DISCOVERY.format(seed='(SELECT min(src) FROM act)', at='src', to='dst')} SELECT element, rank AS pos FROM found WHERE rank < 30")
def traverse_function(spark, d):
    """The first ids that the traverse function returns, in their order."""
    g = _events_graph(spark, d)
    ids = g.graph_traverse(g.nodes.agg(F.min("node")).first()[0], 30, 2)
    return spark.createDataFrame([(e, i) for i, e in enumerate(ids)], "element long, pos long")


@query(f"WITH {activity_sql()}, e AS (SELECT * FROM act), {DISCOVERY.format(seed='(SELECT min(src) FROM act)', at='src', to='dst')} SELECT least(25, count(*)) AS visited FROM found")
def visited_under_limit(spark, d):
    """Without an order the limit holds too."""
    g = _events_graph(spark, d)
    start = g.nodes.agg(F.min("node")).first()[0]
    return g.traverse([start], 25, 2, ordered=False).agg(F.count("*").alias("visited"))


@query()
def seeded_graph_depth_three(spark, d):
    """10,000 nodes with hubs, three hops from the greatest one; a graph of its own, no table is read."""
    return X.seeded_graph(spark).bfs_bounded([0], 3, include_seeds=True)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_two_hops(spark, sf_dir)

