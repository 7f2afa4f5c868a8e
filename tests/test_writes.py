"""Writes, versions, registrations, change logs, and operators row by row against plain versions."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from weftgraph.catalog import Catalog
from weftgraph.errors import CommitConflictError, RegistrationError, SyncError, UnknownElementError
from weftgraph.examples import seeded_graph
from weftgraph.graph import Graph
from weftgraph.operators import traversal
from weftgraph.operators.components import connected, members
from weftgraph.operators.pagerank import pagerank
from weftgraph.sources.relational import Registry, RelationalGraph, captured, in_order, overlay_state, resolved, sync_nodes
from weftgraph.store import GraphStore, versions


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def store(spark):
    c = Catalog().role("from").role("to").label("Depot").label("Yard").relation_type("Road").relation_type("Rail").property_key("code", "element", "integer")
    s, _ = GraphStore.empty(spark, c).add_elements(frame(spark, [(i,) for i in range(4)], "n long"), ["n"])
    s, _ = s.add_relations(frame(spark, [(1, 1), (2, 2)], "n long, relation_type_id long"), ["n"])
    return s.compact()


def test_ids_are_never_given_out_again(spark, store):
    s = store.without(0, frame(spark, [(4,), (3,)], "subject_id long"))
    s, new = s.add_elements(frame(spark, [("a",), ("b",)], "t string"), ["t"])
    assert sorted(r["element_id"] for r in new.collect()) == [5, 6] and sorted(r[0] for r in s.elements.collect()) == [1, 2, 5, 6]


def test_last_write_wins_and_equal_writes_change_nothing(spark, store):
    s = store.set_properties("code", frame(spark, [(1, 10, 1), (1, 7, 3), (1, 30, 2), (2, 4, 1)], "subject_id long, value long, seq int"))
    assert s.property(0, 1, "code") == 7 and s.property(0, 2, "code") == 4 and s.properties.count() == 2 and s.validate().isEmpty()
    assert s.set_properties("code", frame(spark, [(1, 7)], "subject_id long, value long")) is s
    assert s.set_properties("code", frame(spark, [(1, 7), (2, 5)], "subject_id long, value long")).properties.count() == 2
    t = store.set_relation_type(frame(spark, [(1, 2, 2), (1, 1, 1)], "relation_id long, relation_type_id long, seq int"))
    assert sorted(tuple(r) for r in t.relations.collect()) == [(1, 2), (2, 2)]
    assert store.set_relation_type(frame(spark, [(2, 2)], "relation_id long, relation_type_id long")) is store
    labels = frame(spark, [(1, 1), (1, 1)], "element_id long, label_id long")
    once = store.add_labels(0, labels)
    assert once.element_labels.count() == 1 and once.add_labels(0, labels) is once
    with pytest.raises(UnknownElementError):
        store.add_labels(0, frame(spark, [(1, 9)], "element_id long, label_id long"))
    with pytest.raises(UnknownElementError):
        store.set_relation_type(frame(spark, [(9, 1)], "relation_id long, relation_type_id long"))


def test_versions_are_whole(spark, store, tmp_path):
    path = str(tmp_path / "s")
    assert GraphStore.create(spark, path).elements.count() == 0 and store.save(path) == 1
    pinned = GraphStore.open(spark, path)
    done = GraphStore.write(spark, path, lambda s: s.without(0, frame(spark, [(4,)], "subject_id long")))
    assert (done.version, done.empty, done.store.elements.count(), pinned.elements.count()) == (2, False, 3, 4)
    same = GraphStore.write(spark, path, lambda s: s)
    assert same.empty and same.version == 2
    with pytest.raises(ZeroDivisionError):
        GraphStore.write(spark, path, lambda s: 1 / 0)
    assert versions(spark, path) == [0, 1, 2]

    def late(s):
        s.add_elements(frame(spark, [("x",)], "t string"), ["t"])[0].save(path)  # another writer is first
        return s.without(0, frame(spark, [(1,)], "subject_id long"))

    with pytest.raises(CommitConflictError):
        GraphStore.write(spark, path, late)
    again = GraphStore.open(spark, path)
    assert sorted(r[0] for r in again.elements.collect()) == [1, 2, 3, 5] and GraphStore.open(spark, path, 1).elements.count() == 4
    with pytest.raises(UnknownElementError):
        GraphStore.open(spark, path, 9)


REGISTRY = Registry().add_table("depot", "k").add_table("trip", "t").add_edge("trip", "trip", "t", "depot", "k").add_filter_column("trip", "day")


def test_registrations_as_rows(spark, tmp_path):
    assert Registry.load(REGISTRY.rows(spark)) == REGISTRY
    rows = REGISTRY.rows(spark)
    with pytest.raises(RegistrationError):
        Registry.load({**rows, "tables": rows["tables"].where("table_id = 1")})
    tables = {"depot": frame(spark, [(1,), (2,)], "k long"), "trip": frame(spark, [(5, 1), (6, 2), (7, 9)], "t long, k long")}
    g = RelationalGraph.build(REGISTRY, tables)
    g.save(str(tmp_path / "g"))
    h = RelationalGraph.load_persisted(spark, str(tmp_path / "g"))
    assert h.registry == REGISTRY and sorted(map(tuple, h.edges.collect())) == sorted(map(tuple, g.edges.collect())) and h.edges.count() == 2
    assert g.reset().edges.isEmpty() and g.rebuild(tables).edges.count() == 2
    log = captured(tables["trip"].where("t = 5"), tables["trip"].where("t = 6"), REGISTRY.edges[0], 10)
    assert [(r["sequence"], r["action_type"], r["arg0"] & 0xFFFFFFFF) for r in log.orderBy("sequence").collect()] == [(10, 1, 5), (11, 5, 6)]


LOG = "sequence long, action_type int, arg0 long, arg1 long"


def test_keys_of_the_log(spark):
    edges = frame(spark, [(100, 300), (200, 300)], "src long, dst long")
    log = frame(spark, [(1, 1, 100, 250), (2, 5, 200, 300), (3, 2, 7, None), (4, 4, None, None)], LOG)
    nodes = sync_nodes(edges, log)
    assert {r["key"]: r["node"] for r in nodes.collect()} == {100: 0, 200: 1, 250: 2, 300: 3}
    assert sorted(map(tuple, resolved(log, nodes).collect()))[:3] == [(1, 1, 0, 2), (2, 5, 1, 3), (3, 2, 7, None)]
    for bad in ([(1, 1, 100, 999)], [(1, 5, None, 100)]):
        with pytest.raises(SyncError):
            resolved(frame(spark, bad, LOG), nodes)


def test_order_of_arrival(spark):
    rows = [(i, 3 * i, 1, i, i) for i in range(200)]
    schema = f"at long, {LOG}"
    assert in_order(frame(spark, rows, schema), "at").count() == 200
    for swap in (3, 150):
        late = [(i, 3 * i - (10 if i == swap else 0), 1, i, i) for i in range(200)]
        with pytest.raises(SyncError):
            overlay_state(frame(spark, late, schema), arrival="at")
        assert overlay_state(frame(spark, late, schema).drop("at")).added.count() == 200


def test_limits_without_order(spark):
    star = [(i, 0, i) for i in range(1, 21)]
    g = RelationalGraph(frame(spark, star, "edge long, src long, dst long"), spark.range(21).select(F.col("id").alias("node")))
    assert sorted(r["element"] for r in g.traverse([0], 3, ordered=False).collect()) == [0, 1, 2]
    from dataclasses import replace

    from weftgraph.sources.relational import Config

    capped = replace(g, config=Config(traverse_limit=5))
    assert capped.visited_count(0) == 5 and g.visited_count(0) == 21
    assert g.graph_traverse(-4, 4, -1) == [0, 1, 2, 3] and g.graph_traverse([7], direction="in") == [7, 0]


def test_components_of_a_sorted_path_take_few_rounds(spark):
    rounds = []
    edges = spark.range(20_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = connected(edges, rounds.append).agg(F.max("label"), F.count("*")).first()
    assert tuple(got) == (0, 20_001) and len(rounds) <= 14


def test_members_of_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)]
    root = list(range(60))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    g = Graph.from_edges(frame(spark, pairs, "src long, dst long"), spark.range(60).select(F.col("id").alias("element_id")))
    got = sorted((r["component"], r["pos"], r["element"]) for r in members(g.weak_components()).collect())
    want = []
    for c in range(60):
        want += [(c, i, e) for i, e in enumerate(e for e in range(60) if top(e) == c)]
    assert got == want


def test_long_paths_and_linear_order(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(0, 7), (3, 40)]
    g = Graph.from_edges(frame(spark, pairs, "src long, dst long"))
    assert [(r["pos"], r["element"]) for r in g.longest_path().collect()] == [(i, i) for i in range(41)]
    rng = random.Random(5)
    dag = [(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(60)) if a < b]
    place = {r["element"]: r["pos"] for r in Graph.from_edges(frame(spark, dag, "src long, dst long")).topological_order().collect()}
    assert sorted(place.values()) == list(range(len(place))) and all(place[a] < place[b] for a, b in dag)


def test_edges_stay_where_they_are(spark, monkeypatch):
    """A level and a round move the frontier and what is given, not the edges; small and large frontiers agree."""
    g = seeded_graph(spark, 300)
    moves = traversal.layout(g.edges, "outgoing")
    moves.count()
    frontier = frame(spark, [(1, 0), (2, 1)], "at long, parent long")
    for size in (2, traversal.BROADCAST_ROWS + 1):
        plan = traversal.ahead(frontier, size, moves)._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" not in line]
        assert len(dealt) <= (size > traversal.BROADCAST_ROWS), plan  # the frontier at most
    moves.unpersist()
    want = {(r["element"], r["depth"]) for r in g.bfs_bounded([5], 3, include_seeds=True).collect()}
    monkeypatch.setattr(traversal, "BROADCAST_ROWS", 0)
    assert {(r["element"], r["depth"]) for r in g.bfs_bounded([5], 3, include_seeds=True).collect()} == want
    ahead = {}
    for r in g.edges.collect():
        ahead.setdefault(r["src"], set()).add(r["dst"])
    plain, queue = {5: 0}, deque([5])
    while queue:
        v = queue.popleft()
        for t in ahead.get(v, ()):
            if t not in plain and plain[v] < 3:
                plain[t] = plain[v] + 1
                queue.append(t)
    assert want == set(plain.items())


def test_hubs_are_split(spark, monkeypatch):
    from weftgraph.operators import pagerank as module

    edges = frame(spark, [(0, i) for i in range(1, 40)] + [(i, 0) for i in range(1, 40)], "src long, dst long").withColumn("edge", F.monotonically_increasing_id())
    states = spark.range(40).select(F.col("id").alias("element_id"))
    whole = {r["element"]: r["rank"] for r in pagerank(edges, states, max_iterations=8, fixed=True).ranks.collect()}
    monkeypatch.setattr(module, "HUB_EDGES", 3)
    split = {r["element"]: r["rank"] for r in pagerank(edges, states, max_iterations=8, fixed=True).ranks.collect()}
    assert all(abs(whole[e] - split[e]) < 1e-12 for e in whole) and abs(sum(split.values()) - 1) < 1e-9
