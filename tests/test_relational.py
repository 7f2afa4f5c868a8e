import random

import pytest

from weftgraph.errors import DuplicateNameError, GraphError, RegistrationError, SchemaConflictError, SyncError, UnknownElementError
from weftgraph.sources import layers
from weftgraph.sources.builders import GraphBuilder, HypergraphBuilder
from weftgraph.sources.relational import Config, Registry, RelationalGraph, overlay_state
from weftgraph.streaming import SyncLogStream

LOG = "sequence long, action_type int, arg0 long, arg1 long"


def dense(spark, pairs, n=None, log=None, **config):
    e = spark.createDataFrame([(i, s, d) for i, (s, d) in enumerate(pairs)], "edge long, src long, dst long")
    g = RelationalGraph.from_dense_edges(e, n, Config(**config))
    return g if log is None else g.with_log(spark.createDataFrame([(i + 1, *r) for i, r in enumerate(log)], LOG))


def nodes(df):
    return [r["element"] for r in df.orderBy("rank").collect()]


def test_registered_tables(spark):
    r = Registry().add_table("nodes", "id").add_edge("edges", "nodes", "src", "nodes", "dst").add_filter_column("nodes", "kind")
    t = {"nodes": spark.createDataFrame([(1,), (2,), (3,)], "id long"), "edges": spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")}
    g = RelationalGraph.build(r, t)
    one = 1 << 32
    assert nodes(g.traverse([one + 1])) == [one + 1, one + 2, one + 3]
    assert nodes(g.traverse([one + 3], direction="in")) == [one + 3, one + 2, one + 1]
    assert g.estimate().first().asDict() == {"nodes": 3, "edges": 2} and '"tables":1' in g.status().first()[0]
    with pytest.raises(RegistrationError):
        r.add_table("nodes", "id")
    with pytest.raises(RegistrationError):
        Registry().add_table("1x", "id")
    with pytest.raises(RegistrationError):
        RelationalGraph.build(r, t | {"edges": t["edges"].limit(0)})
    with pytest.raises(RegistrationError):
        Config(search_limit=0)


def test_freshness(spark):
    g = dense(spark, [(0, 1)], 3, [(1, 0, 2)])
    assert nodes(g.traverse([0], max_depth=2)) == [0, 1, 2]
    assert nodes(g.traverse([0], max_depth=2, freshness="base_only")) == [0, 1]


def test_no_cap_finds_everything(spark):
    # A fan of three levels, inwards, wider than the default cap of a traversal.
    pairs = [(1, 0), (2, 0)] + [(i, 1 + i % 2) for i in range(3, 10_503)]
    g, whole = (dense(spark, pairs, None, [(1, 10_503, 3), (3, 5, None)], **c) for c in ({}, {"traverse_limit": None}))
    want = {(0, 0), (1, 1), (2, 1), (10_503, 3)} | {(i, 2) for i in range(3, 10_503) if i != 5}
    for ordered in (False, True):
        got = [(r["element"], r["depth"]) for r in whole.traverse([0], None, direction="in", ordered=ordered).collect()]
        assert len(got) == len(want) and set(got) == want
    assert whole.visited_count(0, direction="in") == len(want) and len(nodes(whole.traverse([0], 7, direction="in"))) == 7
    assert g.traverse([0], None, direction="in", ordered=False).count() == g.visited_count(0, direction="in") == 10_000
    with pytest.raises(RegistrationError):
        Config(traverse_limit=0)


def test_tombstones(spark):
    g = dense(spark, [(0, 1), (1, 2)], None, [(2, 1, None)])
    assert nodes(g.traverse([0])) == [0, 1] and nodes(g.traverse([2], direction="in")) == [2]
    g = dense(spark, [(0, 1), (0, 1), (0, 2)], None, [(3, 1, None)])
    assert g.visited_count(0, 1) == 2 and dense(spark, [(0, 1), (0, 1), (0, 2)]).visited_count(0, 1) == 3
    assert [r[0] for r in g.search(2, 0).collect()] == [0, 2] and [r[0] for r in g.search(-4).collect()] == [0]
    assert nodes(dense(spark, [(0, 0), (0, 1), (0, 1)]).traverse([0], limit=1)) == [0]
    with pytest.raises(UnknownElementError):
        g.traverse([0, 9])
    with pytest.raises(RegistrationError):
        dense(spark, [(0, 5)], 3)


def replay(log):
    added, edges, dead = [], set(), set()
    for s, a, x, y in log:
        if a == 1:
            added.append((s, x, y))
        elif a == 5:
            added = [e for e in added if e[1:] != (x, y)]
        elif a == 2:
            edges.add(x)
        elif a == 3:
            dead.add(x)
        else:
            added, edges, dead = [], set(), set()
    return sorted(added), edges, dead


def random_log(rng, n):
    return [(i + 1, rng.choice([1, 1, 1, 5, 2, 3, 4] if rng.random() < 0.3 else [1, 5, 1]), rng.randrange(3), rng.randrange(3)) for i in range(n)]


def test_overlay_against_a_replay(spark):
    rng = random.Random(4)
    for _ in range(4):
        log = random_log(rng, 25)
        o = overlay_state(spark.createDataFrame(log, LOG))
        got = sorted((r["sequence"], r["src"], r["dst"]) for r in o.added.collect()), {r[0] for r in o.dead_edges.collect()}, {r[0] for r in o.dead_nodes.collect()}
        assert got == replay(log)
    with pytest.raises(SyncError):
        overlay_state(spark.createDataFrame([(1, 1, 0, 1), (1, 1, 0, 2)], LOG))
    with pytest.raises(SyncError):
        overlay_state(spark.createDataFrame([(1, 9, 0, 1)], LOG))


def test_stream_equals_batch(spark, tmp_path):
    log = random_log(random.Random(6), 30)
    stream = SyncLogStream(spark, str(tmp_path / "in"), str(tmp_path / "state"))
    for part in (log[:12], log[12:]):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.start().awaitTermination()
    added, edges, dead = replay(log)
    o = stream.overlay()
    assert sorted((r["sequence"], r["src"], r["dst"]) for r in o.added.collect()) == added
    assert o.health().first().asDict() == {"overlay_edges": len(added), "tombstoned_edges": len(edges), "tombstoned_nodes": len(dead)}


def test_builders(spark):
    b = GraphBuilder(spark)
    a, c = b.add_node("a"), b.add_node("c", 2.0)
    b.add_edge(a, c)
    b.add_edge(a, a, 3.0)
    with pytest.raises(DuplicateNameError):
        b.add_node("a")
    with pytest.raises(UnknownElementError):
        b.add_edge(0, 7)
    with pytest.raises(GraphError):
        b.set_weights([1.0])
    g = b.freeze()
    assert g.edges.count() == 2 and [r[0] for r in g.successors(0).orderBy("element").collect()] == [0, 1]
    h = HypergraphBuilder(spark)
    for v in "abcd":
        h.add_vertex(v)
    h.add_hyperedge([1, 0], [3, 2])
    h.add_hyperedge([2], [0])
    with pytest.raises(DuplicateNameError):
        h.add_hyperedge([1, 1], [0])
    assert [(r, i, v) for r, i, v, _ in h.incidences()] == [(0, 0, 0), (0, 1, 1), (1, 2, 2), (0, 3, 2), (0, 4, 3), (1, 5, 0)]
    f = h.freeze()
    assert sorted(tuple(r) for r in f.successors().collect()) == [(0, 2), (0, 3), (1, 2), (1, 3), (2, 0)]
    assert [r[0] for r in f.incident(0, "target").collect()] == [1] and f.participants(0, "source").count() == 2


def test_layers(spark):
    layer = spark.createDataFrame([(0, 1.0), (2, 3.0)], "id long, value double")
    ids = spark.range(3)
    assert {r[0]: r[1] for r in layers.total(layer, ids, 9.0).collect()} == {0: 1.0, 1: 9.0, 2: 3.0}
    assert layers.check_layer(layer, 3, sparse=True) is layer
    with pytest.raises(SchemaConflictError):
        layers.check_layer(layer, 3, sparse=False)
    local = spark.createDataFrame([(0, 2), (1, 0)], "local_idx long, canonical_id long")
    assert {r[0]: r[1] for r in layers.rekey(layer, local).collect()} == {0: 3.0, 1: 1.0}
    with pytest.raises(SchemaConflictError):
        layers.rekey(layer, spark.createDataFrame([(0, 1)], "local_idx long, canonical_id long"))
