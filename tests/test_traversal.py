import random
from collections import deque

import pytest

from weftgraph.errors import CycleError, UnknownElementError, UnsupportedError
from weftgraph.graph import Graph


def graph(spark, pairs, n=None):
    e = spark.createDataFrame([(i, s, d) for i, (s, d) in enumerate(pairs)], "edge long, src long, dst long")
    v = None if n is None else spark.createDataFrame([(i,) for i in range(n)], "element_id long")
    return Graph.from_edges(e, v)


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def order(df):
    return [r["element"] for r in df.orderBy("rank").collect()]


def test_bfs_order_and_reverse(spark):
    g = graph(spark, [(0, 1), (0, 2), (1, 3), (2, 3)])
    assert order(g.bfs(0, ordered=True)) == [0, 1, 2, 3]
    assert order(g.bfs(3, reverse=True, ordered=True)) == [3, 1, 2, 0]


def test_walks_on_a_cycle(spark):
    a, b, c = 1, 2, 3
    g = graph(spark, [(a, b), (b, c), (c, a)])
    walk = lambda *s, **k: rows(g.walk(list(s), **k).nodes, "element", "depth")
    assert walk(a) == [(b, 1)]
    assert walk(b, direction="incoming") == [(a, 1)]
    assert walk(b, direction="both") == [(c, 1), (a, 1)]
    assert walk(a, max_depth=2) == [(b, 1), (c, 2)]
    assert walk(a, b, max_depth=2, include_start=True) == [(a, 0), (b, 0), (c, 1)]
    assert walk(a, max_depth=2, limit=1) == [(b, 1)]
    assert walk() == [] and walk(a, limit=0) == []
    with pytest.raises(UnknownElementError):
        walk(9)
    with pytest.raises(UnsupportedError):
        walk(a, direction="up")
    assert rows(g.walk([a], max_depth=2, include_start=True).edges, "source", "target") == [(a, b), (b, c), (c, a)]
    assert rows(g.walk([a]).edges, "source", "target") == [(a, b)]


def plain_bfs(pairs, seeds, depth, direction, include, limit):
    seen, out, queue = set(seeds), [], deque()
    for s in dict.fromkeys(seeds):
        queue.append((s, 0))
        if include:
            out.append((s, 0))
    while queue:
        v, d = queue.popleft()
        if depth is not None and d >= depth:
            continue
        ahead = [t for s, t in pairs if s == v] if direction != "incoming" else []
        back = [s for s, t in pairs if t == v] if direction != "outgoing" else []
        for w in ahead + back:
            if w not in seen:
                seen.add(w)
                out.append((w, d + 1))
                queue.append((w, d + 1))
    return out if limit is None else out[:limit]


def test_random_graphs_against_a_plain_search(spark):
    rng = random.Random(5)
    for _ in range(6):
        n = rng.randint(1, 7)
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 14))]
        seeds = [rng.randrange(n) for _ in range(rng.randint(1, 2))]
        depth, limit = rng.choice([None, 0, 1, 2, 3]), rng.choice([None, 1, 3, 9])
        direction, include = rng.choice(["outgoing", "incoming", "both"]), rng.random() < 0.5
        got = graph(spark, pairs, n).bfs_bounded(seeds, depth, limit, include, direction, ordered=True)
        assert rows(got.orderBy("rank"), "element", "depth") == plain_bfs(pairs, seeds, depth, direction, include, limit)


def test_components(spark):
    g = graph(spark, [(0, 1), (2, 3)], 5)
    assert dict(rows(g.weak_components(), "element", "component")) == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    g = graph(spark, [(0, 1), (1, 2), (2, 0), (2, 3)], 4)
    assert dict(rows(g.strong_components(), "element", "component")) == {0: 0, 1: 0, 2: 0, 3: 3}


def test_strong_components_of_random_graphs(spark):
    rng = random.Random(8)
    for _ in range(2):
        n = 9
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(14)]
        reach = {(a, b) for a in range(n) for b, _ in plain_bfs(pairs, [a], None, "outgoing", True, None)}
        want = {a: min(b for b in range(n) if (a, b) in reach and (b, a) in reach) for a in range(n)}
        assert dict(rows(graph(spark, pairs, n).strong_components(), "element", "component")) == want


def test_orders(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 3), (0, 2)], 4)
    assert rows(g.longest_path(), "pos", "element") == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert dict(rows(g.topological_levels(), "element", "level")) == {0: 0, 1: 1, 2: 2, 3: 3}
    cycle = graph(spark, [(0, 1), (1, 2), (2, 0)], 3)
    with pytest.raises(CycleError):
        cycle.topological_levels()
    two = spark.createDataFrame([(0,), (1,)], "element_id long")
    assert rows(cycle.longest_path(two), "element") == [(0,), (1,)]
    with pytest.raises(CycleError):
        graph(spark, [(0, 0)], 1).longest_path()
    assert rows(graph(spark, [(0, 1), (1, 2), (3, 4)], 5).longest_path(), "element") == [(0,), (1,), (2,)]
    assert rows(g.longest_path(g.vertices.limit(0)), "element") == []


def test_hops(spark):
    g = graph(spark, [(0, 1), (0, 3), (1, 2)], 4)
    assert dict(rows(g.hops(0), "element", "hops")) == {0: 0, 1: 1, 2: 2, 3: 1}
    some = spark.createDataFrame([(1,), (2,)], "element_id long")
    assert rows(g.hops(0, some), "element") == []


def test_degrees_and_parallel_edges(spark):
    g = graph(spark, [(0, 1), (0, 1), (0, 2)], 3)
    assert dict(rows(g.degrees(), "element_id", "degree")) == {0: 3, 1: 0, 2: 0}
    assert g.unique_adjacency().count() == 2
    assert rows(g.transpose().out_edges(1), "edge", "dst") == [(0, 0), (1, 0)]
