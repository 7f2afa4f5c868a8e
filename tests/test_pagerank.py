import pytest

from weftgraph.errors import NonConvergedError, PageRankError
from weftgraph.graph import Graph
from weftgraph.sources.builders import HypergraphBuilder

EDGES = [(0, 0, 1, 1.0), (1, 1, 2, 1.0), (2, 2, 0, 4.0), (3, 2, 1, 1.0)]
CONFIG = {"tolerance": 1e-12, "max_iterations": 500}


def graph(spark, edges=EDGES):
    e = spark.createDataFrame(edges, "edge long, src long, dst long, weight double")
    return Graph(e, spark.createDataFrame([(i,) for i in range(4)], "element_id long"))


def ranks(df, key="element"):
    return {r[key]: r["rank"] for r in df.collect()}


def close(got, want):
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_uniform(spark):
    close(ranks(graph(spark).pagerank(**CONFIG).ranks), {0: 0.2045815500, 1: 0.3784758675, 2: 0.3693235350, 3: 0.0476190476})


def test_weighted(spark):
    close(ranks(graph(spark).pagerank(weight=True, **CONFIG).ranks), {0: 0.2763395309, 1: 0.3396877697, 2: 0.3363536518, 3: 0.0476190476})


def test_visible_subset_and_zero_weights(spark):
    g = graph(spark)
    close(ranks(g.pagerank(visible=g.vertices.where("element_id < 2"), **CONFIG).ranks), {0: 0.3508771930, 1: 0.6491228070})
    zero = graph(spark, [(e, s, d, 0.0) for e, s, d, _ in EDGES])
    close(ranks(zero.pagerank(weight=True, **CONFIG).ranks), dict.fromkeys(range(4), 0.25))


def test_hypergraph(spark):
    b = HypergraphBuilder(spark)
    for v in "abc":
        b.add_vertex(v)
    b.add_hyperedge([0], [1, 2], 4.0)
    b.add_hyperedge([0, 1], [2], 1.0)
    h = b.freeze()
    got = h.pagerank(**CONFIG)
    close(ranks(got.elements), {0: 0.0926153579, 1: 0.1487055340, 2: 0.3683256344})
    close(ranks(got.relations, "relation"), {0: 0.1319768849, 1: 0.2583765888})
    b.set_incidence_weights([1, 1, 1, 3, 1, 1])
    got = b.freeze().pagerank(relation_weights=b.relation_weights(), **CONFIG)
    close(ranks(got.elements), {0: 0.0867366820, 1: 0.1796316683, 2: 0.3337451880})
    close(ranks(got.relations, "relation"), {0: 0.1457176257, 1: 0.2541688360})


def test_errors(spark):
    g = graph(spark)
    with pytest.raises(NonConvergedError):
        g.pagerank(tolerance=1e-15, max_iterations=2)
    with pytest.raises(PageRankError):
        g.pagerank(damping=1.5)
    with pytest.raises(PageRankError):
        g.pagerank(visible=g.vertices.limit(0))
    with pytest.raises(PageRankError):
        g.pagerank(personalization=spark.createDataFrame([(0, 0.0)], "element long, weight double"))
    with pytest.raises(Exception, match="weight"):
        graph(spark, [(0, 0, 1, -1.0)]).pagerank(weight=True)


def test_personalized_falls_back_to_uniform(spark):
    g = graph(spark)
    close(ranks(g.personalized_pagerank([99], **CONFIG)), ranks(g.pagerank(**CONFIG).ranks))
    order = [r["element"] for r in g.personalized_pagerank([2, 2], **CONFIG).collect()]
    assert order[0] in (1, 2) and order[-1] == 3
