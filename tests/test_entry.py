import duckdb
import pytest

import __spark_entry__ as entry
from weftgraph import queries as graph_queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["label_scan", "where_compound", "hyper_successors", "supplier_two_hops", "bfs_both", "wcc", "topo_levels", "pagerank_personalized", "sync_overlay_state", "search_range"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(graph_queries.ORACLES[name])
    names = sorted(want.columns)
    rows = sorted(map(str, want.project(", ".join(names)).fetchall()))
    assert rows == sorted(str(tuple(r)) for r in graph_queries.QUERIES[name](spark, DATA).select(names).collect())


@pytest.mark.parametrize("name, ends", [("traverse_incoming", "spoke, at"), ("traverse_overlay_aware", "at, spoke"), ("traverse_base_only", "at, spoke")])
def test_wide_traversals_equal_their_sql(spark, tmp_path, name, ends):
    # A hub, three levels around it, more nodes than the default cap of a traversal.
    level = "CASE id % 4 WHEN 1 THEN id + 99 WHEN 2 THEN id + 99 ELSE 1 END"
    user, k = ends.split(", ")
    rows = spark.range(24_000).selectExpr("id AS event_id", "id + 100 AS spoke", f"{level} AS at")
    rows.selectExpr("event_id", f"{user} AS user_id", f"concat('{{\"k\": ', {k}, '}}') AS props", "1.0D AS value").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.sql(graph_queries.ORACLES[name]).project("element, depth").fetchall())
    assert len(want) > 10_000 and {d for _, d in want} == {0, 1, 2, 3}
    assert sorted(tuple(r) for r in graph_queries.QUERIES[name](spark, str(tmp_path)).select("element", "depth").collect()) == want
