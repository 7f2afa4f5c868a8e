"""Graphs over registered relational tables, with an overlay of logged changes."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.errors import RegistrationError, SyncError, UnknownElementError
from weftgraph.functions.keys import node_key, valid_identifier, valid_primary_key, valid_table_id
from weftgraph.operators import traversal
from weftgraph.session import cut, numbered


@dataclass(frozen=True)
class Config:
    """Caps of what a call returns, as a server needs them; a traverse_limit of None is no cap."""

    traverse_limit: int | None = 10_000
    search_limit: int = 10_000
    maintenance: bool = True
    freshness: str = "overlay_aware"

    def __post_init__(self):
        if self.traverse_limit is not None and self.traverse_limit < 1 or self.search_limit < 1 or self.freshness not in ("overlay_aware", "base_only"):
            raise RegistrationError("limits must be positive and freshness overlay_aware or base_only")


@dataclass(frozen=True)
class Table:
    table_id: int
    name: str
    key: str


@dataclass(frozen=True)
class Edge:
    edge_id: int
    source_table: int
    target_table: int
    name: str
    source_column: str
    target_column: str


REGISTRATIONS = {
    "tables": "table_id int, name string, key string",
    "edges": "edge_id int, source_table int, target_table int, name string, source_column string, target_column string",
    "filter_columns": "table_id int, column string",
}


@dataclass(frozen=True)
class Registry:
    """Registered tables, edges and filter columns; each registration gives a new registry."""

    tables: tuple[Table, ...] = ()
    edges: tuple[Edge, ...] = ()
    filter_columns: tuple[tuple[int, str], ...] = ()

    def add_table(self, name: str, key: str, table_id: int | None = None) -> Registry:
        t = Table(valid_table_id(table_id or max((t.table_id for t in self.tables), default=0) + 1), valid_identifier(name), valid_identifier(key))
        if any(o.table_id == t.table_id or o.name == name for o in self.tables):
            raise RegistrationError(f"table {name} is registered")
        return replace(self, tables=(*self.tables, t))

    def add_edge(self, name: str, source_table: str, source_column: str, target_table: str, target_column: str, edge_id: int | None = None) -> Registry:
        ids = {t.name: t.table_id for t in self.tables}
        if source_table not in ids or target_table not in ids:
            raise RegistrationError(f"edge {name}: its tables are not registered")
        e = Edge(valid_table_id(edge_id or max((e.edge_id for e in self.edges), default=0) + 1), ids[source_table], ids[target_table], valid_identifier(name), valid_identifier(source_column), valid_identifier(target_column))
        if any(o.edge_id == e.edge_id for o in self.edges):
            raise RegistrationError(f"edge {e.edge_id} is registered")
        return replace(self, edges=(*self.edges, e))

    def add_filter_column(self, table: str, column: str) -> Registry:
        """Kept as metadata: no predicate reads it."""
        ids = {t.name: t.table_id for t in self.tables}
        if table not in ids or (ids[table], column) in self.filter_columns:
            raise RegistrationError(f"filter column {table}.{column}")
        return replace(self, filter_columns=(*self.filter_columns, (ids[table], valid_identifier(column))))

    def rows(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The registrations as tables, to be written and read again by load()."""
        return {
            "tables": spark.createDataFrame([(t.table_id, t.name, t.key) for t in self.tables], REGISTRATIONS["tables"]),
            "edges": spark.createDataFrame([(e.edge_id, e.source_table, e.target_table, e.name, e.source_column, e.target_column) for e in self.edges], REGISTRATIONS["edges"]),
            "filter_columns": spark.createDataFrame(list(self.filter_columns), REGISTRATIONS["filter_columns"]),
        }

    @classmethod
    def load(cls, rows: Mapping[str, DataFrame]) -> Registry:
        """A registry from its tables, each read in the order of its ids; every rule of registration holds."""
        read = lambda name: rows[name].orderBy(*rows[name].columns[:2]).collect()  # noqa: E731  registrations, not data
        out = cls()
        for r in read("tables"):
            out = out.add_table(r["name"], r["key"], r["table_id"])
        names = {t.table_id: t.name for t in out.tables}
        for r in read("edges"):
            if r["source_table"] not in names or r["target_table"] not in names:
                raise RegistrationError(f"edge {r['name']}: its tables are not registered")
            out = out.add_edge(r["name"], names[r["source_table"]], r["source_column"], names[r["target_table"]], r["target_column"], r["edge_id"])
        for r in read("filter_columns"):
            if r["table_id"] not in names:
                raise RegistrationError(f"filter column {r['column']}")
            out = out.add_filter_column(names[r["table_id"]], r["column"])
        return out

    def check(self) -> Registry:
        if not self.tables or not self.edges:
            raise RegistrationError("a build needs a table and an edge")
        return self


def edge_scan(edge: Edge, registry: Registry, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(src, dst) node keys of one registered edge.

    Between two tables both ends must exist there; within one table the edge table
    is taken as it is.
    """
    by_id = {t.table_id: t for t in registry.tables}
    source, target = by_id[edge.source_table], by_id[edge.target_table]
    rows = tables[edge.name].select(F.col(edge.source_column).cast("long").alias("s"), F.col(edge.target_column).cast("long").alias("t")).where("s IS NOT NULL AND t IS NOT NULL")
    if source != target:
        rows = rows.join(tables[source.name].select(F.col(source.key).cast("long").alias("s")), "s").join(tables[target.name].select(F.col(target.key).cast("long").alias("t")), "t")
    return rows.select(node_key(source.table_id, valid_primary_key(F.col("s"))).alias("src"), node_key(target.table_id, valid_primary_key(F.col("t"))).alias("dst"))


def dense_nodes(edges: DataFrame) -> DataFrame:
    """(key, node): distinct ends in ascending order, numbered from 0."""
    keys = edges.select(F.col("src").alias("key")).unionByName(edges.select(F.col("dst").alias("key"))).distinct()
    return numbered(keys, ["key"], "node")


@dataclass(frozen=True)
class Overlay:
    """added(src, dst), dead_edges(edge), dead_nodes(node)."""

    added: DataFrame
    dead_edges: DataFrame
    dead_nodes: DataFrame

    def health(self) -> DataFrame:
        """overlay_edges, tombstoned_edges, tombstoned_nodes: one row."""
        count = lambda df, n: df.agg(F.count("*").alias(n))
        return count(self.added, "overlay_edges").crossJoin(count(self.dead_edges, "tombstoned_edges")).crossJoin(count(self.dead_nodes, "tombstoned_nodes"))


# Action codes of the change log.
INSERT_EDGE, DELETE_EDGE, DELETE_NODE, TRUNCATE, REMOVE_OVERLAY_EDGE = 1, 2, 3, 4, 5


def captured(inserted: DataFrame, deleted: DataFrame, edge: Edge, start: int = 1) -> DataFrame:
    """Changes of a registered edge's table as log rows (sequence, action_type, arg0, arg1).

    Rows written to the table insert an edge, rows deleted from it remove the overlay
    edge; both name node keys. Sequences go on from start, inserts before deletes.
    """
    def one(rows: DataFrame, action: int) -> DataFrame:
        key = lambda table, column: node_key(table, valid_primary_key(F.col(column).cast("long")))
        return rows.select(F.lit(action).alias("action_type"), key(edge.source_table, edge.source_column).alias("arg0"), key(edge.target_table, edge.target_column).alias("arg1"))

    changes = one(inserted, INSERT_EDGE).unionByName(one(deleted, REMOVE_OVERLAY_EDGE)).where("arg0 IS NOT NULL AND arg1 IS NOT NULL")
    return numbered(changes, ["action_type", "arg0", "arg1"], "sequence", start).select("sequence", "action_type", "arg0", "arg1")


def sync_nodes(edges: DataFrame, log: DataFrame) -> DataFrame:
    """(key, node): dense ids of the ends of edges and of the keys that the log names."""
    keyed = log.where(F.col("action_type").isin(INSERT_EDGE, REMOVE_OVERLAY_EDGE))
    named = keyed.select(F.col("arg0").alias("key")).unionByName(keyed.select(F.col("arg1").alias("key"))).where("key IS NOT NULL")
    ends = edges.select(F.col("src").alias("key")).unionByName(edges.select(F.col("dst").alias("key")))
    return numbered(ends.unionByName(named).distinct(), ["key"], "node")


def resolved(log: DataFrame, nodes: DataFrame) -> DataFrame:
    """The log with dense ids for the node keys of its keyed actions; nodes is (key, node).

    A key that nodes lacks, or a keyed action without one, is an error.
    """
    keyed = F.col("action_type").isin(INSERT_EDGE, REMOVE_OVERLAY_EDGE)
    out = log
    for arg in ("arg0", "arg1"):
        out = out.join(nodes.select(F.col("key").alias(arg), F.col("node").alias(f"{arg}_node")), arg, "left")
    out = cut(out.select("sequence", "action_type", *[F.when(keyed, F.col(f"{a}_node")).otherwise(F.col(a)).alias(a) for a in ("arg0", "arg1")], F.when(keyed, F.col("arg0_node").isNull() | F.col("arg1_node").isNull()).otherwise(False).alias("unknown")))
    bad = out.where("unknown").orderBy("sequence").first()
    if bad is not None:
        raise SyncError(f"unknown node key in the row of sequence {bad['sequence']}")
    return out.drop("unknown")


def in_order(log: DataFrame, arrival: str) -> DataFrame:
    """The log, if sequences strictly increase in the order of the arrival column; else an error.

    Each range of arrivals is checked by itself, and a row for each range says how
    neighbours meet, so no task sees the whole log.
    """
    placed = cut(log.orderBy(arrival).withColumn("__part", F.spark_partition_id()))
    before = F.lag("sequence").over(Window.partitionBy("__part").orderBy(arrival))
    parts = placed.select("__part", "sequence", (F.col("sequence") <= before).alias("late"))
    ranges = parts.groupBy("__part").agg(F.max("late").alias("late"), F.min("sequence").alias("low"), F.max("sequence").alias("high")).orderBy("__part").collect()
    high = None
    for r in ranges:
        if r["late"] or high is not None and r["low"] <= high:
            raise SyncError("sequence numbers do not increase in the order of arrival")
        high = r["high"]
    return placed.drop("__part")


def overlay_state(log: DataFrame, check: bool = True, arrival: str | None = None) -> Overlay:
    """The state after a log (sequence, action_type, arg0, arg1), as a set expression.

    Rows before the last truncation do not count. An inserted edge stays unless a
    later row removes its pair; inserts are a multiset, tombstones are sets. A table
    has no order of its own: without the name of an arrival column, the rows count
    in the order of their sequence, and only one that occurs twice is an error; with
    it, sequences must increase strictly in that order.
    """
    if arrival is not None:
        log = in_order(log, arrival)
    if check:
        bad = log.agg(F.count("*") - F.countDistinct("sequence"), F.sum(F.when(F.col("action_type").between(1, 5), 0).otherwise(1))).first()
        if bad[0]:
            raise SyncError("a sequence number occurs twice")
        if bad[1]:
            raise SyncError("unknown action")
    last = log.where(F.col("action_type") == TRUNCATE).agg(F.max("sequence").alias("cutoff"))
    live = log.crossJoin(F.broadcast(last)).where("cutoff IS NULL OR sequence > cutoff").drop("cutoff")  # one row
    inserts = live.where(F.col("action_type") == INSERT_EDGE).select("sequence", F.col("arg0").alias("src"), F.col("arg1").alias("dst"))
    removes = live.where(F.col("action_type") == REMOVE_OVERLAY_EDGE).groupBy(F.col("arg0").alias("src"), F.col("arg1").alias("dst")).agg(F.max("sequence").alias("removed"))
    added = inserts.join(removes, ["src", "dst"], "left").where("removed IS NULL OR sequence > removed").select("src", "dst", "sequence")
    dead_edges = live.where(F.col("action_type") == DELETE_EDGE).select(F.col("arg0").alias("edge")).distinct()
    dead_nodes = live.where(F.col("action_type") == DELETE_NODE).select(F.col("arg0").alias("node")).distinct()
    return Overlay(added, dead_edges, dead_nodes)


@dataclass(frozen=True)
class RelationalGraph:
    """edges(edge, src, dst) over dense or packed node ids, nodes(node), and an overlay."""

    edges: DataFrame
    nodes: DataFrame
    overlay: Overlay | None = None
    registry: Registry = field(default_factory=Registry)
    config: Config = field(default_factory=Config)

    @classmethod
    def build(cls, registry: Registry, tables: Mapping[str, DataFrame], config: Config | None = None) -> RelationalGraph:
        """Scan every registered edge; no edge at all is an error."""
        registry.check()
        parts = [edge_scan(e, registry, tables).withColumn("of", F.lit(e.edge_id)) for e in registry.edges]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        edges = numbered(rows, ["of", "src", "dst"], "edge").select("edge", "src", "dst")
        if edges.isEmpty():
            raise RegistrationError("no edges")
        nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
        return cls(cut(edges), nodes, None, registry, config or Config())

    @classmethod
    def from_dense_edges(cls, edges: DataFrame, n: int | None = None, config: Config | None = None) -> RelationalGraph:
        """From (src, dst) numbered from 0; an end at or beyond n is an error."""
        top = edges.agg(F.max(F.greatest("src", "dst")), F.min(F.least("src", "dst"))).first()
        if top[0] is None and n is None:
            raise RegistrationError("no edges")
        n = n if n is not None else top[0] + 1
        if top[0] is not None and (top[0] >= n or top[1] < 0):
            raise RegistrationError("an edge end is out of range")
        edges = edges if "edge" in edges.columns else numbered(edges, ["src", "dst"], "edge")
        return cls(edges, edges.sparkSession.range(n).select(F.col("id").alias("node")), None, Registry(), config or Config())

    def estimate(self) -> DataFrame:
        """nodes, edges: one row."""
        ends = self.edges.select(F.col("src").alias("n")).unionByName(self.edges.select(F.col("dst").alias("n")))
        return ends.agg(F.countDistinct("n").alias("nodes"), (F.count("*") / 2).cast("long").alias("edges"))

    def with_log(self, log: DataFrame, arrival: str | None = None) -> RelationalGraph:
        """The overlay of a whole log, computed anew each time."""
        return replace(self, overlay=overlay_state(log, arrival=arrival))

    def reset(self) -> RelationalGraph:
        """Without registrations, overlay and edges."""
        return RelationalGraph(self.edges.limit(0), self.nodes.limit(0), None, Registry(), self.config)

    def save(self, path: str) -> None:
        """Write base edges, nodes and registrations; the overlay is what the log says."""
        spark = self.edges.sparkSession
        for name, df in ({"edges": self.edges, "nodes": self.nodes} | {f"registered_{k}": v for k, v in self.registry.rows(spark).items()}).items():
            df.write.parquet(f"{path}/{name}")

    @classmethod
    def load_persisted(cls, spark: SparkSession, path: str, config: Config | None = None) -> RelationalGraph:
        """What save() wrote."""
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return cls(read("edges"), read("nodes"), None, Registry.load({k: read(f"registered_{k}") for k in REGISTRATIONS}), config or Config())

    def rebuild(self, tables: Mapping[str, DataFrame]) -> RelationalGraph:
        """New base edges from the registered tables; the overlay is dropped."""
        if not self.config.maintenance:
            raise RegistrationError("maintenance is off")
        return RelationalGraph.build(self.registry, tables, self.config)

    def visible_edges(self, freshness: str | None = None) -> DataFrame:
        """(edge, src, dst) that a traversal sees."""
        base = self.edges
        if self.overlay is None:
            return base
        base = base.join(self.overlay.dead_edges, "edge", "left_anti").select("edge", "src", "dst")
        if (freshness or self.config.freshness) == "overlay_aware":
            offset = self.edges.agg((F.coalesce(F.max("edge"), F.lit(-1)) + 1).alias("offset"))
            more = self.overlay.added.crossJoin(F.broadcast(offset)).select((F.col("offset") + F.col("sequence")).alias("edge"), "src", "dst")  # one row
            base = base.unionByName(more)
        dead = self.overlay.dead_nodes
        return base.join(dead.withColumnRenamed("node", "src"), "src", "left_anti").join(dead.withColumnRenamed("node", "dst"), "dst", "left_anti").select("edge", "src", "dst")

    def visible_nodes(self) -> DataFrame:
        return self.nodes if self.overlay is None else self.nodes.join(self.overlay.dead_nodes, "node", "left_anti")

    def traverse(self, seeds: list[int], limit: int | None = 100, max_depth: int | None = None, direction: str = "out", freshness: str | None = None, ordered: bool = True) -> DataFrame:
        """element, depth (and rank) from the seeds, which come first and count.

        A seed outside the graph is an error, a tombstoned one is left out. The limit
        holds with and without order; without, the level that it cuts gives its
        smallest elements. Without a limit only the configuration's cap holds, and
        where that is None too, everything within the depth is found.
        """
        seeds = list(dict.fromkeys(max(0, int(s)) for s in seeds))
        if self.nodes.where(F.col("node").isin(seeds)).count() < len(seeds):
            raise UnknownElementError(f"seeds: {seeds}")
        alive = {r[0] for r in self.visible_nodes().where(F.col("node").isin(seeds)).collect()}
        limit = min((n for n in (None if limit is None else max(1, limit), self.config.traverse_limit) if n is not None), default=None)
        depth = None if max_depth is None or max_depth <= 0 else max_depth
        way = "incoming" if direction == "in" else "outgoing"
        cap = {"limit": limit} if ordered else {"most": limit}
        return traversal.bfs(self.visible_edges(freshness), [s for s in seeds if s in alive], depth, way, True, ordered=ordered, **cap)

    def visited_count(self, seed: int, max_depth: int | None = None, direction: str = "out", freshness: str | None = None) -> int:
        return self.traverse([seed], None, max_depth, direction, freshness, ordered=False).count()

    def search(self, start: int = 0, end: int = -1, limit: int = 100) -> DataFrame:
        """Visible nodes of a range, ascending: a negative start is 0, a negative end the start alone."""
        start = max(0, start)
        low, high = (start, start) if end < 0 else sorted((start, end))
        return self.visible_nodes().where(F.col("node").between(low, high)).select("node").orderBy("node").limit(min(max(1, limit), self.config.search_limit))

    def graph_traverse(self, seeds: int | list[int], limit: int = 100, max_depth: int = 0, direction: str = "out") -> list[int]:
        """Node ids in the order of discovery, as a database function would return them.

        The limit is a number, and capped by the configuration, so the list is of bounded size. A
        direction other than "in" is out, a depth of 0 or less has no bound.
        """
        found = self.traverse([seeds] if isinstance(seeds, int) else seeds, limit, max_depth, direction)
        return [r["element"] for r in found.orderBy("rank").collect()]

    def status(self) -> DataFrame:
        """One row of JSON: counts of the base, of the overlay and of what is registered."""
        row = self.estimate()
        if self.overlay is not None:
            row = row.crossJoin(self.overlay.health())  # one row each
        sizes = (("tables", self.registry.tables), ("edges_registered", self.registry.edges), ("filter_columns", self.registry.filter_columns))
        row = row.select("*", *[F.lit(len(v)).alias(k) for k, v in sizes], F.lit(self.config.freshness).alias("freshness"))
        return row.select(F.to_json(F.struct("*")).alias("status"))
