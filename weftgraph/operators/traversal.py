"""Breadth-first traversals, walks and hop distances.

Edges are (edge, src, dst); a traversal is a driver loop of one join a level,
cut by a reliable checkpoint. The moves are laid out once, by node and by a salt
that splits the edges of a hub, and stay where they are: a frontier of measured
small size is broadcast to them, a larger one is dealt to them, once a salt.
First-discovery order needs a rank for each level and is only computed when it is
asked for or when a limit cuts inside a level.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.errors import UnknownElementError, UnsupportedError
from weftgraph.session import cut, numbered

DIRECTIONS = ("outgoing", "incoming", "both")
#: Rows that are broadcast at most, two numbers each; their count is known before.
BROADCAST_ROWS = 500_000
SALTS = 8


class Subgraph(NamedTuple):
    """nodes(element, depth, rank) and edges(relation_id, source, target) of a walk."""

    nodes: DataFrame
    edges: DataFrame


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """(at, to, side, edge): moves along edges, successors before predecessors."""
    if direction not in DIRECTIONS:
        raise UnsupportedError(f"direction: {direction}")
    out = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.lit(0).alias("side"), "edge")
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(1).alias("side"), "edge")
    return out if direction == "outgoing" else back if direction == "incoming" else out.unionByName(back)


def layout(edges: DataFrame, direction: str) -> DataFrame:
    """steps() with a salt, partitioned by node and salt and kept; it can be made again from the edges."""
    salt = F.pmod(F.xxhash64("edge"), F.lit(SALTS)).cast("int").alias("salt")
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return steps(edges, direction).select("*", salt).repartition(n, "at", "salt").sortWithinPartitions("at", "salt").persist()


def ahead(frontier: DataFrame, size: int, moves: DataFrame) -> DataFrame:
    """frontier (at and more) joined with the moves of a layout, which do not move."""
    if size <= BROADCAST_ROWS:
        return moves.join(F.broadcast(frontier), "at")
    return moves.join(frontier.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), ["at", "salt"])


def seed_frame(edges: DataFrame, seeds: DataFrame | list[int]) -> DataFrame:
    """(element, rank): seeds without repetition, in their order."""
    if isinstance(seeds, DataFrame):
        return numbered(seeds.select(F.col(seeds.columns[0]).cast("long").alias("element")).distinct(), ["element"], "rank")
    kept = list(dict.fromkeys(int(s) for s in seeds))
    return edges.sparkSession.createDataFrame([(e, i) for i, e in enumerate(kept)], "element long, rank long")


def bfs(edges: DataFrame, seeds: DataFrame | list[int], max_depth: int | None = None, direction: str = "outgoing", include_seeds: bool = True, limit: int | None = None, ordered: bool = False, on_level: Callable[[int, DataFrame], bool | None] | None = None, most: int | None = None) -> DataFrame:
    """element, depth, and rank (first-discovery order) if ordered or limited.

    Seeds count as visited whether or not they are returned. on_level sees each
    frontier and stops the traversal by returning False. A limit cuts inside the
    order and also ends the loop; most does so without an order, and takes the
    smallest elements of the level that it cuts.
    """
    ordered = ordered or limit is not None
    enough = limit if limit is not None else most
    start = seed_frame(edges, seeds).select("element", F.lit(0).alias("depth"), "rank")
    if enough == 0:
        return start.limit(0) if ordered else start.limit(0).drop("rank")
    moves = layout(edges, direction)
    frontier = visited = cut(start)
    n = found = start.count()
    total = found if include_seeds else 0
    depth = 0
    while (max_depth is None or depth < max_depth) and (enough is None or total < enough):
        if on_level is not None and on_level(depth, frontier) is False:
            break
        depth += 1
        met = ahead(frontier.select(F.col("element").alias("at"), F.col("rank").alias("parent")), n, moves)
        if ordered:
            new = met.groupBy(F.col("to").alias("element")).agg(F.min(F.struct("parent", "side", "edge")).alias("first"))
        else:
            new = met.select(F.col("to").alias("element")).distinct()
        seen = visited.select("element")
        new = new.join(F.broadcast(seen) if found <= BROADCAST_ROWS else seen, "element", "left_anti")
        if ordered:
            new = numbered(new, ["first"], "rank", found).drop("first")
        else:
            new = new.withColumn("rank", F.lit(0).cast("long"))
        frontier = cut(new.select("element", F.lit(depth).alias("depth"), "rank"))
        n = frontier.count()
        if not n:
            break
        total, found = total + n, found + n
        visited = visited.unionByName(frontier)
        if depth % 8 == 0:
            visited = cut(visited)
    moves.unpersist()
    out = visited if include_seeds else visited.where("depth > 0")
    if limit is not None:
        return out.orderBy("rank").limit(limit)
    if most is not None and total > most:
        out = out.orderBy("depth", "element").limit(most)
    return out if ordered else out.drop("rank")


def hops(edges: DataFrame, source: int, elements: DataFrame | None = None) -> DataFrame:
    """element, hops from source inside the induced subgraph; empty if source is not in it."""
    if elements is not None:
        edges = induced(edges, elements)
        if elements.where(F.col(elements.columns[0]) == source).isEmpty():
            return edges.select(F.col("src").alias("element"), F.lit(0).alias("hops")).limit(0)
    return bfs(edges, [source]).select("element", F.col("depth").alias("hops"))


def induced(edges: DataFrame, elements: DataFrame) -> DataFrame:
    """Edges with both ends among the elements."""
    ids = elements.select(F.col(elements.columns[0]).alias("__id")).distinct()
    return edges.join(ids, F.col("src") == F.col("__id"), "left_semi").join(ids, F.col("dst") == F.col("__id"), "left_semi")


def internal_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """relation_id, source, target of edges inside a node set, one for each relation, in that order."""
    inside = induced(edges, nodes.select("element"))
    return inside.groupBy(F.col("edge").alias("relation_id")).agg(F.min(F.struct("src", "dst")).alias("e")).select("relation_id", F.col("e.src").alias("source"), F.col("e.dst").alias("target")).orderBy("relation_id", "source", "target")


def walk(edges: DataFrame, vertices: DataFrame, seeds: list[int], max_depth: int = 1, direction: str = "outgoing", limit: int | None = None, include_start: bool = False) -> Subgraph:
    """Nodes by discovery and the edges between them; the seeds always belong to the inside.

    No seeds or a limit of 0 give nothing; a seed outside the graph is an error.
    """
    if not seeds or limit == 0:
        nothing = edges.select(F.col("src").alias("element"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("rank")).limit(0)
        return Subgraph(nothing, edges.select(F.col("edge").alias("relation_id"), F.col("src").alias("source"), F.col("dst").alias("target")).limit(0))
    asked = sorted(set(map(int, seeds)))
    known = vertices.where(F.col("element_id").isin(asked)).select("element_id").distinct().count()
    if known < len(asked):
        raise UnknownElementError(f"seeds: {asked}")
    nodes = bfs(edges, seeds, max_depth, direction, include_start, limit, ordered=True)
    inside = nodes.select("element").unionByName(seed_frame(edges, seeds).select("element")).distinct()
    return Subgraph(nodes.orderBy("rank"), internal_edges(edges, inside))
