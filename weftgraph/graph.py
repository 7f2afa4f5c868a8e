"""Graph and HyperGraph: what a projection yields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import components, dag, pagerank, traversal
from weftgraph.session import numbered



@dataclass(frozen=True)
class Graph:
    """edges(edge, src, dst [, weight]) and vertices(element_id); parallel edges are kept."""

    edges: DataFrame
    vertices: DataFrame

    @classmethod
    def from_edges(cls, edges: DataFrame, vertices: DataFrame | None = None) -> Graph:
        """From (src, dst [, edge] [, weight]); without vertices, the ends are them."""
        if "edge" not in edges.columns:
            edges = numbered(edges, ["src", "dst"], "edge")
        if vertices is None:
            vertices = edges.select(F.col("src").alias("element_id")).unionByName(edges.select(F.col("dst").alias("element_id"))).distinct()
        return cls(edges, vertices)

    def local_ids(self) -> DataFrame:
        """element_id, local_idx in the order of first appearance, sources before targets."""
        first = self.edges.select(F.col("src").alias("element_id"), (F.col("edge") * 2).alias("p")).unionByName(self.edges.select(F.col("dst").alias("element_id"), (F.col("edge") * 2 + 1).alias("p")))
        return numbered(first.groupBy("element_id").agg(F.min("p").alias("p")), ["p"], "local_idx").drop("p")

    def transpose(self) -> Graph:
        """Edges turned round, with the same edge ids."""
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        return Graph(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest), self.vertices)

    def degrees(self, direction: str = "outgoing") -> DataFrame:
        """element_id, degree of every vertex; parallel edges count."""
        at = traversal.steps(self.edges, direction).groupBy(F.col("at").alias("element_id")).agg(F.count("*").alias("degree"))
        return self.vertices.join(at, "element_id", "left").select("element_id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))

    def unique_adjacency(self) -> DataFrame:
        return self.edges.select("src", "dst").distinct()

    def out_edges(self, element: int) -> DataFrame:
        return self.edges.where(F.col("src") == element)

    def in_edges(self, element: int) -> DataFrame:
        return self.edges.where(F.col("dst") == element)

    def successors(self, element: int) -> DataFrame:
        return self.out_edges(element).select(F.col("dst").alias("element"))

    def predecessors(self, element: int) -> DataFrame:
        return self.in_edges(element).select(F.col("src").alias("element"))

    def bfs(self, start: int, reverse: bool = False, ordered: bool = False) -> DataFrame:
        return traversal.bfs(self.edges, [start], direction="incoming" if reverse else "outgoing", ordered=ordered)

    def bfs_bounded(self, seeds, max_depth=None, limit=None, include_seeds=False, direction="outgoing", ordered=False) -> DataFrame:
        return traversal.bfs(self.edges, seeds, max_depth, direction, include_seeds, limit, ordered)

    def walk(self, seeds: list[int], max_depth: int = 1, direction: str = "outgoing", limit: int | None = None, include_start: bool = False) -> traversal.Subgraph:
        return traversal.walk(self.edges, self.vertices, seeds, max_depth, direction, limit, include_start)

    def hops(self, source: int, elements: DataFrame | None = None) -> DataFrame:
        return traversal.hops(self.edges, source, elements)

    def weak_components(self, elements: DataFrame | None = None) -> DataFrame:
        return components.weak_components(self.edges, elements if elements is not None else self.vertices)

    def strong_components(self, elements: DataFrame | None = None) -> DataFrame:
        return components.strong_components(self.edges, elements if elements is not None else self.vertices)

    def topological_levels(self, elements: DataFrame | None = None) -> DataFrame:
        return dag.topological_levels(self.edges, elements if elements is not None else self.vertices)

    def topological_order(self, elements: DataFrame | None = None) -> DataFrame:
        return dag.topological_order(self.edges, elements if elements is not None else self.vertices)

    def longest_path(self, elements: DataFrame | None = None) -> DataFrame:
        return dag.longest_path(self.edges, elements if elements is not None else self.vertices)

    def pagerank(self, weight: bool = False, visible: DataFrame | None = None, personalization: DataFrame | None = None, **config) -> pagerank.Ranks:
        return pagerank.pagerank(self.edges, visible if visible is not None else self.vertices, weight, personalization, **config)

    def personalized_pagerank(self, seeds: list[int], **config) -> DataFrame:
        """element, rank by falling rank; seeds outside are left out, none left means uniform."""
        spark = self.edges.sparkSession
        given = spark.createDataFrame([(int(s), 1.0) for s in dict.fromkeys(seeds)], "element long, weight double")
        known = given.join(self.vertices.select(F.col("element_id").alias("element")), "element", "left_semi")
        return self.pagerank(personalization=None if known.isEmpty() else known, **config).ranks.orderBy(F.desc("rank"), "element")


@dataclass(frozen=True)
class HyperGraph:
    """sides(relation_id, incidence_id, element_id, side [, weight]), vertices(element_id), relations(relation_id)."""

    sides: DataFrame
    vertices: DataFrame
    relations: DataFrame

    @classmethod
    def from_sides(cls, sides: DataFrame) -> HyperGraph:
        return cls(sides, sides.select("element_id").distinct(), sides.select("relation_id").distinct())

    def participants(self, relation: int, side: str | None = None) -> DataFrame:
        own = self.sides.where(F.col("relation_id") == relation)
        return (own if side is None else own.where(F.col("side") == side)).select("incidence_id", "element_id", "side")

    def incident(self, element: int, side: str | None = None) -> DataFrame:
        """Relations of an element, without repetition; side source: outgoing, target: incoming."""
        own = self.sides.where(F.col("element_id") == element)
        return (own if side is None else own.where(F.col("side") == side)).select("relation_id").distinct()

    def participant_counts(self) -> DataFrame:
        return self.sides.groupBy("relation_id").agg(F.count("*").alias("participants"))

    def incident_counts(self) -> DataFrame:
        return self.sides.groupBy("element_id").agg(F.countDistinct("relation_id").alias("relations"))

    def successors(self) -> DataFrame:
        """(src, dst) of vertices joined by a relation from its source to its target side, once each."""
        a = self.sides.where("side = 'source'").select("relation_id", F.col("element_id").alias("src")).distinct()
        b = self.sides.where("side = 'target'").select("relation_id", F.col("element_id").alias("dst")).distinct()
        return a.join(b, "relation_id").select("src", "dst").distinct()

    def predecessors(self) -> DataFrame:
        """(src, dst): dst is on a target side, src on the source side of the same relation; once each."""
        return self.successors().select(F.col("dst").alias("src"), F.col("src").alias("dst"))

    def outgoing(self, element: int) -> DataFrame:
        """Relations that the element is a source of."""
        return self.incident(element, "source")

    def incoming(self, element: int) -> DataFrame:
        """Relations that the element is a target of."""
        return self.incident(element, "target")

    def local_ids(self, of: str = "element") -> DataFrame:
        """(element_id, relation_id or incidence_id, local_idx): dense numbers in the order of the ids."""
        frame = {"element": self.vertices, "relation": self.relations, "incidence": self.sides}[of]
        return numbered(frame.select(f"{of}_id").distinct(), [f"{of}_id"], "local_idx")

    def star_expansion(self) -> DataFrame:
        """Bipartite edges (kind, src, dst): element to relation on the source side, relation to element on the target side."""
        into = self.sides.where("side = 'source'").select(F.lit("in").alias("kind"), F.col("element_id").alias("src"), F.col("relation_id").alias("dst")).distinct()
        onward = self.sides.where("side = 'target'").select(F.lit("out").alias("kind"), F.col("relation_id").alias("src"), F.col("element_id").alias("dst"))
        return into.unionByName(onward)

    def pagerank(self, relation_weights: DataFrame | None = None, personalization: DataFrame | None = None, **config) -> pagerank.HyperRanks:
        return pagerank.hyper_pagerank(self.sides, self.vertices, self.relations, relation_weights, personalization, **config)

    def personalized_pagerank(self, seeds: list[int], **config) -> pagerank.HyperRanks:
        given = self.sides.sparkSession.createDataFrame([(int(s), 1.0) for s in dict.fromkeys(seeds)], "element long, weight double")
        known = given.join(self.vertices.select(F.col("element_id").alias("element")), "element", "left_semi")
        return self.pagerank(personalization=None if known.isEmpty() else known, **config)
