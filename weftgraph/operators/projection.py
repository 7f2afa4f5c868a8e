"""From relations and incidences to graphs and hypergraphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.errors import InvalidProjectionError
from weftgraph.graph import Graph, HyperGraph


def selected(relations: DataFrame, types: Sequence[int]) -> DataFrame:
    """All relations if no type is named, else those of the types; untyped ones only in the first case."""
    return relations.where(F.col("relation_type_id").isin(*types)) if types else relations


def graph_edges(relations: DataFrame, incidences: DataFrame, types: Sequence[int], source: int, target: int, check: bool = True) -> DataFrame:
    """(edge, src, dst): one shuffle that counts and picks both ends.

    A selected relation without exactly one incidence on each side fails the whole
    projection; other roles are ignored.
    """
    is_source, is_target = F.col("role_id") == source, F.col("role_id") == target
    ends = incidences.where(is_source | is_target).groupBy("relation_id").agg(
        F.count_if(is_source).alias("ns"), F.count_if(is_target).alias("nt"),
        F.max(F.when(is_source, F.col("element_id"))).alias("src"), F.max(F.when(is_target, F.col("element_id"))).alias("dst"),
    )
    own = selected(relations, types).select("relation_id").join(ends, "relation_id", "left")
    if check and not own.where("ns IS NULL OR ns <> 1 OR nt <> 1").isEmpty():
        raise InvalidProjectionError("a selected relation lacks exactly one source and one target")
    return own.select(F.col("relation_id").alias("edge"), "src", "dst")


def graph(relations: DataFrame, incidences: DataFrame, types: Sequence[int], source: int, target: int, check: bool = True) -> Graph:
    edges = graph_edges(relations, incidences, types, source, target, check)
    return Graph.from_edges(edges)


def hypergraph(relations: DataFrame, incidences: DataFrame, types: Sequence[int], sources: Sequence[int], targets: Sequence[int], check: bool = True) -> HyperGraph:
    """A role on both sides puts its incidence on both; every participant is a vertex, also on no side."""
    own = selected(relations, types).select("relation_id")
    mine = incidences.join(own, "relation_id", "left_semi")
    sides = F.array_compact(F.array(F.when(F.col("role_id").isin(*sources), F.lit("source")), F.when(F.col("role_id").isin(*targets), F.lit("target"))))
    split_up = mine.select("relation_id", "incidence_id", "element_id", F.explode(sides).alias("side"))
    if check:
        both = split_up.groupBy("relation_id").agg(F.countDistinct("side").alias("n")).where("n = 2")
        if not own.join(both, "relation_id", "left_anti").isEmpty():
            raise InvalidProjectionError("a selected relation lacks a side")
    return HyperGraph(split_up, mine.select("element_id").distinct(), own)
