"""Topological levels and longest paths of acyclic graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.errors import CycleError
from weftgraph.operators.traversal import induced
from weftgraph.session import cut, numbered


def topological_levels(edges: DataFrame, elements: DataFrame) -> DataFrame:
    """element, level: the number of edges of the longest path that ends there.

    Elements without an edge in get the level of the round and leave the graph; a
    round that finds none while elements are left is a cycle.
    """
    ids = cut(elements.select(F.col(elements.columns[0]).alias("element")).distinct())
    left = cut(induced(edges, ids).select("src", "dst").distinct())
    out: list[DataFrame] = []
    level = 0
    while not ids.isEmpty():
        free = cut(ids.join(left.select(F.col("dst").alias("element")).distinct(), "element", "left_anti"))
        if free.isEmpty():
            raise CycleError("the elements have a cycle")
        out.append(free.select("element", F.lit(level).alias("level")))
        if len(out) == 32:  # a long graph does not make a long plan
            out = [cut(reduce(DataFrame.unionByName, out))]
        ids = cut(ids.join(free, "element", "left_anti"))
        left = cut(left.join(free.select(F.col("element").alias("src")), "src", "left_anti"))
        level += 1
    return reduce(DataFrame.unionByName, out) if out else ids.select("element", F.lit(0).alias("level"))


def topological_order(edges: DataFrame, elements: DataFrame) -> DataFrame:
    """pos, element: a linear order in which every edge leads onward; by level, then by element."""
    return numbered(topological_levels(edges, elements), ["level", "element"], "pos").select("pos", "element")


def longest_path(edges: DataFrame, elements: DataFrame) -> DataFrame:
    """pos, element of a longest path; ties go to the smallest end and the smallest predecessor.

    An element on the path stands at its level. The path is traced from its end by
    pointers that double: each round knows the elements up to twice as far.
    """
    levels = cut(topological_levels(edges, elements))
    last = levels.orderBy(F.desc("level"), "element").first()
    if last is None:
        return edges.sparkSession.createDataFrame([], "pos int, element long")
    inside = induced(edges, elements).select("src", "dst").distinct()
    before = levels.select(F.col("element").alias("src"), F.col("level").alias("above"))
    jump = cut(
        inside.join(before, "src").join(levels.withColumnRenamed("element", "dst"), "dst").where("above = level - 1")
        .groupBy(F.col("dst").alias("element")).agg(F.min("src").alias("to"))
    )
    path = cut(levels.where(F.col("element") == last["element"]).select("element"))
    known = 1
    while known <= last["level"]:
        path = cut(path.unionByName(path.join(jump, "element").select(F.col("to").alias("element"))))
        known *= 2
        if known <= last["level"]:
            jump = cut(jump.join(jump.toDF("to", "next"), "to").select("element", F.col("next").alias("to")))
    return levels.join(path, "element").select(F.col("level").alias("pos"), "element").orderBy("pos")
