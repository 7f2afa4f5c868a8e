"""Weak and strong components as (element, component), the component being its smallest element."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.traversal import induced
from weftgraph.session import cut, forget, numbered


def connected(edges: DataFrame, on_round: Callable[[int], None] | None = None) -> DataFrame:
    """(node, label) for every node of the edges (a, b): the smallest node it is connected with.

    In each round a node takes the node of least hash within two steps of it, and
    the graph is contracted along these choices. The hash is drawn anew each round,
    so the order of ids does not matter: of a path about a third of the nodes is
    left, of a star one, and the rounds grow with the logarithm of a component.
    The maps shrink alike and are put together from the smallest one up.
    """
    a, b = F.col("a"), F.col("b")
    cur = cut(edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    maps: list[DataFrame] = []
    while not cur.isEmpty():
        if on_round is not None:
            on_round(len(maps) + 1)
        ends = F.explode(F.array(F.struct(a.alias("node"), b.alias("near")), F.struct(b.alias("node"), a.alias("near")), F.struct(a.alias("node"), a.alias("near")), F.struct(b.alias("node"), b.alias("near"))))
        around = cur.select(ends.alias("e")).select("e.node", "e.near")
        drawn = F.struct(F.xxhash64("near", F.lit(len(maps))).alias("h"), F.col("near").alias("node"))
        one = around.groupBy("node").agg(F.min(drawn).alias("least"))
        two = around.join(one.withColumnRenamed("node", "near"), "near").groupBy("node").agg(F.min("least").alias("least"))
        step = cut(two.select("node", F.col("least.node").alias("label")))
        maps.append(step)
        la, lb = F.col("la"), F.col("lb")
        ahead = cur.join(step.toDF("a", "la"), "a").join(step.toDF("b", "lb"), "b").where(la != lb)
        ahead = cut(ahead.select(F.least(la, lb).alias("a"), F.greatest(la, lb).alias("b")).distinct())
        forget(cur)
        cur = ahead
    if not maps:
        return edges.select(a.alias("node"), a.alias("label")).limit(0)
    labels = maps.pop()
    while maps:
        step = maps.pop()
        known = cut(step.join(labels.toDF("label", "next"), "label", "left").select("node", F.coalesce("next", "label").alias("label")))
        forget(step, labels)
        labels = known
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    out = cut(labels.join(least, "label").select("node", F.col("least").alias("label")))
    forget(labels, cur)
    return out


def weak_components(edges: DataFrame, elements: DataFrame) -> DataFrame:
    """Every element with the smallest element it is connected with, edges taken both ways.

    The rounds of connected() grow with the logarithm of the largest component.
    """
    ids = elements.select(F.col(elements.columns[0]).alias("element")).distinct()
    found = connected(induced(edges, ids).select(F.col("src").alias("a"), F.col("dst").alias("b"))).toDF("element", "label")
    return ids.join(found, "element", "left").select("element", F.coalesce("label", "element").alias("component"))


def _spread(labels: DataFrame, moves: DataFrame) -> DataFrame:
    """The smallest label that reaches each element along the moves (at, to).

    Only elements whose label fell in the last round send it on, so the work of all
    rounds is that of the changes, not of the whole graph each time.
    """
    cur = cut(labels)
    fresh = cur
    while True:
        seen = moves.join(fresh.select(F.col("element").alias("at"), F.col("label").alias("in")), "at").groupBy(F.col("to").alias("element")).agg(F.min("in").alias("in"))
        new = cut(cur.join(seen, "element", "left").select("element", F.least("label", F.coalesce("in", "label")).alias("label"), F.coalesce(F.col("in") < F.col("label"), F.lit(False)).alias("moved")))
        cur, fresh = new.select("element", "label"), new.where("moved").select("element", "label")
        if fresh.isEmpty():
            return cur


def strong_components(edges: DataFrame, elements: DataFrame) -> DataFrame:
    """Forward-backward colouring with trimming.

    Elements without an edge in or out are components of their own. The rest are
    coloured by the smallest element that reaches them; those that reach it back
    within their colour are its component. Found components leave the graph.
    """
    ids = cut(elements.select(F.col(elements.columns[0]).alias("element")).distinct())
    left = cut(induced(edges, ids).select("src", "dst").where("src <> dst").distinct())
    out: list[DataFrame] = []
    while True:
        both = left.select(F.col("src").alias("element")).intersect(left.select(F.col("dst").alias("element")))
        alive = cut(ids.join(both, "element", "left_semi"))
        trimmed = cut(ids.join(alive, "element", "left_anti"))
        ids = alive
        if not trimmed.isEmpty():
            out.append(trimmed.select("element", F.col("element").alias("component")))
            left = cut(induced(left, ids))
            continue
        if ids.isEmpty():
            break
        colour = _spread(ids.select("element", F.col("element").alias("label")), left.select(F.col("src").alias("at"), F.col("dst").alias("to")))
        c = colour.select(F.col("element").alias("e"), F.col("label").alias("c"))
        same = cut(left.join(c.toDF("src", "cs"), "src").join(c.toDF("dst", "cd"), "dst").where("cs = cd").select(F.col("dst").alias("at"), F.col("src").alias("to")))
        roots = colour.where("element = label")
        reached = frontier = cut(roots.select("element"))
        while True:
            frontier = cut(same.join(frontier.select(F.col("element").alias("at")), "at").select(F.col("to").alias("element")).distinct().join(reached, "element", "left_anti"))
            if frontier.isEmpty():
                break
            reached = cut(reached.unionByName(frontier))
        found = cut(colour.join(reached, "element").select("element", F.col("label").alias("component")))
        out.append(found)
        ids = cut(ids.join(found, "element", "left_anti"))
        left = cut(induced(left, ids))
    if not out:
        return elements.select(F.col(elements.columns[0]).alias("element"), F.col(elements.columns[0]).alias("component")).limit(0)
    return reduce(DataFrame.unionByName, out)


def sizes(components: DataFrame) -> DataFrame:
    """component, size: how many elements each component has."""
    return components.groupBy("component").agg(F.count("*").alias("size"))


def members(components: DataFrame) -> DataFrame:
    """component, pos, element: the elements of each component in ascending order, numbered from 0.

    A component may be as large as the graph, so positions come from one global
    order and each component's first place in it, not from gathered lists.
    """
    placed = cut(numbered(components.select("component", "element"), ["component", "element"], "at"))
    first = placed.groupBy("component").agg(F.min("at").alias("first"))
    return placed.join(first, "component").select("component", (F.col("at") - F.col("first")).alias("pos"), "element")
