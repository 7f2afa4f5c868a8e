"""PageRank over graphs and hypergraphs.

r' = d A(r) + ((1 - d) + d * dangling) t, from r = t. Dangling rank goes back
along the teleport vector t. The shares are laid out once by source, a hub's in
several parts, and stay where they are. One iteration deals the ranks to them,
sums what they give by target, and takes one small aggregate of the cut result
that yields both the L1 delta and the next dangling mass.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.errors import NonConvergedError, PageRankError
from weftgraph.session import cut, forget


#: A source with more edges than this, or than half a partition of all edges, is split.
HUB_EDGES = 10_000


class Ranks(NamedTuple):
    ranks: DataFrame
    iterations: int
    delta: float


def uniform(edges: DataFrame) -> DataFrame:
    """(src, dst, share): an equal share for each edge, parallel edges counted."""
    return weighted(edges.withColumn("weight", F.lit(1.0)))


def weighted(edges: DataFrame) -> DataFrame:
    """(src, dst, share) in proportion to weight; a source without positive weight dangles.

    A negative or non-finite weight is an error while the plan runs.
    """
    w = F.col("weight").cast("double")
    bad = w.isNull() | F.isnan(w) | (w < 0) | (F.abs(w) == math.inf)
    checked = edges.select("src", "dst", F.when(bad, F.raise_error(F.lit("weight must be finite and not negative")).cast("double")).otherwise(w).alias("w"))
    pairs = checked.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    totals = pairs.groupBy("src").agg(F.sum("w").alias("total"))
    return pairs.join(totals, "src").where("total > 0 AND w > 0").select("src", "dst", (F.col("w") / F.col("total")).alias("share"))


def pagerank(edges: DataFrame, states: DataFrame, weight: bool = False, personalization: DataFrame | None = None, damping: float = 0.85, tolerance: float = 1e-6, max_iterations: int = 100, fixed: bool = False, distribution: Callable[[DataFrame], DataFrame] | None = None) -> Ranks:
    """Ranks (element, rank) of the states; edges with an end outside are not seen.

    personalization is (element, weight). With fixed, exactly max_iterations run
    and the tolerance is not looked at. distribution may replace how edges are
    turned into shares (src, dst, share) that sum to at most 1 for each source.
    """
    if not (math.isfinite(damping) and 0 <= damping <= 1 and math.isfinite(tolerance) and tolerance >= 0 and max_iterations >= 1):
        raise PageRankError("damping in 0..1, tolerance not negative and at least one iteration are needed")
    ids = states.select(F.col(states.columns[0]).alias("element"))
    repeated = ids.groupBy("element").count().agg(F.max("count"), F.count("*")).first()
    if not repeated[1]:
        raise PageRankError("no states")
    if repeated[0] > 1:
        raise PageRankError("a state occurs twice")
    a, b = ids.toDF("src"), ids.toDF("dst")
    seen = edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")
    shares = cut((distribution or (weighted if weight else uniform))(seen))
    if personalization is None:
        teleport = ids.withColumn("t", F.lit(1.0))
    else:
        given = personalization.toDF("element", "t").groupBy("element").agg(F.sum(F.col("t").cast("double")).alias("t"))
        teleport = ids.join(given, "element", "left").select("element", F.coalesce("t", F.lit(0.0)).alias("t"))
    mass, least, worst = teleport.agg(F.sum("t"), F.min("t"), F.max(F.isnan("t") | (F.abs("t") == math.inf))).first()
    if worst or least < 0:
        raise PageRankError("teleport weights must be finite and not negative")
    if mass <= 0:
        raise PageRankError("the teleport vector is zero")
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sources = cut(shares.groupBy("src").agg(F.count("*").alias("edges")))
    hub = max(HUB_EDGES, (sources.agg(F.sum("edges")).first()[0] or 0) // (2 * n))
    sources = sources.select("src", F.ceil(F.col("edges") / hub).cast("int").alias("parts"))
    hubs = sources.where("parts > 1")  # fewer than 2 n
    part = F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1))).cast("int")
    placed = shares.join(F.broadcast(hubs), "src", "left").select("src", "dst", "share", part.alias("part")).repartition(n, "src", "part").sortWithinPartitions("src", "part").persist()
    state = teleport.join(sources.withColumnRenamed("src", "element"), "element", "left").select("element", (F.col("t") / mass).alias("t"), F.coalesce("parts", F.lit(0)).alias("parts"))
    before = cur = cut(state.withColumn("rank", F.col("t")))
    lost = F.sum(F.when(F.col("parts") == 0, F.col("rank")).otherwise(0.0))
    dangling = cur.agg(lost).first()[0]
    delta = math.inf
    for i in range(1, max_iterations + 1):
        giving = cur.where("parts > 0").select(F.col("element").alias("src"), "rank", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        got = placed.join(giving, ["src", "part"]).groupBy(F.col("dst").alias("element")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = damping * F.coalesce("got", F.lit(0.0)) + ((1 - damping) + damping * dangling) * F.col("t")
        new = cut(cur.withColumnRenamed("rank", "old").join(got, "element", "left").select("element", "t", "parts", rank.alias("rank"), F.abs(rank - F.col("old")).alias("moved")))
        delta, dangling = new.agg(F.sum("moved"), lost).first()
        forget(before)
        before, cur = new, new.drop("moved")
        if not fixed and delta <= tolerance:
            break
    placed.unpersist()
    forget(shares, sources)
    if not fixed and delta > tolerance:
        raise NonConvergedError(f"delta {delta} after {max_iterations} iterations")
    return Ranks(cur.select("element", "rank"), i, delta)


class HyperRanks(NamedTuple):
    elements: DataFrame
    relations: DataFrame
    iterations: int
    delta: float


def hyper_edges(sides: DataFrame, relation_weights: DataFrame | None = None) -> DataFrame:
    """Bipartite edges (src, dst, weight); an element is 2 id, a relation 2 id + 1.

    An element gives to each relation on whose source side it is, once; a relation
    gives to the elements of its target side, once for each incidence, by the
    weight of the incidence where sides has one.
    """
    element, relation = F.col("element_id") * 2, F.col("relation_id") * 2 + 1
    into = sides.where("side = 'source'").select("relation_id", "element_id").distinct()
    if relation_weights is None:
        into = into.withColumn("weight", F.lit(1.0))
    else:
        into = into.join(relation_weights.toDF("relation_id", "weight"), "relation_id")
    w = F.col("weight").cast("double") if "weight" in sides.columns else F.lit(1.0)
    onward = sides.where("side = 'target'").select(relation.alias("src"), element.alias("dst"), w.alias("weight"))
    return into.select(element.alias("src"), relation.alias("dst"), F.col("weight").cast("double").alias("weight")).unionByName(onward)


def hyper_pagerank(sides: DataFrame, elements: DataFrame, relations: DataFrame, relation_weights: DataFrame | None = None, personalization: DataFrame | None = None, **config) -> HyperRanks:
    """Ranks over elements and relations together; personalization is (element, weight).

    A distribution in config sees both legs at once: edges (src, dst, weight) from
    elements (even ids) to relations (odd ids) and onward.
    """
    states = elements.select((F.col(elements.columns[0]) * 2).alias("element")).unionByName(relations.select((F.col(relations.columns[0]) * 2 + 1).alias("element")))
    seeds = None if personalization is None else personalization.select((F.col(personalization.columns[0]) * 2).alias("element"), F.col(personalization.columns[1]).alias("weight"))
    got = pagerank(hyper_edges(sides, relation_weights), states, True, seeds, **config)
    half = F.shiftright("element", 1)
    odd = F.col("element").bitwiseAND(F.lit(1).cast("long")) == 1
    return HyperRanks(got.ranks.where(~odd).select(half.alias("element"), "rank"), got.ranks.where(odd).select(half.alias("relation"), "rank"), got.iterations, got.delta)
