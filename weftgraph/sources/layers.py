"""Property layers: a column of values keyed by ids of one family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.errors import SchemaConflictError


def check_layer(layer: DataFrame, length: int, sparse: bool) -> DataFrame:
    """(id, value) with distinct ids in 0..length - 1; a dense layer has all of them."""
    n, distinct, low, high = layer.agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id")).first()
    if n != distinct or (n and (low < 0 or high >= length)) or (not sparse and n != length):
        raise SchemaConflictError("the layer does not fit its ids")
    return layer


def total(layer: DataFrame, ids: DataFrame, default) -> DataFrame:
    """A value for every id: what the layer has, else the default."""
    if default is None:
        raise SchemaConflictError("a sparse layer needs a default here")
    return ids.select(F.col(ids.columns[0]).alias("id")).join(layer, "id", "left").select("id", F.coalesce("value", F.lit(default)).alias("value"))


def rekey(layer: DataFrame, local: DataFrame, sparse: bool = False) -> DataFrame:
    """The layer over local ids; local is (local_idx, canonical_id). A dense layer must cover them all."""
    out = local.join(layer.withColumnRenamed("id", "canonical_id"), "canonical_id", "inner" if sparse else "left")
    if not sparse and not out.where(F.col("value").isNull()).isEmpty():
        raise SchemaConflictError("the layer does not cover all local ids")
    return out.select(F.col("local_idx").alias("id"), "value")
