"""Session helper, lineage cuts and dense numbering."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def session(app: str = "weftgraph", cores: int | None = None, partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores or os.cpu_count()}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g").getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which every node sees.

    Where the setting is missing, a local master takes a folder under the warehouse;
    a cluster must name one, as a folder of one machine would lose what it keeps.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder, which takes less room than a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files of checkpoints and stored tables that nothing will read again.

    Spark's cleaner does so only where a cluster asks for it. Call it once what was
    made from the frames has been cut itself.
    """
    for df in frames:
        if hasattr(df, "_stored_at"):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
            continue
        plan = df._jdf.queryExecution().logical()
        if plan.getClass().getSimpleName() != "LogicalRDD":
            continue
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: Sequence[Column | str], name: str, start: int = 0) -> DataFrame:
    """Dense numbers in a global order without gathering the rows in one task.

    The rows are range-partitioned and sorted, counted by partition, and numbered
    within each partition from the sum of those before.
    """
    placed = cut(df.orderBy(*order).withColumn("__part", F.spark_partition_id()))
    sizes = placed.groupBy("__part").count().orderBy("__part").collect()  # a row for each partition
    offsets, total = {}, start
    for r in sizes:
        offsets[r["__part"]] = total
        total += r["count"]
    if not offsets:
        return df.withColumn(name, F.lit(None).cast("long"))
    base = F.create_map(*[F.lit(x) for p, o in offsets.items() for x in (p, o)])[F.col("__part")]
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return placed.withColumn(name, base + within - 1).drop("__part")
