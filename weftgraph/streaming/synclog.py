"""A sync log as a stream of Parquet files.

Each micro-batch is appended to a table under the target folder, in a partition
of its own that a retry overwrites; so a batch that runs twice counts once. The
overlay is the set expression over the table, the same as for a batch log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.sources.relational import Overlay, overlay_state

LOG = "sequence long, action_type int, arg0 long, arg1 long"


class SyncLogStream:
    def __init__(self, spark: SparkSession, source: str, target: str):
        self.spark, self.source, self.target = spark, source, target

    def _append(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.target}/log/batch={batch_id}")

    def start(self, **trigger):
        """Start the query; trigger as for DataStreamWriter.trigger()."""
        rows = self.spark.readStream.schema(LOG).parquet(self.source)
        return rows.writeStream.foreachBatch(self._append).option("checkpointLocation", f"{self.target}/progress").trigger(**(trigger or {"availableNow": True})).start()

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.target}/log").select("sequence", "action_type", "arg0", "arg1")

    def overlay(self) -> Overlay:
        return overlay_state(self.log())
