"""Scores from a stream into an append-only table, exactly once an id, over any number of runs and restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memloom.sources.io import exists


class ScoreSink:
    """A table of scored records (id, attempt, error, ...): of each id the first that has no error, by attempt; what is stored is never rewritten, and an id that has only failed is open.

    Called with a micro-batch and its number, as foreachBatch does. A batch is a folder of the run, written over if the batch comes again: a stream that stops between a batch's rows and
    its commit repeats the batch, sees all others' ids and none of its own, and so leaves the same rows. Ids are read from their column alone. Runs have names, since their batches are
    numbered each from 0; one run writes at a time.
    """

    def __init__(self, path: str, run: str, schema: str, id_: str = "id", order: str = "attempt", error: str = "error"):
        self.path, self.run, self.schema, self.id, self.order, self.error = path, run, schema, id_, order, error

    def stored(self, spark: SparkSession) -> DataFrame:
        """The records, with the run and the batch that brought them."""
        kind = f"{self.schema}, run string, batch long"
        return spark.read.schema(kind).option("basePath", self.path).parquet(self.path) if exists(spark, self.path) else spark.createDataFrame([], kind)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c != self.id]
        good = batch.where(F.col(self.error).isNull() & F.col(self.id).isNotNull())
        first = good.groupBy(self.id).agg(F.min(F.struct(self.order, *(c for c in rest if c != self.order))).alias("x")).select(self.id, *(F.col("x")[c].alias(c) for c in rest)).select(batch.columns)
        others = self.stored(spark).where((F.col("run") != self.run) | (F.col("batch") != number)).select(self.id)
        first.join(others, self.id, "left_anti").select(batch.columns).write.mode("overwrite").parquet(f"{self.path}/run={self.run}/batch={number}")

    def open_ids(self, requests: DataFrame) -> DataFrame:
        """The requests that are to be made (again): those without a stored score."""
        return requests.join(self.stored(requests.sparkSession).select(self.id), self.id, "left_anti")


def score_available(records: DataFrame, sink: ScoreSink, checkpoint: str) -> StreamingQuery:
    """Scores what a stream of records has, from where the checkpoint left off."""
    return records.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
