"""Incremental reports: a stream of report rows upserted into a stored report. An extension; the batch form is
``gantrel.operators.reports.merge_reports``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gantrel.operators.reports import last_wins, merge_reports


def upsert_stream(updates: DataFrame, store: str, checkpoint: str, keys: Sequence[str], order: str = "ord") -> StreamingQuery:
    """Merge each micro-batch into the report under ``store``: generation n is written beside generation n-1, so a batch
    that is tried again after a failure starts from the same state."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        newest = last_wins(batch, keys, order).withColumn("ord", F.col(order))
        before = current(spark, store, epoch - 1)
        if before is None:
            merged = newest
        else:
            merged = merge_reports(before, newest.select(*before.columns), keys).withColumn("ord", F.col("place.at")).drop("place")
        merged.write.mode("overwrite").parquet(f"{store}/generation={epoch}")

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, store: str, epoch: int) -> DataFrame | None:
    """The report after ``epoch``, or None before the first."""
    if epoch < 0:
        return None
    return spark.read.parquet(f"{store}/generation={epoch}")
