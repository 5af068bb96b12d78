"""The live notifier: abandonments become offers, and its counters and gauges are kept beside them.

One streaming query. The keyed carts (``carts.notifier_stream``) are the stateful part; each micro-batch of
their rows is joined with the customers' labels and addresses, and leaves one row of counts. Gauges add up
over the batches, so nothing is read again. Every write owns its ``run=<query id>/batch=<id>`` folder, and a
replay overwrites just that."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import carts as CT
from ..operators import sinks as SK
from ..schema import ABANDON_MINUTES, TRIGGER_INTERVAL
from . import carts as SCT

COUNTERS = ["events_processed", "cart_abandonments", "notifications_sent", "active_carts"]


def batch_counts(rows: DataFrame) -> DataFrame:
    """One row: what a batch of notifier rows adds to the counters and to the gauge of active carts."""
    abandoned = F.count_if(F.col("kind") == "abandoned")
    return rows.agg(
        F.coalesce(F.sum("events"), F.lit(0)).alias("events_processed"), abandoned.alias("cart_abandonments"),
        abandoned.alias("notifications_sent"), F.coalesce(F.sum("active"), F.lit(0)).alias("active_carts"))


def notifier_writer(path: str, labels: Callable[[], DataFrame], users: DataFrame):
    """foreachBatch body: ``offers`` and ``counts`` of the batch. ``labels`` is called per batch, so that
    an offer goes by the labels of its time."""
    def write(batch: DataFrame, batch_id: int) -> None:
        run = SK.run_of(batch)
        rows = batch.persist()
        try:
            offers = CT.discount_offers(SCT.with_ntz(SCT.abandoned_only(rows)), labels(), users)
            offers.write.mode("overwrite").parquet(f"{path}/offers/run={run}/batch={batch_id}")
            counts = batch_counts(rows).withColumn("written_at", F.current_timestamp())
            counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts/run={run}/batch={batch_id}")
        finally:
            rows.unpersist()
    return write


def start_notifier(user_events: DataFrame, labels: Callable[[], DataFrame], users: DataFrame, path: str, checkpoint_dir: str,
                   minutes: int = ABANDON_MINUTES, trigger_interval: str | None = TRIGGER_INTERVAL, available_now: bool = False) -> StreamingQuery:
    """Start the notifier over a watermarked stream of validated user events."""
    w = (SCT.notifier_stream(user_events, minutes).writeStream.outputMode("append")
         .foreachBatch(notifier_writer(path, labels, users)).option("checkpointLocation", f"{checkpoint_dir}/notifier"))
    if available_now:
        w = w.trigger(availableNow=True)
    elif trigger_interval:
        w = w.trigger(processingTime=trigger_interval)
    return w.start()


def read_offers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/offers").drop("run", "batch")


def read_gauges(spark: SparkSession, path: str) -> DataFrame:
    """(run, batch, written_at, events_processed, ...): counters and active carts as they stood after each
    batch. One row per batch of a run is read."""
    upto = Window.partitionBy("run").orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = spark.read.parquet(f"{path}/counts")
    return counts.select("run", "batch", "written_at", *(F.sum(c).over(upto).alias(c) for c in COUNTERS))


def current_gauges(spark: SparkSession, path: str) -> DataFrame:
    """The counters and the gauge as they stand: the sums over all batches."""
    return spark.read.parquet(f"{path}/counts").agg(*(F.sum(c).alias(c) for c in COUNTERS))
