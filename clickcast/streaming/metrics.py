"""Live metrics as a table-driven spec. ``metric_frame`` builds the same aggregate for a
batch DataFrame (the oracle side) and for a stream (started with ``start_metric``)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import sinks as SK
from ..schema import METRIC_WINDOW, NOTIF_TOPIC, REC_TOPIC, TRIGGER_INTERVAL, USER_TOPIC


@dataclass(frozen=True)
class Metric:
    name: str
    topic: str
    event_type: str | None   # filter, None = all events of the topic
    group: str                # "event_type" | "product_id" | "total" | "minute"
    column: str
    mode: str                 # "complete" | "update"


# --- fixed values: the 23 live metrics (name, topic, filter, grouping, column, mode) ---------
METRICS = [
    Metric("event_counts", USER_TOPIC, None, "event_type", "event_count", "complete"),
    Metric("total_events_received", USER_TOPIC, None, "total", "total_events_received", "complete"),
    Metric("events_per_minute", USER_TOPIC, None, "minute", "events_per_minute", "update"),
    Metric("views_per_minute", USER_TOPIC, "view", "minute", "views_per_minute", "update"),
    Metric("add_to_cart_per_minute", USER_TOPIC, "add_to_cart", "minute", "add_to_cart_per_minute", "update"),
    Metric("top_viewed_products_live", USER_TOPIC, "view", "product_id", "top_viewed_products", "complete"),
    Metric("top_products_added_to_cart", USER_TOPIC, "add_to_cart", "product_id", "top_products_added_to_cart", "complete"),
    Metric("purchases_per_minute", USER_TOPIC, "transaction", "minute", "purchases_per_minute", "update"),
    Metric("refunds_per_minute", USER_TOPIC, "refund_request", "minute", "refunds_per_minute", "update"),
    Metric("top_purchased_products_live", USER_TOPIC, "transaction", "product_id", "top_purchased_products", "complete"),
    Metric("top_refunded_products", USER_TOPIC, "refund_request", "product_id", "top_refunded_products", "complete"),
    Metric("recommendation_events_by_type", REC_TOPIC, None, "event_type", "recommendation_event_count", "complete"),
    Metric("total_recommendations_received", REC_TOPIC, None, "total", "total_recommendations_received", "complete"),
    Metric("recommendations_per_minute", REC_TOPIC, None, "minute", "recommendations_per_minute", "update"),
    Metric("top_recommended_products", REC_TOPIC, None, "product_id", "recommendation_count", "complete"),
    Metric("recommendation_clicks", REC_TOPIC, "recommendation_clicked", "product_id", "recommendation_clicks", "complete"),
    Metric("recommendations_accepted", REC_TOPIC, "recommendation_accepted", "product_id", "recommendation_acceptance", "complete"),
    Metric("notification_events_count", NOTIF_TOPIC, None, "event_type", "notification_event_count", "complete"),
    Metric("total_notifications", NOTIF_TOPIC, None, "total", "total_notifications", "complete"),
    Metric("notifications_per_minute", NOTIF_TOPIC, None, "minute", "notifications_per_minute", "update"),
    Metric("notifications_by_product", NOTIF_TOPIC, None, "product_id", "notifications_by_product", "complete"),
    Metric("accepted_offers", NOTIF_TOPIC, "offer_accepted", "product_id", "accepted_offers", "complete"),
    Metric("declined_offers", NOTIF_TOPIC, "offer_declined", "product_id", "declined_offers", "complete"),
]
# --- end of fixed values ------------------------------------------------------------------
BY_NAME = {m.name: m for m in METRICS}


def metric_frame(df: DataFrame, m: Metric) -> DataFrame:
    if m.event_type:
        df = df.filter(F.col("event_type") == m.event_type)
    cnt = F.count(F.lit(1)).alias(m.column)
    if m.group == "total":
        return df.agg(cnt)
    if m.group == "minute":
        g = df.groupBy(F.window("event_time", METRIC_WINDOW).alias("w")).agg(cnt)
        return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), m.column)
    out = df.groupBy(m.group).agg(cnt)
    return out.orderBy(F.desc(m.column)) if m.mode == "complete" and m.group == "product_id" else out


def csv_version_writer(path: str, schema=None, keys: list[str] | None = None, keep: int | None = None):
    """foreachBatch body for a metric file: each batch is written as its own ``run=<query>/batch=<id>``
    version and nothing is read back. A replay overwrites only its own version, and a failed
    write fails the batch, so no earlier version can be lost.

    With ``keep``, every ``keep``-th version holds the metric's whole current value (``schema`` and
    ``keys`` as for ``read_metric_csv``), and the versions before it are deleted once it is written."""
    def write(batch: DataFrame, batch_id: int) -> None:
        own, spark = f"{path}/run={SK.run_of(batch)}/batch={batch_id}", batch.sparkSession
        stamped = batch.withColumn("written_at", F.current_timestamp())
        before = SK.folders(spark, path, 2) if keep and batch_id % keep == keep - 1 else []
        before = [f for f in before if not f.endswith(own.removeprefix(path))]
        if before and keys:
            old = spark.read.schema(_versioned(schema)).option("header", True).option("basePath", path).csv(before)
            stamped = _newest(old.select(*schema.names, "written_at").unionByName(stamped), keys, schema.names).withColumn("written_at", F.current_timestamp())
        stamped.write.mode("overwrite").option("header", True).csv(own)
        SK.delete_folders(spark, before)
    return write


def _versioned(schema):
    return T.StructType([f for f in schema.fields if f.name != "batch"] + [
        T.StructField("written_at", T.TimestampType()), T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())])


def _newest(versions: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    values = [c for c in names if c not in keys]
    return versions.groupBy(*keys).agg(*[F.max_by(c, "written_at").alias(c) for c in values]).select(names)


def read_metric_csv(spark, path: str, schema, keys: list[str]) -> DataFrame:
    """A metric from its versions: update mode (``keys``) takes each key's value from the newest
    version that has it, complete mode the newest version. Versions are told apart by the time they
    were written, so those of a new checkpoint follow those of the old one."""
    v = spark.read.option("header", True).schema(_versioned(schema)).csv(path)
    if not keys:
        return v.filter(F.col("written_at") == v.agg(F.max("written_at")).scalar()).select(schema.names)
    return _newest(v, keys, schema.names)


def start_metric(df: DataFrame, m: Metric, sink: str = "console", metrics_path: str | None = None,
                 checkpoint_dir: str | None = None, trigger_interval: str | None = TRIGGER_INTERVAL,
                 available_now: bool = False, keep: int | None = None) -> StreamingQuery:
    agg = metric_frame(df, m)
    w = agg.writeStream.queryName(m.name).outputMode(m.mode)
    if sink == "console":
        w = w.format("console").option("truncate", False)
    elif sink == "memory":
        w = w.format("memory")
    else:
        keys = metric_keys(m) if m.mode == "update" else None
        w = (w.foreachBatch(csv_version_writer(f"{metrics_path}/{m.name}", agg.schema, keys, keep))
              .option("checkpointLocation", f"{checkpoint_dir}/metrics_{m.name}"))
    if available_now:
        w = w.trigger(availableNow=True)
    elif trigger_interval:
        w = w.trigger(processingTime=trigger_interval)
    return w.start()


def metric_keys(m: Metric) -> list[str]:
    return {"total": [], "minute": ["window_start", "window_end"]}.get(m.group, [m.group])


def _bases(df: DataFrame) -> dict[str, DataFrame]:
    """The two count tables every metric rolls up from: per (topic, type, product) and per
    (topic, type, minute window). Both are bounded by their key domains."""
    prod = df.groupBy("topic", "event_type", "product_id").agg(F.count(F.lit(1)).alias("n"))
    mins = (df.groupBy("topic", "event_type", F.window("event_time", METRIC_WINDOW).alias("w"))
              .agg(F.count(F.lit(1)).alias("n"))
              .select("topic", "event_type", F.col("w.start").alias("window_start"),
                      F.col("w.end").alias("window_end"), "n"))
    return {"by_product": prod, "by_minute": mins}


def metric_from_bases(by_product: DataFrame, by_minute: DataFrame, m: Metric) -> DataFrame:
    """One live metric as a roll-up of the running count tables."""
    src = by_minute if m.group == "minute" else by_product
    src = src.filter(F.col("topic") == m.topic)
    if m.event_type:
        src = src.filter(F.col("event_type") == m.event_type)
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias(m.column)
    keys = metric_keys(m)
    return src.groupBy(*keys).agg(total) if keys else src.agg(total)


def all_metrics_writer(path: str):
    """foreachBatch body of the count tables: the batch's own counts are appended as
    ``run=<query>/batch=<id>``. Nothing is read or merged, so work and files grow with the input alone, a
    replay rewrites its own folder, and a failure cannot drop earlier counts. Readers add up."""
    def write(batch: DataFrame, batch_id: int) -> None:
        for name, part in _bases(batch).items():
            part.write.mode("overwrite").parquet(f"{path}/{name}/run={SK.run_of(batch)}/batch={batch_id}")
    return write


def read_live_metric(spark, path: str, m: Metric) -> DataFrame:
    """A metric's current value: the sum over the batches' counts."""
    return metric_from_bases(spark.read.parquet(f"{path}/by_product"), spark.read.parquet(f"{path}/by_minute"), m)


def compact_counts(spark, path: str, out: str) -> None:
    """Write the count tables summed up as one batch of a new table (between two runs of the
    metrics query, or to keep a closed period): the same sums in one folder."""
    for name in ("by_product", "by_minute"):
        t = spark.read.parquet(f"{path}/{name}")
        keys = [c for c in t.columns if c not in ("n", "run", "batch")]
        t.groupBy(*keys).agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{out}/{name}/run=compacted/batch=0")


def start_metrics_job(validated: DataFrame, path: str, checkpoint_dir: str,
                      trigger_interval: str | None = TRIGGER_INTERVAL, available_now: bool = False) -> StreamingQuery:
    """All live metrics from one streaming query over the validated events."""
    w = (validated.writeStream.foreachBatch(all_metrics_writer(path))
         .option("checkpointLocation", f"{checkpoint_dir}/metrics_job"))
    if available_now:
        w = w.trigger(availableNow=True)
    elif trigger_interval:
        w = w.trigger(processingTime=trigger_interval)
    return w.start()
