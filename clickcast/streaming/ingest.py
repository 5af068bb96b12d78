"""Structured Streaming ingest: message rows -> decoded, keyed, validated events -> sinks.

The ingest query reads the source once and keeps no state: each micro-batch is judged as a whole against
the ids landed so far, and every message ends up either among the raw events or among the dead letters.
Windowed activity and carts are queries of their own; the watermark is set once for them (event time must
be a TIMESTAMP for it, so the NTZ event time is cast and cast back for output)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import activity as AC
from ..operators import enrich as EN
from ..operators import ingest as IG
from ..operators import sinks as SK
from ..functions.exprs import is_present
from ..schema import (ACTIVITY_WINDOW, NOTIF_TOPIC, REC_TOPIC, TRIGGER_INTERVAL, USER_TOPIC,
                      WATERMARK_DELAY)
from . import metrics as SM

ID_BUCKETS = 64
FEW_IDS = 100_000  # so many (topic, id, row number) are broadcast: a few MB
ID_BLOCK_BITS = 12
STATE_PARTITIONS = 24
MESSAGES_PER_FILE = 250_000
IDS_SCHEMA = "topic string, id long, bucket int, run string, batch long"
DUMP_NAMES = {USER_TOPIC: "user_events", REC_TOPIC: "recommendation_events",
              NOTIF_TOPIC: "notification_events"}


def watermarked_events(raw: DataFrame, delay: str = WATERMARK_DELAY) -> DataFrame:
    """decode -> key -> watermark on event_time (TIMESTAMP)."""
    keyed = IG.key_events(IG.decode_events(raw))
    return keyed.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark(
        "event_time", delay)


def validated_streams(wm: DataFrame, within_watermark: bool = True) -> dict[str, DataFrame]:
    """The accepted events of each topic, from one dedupe state."""
    return IG.topic_split(validated_stream(wm, within_watermark))


def ntz_output(df: DataFrame) -> DataFrame:
    return df.withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


@dataclass
class StreamConfig:
    raw_events_path: str
    checkpoint_dir: str
    trigger_interval: str | None = TRIGGER_INTERVAL
    available_now: bool = False
    watermark_delay: str = WATERMARK_DELAY
    window_duration: str = ACTIVITY_WINDOW
    activity_path: str | None = None
    dump_path: str | None = None
    metrics_path: str | None = None
    reject_path: str | None = None
    ids_path: str | None = None     # default: beside the raw events
    within_watermark: bool = True   # of the activity query's dedupe state


def _trigger(w, cfg: StreamConfig):
    if cfg.available_now:
        return w.trigger(availableNow=True)
    if cfg.trigger_interval:
        return w.trigger(processingTime=cfg.trigger_interval)
    return w


def validated_stream(wm: DataFrame, within_watermark: bool = True) -> DataFrame:
    """All accepted events with one dedupe state over (topic, id). The state holds the ids of the
    watermark's reach; ``within_watermark=False`` keeps every id for ever, as the reference does."""
    whole = wm.filter(IG.complete())
    once = whole.dropDuplicatesWithinWatermark(["id", "topic"]) if within_watermark else IG.first_copies(whole)
    return once.filter(IG.accepted())


def id_bucket():
    return F.pmod(F.xxhash64("topic", "id"), F.lit(ID_BUCKETS)).cast("int")


def landed_ids(spark: SparkSession, path: str, ids: DataFrame, run: str, batch_id: int) -> DataFrame:
    """(topic, id) that earlier batches have used up, in the neighbourhood of ``ids``. The files are sorted
    by id, so a batch of new ids reads next to nothing, and late copies read the row groups of their
    range. Ids from several counters have a wide range with gaps: if the batch lies in few blocks of ids,
    rows of other blocks go no further than the scan. What this very batch wrote in an earlier attempt does
    not count."""
    seen = SK.read_parquet_or_empty(spark, path, IDS_SCHEMA)
    mine = (F.col("run") == run) & (F.col("batch") == batch_id)
    low, high = ids.agg(F.min("id"), F.max("id")).first()
    seen = seen.filter(F.col("id").between(low, high) & ~mine).select("topic", "id")
    block = F.shiftright("id", ID_BLOCK_BITS)
    blocks = ids.select(block.alias("block")).distinct()
    few = blocks.limit(FEW_IDS + 1).count() <= FEW_IDS
    return seen.join(F.broadcast(blocks), block == F.col("block"), "left_semi") if few else seen


def write_ingest_batch(batch: DataFrame, batch_id: int, cfg: "StreamConfig", products: DataFrame | None = None) -> None:
    """One micro-batch of decoded messages -> raw events (partitioned, clustered), dead letters, the ids
    that are used up, and when configured the per-topic dumps and the metric counts. Each output has a
    folder ``run=<query>/batch=<id>`` of its own, which a replay overwrites; the ids come last but one's
    own don't count, so a batch that failed half-way is judged alike when it runs again. Kept are the decoded
    rows, without the messages if no dead letters are written, and the ids."""
    spark, run = batch.sparkSession, SK.run_of(batch)
    ids_path = cfg.ids_path or cfg.raw_events_path.rstrip("/") + "_ids"
    rows = (batch if cfg.reject_path else batch.drop("raw_value")).persist()  # the message itself is for dead letters
    ids = IG.ids_of_batch(rows).persist()
    known = IG.known_ids(ids, landed_ids(spark, ids_path, ids, run, batch_id)).persist()
    few = ids.filter("_n > 1").count() + known.count() <= FEW_IDS
    judged = IG.judged(rows, ids, known, few)
    judged = judged if few else judged.persist()
    own = f"run={run}/batch={batch_id}"
    try:
        accepted = judged.filter("reason is null").drop("reason", "raw_value", "broken")
        if products is not None:
            accepted = EN.enrich_with_products(accepted, products)
        SK.write_raw_batch(accepted, batch_id, cfg.raw_events_path)
        if cfg.reject_path:
            (judged.filter("reason is not null").select("topic", "reason", "id", "event_time", "raw_value")
                   .write.mode("overwrite").parquet(f"{cfg.reject_path}/{own}"))
        if cfg.dump_path:
            for topic, name in DUMP_NAMES.items():
                accepted.filter(F.col("topic") == topic).write.mode("overwrite").parquet(f"{cfg.dump_path}/{name}/{own}")
        if cfg.metrics_path:
            SM.all_metrics_writer(cfg.metrics_path)(accepted, batch_id)
        used = ids.join(F.broadcast(known) if few else known, ["topic", "id"], "left_anti")
        (used.select("topic", "id", id_bucket().alias("bucket"), F.lit(run).alias("run"), F.lit(batch_id).alias("batch"))
             .repartition("bucket").sortWithinPartitions("bucket", "id")
             .write.partitionBy("bucket", "run", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(ids_path))
    finally:
        for kept in (judged, known, ids, rows):
            kept.unpersist()


@contextmanager
def stream_partitions(spark: SparkSession) -> Iterator[None]:
    """Shuffle partitions of the queries that are started inside (a query takes along a copy of the session's
    settings): what the session says, but no more than the cores have use for. A micro-batch is bounded by
    its source, whatever the stream brings in all, and each partition of a state writes a file per batch.
    A checkpoint keeps the number it began with."""
    name = "spark.sql.shuffle.partitions"
    was = spark.conf.get(name)
    spark.conf.set(name, str(min(int(was), max(STATE_PARTITIONS, 2 * spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def start_ingest(spark: SparkSession, raw: DataFrame, cfg: StreamConfig,
                 products: DataFrame | None = None) -> list[StreamingQuery]:
    """One ingest query (one source read, no state) landing raw events, dead letters, dumps and metric
    counts per micro-batch; the windowed activity, if asked for, is a second query with its own
    source read and dedupe state. Returns the queries."""
    decoded = IG.with_keys(IG.decode_messages(raw))
    raw_w = (decoded.writeStream
             .foreachBatch(lambda b, i: write_ingest_batch(b, i, cfg, products))
             .option("checkpointLocation", f"{cfg.checkpoint_dir}/ingest").outputMode("append"))
    with stream_partitions(spark):
        queries = [_trigger(raw_w, cfg).start()]
    if cfg.activity_path:
        validated = validated_stream(watermarked_events(raw, cfg.watermark_delay), cfg.within_watermark)
        act = AC.customer_activity(validated, cfg.window_duration)
        aw = (act.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
                 .withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))
                 .writeStream.format("parquet").option("path", cfg.activity_path)
                 .option("checkpointLocation", f"{cfg.checkpoint_dir}/customer_activity").outputMode("append"))
        with stream_partitions(spark):
            queries.append(_trigger(aw, cfg).start())
    return queries


def write_message_files(events: DataFrame, path: str, files: int = 28, shuffled: bool = False) -> int:
    """Kafka-shaped (topic, value) rows as about ``files`` parquet files in one write (a file
    stand-in for the broker): events are range-partitioned by time, and the files' times are set in
    that order, so a file stream replays them in time order. A range of more than ``MESSAGES_PER_FILE`` is
    several files, one after the other in time, so that a micro-batch of so many files is bounded however
    many events there are. ``shuffled`` swaps neighbouring ranges, so that files hold
    events older than those of the file before. Returns the number of folders (one)."""
    ranged = events.repartitionByRange(files, "event_time").withColumn("_part", F.spark_partition_id())
    if shuffled:
        ranged = ranged.withColumn("_part", F.when(F.col("_part") % 2 == 0, F.col("_part") + 1).otherwise(F.col("_part") - 1))
        ranged = ranged.repartitionByRange(files, "_part")
    (IG.to_kafka_rows(ranged.sortWithinPartitions("_part", "event_time"))
       .write.option("maxRecordsPerFile", MESSAGES_PER_FILE).mode("overwrite").parquet(f"{path}/00000"))
    spark = events.sparkSession
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().toString() for f in fs.listStatus(path_of(f"{path}/00000")) if f.getPath().getName().startswith("part-")]
    in_order = lambda name: tuple(map(int, re.search(r"part-(\d+)-.*-c(\d+)\.", name).groups()))
    for i, name in enumerate(sorted(names, key=in_order)):
        fs.setTimes(path_of(name), 1_600_000_000_000 + 1000 * i, -1)
    return 1
