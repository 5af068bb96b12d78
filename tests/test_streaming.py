import datetime as dt
import tempfile

from pyspark.sql import functions as F

from clickcast.operators import carts as CT
from clickcast.plans import inputs as I
from clickcast.sources.files import read_message_files
from clickcast.sources.tables import shop_events
from clickcast.streaming import carts as SCT
from clickcast.streaming import ingest as SI
from clickcast.streaming import metrics as SM
from conftest import SF_SMALL


def _stream(spark, shuffled=False):
    root = tempfile.mkdtemp(prefix="cc-stream-", dir="/tmp")
    SI.write_message_files(shop_events(spark, SF_SMALL), f"{root}/messages", shuffled=shuffled)
    return root, read_message_files(spark, f"{root}/messages", max_files_per_trigger=5)


def test_stream_abandonment_equals_batch(spark):
    """Overlapping files in shuffled order: the result is the batch result at the last watermark."""
    root, raw = _stream(spark, shuffled=True)
    br = SI.validated_streams(SI.watermarked_events(raw, "3 days"))
    q = (SCT.with_ntz(SCT.abandoned_carts_stream(br["user-events"])).writeStream.format("parquet")
         .option("path", f"{root}/ab").option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(f"{root}/ab")
    last = I.keyed_events(spark, SF_SMALL).agg(F.max("event_time")).first()[0]
    mark = last.replace(microsecond=last.microsecond // 1000 * 1000) - dt.timedelta(days=3)
    seen = I.user_events(spark, SF_SMALL).filter(F.col("event_time") <= F.lit(mark).cast("timestamp_ntz"))
    exp = CT.abandoned_carts(seen, snapshot=F.lit(mark).cast("timestamp_ntz"))
    assert exp.count() > 10
    cols = ["user_id", "episode", "last_activity", "notify_at", "cart_size"]
    assert got.select(cols).exceptAll(exp.select(cols)).count() == 0
    assert exp.select(cols).exceptAll(got.select(cols)).count() == 0


def test_stream_ingest_and_metrics_equal_batch(spark):
    root, raw = _stream(spark)
    cfg = SI.StreamConfig(raw_events_path=f"{root}/raw", checkpoint_dir=f"{root}/ck", available_now=True)
    for q in SI.start_ingest(spark, raw, cfg):
        q.awaitTermination()
    got = spark.read.parquet(f"{root}/raw").select("id", "topic", "event_type")
    exp = I.all_validated(spark, SF_SMALL).select("id", "topic", "event_type")
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0
    # one complete-mode and one update-mode metric, stream vs batch
    for name in ["event_counts", "views_per_minute"]:
        m = SM.BY_NAME[name]
        root2, raw2 = _stream(spark)
        br = SI.validated_streams(SI.watermarked_events(raw2, "10 minutes"))
        q = SM.start_metric(SI.ntz_output(br[m.topic]), m, sink="csv", metrics_path=f"{root2}/m",
                            checkpoint_dir=f"{root2}/ck", available_now=True)
        q.awaitTermination()
        batch = SM.metric_frame(I.validated(spark, SF_SMALL)[m.topic], m)
        stream = SM.read_metric_csv(spark, f"{root2}/m/{name}", batch.schema, SM.metric_keys(m))
        assert stream.exceptAll(batch).count() == 0 and batch.exceptAll(stream).count() == 0


def test_activity_append_emits_closed_windows_only(spark):
    root, raw = _stream(spark)
    cfg = SI.StreamConfig(raw_events_path=f"{root}/raw", checkpoint_dir=f"{root}/ck", available_now=True,
                          activity_path=f"{root}/act")
    for q in SI.start_ingest(spark, raw, cfg):
        q.awaitTermination()
    got = spark.read.parquet(f"{root}/act")
    from clickcast.operators.activity import customer_activity
    allv = I.all_validated(spark, SF_SMALL)
    cutoff = allv.agg(F.max("event_time")).first()[0]
    exp = customer_activity(allv).filter(F.col("window_end") <= F.lit(cutoff) - F.expr("INTERVAL 10 MINUTES"))
    assert got.select(exp.columns).exceptAll(exp).count() == 0
    assert exp.exceptAll(got.select(exp.columns)).count() == 0


def test_single_query_metrics_job_equals_batch(spark):
    root, raw = _stream(spark)
    v = SI.ntz_output(SI.validated_stream(SI.watermarked_events(raw, "10 minutes")))
    SM.start_metrics_job(v, f"{root}/metrics", f"{root}/ck", available_now=True).awaitTermination()
    val = I.validated(spark, SF_SMALL)
    for m in SM.METRICS:
        batch = SM.metric_frame(val[m.topic], m)
        batch = batch.select(*[F.col(c).cast("bigint").alias(c) if c == m.column else F.col(c) for c in batch.columns])
        live = SM.read_live_metric(spark, f"{root}/metrics", m).select(batch.columns)
        assert live.exceptAll(batch).count() == 0 and batch.exceptAll(live).count() == 0, m.name


def test_late_file_is_dropped_by_the_watermark(spark):
    """A file of events older than the watermark arrives after newer data: windowed
    activity ignores it (append mode), like a batch over the on-time events. Spark filters
    late rows with the previous batch's watermark, so the late file comes two batches
    after the newer data."""
    from clickcast.operators.activity import customer_activity
    from clickcast.operators import ingest as IG
    root = tempfile.mkdtemp(prefix="cc-late-", dir="/tmp")
    ev = shop_events(spark, SF_SMALL)
    day = lambda d: ev.filter(F.to_date("event_time") == F.lit(d).cast("date"))
    IG.to_kafka_rows(day("2024-01-02")).coalesce(1).write.parquet(f"{root}/m/00000")
    IG.to_kafka_rows(day("2024-01-03")).coalesce(1).write.parquet(f"{root}/m/00001")
    IG.to_kafka_rows(day("2024-01-01")).coalesce(1).write.parquet(f"{root}/m/00002")   # late
    raw = read_message_files(spark, f"{root}/m", max_files_per_trigger=1)
    cfg = SI.StreamConfig(raw_events_path=f"{root}/raw", checkpoint_dir=f"{root}/ck", available_now=True,
                          activity_path=f"{root}/act")
    for q in SI.start_ingest(spark, raw, cfg):
        q.awaitTermination()
    got = spark.read.parquet(f"{root}/act")
    on_time = IG.union_validated(IG.key_events(day("2024-01-02").unionByName(day("2024-01-03"))))
    cutoff = on_time.agg(F.max("event_time")).first()[0]
    exp = customer_activity(on_time).filter(F.col("window_end") <= F.lit(cutoff) - F.expr("INTERVAL 10 MINUTES"))
    assert got.filter(F.to_date("window_start") == F.lit("2024-01-01").cast("date")).count() == 0
    assert got.select(exp.columns).exceptAll(exp).count() == 0
    assert exp.exceptAll(got.select(exp.columns)).count() == 0
