from pyspark.sql import functions as F

from clickcast.operators import compaction as CO
from clickcast.operators import sinks as SK


def test_a_task_sorts_no_more_than_its_share(spark, tmp_path, monkeypatch):
    """Before: one task and file per 128 MB of landed files, some ten times that in memory."""
    events = spark.range(20_000).select(
        "id", F.md5(F.col("id").cast("string")).alias("customer_key"), F.lit("user").alias("id_type"), F.lit("2024-01-01").cast("date").alias("event_date"),
        F.timestamp_seconds("id").alias("event_time"))
    raw, out = f"{tmp_path}/raw", f"{tmp_path}/out"
    SK.write_raw_events(events, raw)
    size = CO.landed_files(spark, raw).agg(F.sum("length")).first()[0]
    monkeypatch.setattr(CO, "TASK_BYTES", size // 5)
    CO.compact(spark, raw, out)
    got = spark.read.parquet(f"{out}/data")
    files = got.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"))
    assert files.count() >= 5 and files.agg(F.max("n")).first()[0] < 20_000 / 3
    assert got.select(events.columns).exceptAll(events).count() == 0 and got.count() == 20_000
