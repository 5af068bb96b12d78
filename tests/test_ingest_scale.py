import datetime as dt
import glob
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from clickcast.operators import ingest as IG
from clickcast.operators.activity import customer_activity
from clickcast.schema import USER_TOPIC
from clickcast.sources.files import read_message_files
from clickcast.streaming import ingest as SI

START = dt.datetime(2024, 1, 1)


def _events(spark, n):
    """Shop events of own make, one per minute; ids count down, so that they tell nothing of the time."""
    rows = [(10_000 - i, USER_TOPIC, "s", "", str(i % 7), START + dt.timedelta(minutes=i), "view", str(i % 5 + 1), None, i % 3 == 0, "") for i in range(n)]
    return spark.createDataFrame(rows, "id long, topic string, session_id string, visitor_id string, user_id string, event_time timestamp_ntz, "
                                 "event_type string, product_id string, order_id_for_refund string, is_recommended boolean, recommendation_view string")


def _message(topic, id, **more):
    body = {"id": id, "visitor_id": "", "user_id": "1", "timestamp": "2024-01-01T00:00:00", "event_type": "view", "product_id": "5"} | more
    return topic, json.dumps(body)


def _batch(spark, messages):
    return IG.with_keys(IG.decode_messages(spark.createDataFrame(messages, "topic string, value string")))


def test_message_files_are_bounded_and_in_time_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SI, "MESSAGES_PER_FILE", 30)
    SI.write_message_files(_events(spark, 400), f"{tmp_path}/m", files=4)
    spans = []
    for path in sorted(glob.glob(f"{tmp_path}/m/00000/part-*"), key=os.path.getmtime):
        times = [r.timestamp for r in IG.decode_events(spark.read.parquet(path)).select("timestamp").collect()]
        assert len(times) <= 30
        spans.append((min(times), max(times), len(times)))
    assert sum(n for _, _, n in spans) == 400
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_activity_over_many_small_files_equals_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SI, "MESSAGES_PER_FILE", 60)
    events = _events(spark, 400)
    SI.write_message_files(events.unionByName(events.filter("id % 10 = 0")), f"{tmp_path}/m", files=2)
    raw = read_message_files(spark, f"{tmp_path}/m", max_files_per_trigger=2)
    cfg = SI.StreamConfig(raw_events_path=f"{tmp_path}/raw", checkpoint_dir=f"{tmp_path}/ck", available_now=True, activity_path=f"{tmp_path}/act")
    partitions = "spark.sql.shuffle.partitions"
    was = spark.conf.get(partitions)
    spark.conf.set(partitions, "70")
    try:
        for q in SI.start_ingest(spark, raw, cfg):
            q.awaitTermination()
        assert spark.conf.get(partitions) == "70"
    finally:
        spark.conf.set(partitions, was)
    once = IG.union_validated(IG.key_events(events))
    last = once.agg(F.max("event_time")).first()[0] - dt.timedelta(minutes=10)
    want = customer_activity(once).filter(F.col("window_end") <= F.lit(last))
    got = spark.read.parquet(f"{tmp_path}/act").select(want.columns)
    assert want.count() > 100
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert spark.read.parquet(f"{tmp_path}/raw").count() == 400
    # the state has as many partitions as the cores have use for, not the 70 of the session
    state = [p for p in os.listdir(f"{tmp_path}/ck/customer_activity/state/0") if re.fullmatch(r"\d+", p)]
    assert len(state) == min(70, max(SI.STATE_PARTITIONS, 2 * spark.sparkContext.defaultParallelism))


@pytest.mark.parametrize("few", [-1, 100_000])
def test_batches_are_judged_alike_with_few_and_many_copies(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(SI, "FEW_IDS", few)
    cfg = SI.StreamConfig(raw_events_path=f"{tmp_path}/raw", checkpoint_dir="", reject_path=f"{tmp_path}/rejected")
    first = [_message(USER_TOPIC, 1), _message(USER_TOPIC, 1, product_id="4"), _message(USER_TOPIC, 1, timestamp="2024-01-01T00:00:01", product_id="3"),
             _message(USER_TOPIC, 2), _message("notification-events", 2, event_type="reminder_sent"),
             _message(USER_TOPIC, 3, product_id="0"), _message(USER_TOPIC, 3, timestamp="2024-01-01T00:00:02"),
             _message(None, 4), _message(None, 4), _message(USER_TOPIC, 5, user_id=""), (USER_TOPIC, "{broken")]
    second = [_message(USER_TOPIC, 1), _message(USER_TOPIC, 3), _message(USER_TOPIC, 3), _message(USER_TOPIC, 6), _message(USER_TOPIC, 900_000)]
    for n, messages in enumerate([first, second]):
        SI.write_ingest_batch(_batch(spark, messages), n, cfg)
    got = {(r.topic, r.id, r.product_id) for r in spark.read.parquet(f"{tmp_path}/raw").collect()}
    assert got == {(USER_TOPIC, 1, "4"), (USER_TOPIC, 2, "5"), ("notification-events", 2, "5"), (USER_TOPIC, 6, "5"), (USER_TOPIC, 900_000, "5")}
    reasons = sorted((r.id or 0, r.reason) for r in spark.read.parquet(f"{tmp_path}/rejected").collect())
    assert reasons == [(0, "malformed"), (1, "duplicate_id"), (1, "duplicate_id"), (1, "duplicate_id"), (3, "bad_product_id"), (3, "duplicate_id"), (3, "duplicate_id"),
                       (3, "duplicate_id"), (4, "duplicate_id"), (4, "type_not_on_topic"), (5, "no_customer_key")]
    used = sorted((r.topic or "", r.id) for r in spark.read.parquet(f"{tmp_path}/raw_ids").collect())
    assert used == [("", 4), ("notification-events", 2), *((USER_TOPIC, i) for i in (1, 2, 3, 6, 900_000))]


def test_rows_of_single_ids_are_not_shuffled(spark):
    rows = _batch(spark, [_message(USER_TOPIC, i) for i in range(20)] + [_message(USER_TOPIC, 1)]).persist()
    ids = IG.ids_of_batch(rows).persist()
    known = ids.filter("id = 2").select("topic", "id")
    plan = IG.judged(rows, ids, known, few=True)._jdf.queryExecution().executedPlan().toString()
    flagged = plan[:plan.index("BroadcastExchange")]
    assert "Exchange" not in flagged and "SortMergeJoin" not in flagged
    rows.unpersist()
    ids.unpersist()


def test_landed_ids_of_other_blocks_stay_behind(spark, tmp_path, monkeypatch):
    seen = [(USER_TOPIC, i, 0, "r", 0) for i in (5, 6, 50_000, 900_001, 2_000_000)]
    spark.createDataFrame(seen, SI.IDS_SCHEMA).write.partitionBy("bucket", "run", "batch").parquet(f"{tmp_path}/ids")
    ids = spark.createDataFrame([(USER_TOPIC, 5, 1), (USER_TOPIC, 7, 1), (USER_TOPIC, 900_001, 1)], "topic string, id long, _n long")
    landed = lambda batch: {r.id for r in SI.landed_ids(spark, f"{tmp_path}/ids", ids, "r", batch).collect()}
    assert landed(1) == {5, 6, 900_001} and landed(0) == set()
    monkeypatch.setattr(SI, "FEW_IDS", 1)
    assert landed(1) == {5, 6, 50_000, 900_001}
    assert {r.id for r in IG.known_ids(ids, SI.landed_ids(spark, f"{tmp_path}/ids", ids, "r", 1)).collect()} == {5, 900_001}
