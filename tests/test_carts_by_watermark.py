import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from clickcast.schema import USER_TOPIC
from clickcast.sources.files import read_message_files
from clickcast.sources.tables import shop_events
from clickcast.streaming import carts as SCT
from clickcast.streaming import ingest as SI
from conftest import SF_SMALL
from test_faults import Expired, Handle, drive

MINUTE = 60_000_000
EVENT = Row("at", "id", "event_type", "product_id")


class CountingHandle(Handle):
    """Counts what sets or deletes a timer."""

    calls = 0

    def registerTimer(self, ms):
        self.calls += 1
        super().registerTimer(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.remove(ms)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def drive_by_watermark(batches, minutes=15):
    """(abandonments, active carts, events) as ``test_faults.drive`` gives them, and the handle."""
    keeper, handle, rows = SCT.CartsByWatermark(minutes), CountingHandle(), []
    keeper.init(handle)
    for events, mark in batches:
        ms = mark // 1000
        if events:
            rows += keeper.handleInputRows(("u",), iter([EVENT(*e) for e in events]), Mark(ms))
        for t in sorted(t for t in handle.timers if t <= ms):
            rows += keeper.handleExpiredTimer(("u",), Mark(ms), Expired(t))
            handle.timers.discard(t)
        assert len(handle.timers) <= 1
    told = sorted((r.episode, r.last_activity, r.notify_at, r.cart_size) for r in rows if r.kind == "abandoned")
    return told, sum(r.active or 0 for r in rows), sum(r.events or 0 for r in rows), handle


def plain(batches):
    told, active, events = drive(batches)
    as_us = lambda t: SCT.pd.Timestamp(t).value // 1000
    return sorted((int(e), as_us(seen), as_us(due), int(n)) for e, seen, due, n in told), active, events


def random_batches(rng):
    kinds = ["add_to_cart", "delete_from_cart", "transaction", "view"]
    events = [(rng.randrange(1, 400) * MINUTE + rng.randrange(1500), i, rng.choice(kinds), rng.choice(["p", " q", None])) for i in range(60)]
    late = sorted(events, key=lambda e: e[0] + rng.randrange(30) * MINUTE)
    parts = [late[k:k + 11] for k in range(0, 60, 11)]
    marks = [max(0, max(e[0] for p in parts[:k + 1] for e in p) - 30 * MINUTE) // 1000 * 1000 for k in range(len(parts))]
    return [*zip(parts, marks), ([], 800 * MINUTE)]


def test_one_timer_per_user_gives_what_a_timer_per_event_gives():
    rng = random.Random(7)
    for _ in range(40):
        batches = random_batches(rng)
        for upto in (3, len(batches)):  # at a watermark with events still waiting, and at the end
            assert drive_by_watermark(batches[:upto])[:3] == plain(batches[:upto])


def test_many_waiting_events_lie_by_hours(monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(SCT, "FEW", 4)
    for _ in range(40):
        batches = random_batches(rng)
        for upto in (2, 4, len(batches)):
            assert drive_by_watermark(batches[:upto])[:3] == plain(batches[:upto])
        keeper_state = drive_by_watermark(batches)[3]
        assert not keeper_state.timers


def test_timers_do_not_grow_with_the_events_of_a_batch():
    """Before: two timers for each event."""
    events = [(k * 20 * MINUTE, k, "add_to_cart", f"p{k}") for k in range(1, 201)]
    told, active, n, handle = drive_by_watermark([(events[:100], 0), (events[100:], 50 * 20 * MINUTE), ([], 10_000 * MINUTE)])
    assert (len(told), active, n) == (200, 1, 200) and handle.calls <= 4


def test_stream_asks_the_keeper_by_watermark(spark, tmp_path):
    SI.write_message_files(shop_events(spark, SF_SMALL), f"{tmp_path}/m", files=4)
    raw = read_message_files(spark, f"{tmp_path}/m", max_files_per_trigger=2)
    events = SI.validated_streams(SI.watermarked_events(raw, "3 days"))[USER_TOPIC]
    rows = SCT.notifier_stream(events)
    assert [f.simpleString() for f in rows.schema] == [f"{c.split()[0]}:{c.split()[1].replace('long', 'bigint')}" for c in SCT.OUTPUT_SCHEMA.split(", ")]
    (SCT.with_ntz(rows).writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/ck")
     .trigger(availableNow=True).start().awaitTermination())
    got = spark.read.parquet(f"{tmp_path}/rows")
    assert got.filter("kind = 'abandoned'").count() > 10
    assert got.filter((F.col("kind") == "abandoned") & (F.col("notify_at") != F.col("last_activity") + F.expr("interval 15 minutes"))).count() == 0
