"""Inputs and failures that must not pass silently."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clickcast.functions.exprs import is_present
from clickcast.operators import carts as CT
from clickcast.operators import champion as CH
from clickcast.operators import ingest as IG
from clickcast.operators import sinks as SK
from clickcast.plans import inputs as I
from clickcast.sources import files as FS
from clickcast.sources.files import read_message_files
from clickcast.sources.tables import shop_events, shop_users, unclean_events
from clickcast.streaming import carts as SCT
from clickcast.streaming import ingest as SI
from clickcast.streaming import metrics as SM
from clickcast.streaming import notifier as SNT
from conftest import SF_SMALL

# the header lines and a row of each seed layout
USERS = ("id,first_name,last_name,email,phone_number,region,country,hashed_password,is_deleted\n"
         "1,Ann,Lee,ann@x.org,+1,Europe,UK,$2b$, false\n2,Bo,Ray,bo@x.org,+2,Asia,JP,$2b$, true\n")
EVENTS = ("id,visitor_id,user_id,timestamp,event_type,product_id,order_id_for_refund,is_recommended\n"
          "1,visitor_1,,2026-01-01T00:00:00,view,1,,no\n2,,7,bad time,refund_request,3,ORD-1,yes\n")
PRODUCTS = ("id,name,short_description,long_description,features,category,image_url,price,created_on,updated_on\n"
            '5,Lamp,"short, with comma","two\nlines",f,Light,http://i,9.5,2026-01-01,2026-01-02\n')


def _file(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_seed_files_are_read_by_header(spark, tmp_path):
    u = FS.read_users_csv(spark, _file(tmp_path, "users.csv", USERS)).collect()
    assert [(r.id, r.email, r.country, r.region, r.is_deleted) for r in u] == [(1, "ann@x.org", "UK", "Europe", False), (2, "bo@x.org", "JP", "Asia", True)]
    e = FS.read_seed_events(spark, _file(tmp_path, "events.csv", EVENTS)).collect()
    assert [(r.id, r.user_id, r.visitor_id, r.event_time is None, r.order_id_for_refund, r.is_recommended) for r in e] == [
        (1, None, "visitor_1", False, None, False), (2, "7", None, True, "ORD-1", True)]
    p = FS.read_products_csv(spark, _file(tmp_path, "products.csv", PRODUCTS)).collect()
    assert [tuple(r) for r in p] == [("5", "Light", 9.5)]
    c = FS.read_seed_categories(spark, _file(tmp_path, "cat.csv", "id,category_name\n1,Beading & Jewelry\n")).collect()
    assert [tuple(r) for r in c] == [(1, "Beading & Jewelry")]


def test_other_headers_fail_instead_of_shifting(spark, tmp_path):
    wrong = _file(tmp_path, "users.csv", USERS.replace("last_name,email", "email,last_name"))
    with pytest.raises(Exception, match="(?i)header"):
        FS.read_users_csv(spark, wrong).collect()


def test_fallback_file_skip_and_load_once(spark, tmp_path):
    there = _file(tmp_path, "there.csv", "a\n1\n")
    assert FS.first_existing(spark, str(tmp_path / "none.csv"), there) == there
    with pytest.raises(FileNotFoundError):
        FS.read_events_csv(spark, str(tmp_path / "none.csv"))
    assert FS.read_seed_products(spark, str(tmp_path / "none.csv")) is None
    rows = spark.range(3)
    assert FS.load_once(rows, spark, str(tmp_path / "t")) and not FS.load_once(rows, spark, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_only_a_missing_path_is_empty(spark, tmp_path):
    assert SK.read_parquet_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        SK.read_parquet_or_empty(spark, str(bad), "a int").count()


def test_metric_batches_add_up_and_replays_overwrite(spark, tmp_path):
    ev = I.all_validated(spark, SF_SMALL)
    write = SM.all_metrics_writer(str(tmp_path / "m"))
    half = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    write(ev.filter(half), 0)
    write(ev.filter(~half), 1)
    write(ev.filter(~half), 1)  # a replay
    SM.compact_counts(spark, str(tmp_path / "m"), str(tmp_path / "c"))
    m = SM.BY_NAME["event_counts"]
    want = {tuple(r) for r in SM.metric_frame(ev.filter(F.col("topic") == m.topic), m).collect()}
    for path in ("m", "c"):
        assert {tuple(r) for r in SM.read_live_metric(spark, str(tmp_path / path), m).collect()} == want


def test_a_failed_metric_write_fails_the_batch(spark, tmp_path):
    ev = I.all_validated(spark, SF_SMALL)
    (tmp_path / "m").write_text("a file where the folder should be")
    with pytest.raises(Exception):
        SM.all_metrics_writer(str(tmp_path / "m"))(ev, 0)


def test_nan_is_never_champion(spark):
    runs = spark.createDataFrame([("m", "a", 1, 0.9), ("m", "b", 2, math.nan), ("m", "c", 3, 0.95), ("m", "d", 4, None)],
                                 "model_name string, run_id string, run_time int, metric double")
    h = CH.champion_history(runs)
    assert [r.champion_run for r in h.orderBy("run_time").collect()] == ["a", "a", "c", "c"]
    assert CH.current_champions(h).first().champion_run == "c"


class Held(dict):
    """A keyed state variable in memory, with the calls of the real ones."""

    def containsKey(self, k):
        return k in self

    def getValue(self, k):
        return dict.get(self, k)

    def updateValue(self, k, v):
        self[k] = v

    def removeKey(self, k):
        del self[k]

    def get(self):
        return dict.get(self, "v")

    def update(self, v):
        self["v"] = v


class Handle:
    def __init__(self):
        self.timers = set()

    def getMapState(self, *a):
        return Held()

    getValueState = getMapState

    def registerTimer(self, ms):
        self.timers.add(ms)


class Expired:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):
        return self.ms


def drive(batches, minutes=15):
    """(abandonments, active carts) of one user: per batch (events, watermark) first the input, then
    the timers that were set before timers fired, by time."""
    keeper, handle, rows = SCT.CartKeeper(minutes), Handle(), []
    keeper.init(handle)
    for events, mark in batches:
        pdf = pd.DataFrame(events, columns=["event_time", "id", "event_type", "product_id"])
        pdf["event_time"] = pdf["event_time"].astype("int64").astype("datetime64[us]")
        rows += list(keeper.handleInputRows(("u",), iter([pdf]), None))
        due = sorted(t for t in handle.timers if t * 1000 <= mark)
        handle.timers -= set(due)
        for ms in due:
            rows += list(keeper.handleExpiredTimer(("u",), None, Expired(ms)))
    out = pd.concat(rows)
    told = out[out["kind"] == "abandoned"][["episode", "last_activity", "notify_at", "cart_size"]]
    return told.astype(str).values.tolist(), int(out["active"].fillna(0).sum()), int(out["events"].fillna(0).sum())


def test_carts_do_not_depend_on_arrival():
    rng = random.Random(3)
    minute, end = 60_000_000, 300 * 60_000_000
    kinds = ["add_to_cart", "delete_from_cart", "transaction", "view"]
    for _ in range(40):
        events = [(rng.randrange(200) * minute + rng.randrange(3), i, rng.choice(kinds), rng.choice(["p", " q", None])) for i in range(40)]
        late = sorted(events, key=lambda e: e[0] + rng.randrange(30) * minute)  # up to 30 minutes late
        parts = [late[k:k + 7] for k in range(0, 40, 7)]
        marks = [max(e[0] for p in parts[:k + 1] for e in p) - 30 * minute for k in range(len(parts))]
        assert drive([*zip(parts, marks), ([], end)]) == drive([(events, end)])


def test_late_older_event_closes_no_cart():
    """Activity at minutes 0 and 12, a late minute 5, then 22: no gap is longer than 12 minutes."""
    m = 60_000_000
    first = [(0, 1, "add_to_cart", "p"), (12 * m, 2, "view", "p")]
    assert drive([(first, 2 * m), ([(5 * m, 3, "view", "p"), (22 * m, 4, "view", "p")], 22 * m)]) == ([], 1, 4)
    assert len(drive([(first, 28 * m)])[0]) == 1


def message_stream(spark, events, path):
    IG.to_kafka_rows(events).repartition(3).write.parquet(path)
    return read_message_files(spark, path, max_files_per_trigger=1)


def ingest(spark, raw, root, name, **more):
    cfg = SI.StreamConfig(raw_events_path=f"{root}/raw", checkpoint_dir=f"{root}/{name}", available_now=True, dump_path=f"{root}/dumps",
                          metrics_path=f"{root}/metrics", reject_path=f"{root}/rejected", **more)
    for q in SI.start_ingest(spark, raw, cfg):
        q.awaitTermination()


def test_new_checkpoint_keeps_what_the_old_one_landed(spark, tmp_path):
    """Two checkpoints on one path: batch ids start at 0 twice, and nothing is overwritten."""
    ev, root = shop_events(spark, SF_SMALL), str(tmp_path)
    half = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    ingest(spark, message_stream(spark, ev.filter(half), f"{root}/m1"), root, "ck1")
    ingest(spark, message_stream(spark, ev.filter(~half), f"{root}/m2"), root, "ck2")
    want = I.all_validated(spark, SF_SMALL)
    assert spark.read.parquet(f"{root}/raw").count() == want.count()
    assert sum(spark.read.parquet(f"{root}/dumps/{n}").count() for n in SI.DUMP_NAMES.values()) == want.count()
    m = SM.BY_NAME["event_counts"]
    assert {tuple(r) for r in SM.read_live_metric(spark, f"{root}/metrics", m).collect()} \
        == {tuple(r) for r in SM.metric_frame(want.filter(F.col("topic") == m.topic), m).collect()}
    # the same messages a third time, long after: every one is a duplicate, however late
    ingest(spark, message_stream(spark, ev, f"{root}/m3"), root, "ck3")
    assert spark.read.parquet(f"{root}/raw").count() == want.count()
    late = spark.read.parquet(f"{root}/rejected").filter("reason = 'duplicate_id'")
    assert late.count() == IG.key_events(ev).filter(IG.complete()).count()


def test_replayed_ingest_batch_is_judged_alike(spark, tmp_path):
    """A batch that ran to its end, but was not committed, runs again: same output, no duplicates."""
    root = str(tmp_path)
    raw = IG.to_kafka_rows(unclean_events(spark, SF_SMALL))
    cfg = SI.StreamConfig(raw_events_path=f"{root}/raw", checkpoint_dir=f"{root}/ck", reject_path=f"{root}/rejected")
    seen = []
    for _ in range(2):
        SI.write_ingest_batch(IG.with_keys(IG.decode_messages(raw)), 0, cfg)
        seen.append((spark.read.parquet(f"{root}/raw").count(), spark.read.parquet(f"{root}/rejected").groupBy("topic", "reason").count().orderBy("topic", "reason").collect()))
    assert seen[0] == seen[1]
    assert seen[0][0] + sum(r["count"] for r in seen[0][1]) == raw.count()


def test_dead_letters_hold_the_message(spark, tmp_path):
    rows = [("user-events", "{broken"), ("user-events", None), ("user-events", "[]"), ("user-events", '{"id": "x", "visitor_id": "v", "event_type": "view"}'),
            ("user-events", '{"id": 1, "event_type": "view"}'), ("nowhere", '{"id": 1, "visitor_id": "v", "event_type": "view", "timestamp": "2024-01-01T00:00:00"}')]
    cfg = SI.StreamConfig(raw_events_path=f"{tmp_path}/raw", checkpoint_dir="", reject_path=f"{tmp_path}/rejected")
    SI.write_ingest_batch(IG.with_keys(IG.decode_messages(spark.createDataFrame(rows, "topic string, value string"))), 0, cfg)
    got = {(r.raw_value, r.reason) for r in spark.read.parquet(f"{tmp_path}/rejected").collect()}
    assert got == set(zip([v for _, v in rows], ["malformed"] * 4 + ["no_customer_key", "type_not_on_topic"]))


def test_metric_versions_are_kept_to_a_number(spark, tmp_path):
    """Every third version holds the whole value, and those before it go; a new run follows the old."""
    path, keys = str(tmp_path / "m"), ["k"]
    schema = spark.createDataFrame([], "k string, n long").schema
    write = SM.csv_version_writer(path, schema, keys, keep=3)
    want = {}
    for b in range(8):
        rows = [(f"k{b % 5}", b), (f"z{b}", 1)]
        want |= dict(rows)
        write(spark.createDataFrame(rows, schema), b)
        assert {r.k: r.n for r in SM.read_metric_csv(spark, path, schema, keys).collect()} == want
        assert len(SK.folders(spark, path, 2)) <= 3
    write(spark.createDataFrame(rows, schema), 7)  # a replay
    assert {r.k: r.n for r in SM.read_metric_csv(spark, path, schema, keys).collect()} == want


def test_notifier_restarts_from_its_checkpoint(spark, tmp_path):
    """Half of the files, a stop, the rest: state and timers come back, each offer is there once."""
    root = str(tmp_path)
    ev = I.user_events(spark, SF_SMALL)
    days = [r[0] for r in ev.select("event_date").distinct().orderBy("event_date").collect()]
    middle = days[len(days) // 2]
    labels = spark.createDataFrame([("1", 2), ("2", 0)], "user_id string, value_label int")
    users = shop_users(spark, SF_SMALL)
    for k, part in enumerate((ev.filter(F.col("event_date") < middle), ev.filter(F.col("event_date") >= middle))):
        IG.to_kafka_rows(part).coalesce(1).write.parquet(f"{root}/m/{k}")
        raw = read_message_files(spark, f"{root}/m")
        live = SI.validated_streams(SI.watermarked_events(raw, "1 day"))["user-events"]
        SNT.start_notifier(live, lambda: labels, users, f"{root}/n", f"{root}/ck", available_now=True).awaitTermination()
    mark = ev.agg(F.max("event_time")).first()[0]
    mark = F.lit(mark.replace(microsecond=mark.microsecond // 1000 * 1000)).cast("timestamp_ntz") - F.expr("INTERVAL 1 DAY")
    seen = ev.filter(F.col("event_time") <= mark)
    abandoned = CT.abandoned_carts(seen, snapshot=mark)
    want = CT.discount_offers(abandoned, labels, users)
    got = SNT.read_offers(spark, f"{root}/n").select(want.columns)
    assert got.count() == want.count() > 10 and got.exceptAll(want).count() == 0
    gauges = SNT.current_gauges(spark, f"{root}/n").first()
    known = ev.filter(is_present("user_id"))
    assert tuple(gauges) == (known.count(), want.count(), want.count(), CT.cart_contents(seen).select("user_id").distinct().count())
    assert len({r.run for r in SNT.read_gauges(spark, f"{root}/n").collect()}) == 1
