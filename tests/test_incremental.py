"""The daily report from day partials equals the report over the whole history."""

import datetime as dt

from pyspark.sql import functions as F

from clickcast import jobs
from clickcast.operators import compaction as CO
from clickcast.operators import ingest as IG
from clickcast.operators import sinks as SK
from clickcast.operators import value as V
from clickcast.plans import daily, features_by_day, incremental
from clickcast.plans import inputs as I
from clickcast.schema import TOPICS
from conftest import SF_SMALL


def rows(df):
    return sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


def same(spark, ev, path, as_of):
    whole = daily.build_report(*(IG.topic_split(ev)[t] for t in TOPICS), as_of_date=as_of)
    got = incremental.report(spark, path, as_of)
    assert set(got) == set(daily.REPORTS)
    for name, df in got.items():
        want = whole[name]
        if name == "summary":
            df, want = df.withColumn("run_date", F.col("run_date").cast("string")), want.withColumn("run_date", F.col("run_date").cast("string"))
        assert rows(df) == rows(want), name


def test_daily_runs_equal_one_run(spark, tmp_path):
    raw, path = str(tmp_path / "raw"), str(tmp_path / "state")
    SK.write_raw_events(I.all_validated(spark, SF_SMALL), raw)
    ev = spark.read.parquet(raw)
    last = ev.agg(F.max("event_date")).first()[0]
    first = ev.agg(F.min("event_date")).first()[0]
    cut = [last - dt.timedelta(days=k) for k in (3, 2, 1, 0)]
    late = ev.filter((F.col("event_date") != cut[1]) | (F.col("id") % 4 > 0))  # a quarter of a day is late
    incremental.update_days(late, path, first, cut[0])
    for day in cut[1:]:
        incremental.update_days(late, path, day)
    same(spark, late, path, None)
    incremental.update_days(ev, path, cut[1])  # now it is there
    incremental.update_days(ev, path, cut[1])  # and again: nothing changes
    same(spark, ev, path, None)
    same(spark, ev, path, str(cut[2]))
    assert incremental.write_report(spark, path, str(tmp_path / "out")) == str(last)
    assert all(spark.read.json(f"{tmp_path}/out/{n}/run_date={last}").count() > 0 for n in daily.REPORTS)


def test_a_day_reads_its_partition(spark, tmp_path):
    raw = str(tmp_path / "raw")
    SK.write_raw_events(I.all_validated(spark, SF_SMALL), raw)
    ev = spark.read.parquet(raw)
    day = str(ev.agg(F.max("event_date")).first()[0])
    plan = incremental.days(ev, day, day)._jdf.queryExecution().executedPlan()
    scan = plan.toString()
    assert "PartitionFilters: [isnotnull(event_date" in scan and day in scan
    own = incremental.days(ev, day, day)
    assert 0 < own.select("_metadata.file_path").distinct().count() < ev.select("_metadata.file_path").distinct().count() / 5


def test_features_of_daily_runs_equal_one_run(spark, tmp_path):
    raw, state = str(tmp_path / "raw"), str(tmp_path / "state")
    SK.write_raw_events(I.all_validated(spark, SF_SMALL), raw)
    ev = spark.read.parquet(raw)
    first, last = ev.agg(F.min("event_date"), F.max("event_date")).first()
    mid = last - dt.timedelta(days=1)
    late = ev.filter((F.col("event_date") != mid) | (F.col("id") % 4 > 0))
    features_by_day.update_days(late, state, first, mid)
    features_by_day.update_days(late, state, last)
    assert rows(features_by_day.customer_counts(spark, state)) == rows(V.customer_counts(late))
    features_by_day.update_days(ev, state, mid)  # the late ones
    assert rows(features_by_day.customer_counts(spark, state)) == rows(V.customer_counts(ev))
    out = str(tmp_path / "out")
    jobs.main(["features", "--raw", raw, "--out", out, "--state", state, "--first", str(last)], spark)
    assert rows(spark.read.parquet(f"{out}/parquet").select("user_id", "value_label")) == rows(V.customer_value(ev).select("user_id", "value_label"))
    assert features_by_day.customer_counts(spark, str(tmp_path / "none")).count() == 0


def test_a_session_over_midnight_is_one_session(spark, tmp_path):
    at = "cast('%s' as timestamp_ntz) as event_time, cast('%s' as date) as event_date"
    ev = spark.sql("select 1 as id, 'u' as user_id, 's' as session_id, 'add_to_cart' as event_type, 'p' as product_id, " + at % ("2024-01-01 23:59:00", "2024-01-01")
                   + " union all select 2, 'u', 's', 'transaction', 'p', " + at % ("2024-01-02 00:01:00", "2024-01-02"))
    state = str(tmp_path / "state")
    features_by_day.update_days(ev, state, "2024-01-01")
    assert features_by_day.customer_counts(spark, state).first().abandoned_cart_sessions == 1
    features_by_day.update_days(ev, state, "2024-01-02")
    got = features_by_day.customer_counts(spark, state).first()
    assert (got.abandoned_cart_sessions, got.unique_sessions, got.unique_products, got.total_events) == (0, 1, 1, 2)


def test_compaction_rewrites_changed_days_only(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    ev = I.landed(spark, SF_SMALL)
    first, last = ev.agg(F.min("event_date"), F.max("event_date")).first()
    for batch in (0, 1):
        SK.write_raw_batch(ev.filter(F.col("id") % 2 == batch).filter(F.col("event_date") < last), batch, raw)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    days = CO.compact(spark, raw, out)
    n_days = ev.filter(F.col("event_date") < last).select("id_type", "event_date").distinct().count()
    assert len(days) == n_days
    before = files()
    assert sum("/data/" in f for f in before) <= n_days + 1 < sum(1 for _ in (tmp_path / "raw").rglob("*.parquet"))
    assert CO.compact(spark, raw, out) == [] and files() == before  # nothing new: nothing written
    SK.write_raw_batch(ev.filter(F.col("event_date") == last), 2, raw)
    again = jobs.main(["compact", "--raw", raw, "--out", out, "--changed"], spark)
    assert {day for _, day in again} == {str(last)}
    assert all(files()[f] == t for f, t in before.items() if "/data/" in f)
    cols = [c for c in ev.columns if c in spark.read.parquet(f"{out}/data").columns]
    assert rows(spark.read.parquet(f"{out}/data").select(cols)) == rows(ev.filter("event_date is not null").select(cols))
    gone = SK.folders(spark, raw, 2)[0]
    SK.delete_folders(spark, [gone])
    assert len(CO.compact(spark, raw, out)) == 1 and gone.split("/raw/")[1] not in " ".join(SK.folders(spark, f"{out}/data", 2))
    assert rows(spark.read.parquet(f"{out}/data").select(cols)) == rows(spark.read.parquet(raw).select(cols))
