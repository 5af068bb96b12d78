"""Plan assertions: pushdown, pruning, broadcast, bucketing, partial top-k."""

import uuid

from pyspark.sql import functions as F

from clickcast.operators import enrich as EN
from clickcast.operators import recommend as RC
from clickcast.operators import sinks as SK
from clickcast.plans import inputs as I
from clickcast.session import shared_dir
from clickcast.sources.tables import read_table, shop_products
from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_projection_reach_the_scan(spark):
    df = read_table(spark, SF_SMALL, "events").filter(F.col("event_type") == "view").select("event_id")
    p = df._jdf.queryExecution().sparkPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in p
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in p


def test_enrichment_broadcasts_the_checked_dimension(spark):
    df = EN.enrich_with_products(I.all_validated(spark, SF_SMALL), shop_products(spark, SF_SMALL))
    df.collect()
    assert "BroadcastHashJoin" in _plan(df)


def test_partition_pruning_on_written_layout(spark):
    path = shared_dir(spark, f"test-raw-{uuid.uuid4().hex[:8]}")
    SK.write_raw_events(I.all_validated(spark, SF_SMALL), path, mode="overwrite")
    df = spark.read.parquet(path).filter((F.col("id_type") == "user") & (F.col("event_date") == "2024-01-02"))
    p = df._jdf.queryExecution().sparkPlan().toString()
    assert "PartitionFilters" in p and "event_date" in p


def test_bucketed_tables_join_without_exchange(spark):
    name = f"bkt_{uuid.uuid4().hex[:8]}"
    ev = I.all_validated(spark, SF_SMALL)
    t = SK.bucketed_compaction(spark, ev, name, num_buckets=8, path=shared_dir(spark, name))
    per_key = t.groupBy("customer_key").agg(F.count(F.lit(1)).alias("n"))
    j = t.join(per_key, "customer_key")
    j.collect()
    assert "Exchange hashpartitioning" not in _plan(j)


def test_recent_interactions_limits_before_shuffle(spark):
    df = RC.recent_interactions(I.user_events(spark, SF_SMALL))
    p = df._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in p


def test_landed_jobs_scan_the_raw_events_once(spark):
    """Validation is one scan and one dedupe; jobs that need the events several times read what was landed."""
    import __spark_entry__ as E
    for name in ["total_customers", "union_validated", "raw_events_sink"]:
        plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("events.parquet") <= 1, name
    for name in ["customer_value_features", "discount_offers", "notifier_counters"]:
        plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("events.parquet") == 0, name
