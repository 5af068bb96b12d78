"""The daily report from mergeable per-day partials: a run reads its own days of the events.

Under one folder, each partitioned by ``event_date``:

    customers    per customer key of the day: registered or anonymous, events by type
    counts       per (topic, event_type, product_id) of the day: events
    first_seen   (kind, k): the day on which a key counts as customer, registered or anonymous first

Partials of days add up to those of the whole history, so late events only mean that their day is run again;
``first_seen`` is then made anew from that day on, out of the partials, not the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import sinks as SK
from ..schema import NOTIF_TOPIC, REC_TOPIC, USER_TOPIC
from ..session import materialize

SCHEMAS = {
    "customers": "k string, reg boolean, anon boolean, n long, v long, a long, t long, r long, event_date date",
    "counts": "topic string, event_type string, product_id string, n long, event_date date",
    "first_seen": "kind string, k string, event_date date",
}
KINDS = {"customer": "k is not null", "registered": "reg", "anonymous": "anon"}


def read_partials(spark: SparkSession, path: str, name: str, schemas: dict[str, str] = SCHEMAS) -> DataFrame:
    return SK.read_parquet_or_empty(spark, f"{path}/{name}", schemas[name])


def replace_days(df: DataFrame, path: str, name: str, first: str, last: str | None) -> None:
    """Write ``df`` in place of the days from ``first`` to ``last``; days without rows are emptied too. A
    run that failed in between is repaired by running it again."""
    spark = df.sparkSession
    old = [f for f in SK.folders(spark, f"{path}/{name}", 1)
           if first <= f.rsplit("event_date=", 1)[-1] and (last is None or f.rsplit("event_date=", 1)[-1] <= last)]
    fresh = materialize(df)  # it may read what is replaced
    SK.delete_folders(spark, old)
    fresh.write.partitionBy("event_date").mode("append").parquet(f"{path}/{name}")


def days(events: DataFrame, first: str, last: str) -> DataFrame:
    """The events of the days; on a table partitioned by ``event_date`` no other partition is read."""
    return events.filter(F.col("event_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def update_days(events: DataFrame, path: str, first: str, last: str | None = None) -> None:
    """Bring the partials of the days ``first`` to ``last`` (default: one day) up to date with validated
    ``events``. The days may be new, or be run again after late events."""
    last, first = str(last or first), str(first)
    own = days(events, first, last)
    k = F.coalesce("user_id", "visitor_id")
    customers = own.filter(F.col("topic") == USER_TOPIC).groupBy(k.alias("k"), "event_date").agg(*A.rollup_aggs())
    replace_days(customers, path, "customers", first, last)
    counts = own.groupBy("topic", "event_type", "product_id", "event_date").agg(F.count(F.lit(1)).alias("n"))
    replace_days(counts, path, "counts", first, last)
    _refresh_first_seen(events.sparkSession, path, first)


def _refresh_first_seen(spark: SparkSession, path: str, first: str) -> None:
    """``first_seen`` from ``first`` on: the first day of each key among the partials of these days, but
    for keys that an earlier day has. One row per kind and key for ever, however many days."""
    later = read_partials(spark, path, "customers").filter(F.col("event_date") >= F.lit(first).cast("date"))
    by_key = later.groupBy("k").agg(*(F.min(F.when(F.expr(c), F.col("event_date"))).alias(kind) for kind, c in KINDS.items()))
    rows = by_key.select("k", F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("event_date")) for kind in KINDS))).alias("s"))
    rows = rows.select("s.kind", "k", "s.event_date").filter("event_date is not null")
    before = read_partials(spark, path, "first_seen").filter(F.col("event_date") < F.lit(first).cast("date"))
    replace_days(rows.join(before.select("kind", "k"), ["kind", "k"], "left_anti"), path, "first_seen", first, None)


def summary(spark: SparkSession, path: str, as_of: str | None = None) -> DataFrame:
    """The one-row summary as of a day (default: the last one with user events). It reads
    ``first_seen``, one row per customer, and ``counts``; no events."""
    seen, counts = (A.as_of(read_partials(spark, path, n), as_of) for n in ("first_seen", "counts"))
    user = F.col("topic") == USER_TOPIC

    def total(what, name):
        return F.coalesce(F.sum(F.when(what, F.col("n"))), F.lit(0)).alias(name)

    def of_type(t):
        return user & (F.col("event_type") == t)

    def keys(kind, name):
        return seen.agg(F.count_if(F.col("kind") == kind)).scalar().alias(name)

    totals = counts.agg(
        F.max(F.when(user, F.col("event_date"))).alias("run_date"), total(user, "total_events"), total(of_type("view"), "total_views"),
        total(of_type("add_to_cart"), "total_add_to_cart"), total(of_type("transaction"), "total_purchases"),
        total(of_type("refund_request"), "total_refunds"), total(F.col("topic") == REC_TOPIC, "recommendations_generated"),
        total(F.col("topic") == NOTIF_TOPIC, "notifications_generated"))
    return totals.select(
        "run_date", keys("registered", "total_registered_customers"), keys("anonymous", "total_anonymous_visitors"), keys("customer", "total_customers"),
        "total_events", "total_views", "total_add_to_cart", "total_purchases", "total_refunds", "recommendations_generated", "notifications_generated")


def report(spark: SparkSession, path: str, as_of: str | None = None) -> dict[str, DataFrame]:
    """Summary and the eight rankings as of a day, from the partials alone; names and rows as in
    ``daily.build_report``."""
    customers, counts = (A.as_of(read_partials(spark, path, n), as_of) for n in ("customers", "counts"))
    of_user = counts.filter(F.col("topic") == USER_TOPIC)
    tpc = of_user.groupBy("event_type", "product_id").agg(F.sum("n").alias("n"))
    whole = customers.groupBy("k").agg(F.bool_or("reg").alias("reg"), F.bool_or("anon").alias("anon"), F.sum("n").alias("n"))

    def by_type(topic):
        return counts.filter(F.col("topic") == topic).groupBy("event_type").agg(F.sum("n").alias("event_count")).orderBy(F.desc("event_count"), "event_type")

    def most_active(flag, name):
        return whole.filter(flag).select(F.col("k").alias(name), F.col("n").alias("event_count")).orderBy(F.desc("event_count"), name).limit(A.TOP_K)

    return {
        "summary": summary(spark, path, as_of),
        "events_by_type": by_type(USER_TOPIC),
        "top_viewed_products": A.rank_from_counts(tpc, "view", "view_count"),
        "top_cart_products": A.rank_from_counts(tpc, "add_to_cart", "add_to_cart_count"),
        "top_purchased_products": A.rank_from_counts(tpc, "transaction", "purchase_count"),
        "most_active_users": most_active("reg", "user_id"),
        "most_active_visitors": most_active("anon", "visitor_id"),
        "recommendation_event_counts": by_type(REC_TOPIC),
        "notification_counts": by_type(NOTIF_TOPIC),
    }


def write_report(spark: SparkSession, path: str, out: str, as_of: str | None = None) -> str:
    """The report as JSON, like ``daily.generate_report``; returns its run date."""
    parts = report(spark, path, as_of)
    parts["summary"] = materialize(parts["summary"])
    rd = str(parts["summary"].first()["run_date"])
    for name, df in parts.items():
        SK.write_json_report(df.drop("run_date"), out, name, rd)
    return rd
