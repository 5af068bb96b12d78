"""The daily analytics report job: the one-row summary and eight rankings, written as JSON
under ``<name>/run_date=<date>``.

The user-event table is read by two aggregations only: the per-customer rollup (summary,
most active users and visitors) and the (event_type, product) pre-aggregate (events by
type and the three product rankings); both are materialised once and every output is
derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators.sinks import write_json_report
from ..session import materialize


REPORTS = ["summary", "events_by_type", "top_viewed_products", "top_cart_products", "top_purchased_products",
           "most_active_users", "most_active_visitors", "recommendation_event_counts", "notification_counts"]


def build_report(ue: DataFrame, rec: DataFrame, notif: DataFrame, run_date=None,
                 as_of_date=None) -> dict[str, DataFrame]:
    ue, rec, notif = (A.as_of(x, as_of_date) for x in (ue, rec, notif))
    roll = materialize(A.customer_rollup(ue))
    tpc = materialize(A.type_product_counts(ue))
    if run_date is None:
        run_date = str(ue.agg(F.max("event_date")).first()[0])
    summary = roll.agg(
        F.count_if(F.col("reg")).alias("total_registered_customers"),
        F.count_if(F.col("anon")).alias("total_anonymous_visitors"),
        F.count_if(F.col("k").isNotNull()).alias("total_customers"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_events"),
        F.coalesce(F.sum("v"), F.lit(0)).cast("bigint").alias("total_views"),
        F.coalesce(F.sum("a"), F.lit(0)).cast("bigint").alias("total_add_to_cart"),
        F.coalesce(F.sum("t"), F.lit(0)).cast("bigint").alias("total_purchases"),
        F.coalesce(F.sum("r"), F.lit(0)).cast("bigint").alias("total_refunds"),
    ).select(F.lit(run_date).alias("run_date"), "*",
             A.recommendations_generated(rec).scalar().alias("recommendations_generated"),
             A.notifications_generated(notif).scalar().alias("notifications_generated"))
    by_type = (tpc.groupBy("event_type").agg(F.sum("n").cast("bigint").alias("event_count"))
                  .orderBy(F.desc("event_count"), "event_type"))
    # the rollup key is coalesce(user_id, visitor_id): registered rows are the reg ones
    users = (roll.filter("reg").select(F.col("k").alias("user_id"), F.col("n").alias("event_count"))
                 .orderBy(F.desc("event_count"), "user_id").limit(A.TOP_K))
    visitors = (roll.filter("anon").select(F.col("k").alias("visitor_id"), F.col("n").alias("event_count"))
                    .orderBy(F.desc("event_count"), "visitor_id").limit(A.TOP_K))
    return {
        "summary": summary,
        "events_by_type": by_type,
        "top_viewed_products": A.rank_from_counts(tpc, "view", "view_count"),
        "top_cart_products": A.rank_from_counts(tpc, "add_to_cart", "add_to_cart_count"),
        "top_purchased_products": A.rank_from_counts(tpc, "transaction", "purchase_count"),
        "most_active_users": users,
        "most_active_visitors": visitors,
        "recommendation_event_counts": A.recommendation_event_counts(rec),
        "notification_counts": A.notification_counts(notif),
        "_run_date": run_date,
    }


def generate_report(ue: DataFrame, rec: DataFrame, notif: DataFrame, out: str, run_date=None,
                    as_of_date=None) -> str:
    parts = build_report(ue, rec, notif, run_date, as_of_date)
    rd = parts.pop("_run_date")
    for name, df in parts.items():
        if name == "summary":
            df.coalesce(1).write.mode("overwrite").json(f"{out}/summary/run_date={rd}")
        else:
            write_json_report(df, out, name, rd)
    return rd
