"""Daily revenue and recommender report, for every date in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import count_if


def daily_report(events: DataFrame, products: DataFrame, date=None) -> DataFrame:
    """Per event date: total_revenue (sum of product price over transactions with a known
    product; quantity is not considered), total_orders (all transactions), recommended
    revenue, recommender CTR % (recommended add_to_cart / recommended view) and conversion
    % (recommended transaction / recommended add_to_cart); 0 when a denominator is 0.
    ``date`` restricts the report to one day (the filter reaches the scan)."""
    ev = events if date is None else events.filter(F.col("event_date") == F.to_date(F.lit(date)))
    price = products.select(F.col("id").cast("string").alias("product_id"),
                            F.col("price").cast("double").alias("price"))
    ev = ev.select("event_date", "event_type", "product_id", "is_recommended").join(
        price, "product_id", "left")
    t, rec = F.col("event_type"), F.col("is_recommended") == F.lit(True)
    agg = ev.groupBy(F.col("event_date").alias("date")).agg(
        F.coalesce(F.sum(F.when(t == "transaction", F.col("price"))), F.lit(0.0)).alias("total_revenue"),
        count_if(t == "transaction").alias("total_orders"),
        F.coalesce(F.sum(F.when((t == "transaction") & rec, F.col("price"))), F.lit(0.0)).alias("recommended_revenue"),
        count_if((t == "view") & rec).alias("impressions"),
        count_if((t == "add_to_cart") & rec).alias("clicks"),
        count_if((t == "transaction") & rec).alias("conversions"),
    )
    return agg.select(
        "date", "total_revenue", "total_orders", "recommended_revenue",
        F.when(F.col("impressions") > 0, F.col("clicks") / F.col("impressions") * 100).otherwise(0.0)
         .alias("recommender_ctr"),
        F.when(F.col("clicks") > 0, F.col("conversions") / F.col("clicks") * 100).otherwise(0.0)
         .alias("recommender_conversion"))


def recent_reports(reports: DataFrame, n: int = 30) -> DataFrame:
    return reports.orderBy(F.desc("date")).limit(n)
