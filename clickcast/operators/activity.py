"""Per-customer activity in tumbling event-time windows (batch and streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import count_if
from ..schema import ACTIVITY_WINDOW


def activity_aggs():
    t = F.col("event_type")
    return [
        F.count(F.lit(1)).alias("event_count"),
        count_if(t == "view").alias("views"),
        count_if(t == "add_to_cart").alias("add_to_carts"),
        count_if(t == "delete_from_cart").alias("cart_removals"),
        count_if(t == "transaction").alias("transactions"),
        count_if(t == "refund_request").alias("refund_requests"),
        count_if(t == "recommendation_clicked").alias("recs_clicked"),
        count_if(F.col("is_recommended") == F.lit(True)).alias("recommended_events"),
    ]


def customer_activity(events: DataFrame, window: str = ACTIVITY_WINDOW) -> DataFrame:
    """(window_start, window_end, customer_key, id_type) -> activity counts, with exact distinct products.

    Two aggregations one after the other: counts per product of a window and key, then their sums and
    the number of products. The state of a stream holds eight counters per product touched and no set;
    both steps close with the same watermark. In batch the first step combines before its shuffle, so a
    customer with a third of all events is no hot group."""
    keys = ["customer_key", "id_type"]
    parts = events.groupBy(F.window("event_time", window).alias("w"), *keys, "product_id").agg(*activity_aggs())
    counts = [c for c in parts.columns if c not in {"w", *keys, "product_id"}]
    whole = F.window(F.window_time("w"), window) if events.isStreaming else F.col("w")
    out = parts.groupBy(whole.alias("w"), *keys).agg(
        *[F.sum(c).alias(c) for c in counts], F.count("product_id").alias("distinct_products_touched"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      *[c for c in out.columns if c != "w"])
