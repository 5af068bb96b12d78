"""Session baskets: per (session, user) the ordered distinct products put in the cart or
bought, with session-level flags and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import is_present, normalise_product_id, user_from_session

ANON_USER = "nan"


def logged_in_only(events: DataFrame) -> DataFrame:
    return events.filter(is_present("user_id"))


def derive_session_id(events: DataFrame) -> DataFrame:
    """user_id + '_' + event date, for sources that carry no session column."""
    return events.withColumn("session_id", F.concat_ws(
        "_", F.coalesce(F.col("user_id"), F.lit(ANON_USER)), F.to_date("event_time").cast("string")))


def recover_user(events: DataFrame) -> DataFrame:
    """Missing user id taken from a 'u<id>-...' session id; still missing -> 'nan'."""
    return events.withColumn("user_id", F.coalesce(
        F.when(is_present("user_id"), F.col("user_id")), user_from_session("session_id"),
        F.lit(ANON_USER)))


def _prepared(events: DataFrame) -> DataFrame:
    if "session_id" not in events.columns:
        events = derive_session_id(events)
    return recover_user(events).withColumn("product_id", normalise_product_id("product_id"))


def _cart_product():
    return F.when(F.col("event_type").isin("add_to_cart", "transaction")
                  & (F.col("product_id") != "") & (F.col("product_id") != ANON_USER), F.col("product_id"))


def _ordered_products(first_col: str = "first", product_col: str = "cp"):
    """array of products ordered by their first (time, id); NULL products skipped."""
    s = F.array_sort(F.collect_list(F.when(F.col(product_col).isNotNull(), F.struct(
        F.col(f"{first_col}.event_time").alias("t"), F.col(f"{first_col}.id").alias("i"),
        F.col(product_col).alias("p")))))
    return F.transform(s, lambda x: x["p"])


def session_baskets(events: DataFrame) -> DataFrame:
    """One row per (session_id, user_id): event_type (transaction > add_to_cart when the
    basket is non-empty > view), has_transaction, cart_product_id_list (distinct, in order
    of first add/purchase), total_cart_items, total_session_events, first/last timestamp.

    One scan, two stacked aggregations, no join: first per (session, user, cart product or
    NULL) - which collapses repeated events on a product and keeps each product's first
    occurrence - then per session, where the collected list is bounded by the session's
    distinct cart products."""
    keys = ["session_id", "user_id"]
    ev = _prepared(events)
    lvl1 = ev.groupBy(*keys, _cart_product().alias("cp")).agg(
        F.bool_or(F.col("event_type") == "transaction").alias("tx"),
        F.count(F.lit(1)).alias("n"),
        F.min("event_time").alias("t0"),
        F.max("event_time").alias("t1"),
        F.min(F.struct("event_time", "id")).alias("first"),
    )
    out = lvl1.groupBy(*keys).agg(
        F.bool_or("tx").alias("has_transaction"),
        F.sum("n").cast("bigint").alias("total_session_events"),
        F.min("t0").alias("first_timestamp"),
        F.max("t1").alias("last_timestamp"),
        _ordered_products().alias("cart_product_id_list"),
    )
    n = F.size("cart_product_id_list")
    return out.select(
        "user_id", "session_id",
        F.when(F.col("has_transaction"), "transaction").when(n > 0, "add_to_cart")
         .otherwise("view").alias("event_type"),
        "has_transaction", "cart_product_id_list",
        n.cast("bigint").alias("total_cart_items"),
        "total_session_events", "first_timestamp", "last_timestamp")


def session_cart_lists(events: DataFrame) -> DataFrame:
    """Only the non-empty cart lists (what itemset mining needs): (session_id, user_id,
    cart_product_id_list), reading only cart events."""
    keys = ["session_id", "user_id"]
    ev = _prepared(events).withColumn("cp", _cart_product()).filter(F.col("cp").isNotNull())
    lvl1 = ev.groupBy(*keys, "cp").agg(F.min(F.struct("event_time", "id")).alias("first"))
    return lvl1.groupBy(*keys).agg(_ordered_products().alias("cart_product_id_list"))


def mining_baskets(events: DataFrame) -> DataFrame:
    """Non-empty session baskets keyed by (session_id, user_id) -> basket_id text, items."""
    return session_cart_lists(events).select(
        F.concat_ws("|", "session_id", "user_id").alias("basket_id"), F.col("cart_product_id_list").alias("items"))
