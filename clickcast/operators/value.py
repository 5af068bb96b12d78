"""Customer-value features, rule-based score and tercile label (per logged-in user)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import count_if, elapsed_days, is_present, safe_ratio
from ..functions.ranking import running_total
from ..schema import LABEL_CUTS, NO_TX_DAYS, SCORE_WEIGHTS
from ..session import materialize

FEATURE_COLUMNS = [
    "user_id", "transaction_count", "add_count", "remove_count", "view_count",
    "refund_count", "unique_sessions", "unique_products", "conversion_rate",
    "removal_rate", "cart_abandon_rate", "recommendation_ctr",
    "days_since_last_tx", "events_per_day", "active_days",
]


def _logged_in(events: DataFrame) -> DataFrame:
    ev = events.filter(is_present("user_id"))
    if "session_id" not in ev.columns:
        ev = ev.withColumn("session_id", F.concat_ws("_", "user_id", F.to_date("event_time").cast("string")))
    return ev


def session_rollup(events: DataFrame, *keys: str) -> DataFrame:
    """Per (user, session) and further ``keys``: per-type counts, add/transaction flags, first/last times."""
    t = F.col("event_type")
    return _logged_in(events).groupBy("user_id", "session_id", *keys).agg(
        F.count(F.lit(1)).alias("n"),
        count_if(t == "view").alias("views"),
        count_if(t == "add_to_cart").alias("adds"),
        count_if(t == "delete_from_cart").alias("removes"),
        count_if(t == "transaction").alias("txs"),
        count_if(t == "refund_request").alias("refunds"),
        count_if(t == "recommendation_shown").alias("shown"),
        count_if(t == "recommendation_clicked").alias("clicked"),
        F.min("event_time").alias("first_t"),
        F.max("event_time").alias("last_t"),
        F.max(F.when(t == "transaction", F.col("event_time"))).alias("last_tx"),
    )


def merged_sessions(parts: DataFrame) -> DataFrame:
    """The rollup of all events out of rollups of some of them each: counts add up, times widen."""
    sums = ("n", "views", "adds", "removes", "txs", "refunds", "shown", "clicked")
    return parts.groupBy("user_id", "session_id").agg(
        *(F.sum(c).alias(c) for c in sums), F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"), F.max("last_tx").alias("last_tx"))


def user_products(events: DataFrame, *keys: str) -> DataFrame:
    """The distinct (user, product), by further ``keys``."""
    return _logged_in(events).filter(F.col("product_id").isNotNull()).select("user_id", "product_id", *keys).distinct()


def customer_counts(events: DataFrame) -> DataFrame:
    """Per user counts, first/last time, distinct sessions and products, abandoned sessions
    and last transaction time. Two-level aggregation (user-session, then user) instead of
    distinct aggregates, so no row expansion happens before the shuffle."""
    return counts_of(session_rollup(events), user_products(events))


def counts_of(sessions: DataFrame, pairs: DataFrame) -> DataFrame:
    """``customer_counts`` from one row per (user, session) and one per (user, product)."""
    s = sessions
    per_user = s.groupBy("user_id").agg(
        F.sum("n").cast("bigint").alias("total_events"),
        F.sum("views").cast("bigint").alias("view_count"),
        F.sum("adds").cast("bigint").alias("add_count"),
        F.sum("removes").cast("bigint").alias("remove_count"),
        F.sum("txs").cast("bigint").alias("transaction_count"),
        F.sum("refunds").cast("bigint").alias("refund_count"),
        F.sum("shown").cast("bigint").alias("rec_shown"),
        F.sum("clicked").cast("bigint").alias("rec_clicked"),
        F.min("first_t").alias("first_event_time"),
        F.max("last_t").alias("last_event_time"),
        F.count(F.lit(1)).cast("bigint").alias("unique_sessions"),
        count_if((F.col("adds") > 0) & (F.col("txs") == 0)).alias("abandoned_cart_sessions"),
        F.max("last_tx").alias("last_transaction_time"),
    )
    products = pairs.groupBy("user_id").agg(F.count(F.lit(1)).cast("bigint").alias("unique_products"))
    return (per_user.join(products, "user_id", "left")
            .withColumn("unique_products", F.coalesce("unique_products", F.lit(0).cast("bigint"))))


def abandoned_cart_sessions(events: DataFrame) -> DataFrame:
    """Per user: sessions with an add_to_cart and no transaction (users with none omitted)."""
    s = session_rollup(events)
    return (s.filter((F.col("adds") > 0) & (F.col("txs") == 0))
             .groupBy("user_id").agg(F.count(F.lit(1)).cast("bigint").alias("abandoned_cart_sessions")))


def customer_value_features(events: DataFrame) -> DataFrame:
    """The 14 model features per user. The snapshot is the latest event time of the input
    (a one-row scalar aggregate, cross joined)."""
    return features_of(customer_counts(events))


def features_of(counts: DataFrame) -> DataFrame:
    """The features of ``customer_counts`` rows."""
    # per-user rows, read twice (features and the snapshot): one pass over the events
    c = materialize(counts)
    c = c.withColumn("snapshot", c.agg(F.max("last_event_time")).scalar())
    days = F.least(F.coalesce(elapsed_days(F.col("snapshot"), F.col("last_transaction_time")),
                              F.lit(NO_TX_DAYS)), F.lit(NO_TX_DAYS)).cast("bigint")
    active = (elapsed_days(F.col("last_event_time"), F.col("first_event_time")) + 1).cast("bigint")
    return c.select(
        "user_id", "transaction_count", "add_count", "remove_count", "view_count",
        "refund_count", "unique_sessions", "unique_products",
        safe_ratio(F.col("transaction_count"), F.col("add_count")).alias("conversion_rate"),
        safe_ratio(F.col("remove_count"), F.col("add_count")).alias("removal_rate"),
        safe_ratio(F.col("abandoned_cart_sessions"), F.col("unique_sessions")).alias("cart_abandon_rate"),
        safe_ratio(F.col("rec_clicked"), F.col("rec_shown")).alias("recommendation_ctr"),
        days.alias("days_since_last_tx"),
        (F.col("total_events") / active).alias("events_per_day"),
        active.alias("active_days"),
    )


def value_score(f: DataFrame) -> DataFrame:
    """Weighted score, rounded to 1e-9 (so ties do not depend on last-bit arithmetic);
    non-finite or NULL -> 0."""
    w = SCORE_WEIGHTS
    raw = (F.col("transaction_count") * w["transaction_count"]
           + F.col("conversion_rate") * w["conversion_rate"]
           + F.col("recommendation_ctr") * w["recommendation_ctr"]
           + F.col("removal_rate") * w["removal_rate"]
           + F.col("cart_abandon_rate") * w["cart_abandon_rate"]
           + (F.col("refund_count") / (F.col("transaction_count") + 1)) * w["refund_per_tx"]
           + F.log1p(F.col("days_since_last_tx").cast("double")) * w["log_days_since_last_tx"])
    finite = raw.isNotNull() & ~F.isnan(raw) & (F.abs(raw) != F.lit(float("inf")))
    return f.withColumn("value_score", F.round(F.when(finite, raw).otherwise(F.lit(0.0)), 9))


def pct_rank_average(df: DataFrame, col: str, out: str = "pct_rank") -> DataFrame:
    """Percentile rank with average ties (pandas ``rank(pct=True, method='average')``):
    (#smaller + (#equal + 1) / 2) / n; NULL values get NULL.

    Equal values are collapsed to (value, count) first, so a hot value is one row; the number of
    smaller ones is a running total over value ranges, as many as the session has partitions."""
    df = materialize(df)  # read twice: the distinct values, and the join back
    dist = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_total(dist, ["_v"], "_c", "_less")
    n = df.agg(F.count(col)).scalar()
    ranked = ranked.select("_v", ((F.col("_less") + (F.col("_c") + 1) / 2.0) / n).alias(out))
    return df.join(ranked, df[col] == ranked["_v"], "left").drop("_v")


def value_label(scored: DataFrame) -> DataFrame:
    """0 / 1 / 2 by average-tie percentile rank of the score (<= .33, <= .66, above)."""
    r = pct_rank_average(scored, "value_score", "_pct")
    lo, hi = LABEL_CUTS
    p = F.coalesce(F.col("_pct"), F.lit(0.5))
    return r.withColumn("value_label", F.when(p <= lo, 0).when(p <= hi, 1).otherwise(2)).drop("_pct")


def customer_value(events: DataFrame) -> DataFrame:
    """Features + value_score + value_label per logged-in user."""
    return value_label(value_score(customer_value_features(events)))
