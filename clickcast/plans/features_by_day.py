"""Customer-value features from mergeable per-day partials: a run reads its own days of the events.

Under one folder, each partitioned by ``event_date``:

    sessions    per (user, session) of the day: events by type, first and last times
    products    the distinct (user, product) of the day

A session's rows of several days add up, so a session may last over midnight, and late events only mean
that their day is run again. The features then read one row per user, session and day, and no events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import value as V
from .incremental import days, read_partials, replace_days

SCHEMAS = {
    "sessions": "user_id string, session_id string, n long, views long, adds long, removes long, txs long, refunds long, shown long, "
                "clicked long, first_t timestamp_ntz, last_t timestamp_ntz, last_tx timestamp_ntz, event_date date",
    "products": "user_id string, product_id string, event_date date",
}


def update_days(events: DataFrame, path: str, first: str, last: str | None = None) -> None:
    """Bring the partials of the days ``first`` to ``last`` (default: one day) up to date with validated
    ``events``. The days may be new, or be run again after late events."""
    last, first = str(last or first), str(first)
    own = days(events, first, last)
    replace_days(V.session_rollup(own, "event_date"), path, "sessions", first, last)
    replace_days(V.user_products(own, "event_date"), path, "products", first, last)


def customer_counts(spark: SparkSession, path: str) -> DataFrame:
    """``value.customer_counts`` of all days run so far; no rows if there is none."""
    sessions = V.merged_sessions(read_partials(spark, path, "sessions", SCHEMAS))
    return V.counts_of(sessions, read_partials(spark, path, "products", SCHEMAS).select("user_id", "product_id").distinct())


def customer_value_features(spark: SparkSession, path: str) -> DataFrame:
    return V.features_of(customer_counts(spark, path))


def customer_value(spark: SparkSession, path: str) -> DataFrame:
    """Features, score and label per user, as ``value.customer_value`` over all events."""
    return V.value_label(V.value_score(customer_value_features(spark, path)))
