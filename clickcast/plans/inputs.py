"""Standard inputs assembled from the driver tables: keyed events and the three
validated topic branches (what the streaming consumer lands at rest)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import ingest
from ..schema import NOTIF_TOPIC, REC_TOPIC, USER_TOPIC
from ..session import materialize
from ..sources.tables import shop_events


def keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.key_events(shop_events(spark, sf_dir))


def validated(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return ingest.validated_branches(keyed_events(spark, sf_dir))


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted events, validated once and cut from their lineage (a reliable checkpoint): for
    jobs that read them several times."""
    return materialize(all_validated(spark, sf_dir).repartitionByRange("topic", "event_date"))


def landed_branches(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return ingest.topic_split(landed(spark, sf_dir))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(spark, sf_dir)[USER_TOPIC]


def recommendation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(spark, sf_dir)[REC_TOPIC]


def notification_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(spark, sf_dir)[NOTIF_TOPIC]


def all_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.union_validated(keyed_events(spark, sf_dir))
