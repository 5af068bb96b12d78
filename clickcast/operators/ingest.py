"""Decode, key and validate events (the ingest half of the streaming consumer).

Every function here is a pure DataFrame -> DataFrame transform, so the same code runs on
a batch DataFrame and on a streaming one.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import (blank_to_null, customer_key, id_type, is_present,
                               parse_event_time, positive_long)
from ..schema import (ALL_EVENTS, EVENT_SCHEMA, EVENT_TYPE_TOPIC, NOTIF_TOPIC, REC_TOPIC,
                      USER_TOPIC)

KEYED_COLUMNS = ["id", "topic", "session_id", "visitor_id", "user_id", "event_time",
                 "event_type", "product_id", "order_id_for_refund", "is_recommended",
                 "recommendation_view", "event_date", "customer_key", "id_type"]


def to_kafka_rows(events: DataFrame) -> DataFrame:
    """(topic, value) message rows: each event as JSON on the topic of its type.
    The event time travels as ISO text with microseconds."""
    body = F.struct(
        "id", "topic", "session_id", "visitor_id", "user_id",
        F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        "event_type", "product_id", "order_id_for_refund", "is_recommended",
        "recommendation_view",
    )
    return events.select(F.col("topic"), F.to_json(body).alias("value"))


def parsed_once(event: Column) -> Column:
    """The struct ``event`` as column ``e``, through a one-row ``inline``. As a plain column the optimizer
    puts the whole parse in place of every later use of a field: some thirty parses of each message."""
    return F.inline(F.array(F.struct(event.alias("e"))))


def decode_events(raw: DataFrame) -> DataFrame:
    """Kafka-shaped rows (binary or string ``value``, ``topic``) -> typed event columns.
    Malformed JSON yields an all-NULL event that validation later rejects; the transport
    topic wins over the one inside the payload."""
    parsed = raw.select(parsed_once(F.from_json(F.col("value").cast("string"), EVENT_SCHEMA)),
                        F.col("topic").alias("kafka_topic"))
    return parsed.select("e.*", "kafka_topic").drop("topic").withColumnRenamed("kafka_topic", "topic")


def decode_messages(raw: DataFrame) -> DataFrame:
    """Like ``decode_events``, with the message itself (``raw_value``) and ``broken``, which says that it
    does not follow the schema. Nothing is dropped."""
    schema = T.StructType([*EVENT_SCHEMA.fields, T.StructField("_broken", T.StringType())])
    value = F.col("value").cast("string")
    e = F.from_json(value, schema, {"columnNameOfCorruptRecord": "_broken"})
    rows = raw.select(parsed_once(e), F.col("topic").alias("_topic"), value.alias("raw_value"))
    broken = F.col("e._broken").isNotNull() | F.col("raw_value").isNull() | F.col("e").isNull()
    return rows.select("e.*", F.col("_topic"), "raw_value", broken.alias("broken")).drop("topic", "_broken").withColumnRenamed("_topic", "topic")


def with_keys(df: DataFrame) -> DataFrame:
    """Add event_time/event_date, customer_key and id_type. Blank user ids and refund order ids are
    normalised to NULL."""
    if "timestamp" in df.columns and "event_time" not in df.columns:
        df = df.withColumn("event_time", parse_event_time("timestamp")).drop("timestamp")
    df = (df.withColumn("user_id", blank_to_null("user_id"))
            .withColumn("order_id_for_refund", blank_to_null("order_id_for_refund")))
    return (df.withColumn("event_date", F.to_date("event_time"))
              .withColumn("customer_key", customer_key())
              .withColumn("id_type", id_type()))


def key_events(df: DataFrame) -> DataFrame:
    """``with_keys`` without the rows that have no key."""
    return with_keys(df).filter(is_present("customer_key"))


#: What every event must carry.
REQUIRED = ["event_time", "id", "visitor_id", "event_type"]
#: Order of the copies of an id: the earliest first, then by every other column, so that the
#: choice never depends on how the rows were dealt out (NULLs first).
COPY_ORDER = ["event_time", "event_type", "product_id", "user_id", "visitor_id", "session_id",
              "order_id_for_refund", "is_recommended", "recommendation_view"]


def complete():
    """Every required column is there."""
    return reduce(and_, (F.col(c).isNotNull() for c in REQUIRED))


def type_on_topic():
    """The event type is one of its topic's (NULL counts as no)."""
    home = F.create_map(*[F.lit(x) for pair in EVENT_TYPE_TOPIC.items() for x in pair])
    return F.coalesce(home[F.col("event_type")] == F.col("topic"), F.lit(False))


def accepted():
    """The one rule predicate behind every validated branch: a type of the topic; a positive
    product id except on the notification topic; an order id on a refund."""
    with_product = F.col("topic") != NOTIF_TOPIC
    refund = F.col("event_type") == "refund_request"
    return (type_on_topic() & (~with_product | F.coalesce(positive_long("product_id"), F.lit(False)))
            & (~refund | F.col("order_id_for_refund").isNotNull()))


def first_copies(df: DataFrame) -> DataFrame:
    """One row per (topic, id): the first by ``COPY_ORDER``; a stream keeps the first arrival."""
    if df.isStreaming:
        return df.dropDuplicates(["topic", "id"])
    rest = [c for c in df.columns if c not in {"topic", "id", *COPY_ORDER}]
    first = df.groupBy("topic", "id").agg(F.min(F.struct(*COPY_ORDER, *rest)).alias("f"))
    return first.select("topic", "id", "f.*").select(df.columns)


def known_events(df: DataFrame) -> DataFrame:
    """Complete events, one per id, of a known type. An id is used up by its first copy, even if
    that copy is rejected later."""
    return first_copies(df.filter(complete())).filter(F.col("event_type").isin(ALL_EVENTS))


def validate_all(keyed: DataFrame) -> DataFrame:
    """All accepted events: one dedupe over (topic, id), then the rule predicate."""
    return first_copies(keyed.filter(complete())).filter(accepted())


def topic_split(keyed: DataFrame) -> dict[str, DataFrame]:
    return {t: keyed.filter(F.col("topic") == t) for t in (USER_TOPIC, REC_TOPIC, NOTIF_TOPIC)}


def validated_branches(keyed: DataFrame) -> dict[str, DataFrame]:
    """The accepted events of each topic."""
    return topic_split(validate_all(keyed))


def union_validated(keyed: DataFrame) -> DataFrame:
    return validate_all(keyed)


def reject_reason(with_dup_flag: bool = True):
    """First failing rule per row (NULL = accepted), in rule order."""
    t = F.col("topic")
    needs_product = t.isin(USER_TOPIC, REC_TOPIC)
    r = (F.when(F.col("event_time").isNull(), "null_event_time")
         .when(F.col("id").isNull(), "null_id")
         .when(F.col("visitor_id").isNull(), "null_visitor_id")
         .when(F.col("event_type").isNull(), "null_event_type"))
    if with_dup_flag:
        r = r.when(F.col("_dup"), "duplicate_id")
    return (r.when(~F.col("event_type").isin(ALL_EVENTS), "unknown_event_type")
             .when(~type_on_topic(), "type_not_on_topic")
             .when(needs_product & ~is_present("product_id"), "missing_product")
             .when(needs_product & ~positive_long("product_id"), "bad_product_id")
             .when((t == USER_TOPIC) & (F.col("event_type") == "refund_request")
                   & F.col("order_id_for_refund").isNull(), "refund_without_order"))


def reject_reasons(keyed: DataFrame) -> DataFrame:
    """Counts of rows failing validation, by topic and first failing rule."""
    ok = complete()
    w = Window.orderBy(*COPY_ORDER)
    flagged = keyed.withColumn(
        "_dup", F.when(ok, F.row_number().over(w.partitionBy(ok, "topic", "id")) > 1).otherwise(False))
    return (flagged.select("topic", reject_reason().alias("reason"))
            .filter(F.col("reason").isNotNull())
            .groupBy("topic", "reason").agg(F.count(F.lit(1)).alias("rejected")))


def keyed_and_complete():
    """A row whose id counts: it has a customer and every required column."""
    return is_present("customer_key") & complete()


def ids_of_batch(rows: DataFrame) -> DataFrame:
    """(topic, id) of the rows that count, with their number ``_n``. The count combines before its shuffle,
    in a hash map of fixed-width values."""
    return rows.filter(keyed_and_complete()).groupBy("topic", "id").agg(F.count(F.lit(1)).alias("_n"))


def known_ids(ids: DataFrame, landed_ids: DataFrame) -> DataFrame:
    """The (topic, id) of ``ids`` that ``landed_ids`` has got. What has landed is all but always the larger
    side: it is neither sorted nor grouped, but looked up in the ids of the batch."""
    return landed_ids.join(ids.hint("shuffle_hash"), ["topic", "id"], "left_semi").select("topic", "id").distinct()


def judged(rows: DataFrame, ids: DataFrame, known: DataFrame, few: bool = False) -> DataFrame:
    """Keyed rows, none dropped, with ``reason``: why a row is rejected, NULL if it is accepted.

    Of the complete rows of an id (``ids``: ``ids_of_batch``) the first by ``COPY_ORDER`` counts, if the id is
    not ``known``; all others are duplicates. Only ids with several rows and known ones need a look. With
    ``few`` of them they are broadcast, and the rows stay where they are. Otherwise the firsts' row numbers
    meet the rows in a join by row number. Either way the choice is an aggregate that combines before its
    shuffle, so a message sent a million times is no hot group. ``rows`` must be persisted: it is read twice
    and its row numbers must agree."""
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    whole, again = numbered.filter(keyed_and_complete()), ids.filter("_n > 1").select("topic", "id")
    named = lambda df: df.withColumnsRenamed({"topic": "_topic", "id": "_id"})
    same = F.col("topic").eqNullSafe(F.col("_topic")) & (F.col("id") == F.col("_id"))
    if few:
        whole = whole.join(F.broadcast(named(again)), same, "left_semi")
    first = whole.groupBy("topic", "id").agg(F.min(F.struct(*COPY_ORDER, "_row")).alias("f")).select("topic", "id", F.col("f._row").alias("_first"))
    fresh = first.join(known, ["topic", "id"], "left_anti")
    if few:
        unsure = named(again.union(known).distinct())
        verdicts = unsure.join(fresh, same, "left").select("_topic", "_id", "_first", F.lit(True).alias("_unsure"))
        flagged = numbered.join(F.broadcast(verdicts), same, "left")
        flagged = flagged.withColumn("_dup", F.col("_unsure").isNotNull() & ~F.col("_first").eqNullSafe(F.col("_row")))
    else:
        fresh = fresh.select(F.col("_first").alias("_row"), F.lit(True).alias("_fresh"))
        flagged = numbered.join(fresh, "_row", "left").withColumn("_dup", F.col("_fresh").isNull())
    reason = F.when(~is_present("customer_key"), "no_customer_key").otherwise(reject_reason())
    reason = F.when(F.col("broken") & reason.isNotNull(), "malformed").otherwise(reason) if "broken" in rows.columns else reason
    return flagged.withColumn("reason", reason).select(*rows.columns, "reason")


def topic_type_match(df: DataFrame) -> DataFrame:
    """Rows whose event type belongs to the topic they travelled on."""
    return df.filter(type_on_topic())
