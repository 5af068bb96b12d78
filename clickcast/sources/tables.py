"""Driver tables and the canonical shop views derived from them.

``shop_events`` / ``shop_products`` / ``shop_users`` map the star-schema test tables onto the
shop data model (see FIXTURES.md §2); every operator reads these or a table derived from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import NOTIF_TOPIC, REC_TOPIC, RECOMMENDATION_VIEWS, USER_TOPIC

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _mapped_event_type(event_id: Column, raw_type: Column) -> Column:
    # fixed mapping of the generic event log onto the 14 shop event types
    other = (F.when(event_id % 9 == 0, "recommendation_shown")
             .when(event_id % 9 == 1, "recommendation_clicked")
             .when(event_id % 9 == 2, "recommendation_accepted")
             .when(event_id % 9 == 3, "recommendation_rejected")
             .when(event_id % 9 == 4, "discount_offer_sent")
             .when(event_id % 9 == 5, "reminder_sent")
             .when(event_id % 9 == 6, "offer_accepted")
             .when(event_id % 9 == 7, "offer_declined")
             .otherwise("refund_request"))
    return (F.when(raw_type == "view", "view")
            .when(raw_type == "click", "add_to_cart")
            .when(raw_type == "purchase", "transaction")
            .when(raw_type == "signup",
                  F.when(event_id % 2 == 0, "quantity").otherwise("delete_from_cart"))
            .otherwise(other))


def topic_of(event_type: Column) -> Column:
    return (F.when(event_type.isin("recommendation_shown", "recommendation_clicked",
                                   "recommendation_accepted", "recommendation_rejected"), REC_TOPIC)
            .when(event_type.isin("discount_offer_sent", "reminder_sent", "offer_accepted",
                                  "offer_declined"), NOTIF_TOPIC)
            .otherwise(USER_TOPIC))


def shop_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shop event per ``events`` row: id, topic, session_id, visitor_id, user_id,
    event_time (timestamp_ntz), event_type, product_id, order_id_for_refund, is_recommended,
    recommendation_view."""
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "props")
    uid = F.col("user_id").cast("string")
    anon = F.col("user_id") % 5 == 0
    etype = _mapped_event_type(F.col("event_id"), F.col("event_type"))
    x = e.select(
        F.col("event_id").alias("id"),
        uid.alias("uid"),
        anon.alias("anon"),
        F.col("ts").alias("event_time"),
        F.regexp_extract("props", "([0-9]+)", 1).alias("product_id"),
        etype.alias("event_type"),
    )
    return x.select(
        "id",
        topic_of(F.col("event_type")).alias("topic"),
        F.concat(F.when(F.col("anon"), F.concat(F.lit("v"), "uid")).otherwise(F.concat(F.lit("u"), "uid")),
                 F.lit("-"), F.col("event_time").cast("date").cast("string"), F.lit("-s0")).alias("session_id"),
        F.when(F.col("anon"), F.concat(F.lit("visitor_"), "uid")).otherwise(F.lit("")).alias("visitor_id"),
        F.when(F.col("anon"), F.lit(None).cast("string")).otherwise(F.col("uid")).alias("user_id"),
        "event_time",
        "event_type",
        "product_id",
        F.when((F.col("event_type") == "refund_request") & (F.col("id") % 3 != 0),
               F.concat(F.lit("ORD-"), F.col("id").cast("string"))).alias("order_id_for_refund"),
        (F.col("id") % 7 == 0).alias("is_recommended"),
        F.when(F.col("id") % 7 == 0, F.element_at(F.array(*map(F.lit, RECOMMENDATION_VIEWS)), (F.col("id") % 4 + 1).cast("int")))
         .otherwise("").alias("recommendation_view"),
    )


def shop_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product dimension: id, title, category, price, reviews, stars, is_best_seller."""
    p = read_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
        F.col("p_size").alias("reviews"),
        ((F.col("p_partkey") % 50).cast("double") / 10).alias("stars"),
        (F.col("p_brand") == "Brand#1").alias("is_best_seller"),
    )


def shop_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users: id, first_name, email, country, region, is_deleted.

    ``nation`` and ``region`` are fixed-size code tables (25 and 5 rows), so broadcasting
    them is bounded regardless of scale.
    """
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
         .join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey))
    return j.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("first_name"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), F.lit("@example.com")).alias("email"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("region"),
        (F.col("c_custkey") % 20 == 0).alias("is_deleted"),
    )


def shop_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category dimension derived from the product table: id (dense rank of the name), name."""
    names = shop_products(spark, sf_dir).select(F.col("category").alias("category_name")).distinct()
    # dense id by name: a distributed rank via join-free sort is not needed here, the
    # category domain is the (bounded) product-type vocabulary
    from pyspark.sql import Window as W
    return names.select(F.dense_rank().over(W.orderBy("category_name")).cast("bigint").alias("id"),
                        "category_name")


def brand_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mining baskets: one row per order with the set of part brands it contains
    (``basket_id``, ``items`` array<string>, sorted and distinct)."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    # pre-aggregate to distinct (order, brand) before collecting: the set per order is
    # bounded by the order's line count
    pairs = li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("basket_id"), F.col("p_brand").alias("item")).distinct()
    return pairs.groupBy("basket_id").agg(F.array_sort(F.collect_set("item")).alias("items"))


def unclean_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``shop_events`` with everything that validation must catch, each derived from a share of the
    rows: copies of an id with another product at the same time, copies on another topic, missing
    required columns, unknown and misplaced types, and missing or bad product ids."""
    e = shop_events(spark, sf_dir)
    part = lambda k: e.filter(F.col("id") % 50 == k)
    fresh = lambda k: part(k).withColumn("id", F.col("id") + k * 1_000_000_000)
    faults = [
        part(0).withColumn("product_id", F.concat("product_id", F.lit("7"))),
        part(1).withColumn("topic", F.lit(NOTIF_TOPIC)),
        fresh(2).withColumn("topic", F.lit(REC_TOPIC)).withColumn("event_type", F.lit("view")),
        fresh(3).withColumn("event_type", F.lit("teleport")),
        fresh(4).withColumn("id", F.lit(None).cast("bigint")),
        fresh(5).withColumn("event_time", F.lit(None).cast("timestamp_ntz")),
        fresh(6).withColumn("visitor_id", F.lit(None).cast("string")).withColumn("user_id", F.lit("77")),
        fresh(7).withColumn("event_type", F.lit(None).cast("string")),
        fresh(8).withColumn("topic", F.lit(USER_TOPIC)).withColumn("event_type", F.lit("view")).withColumn("product_id", F.lit("")),
        fresh(9).withColumn("topic", F.lit(USER_TOPIC)).withColumn("event_type", F.lit("view")).withColumn("product_id", F.lit("-1")),
    ]
    for f in faults:
        e = e.unionByName(f)
    return e
