"""File sources with explicit schemas (no inference on the hot path)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import EXPORT_COLUMNS

# --- fixed values: the headers of the seed and export files, in file order ---
SEED_USERS = ["id", "first_name", "last_name", "email", "phone_number", "region", "country",
              "hashed_password", "is_deleted"]
SEED_EVENTS = ["id", "visitor_id", "user_id", "timestamp", "event_type", "product_id",
               "order_id_for_refund", "is_recommended"]
SEED_CATEGORIES = ["id", "category_name"]
SEED_PRODUCTS = ["asin", "title", "img_url", "product_url", "stars", "reviews", "price",
                 "list_price", "category_id", "is_best_seller", "bought_in_last_month"]
GENERATED_PRODUCTS = ["id", "name", "short_description", "long_description", "features", "category",
                      "image_url", "price", "created_on", "updated_on"]
# --- end of fixed values ---


def read_with_header(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """Text columns of a CSV file whose header line must be ``header``: another header fails
    instead of shifting columns. Fields are trimmed; empty ones are NULL."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    raw = (spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
           .option("multiLine", True).option("escape", '"').csv(path))
    return raw.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in header])


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first of the paths that exists; none: an error."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return path
    raise FileNotFoundError(f"none of these exists: {', '.join(paths)}")


def _flag(c: str):
    return F.expr(f"try_cast({c} as boolean)").alias(c)


def read_products_csv(spark: SparkSession, path: str) -> DataFrame:
    """Product dimension from a generated product file: product_id as text, category, price."""
    p = read_with_header(spark, path, GENERATED_PRODUCTS)
    return p.select(F.col("id").alias("product_id"), F.col("category").alias("product_category"),
                    F.expr("try_cast(price as double)").alias("product_price"))


def read_seed_products(spark: SparkSession, path: str) -> DataFrame | None:
    """The product seed; None if the file is not there (the seed then goes on without products)."""
    try:
        path = first_existing(spark, path)
    except FileNotFoundError:
        return None
    p = read_with_header(spark, path, SEED_PRODUCTS)
    number = lambda c, t: F.expr(f"try_cast({c} as {t})").alias(c)
    return p.select("asin", "title", "img_url", "product_url", number("stars", "double"), number("reviews", "bigint"),
                    number("price", "double"), number("list_price", "double"), number("category_id", "bigint"),
                    _flag("is_best_seller"), number("bought_in_last_month", "bigint"))


def read_seed_categories(spark: SparkSession, path: str) -> DataFrame:
    return read_with_header(spark, path, SEED_CATEGORIES).select(F.expr("try_cast(id as bigint)").alias("id"), "category_name")


def _event_columns(e: DataFrame) -> list:
    return [F.col("user_id"), F.col("visitor_id"),
            F.col("session_id") if "session_id" in e.columns else F.lit(None).cast("string").alias("session_id"),
            F.try_to_timestamp("timestamp").cast("timestamp_ntz").alias("event_time"),
            F.col("event_type"), F.col("product_id"), _flag("is_recommended"), F.col("order_id_for_refund")]


def read_events_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """The flat event export (the first of ``paths`` that exists): yes/no/true/false flags become
    booleans, timestamps are parsed (unparsable -> NULL)."""
    e = read_with_header(spark, first_existing(spark, *paths), EXPORT_COLUMNS)
    return e.select(*_event_columns(e))


def read_seed_events(spark: SparkSession, path: str) -> DataFrame:
    """The event seed (with ids, without sessions), typed as ``read_events_csv``."""
    e = read_with_header(spark, path, SEED_EVENTS)
    return e.select(F.expr("try_cast(id as bigint)").alias("id"), *_event_columns(e))


def read_users_csv(spark: SparkSession, path: str) -> DataFrame:
    """The user seed (' false' -> false)."""
    u = read_with_header(spark, path, SEED_USERS)
    return u.select(F.expr("try_cast(id as bigint)").alias("id"), *SEED_USERS[1:-1], _flag("is_deleted"))


def load_once(rows: DataFrame, spark: SparkSession, path: str) -> bool:
    """Write a seed table unless it is there already; says if it was written."""
    try:
        first_existing(spark, path)
    except FileNotFoundError:
        rows.write.parquet(path)
        return True
    return False


def read_jdbc(spark: SparkSession, url: str, table: str, props: dict | None = None,
              partition_column: str | None = None, lower: int = 0, upper: int = 0,
              num_partitions: int = 0) -> DataFrame:
    """Table read over JDBC, split into ``num_partitions`` range reads when a numeric
    partition column is given (parallel scan instead of one connection)."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (props or {}).items():
        r = r.option(k, v)
    if partition_column and num_partitions:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
              .option("upperBound", upper).option("numPartitions", num_partitions))
    return r.load()


def read_kafka(spark: SparkSession, brokers: str, topics: str, starting_offsets: str = "latest"):
    """Streaming subscription to the event topics (needs the Kafka connector on the
    classpath); ``decode_events`` turns its rows into events."""
    return (spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", brokers)
            .option("subscribe", topics)
            .option("startingOffsets", starting_offsets)
            .option("failOnDataLoss", "false")
            .load())


def read_message_files(spark: SparkSession, path: str, max_files_per_trigger: int | None = None):
    """File stand-in for the Kafka source: parquet/JSON files of (topic, value) rows,
    read as a stream."""
    schema = T.StructType([T.StructField("topic", T.StringType()), T.StructField("value", T.StringType())])
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.option("recursiveFileLookup", True).parquet(path)
