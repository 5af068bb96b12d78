"""Writers: partitioned raw events, bucketed compaction, per-topic dumps, JSON reports,
flat CSV export, feature/rule files and the insert-if-absent append.

All writers are distributed (no driver collect) and idempotent when re-run: they either
overwrite the exact output they own or append only rows whose key is absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..schema import EXPORT_COLUMNS, NUM_BUCKETS


def write_raw_events(df: DataFrame, path: str, mode: str = "append") -> None:
    """Clustered by customer_key inside each file, partitioned by id_type and event_date
    (partition pruning on either)."""
    (df.sortWithinPartitions("customer_key")
       .write.partitionBy("id_type", "event_date").mode(mode).parquet(path))


def run_of(batch: DataFrame) -> str:
    """The id of the streaming query behind a micro-batch. It lives as long as the query's checkpoint:
    a restart keeps it, a new checkpoint, whose batches count from 0 again, has another."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"


def folders(spark: SparkSession, path: str, depth: int) -> list[str]:
    """The folders ``depth`` levels below ``path``; none if there is no such path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path + "/*" * depth)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(f.getPath().toString() for f in found or [] if f.isDirectory())


def delete_folders(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_raw_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """foreachBatch body that survives replays: within each ``id_type``/``event_date`` folder a
    micro-batch owns one ``run=<query>/batch=<id>`` folder, overwritten if the batch is run again. A
    filter on the date lists that date's folders only; ``bucketed_compaction`` merges the small files."""
    (batch.withColumn("run", F.lit(run_of(batch))).withColumn("batch", F.lit(batch_id)).sortWithinPartitions("customer_key")
          .write.partitionBy("id_type", "event_date", "run", "batch").mode("overwrite")
          .option("partitionOverwriteMode", "dynamic").parquet(path.rstrip("/")))


def bucketed_compaction(spark: SparkSession, raw: DataFrame, table: str,
                        num_buckets: int = NUM_BUCKETS, path: str | None = None) -> DataFrame:
    """Rewrite events into a table bucketed and sorted by customer_key, so per-customer
    joins and aggregations over it need no shuffle."""
    w = raw.write.bucketBy(num_buckets, "customer_key").sortBy("customer_key").mode("overwrite")
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)
    return spark.table(table)


def read_parquet_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """Missing input -> an empty frame with the expected schema; any other failure is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_json_report(df: DataFrame, out: str, name: str, run_date: str) -> None:
    """One small report per name under run_date=...; a single file is fine for these
    (they are aggregates of at most a few hundred rows)."""
    (df.withColumn("run_date", F.lit(run_date)).coalesce(1)
       .write.mode("overwrite").json(f"{out}/{name}/run_date={run_date}"))


def flat_event_export(df: DataFrame, path: str) -> int:
    """Project the export columns that exist and write CSV with a header, in parallel."""
    keep = [c for c in EXPORT_COLUMNS if c in df.columns]
    out = df.select(keep)
    out.write.mode("overwrite").option("header", True).csv(path)
    return len(keep)


def with_json_arrays(df: DataFrame) -> DataFrame:
    """Array columns become JSON text (CSV has no array type)."""
    for f in df.schema.fields:
        if f.dataType.typeName() == "array":
            df = df.withColumn(f.name, F.to_json(F.col(f.name)))
    return df


def write_csv(df: DataFrame, path: str) -> None:
    with_json_arrays(df).write.mode("overwrite").option("header", True).csv(path)


def insert_if_absent(new: DataFrame, existing: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not yet in ``existing`` (append these)."""
    return new.join(existing.select(key).distinct(), on=key, how="left_anti")
