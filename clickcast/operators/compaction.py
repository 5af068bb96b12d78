"""Incremental compaction of landed events: only the days with new files are rewritten, into few files.

A manifest beside the compacted table lists, by day, the landed files that its files were made of. A run
compares it with the files that are there now; a day whose files are all in it is left alone. A rewritten
day holds about one file per ``target_bytes``, but at least one per ``TASK_BYTES``, which is what a task
sorts; files are sorted by customer. A run that fails between the data and
the manifest is repaired by the next, which writes the same days again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .sinks import delete_folders, folders, read_parquet_or_empty

DAY = ["id_type", "event_date"]
FILE = ["path", "length", "modified"]
TASK_BYTES = 32 << 20  # landed bytes that a task sorts: some 10 times as much in memory
MANIFEST = "path string, length long, modified timestamp, id_type string, event_date date"


def landed_files(spark: SparkSession, raw: str) -> DataFrame:
    """(id_type, event_date, path, length, modified) of each Parquet file below ``raw``; contents are not
    read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(raw)
    part = {c: F.regexp_extract("path", f"/{c}=([^/]*)/", 1) for c in DAY}
    return listed.select(part["id_type"].alias("id_type"), part["event_date"].cast("date").alias("event_date"),
                         "path", "length", F.col("modificationTime").alias("modified"))


def changed_days(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(id_type, event_date, size): the days with a file that is new, or gone since the last run, and the
    bytes of their present files."""
    new, gone = files.join(manifest, [*DAY, *FILE], "left_anti"), manifest.join(files, [*DAY, *FILE], "left_anti")
    days = new.select(DAY).union(gone.select(DAY)).distinct()
    size = files.groupBy(DAY).agg(F.sum("length").alias("size"))
    return days.join(size, DAY, "left").withColumn("size", F.coalesce("size", F.lit(0)))


def compact(spark: SparkSession, raw: str, out: str, target_bytes: int = 128 << 20) -> list[tuple[str, str]]:
    """Bring ``out``/data, partitioned like ``raw`` by id_type and event_date, up to date with the landed
    events below ``raw``; returns the days written as (id_type, event_date).

    The days are few (one row per id type and calendar day), so the driver may list them. Rows are dealt by
    ranges of day, customer and time, so a customer with much of a day is spread over its files. The ranges
    follow the landed bytes, so a task's memory does not grow with what has landed."""
    data, lists = f"{out}/data", f"{out}/manifest"
    files = materialize(landed_files(spark, raw))
    manifest = materialize(read_parquet_or_empty(spark, lists, MANIFEST).select(*DAY, *FILE))
    days = changed_days(files, manifest).orderBy(DAY).collect()
    if not days:
        return []
    wanted = [(d.id_type, str(d.event_date)) for d in days]
    is_wanted = F.lit(False)
    for kind in sorted({k for k, _ in wanted}):
        of_kind = [F.lit(day).cast("date") for k, day in wanted if k == kind]
        is_wanted = is_wanted | ((F.col("id_type") == kind) & F.col("event_date").isin(*of_kind))
    parts = max(1, -(-sum(d.size for d in days) // min(target_bytes, TASK_BYTES)))
    events = spark.read.parquet(raw).filter(is_wanted).drop("run", "batch")
    order = [*DAY, "customer_key", "event_time"]
    # a day whose files are all gone has no rows that would overwrite it
    delete_folders(spark, [f for f in folders(spark, data, 2) for k, day in ((d.id_type, str(d.event_date)) for d in days if not d.size)
                           if f.endswith(f"/id_type={k}/event_date={day}")])
    (events.repartitionByRange(int(parts), *order).sortWithinPartitions(*order)
           .write.partitionBy(*DAY).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(data))
    present = files.filter(is_wanted)
    kept = manifest.filter(~is_wanted)
    materialize(kept.unionByName(present)).coalesce(1).write.mode("overwrite").parquet(lists)
    return wanted
