"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickcast.session import ensure_checkpoint_dir, shared_dir

#: A word: a run of characters that are neither a space nor one of TAB..CR.
WORD = r"[^\x20\x09-\x0D]+"
SIEVE_BITS = 26             # 8 MB bitmaps
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays as it is."""
    return F.translate(c, UPPER, LOWER)


def words(text: str | None) -> list[bytes]:
    """The words of a whole text as UTF-8 (bytes.split cuts at exactly the six ASCII blanks)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def tidy(run):
    """A mapInArrow or mapInPandas function that gives its memory back to the system when its
    partition is done. Spark keeps Python workers for later tasks; without this each holds on to the
    most that any earlier stage took."""

    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def give_back() -> None:
    """Return this process's unused memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def few_rows_at_once(spark: SparkSession, rows: int = 1500) -> None:
    """Lower the session's Arrow batches to ``rows`` rows: a Python worker then holds that many texts,
    whatever their partition's size. Only ever lowers the setting; results do not depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, str(rows))


def few_bytes_at_once(spark: SparkSession, size: int = 1 << 25) -> None:
    """Lower the session's Arrow batches to ``size`` bytes, for rows that hold whole blocks. Only ever
    lowers the setting; results do not depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    set_to = int(spark.conf.get(name, None) or 0)
    if set_to <= 0 or set_to > size:
        spark.conf.set(name, str(size))


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost
    executors, and fixes generated row ids. The folder goes when the driver's JVM ends."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = shared_dir(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.option("compression", "zstd").parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_id(df: DataFrame, name: str, column: str = "row_id") -> DataFrame:
    """Add a row id, unique per row even among equal rows, that stays the same however often and on
    however many cores the table is read: the number of the row's file in the order of all paths, and
    the row's place in the file. The files are counted from their names, one row each, which the driver
    lists to plan the scan anyway. A table that is no plain scan of Parquet files is landed first."""
    path, at, number = (free_name(df, c) for c in ("file_path", "file_row", "file_no"))
    try:
        meta = df.metadataColumn("_metadata")
        rows = df.select("*", meta.getField("file_path").alias(path), meta.getField("row_index").alias(at))
    except AnalysisException:
        return landed(df.withColumn(column, F.monotonically_increasing_id()), name)
    order = Window.orderBy(path)
    files = landed(rows.select(path).distinct().withColumn(number, F.row_number().over(order).cast("long")), f"{name}-files")
    return rows.join(F.broadcast(files), path).withColumn(column, F.shiftleft(number, 36).bitwiseOR(F.col(at))).select(*df.columns, column)


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of a batch of texts: a code per word, the number of words per text (null: 0), and the
    distinct words by code. Arrow's split cuts at the same six ASCII blanks and leaves empty strings
    between neighbouring ones, which are taken out."""
    texts = texts.cast(pa.large_string())
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = parts.flatten().dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    blank = pc.index(flat.dictionary, "").as_py()
    if blank >= 0:
        there = codes != blank
        codes, owner = codes[there], owner[there]
    return codes, np.bincount(owner, minlength=len(texts)), flat.dictionary


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def sieve(keys: DataFrame, key: str, log2_bits: int = SIEVE_BITS) -> Broadcast:
    """A bitmap of a fixed size (2**log2_bits bits) with the hash of each key's bit set, for all workers.
    It only spares shuffles: a key that fell on a set bit by chance goes out in the join that follows,
    and however many keys there are, the bitmap does not grow; it just lets more through."""

    def fold(batches):
        for rb in batches:
            at = sieve_places(rb.column(0).to_numpy(), log2_bits)
            word, inverse = np.unique(at >> 6, return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, inverse, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], ["word", "bits"])

    got = keys.select(key).mapInArrow(tidy(fold), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (log2_bits - 6), np.int64)
    bitmap[got["word"].to_numpy()] = got["bits"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(bitmap)


def sieve_places(keys: np.ndarray, log2_bits: int) -> np.ndarray:
    return (mixed(keys.astype(np.int64).view(np.uint64)) >> np.uint64(64 - log2_bits)).astype(np.int64)


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = sieve_places(keys, len(bitmap).bit_length() - 1 + 6)
    return (bitmap[at >> 6] >> (at & 63)) & 1 == 1


def sifted(docs: DataFrame, rows: Broadcast, column: str, inside: bool) -> DataFrame:
    """The documents whose row ids pass the sieve, or the others."""

    def run(batches):
        for rb in batches:
            yield rb.filter(pa.array(passes(rows.value, rb.column(column).to_numpy()) == inside))

    return docs.mapInArrow(tidy(run), docs.schema)
