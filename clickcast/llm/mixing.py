"""Operator 9: mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Each document has a 60-bit hash: 36 bits of its id and text, then 24 bits of its row, which part equal
rows. Words are summed by source and by the top 12 bits; the bucket in which a source's running sum
passes its budget is the boundary bucket, and only its documents are summed again by the next 12 bits,
and so on. The five parts make one threshold per source, and choosing documents is a filter
``hash < threshold``: nothing is sorted, and neither a source nor its repeated rows are gathered in one
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickcast.llm.common import WORD, free_name, landed, with_row_id

WEIGHTS = (5, 2, 1)  # by source in code-point order, repeating; null last
MAX_REPEAT = 3
LEVEL_BITS, LEVELS = 12, 5
ROW_BITS = 24  # the lowest bits of the hash


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def doc_hash(doc_id: Column, text: Column, row_id: Column) -> Column:
    """36 bits of the MD5 of id and text, then 24 bits of the row's own hash."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    own = F.conv(F.substring(F.md5(key), 1, (LEVELS * LEVEL_BITS - ROW_BITS) // 4), 16, 10).cast("long")
    return F.shiftleft(own, ROW_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64(row_id), 64 - ROW_BITS))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) by water-filling, over one row per source.

    A target is min(level * weight, max_repeat * size), where the level makes the targets sum to all
    words: the fixed point of resharing the excess by weight. Sources fill up in the order of
    size / weight; the first source that does not fill up, if all before it do, gives the level.
    The two windows over all sources see one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.array(*(F.lit(x) for x in weights))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    full = by_source.withColumn("rank", rank).withColumn(
        "weight", F.element_at(w, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * max_repeat).over(earlier), F.lit(0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    )
    cap = (F.col("source_size") * max_repeat).cast("double")
    fits = full.withColumn("level", level).withColumn("place", F.row_number().over(order))
    found = F.min(F.when(F.col("level") * F.col("weight") <= cap, F.struct("place", "level"))).over(everything)["level"]
    return fits.withColumn("found", found).select(
        "source", "rank", "source_size",
        F.least(F.coalesce(F.col("found") * F.col("weight"), cap), cap).alias("target"))


def hash_thresholds(sizes: DataFrame, max_repeat: int = MAX_REPEAT, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, target, whole, threshold, take_equal) for a table (source, size, h).

    Every document is taken ``whole`` times, and once more if its hash is below the threshold;
    ``take_equal`` says if documents at the threshold itself are taken too, as the sum then comes
    nearer to the target.
    """
    targets = source_targets(sizes, weights, max_repeat).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    # nothing is left over where a source is taken whole; 'before' are the chosen words below the boundary so far
    state = targets.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")) \
        .withColumn("threshold", F.lit(0).cast("long")).withColumn("before", F.lit(0).cast("long"))
    state = landed(state, "mix-targets")
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        inside = sizes.filter("size > 0").withColumn("top", F.shiftright("h", shift)).alias("d").join(
            state.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))
            & (F.shiftright("d.top", LEVEL_BITS) == F.col("s.threshold")))
        sums = inside.groupBy("rank", "top").agg(F.sum("size").alias("bucket_words"), F.first("budget").alias("budget"), F.first("before").alias("before"))
        upto = Window.partitionBy("rank").orderBy("top").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        past = (
            sums.withColumn("upto", F.col("before") + F.sum("bucket_words").over(upto)).filter("upto > budget")
            .groupBy("rank").agg(F.min(F.struct("top", (F.col("upto") - F.col("bucket_words")).alias("before"), "bucket_words")).alias("b"))
        )
        state = state.drop("bucket_words").join(past, "rank", "left").select(
            "rank", "source", "source_size", "target", "whole", "budget",
            F.coalesce("b.top", F.shiftleft("threshold", LEVEL_BITS)).alias("threshold"),
            F.coalesce("b.before", "before").alias("before"), F.coalesce("b.bucket_words", F.lit(0)).alias("bucket_words"))
        state = landed(state, f"mix-level{level}")
    return state.select(
        "source", "source_size", "target", "whole", "threshold",
        (F.col("bucket_words") <= 2 * (F.col("budget") - F.col("before"))).alias("take_equal"))


def copies(h: Column, t: str = "t") -> Column:
    """How often a document with hash ``h`` is taken by the thresholds of alias ``t``."""
    limit = F.col(f"{t}.threshold")
    return F.col(f"{t}.whole") + ((h < limit) | ((h == limit) & F.col(f"{t}.take_equal"))).cast("long")


def sizes_of(docs: DataFrame) -> DataFrame:
    rows = with_row_id(docs.select("doc_id", "source", "text"), "mix-rows")
    h = doc_hash(F.col("doc_id"), F.col("text"), F.col("row_id"))
    return rows.select("doc_id", "source", n_words(F.col("text")).alias("size"), h.alias("h"))


def mix(docs: DataFrame) -> DataFrame:
    """``documents`` -> (doc_id, size, source_size, target, taken), one row per document.

    A null text has size 0 and is taken as 0 words; a null source is a source of its own, the last.
    Rows that are equal in id and text are told apart by their row ids, so that as many of them are taken
    as the budget allows; which of them does not show. An empty table gives no rows. The threshold
    depends on the rows alone, so reruns agree.
    """
    sizes = landed(sizes_of(docs), "mix-sizes")
    t = hash_thresholds(sizes)
    out = sizes.alias("d").join(t.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("h"))).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns, whatever else they
    are called. A document without words (null, empty or blank text) counts for nothing and stays once;
    repeated rows and null sources are as in ``mix``; an empty table gives no rows."""
    row, size, h, copy = (free_name(docs, c) for c in ("row_id", "size", "hash", "copy"))
    ids = with_row_id(docs, "mix-rows", row)
    sized = ids.withColumn(size, n_words(F.col("text"))).withColumn(h, doc_hash(F.col("doc_id"), F.col("text"), F.col(row)))
    t = hash_thresholds(landed(sized.select("source", F.col(size).alias("size"), F.col(h).alias("h")), "mix-sizes"))
    out = sized.alias("d").join(t.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    n = F.when(F.col(f"d.{size}") > 0, copies(F.col(f"d.{h}"))).otherwise(1).cast("int")
    return out.select("d.*", F.explode(F.array_repeat(F.lit(1), n)).alias(copy)).select(*docs.columns)
