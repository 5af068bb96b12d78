"""Title search by positional trigrams: postings instead of a scan of the titles.

Each place of a lower-cased title is one posting (gram, id, place); the grams at the title's end are
shorter. A term of three characters or more is found where all its grams follow each other, so the
postings alone decide and no title is read; a shorter term is found where a gram begins with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import MAX_PAGE_SIZE

GRAM = 3
#: Characters with a meaning in patterns. A term with one is left to the scan.
PATTERN_CHARS = "%_\\"


def title_grams(products: DataFrame) -> DataFrame:
    """(id, title) -> postings (gram, id, place), places from 1; null and empty titles have none."""
    low = products.select("id", F.lower("title").alias("t")).filter(F.length("t") > 0)
    places = F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.struct(F.col("t").substr(i, F.lit(GRAM)).alias("gram"), i.alias("place")))
    return low.select("id", F.explode(places).alias("p")).select("p.gram", "id", "p.place")


def write_title_index(products: DataFrame, path: str) -> None:
    """Postings ranged and sorted by gram, so that a search reads the row groups of its grams alone."""
    title_grams(products).repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.mode("overwrite").parquet(path)


def read_title_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("gram string, id long, place int").parquet(path)


def indexable(term: str) -> bool:
    return term != "" and not any(c in term for c in PATTERN_CHARS)


def _lowered(spark: SparkSession, term: str) -> str:
    """The term in the lower case that Spark gives the titles, which may be longer than the term."""
    return spark.sql("select lower(:t)", args={"t": term}).first()[0]


def title_hits(postings: DataFrame, term: str) -> DataFrame:
    """Ids of the titles that contain the term, in any case: one row each, from the postings alone."""
    if not indexable(term):
        raise ValueError(f"an empty term or one with any of {PATTERN_CHARS} cannot be looked up")
    low = _lowered(postings.sparkSession, term)
    if len(low) < GRAM:
        return postings.filter(F.col("gram").startswith(low)).select("id").distinct()
    grams = [low[k:k + GRAM] for k in range(len(low) - GRAM + 1)]
    found = postings.filter(F.col("gram").isin(sorted(set(grams))))
    # a posting of grams[k] speaks for a hit that begins k places before it
    offsets = F.create_map(*[x for g in sorted(set(grams)) for x in (F.lit(g), F.array(*[F.lit(k) for k, h in enumerate(grams) if h == g]))])
    begins = found.select("id", "place", F.explode(offsets[F.col("gram")]).alias("k")).select("id", (F.col("place") - F.col("k")).alias("begin"))
    whole = begins.groupBy("id", "begin").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams))
    return whole.select("id").distinct()


def indexed_search(postings: DataFrame, products: DataFrame, term: str, after: int | Column | None = None, limit: int = 20) -> DataFrame:
    """The products whose title contains the term, by id: the first ``limit`` after the id ``after``
    (the last id of the page before), with the total number of matches. A page costs the same however
    far it is from the first. Terms that the index cannot answer are looked for in the titles."""
    limit = max(1, min(int(limit), MAX_PAGE_SIZE))
    if indexable(term):
        hits = title_hits(postings, term)
    else:
        hits = products.filter(F.col("title").ilike(f"%{term}%")).select("id")
    total = hits.agg(F.count(F.lit(1))).scalar()
    if after is not None:
        hits = hits.filter(F.col("id") > after)
    page = hits.orderBy("id").limit(limit)
    return products.join(F.broadcast(page), "id").withColumn("total", total)  # at most MAX_PAGE_SIZE rows
