"""The corpus pipeline: documents in, packed training sequences out.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that the stage before it kept;
its result is written as Parquet and read again as the next stage's documents. All stages but the
last return the columns of ``documents``; the last returns one row per piece of a training sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickcast.llm import mixing, packing, simhash, substring, toxicity
from clickcast.llm.common import free_name, landed, table

#: SimHash, the toxicity model and the tokenizer cannot be written in SQL; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar, fitted to the labels, does not reject (score below 0.5).

    A null or empty text has no clause, scores low and stays; repeated rows score alike and share one
    fate; ids may be null; all columns come back, whatever their names. An empty table gives no rows."""
    model = toxicity.train_model(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return toxicity.score_documents(docs, model, score).filter(F.col(score) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash near-dedup links (four-word shingles, 4 bits or fewer).
    The smallest doc_id stays (nulls last). Texts without words, null ones included, share a fingerprint,
    so one of them stays; of repeated rows one stays. An empty table gives no rows."""
    return simhash.one_of_each_group(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 35-word windows that occur elsewhere too; a text of which nothing is
    left goes, one that had no words (null, empty, blank) stays. ``n_chars`` follows the text. Repeated
    rows repeat each other's windows and lose them. An empty table gives no rows."""
    n, gone = free_name(docs, "n_words"), free_name(docs, "n_removed")
    out = substring.deduplicated(docs, n, gone).filter((F.col(gone) == 0) | (F.col(gone) < F.col(n)))
    changed = F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it; one without words (null, empty, blank)
    stays once, a null source is the last one, and of repeated rows as many are taken as the target
    allows. An empty table gives no rows."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: pieces of documents with their ids. A null or empty text is its end id
    alone; repeated rows are packed each. An empty table gives no rows."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them are in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
