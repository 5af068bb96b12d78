"""Operator 7: document fingerprints as Merkle trees over paragraphs and sections.

Leaves are sentence-sized pieces; a paragraph (a line) is the digest of its leaves, a section the
digest of its paragraphs, and the root the digest of its sections. A section ends after a paragraph
whose digest falls on a fixed residue, so an edit moves only the section borders near it. The
fingerprint string carries the leaves, the inner borders and the root: equal roots mean equal
texts, and two trees are compared from the top down, so only differing branches are opened.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = re.compile(r"[^.!?]*[.!?]*\s*", re.S)
MAX_PIECE = 160          # characters; longer pieces are cut from their start
SECTION_EVERY = 4        # paragraphs of a section on average
LEAF_HEX, ROOT_HEX = 8, 32


def _digest(data: bytes, size: int) -> str:
    return hashlib.blake2b(data, digest_size=size // 2).hexdigest()


def leaves(paragraph: str) -> list[str]:
    """Digest and length of each piece of a paragraph."""
    out = []
    for piece in PIECE.findall(paragraph):
        for k in range(0, len(piece), MAX_PIECE):
            part = piece[k:k + MAX_PIECE]
            out.append(_digest(part.encode("utf-8", "surrogatepass"), LEAF_HEX) + format(len(part), "02x"))
    return out


def fingerprint(text: str | None) -> str:
    """``root:section/section/...``; a section is ``paragraph,paragraph,...`` and a paragraph the
    concatenation of its leaves (8 hex digits of digest, 2 of length). The root digests the whole
    text as well, so equal fingerprints mean equal texts. A null text counts as empty."""
    text = text or ""
    sections, section = [], []
    for paragraph in text.split("\n"):
        p = "".join(leaves(paragraph))
        section.append(p)
        if int(_digest(p.encode(), 8), 16) % SECTION_EVERY == 0:
            sections.append(",".join(section))
            section = []
    if section:
        sections.append(",".join(section))
    body = "/".join(sections)
    tops = "".join(_digest("".join(_digest(p.encode(), ROOT_HEX) for p in s.split(",")).encode(), ROOT_HEX) for s in sections)
    root = _digest((tops + _digest(text.encode("utf-8", "surrogatepass"), ROOT_HEX)).encode(), ROOT_HEX)
    return f"{root}:{body}"


def _opened(a: Counter, b: Counter, sep: str) -> tuple[Counter, Counter]:
    """Children of the branches that only one side has."""
    out = []
    for x, y in ((a, b), (b, a)):
        c: Counter = Counter()
        for k, n in (x - y).items():
            for child in k.split(sep) if sep else (k[i:i + LEAF_HEX + 2] for i in range(0, len(k), LEAF_HEX + 2)):
                c[child] += n
        out.append(c)
    return out[0], out[1]


def likeness(a: str, b: str) -> float:
    """Share of the characters of two texts that lie in equal leaves (0 to 1), from their
    fingerprints alone. Equal roots give 1 at once; equal sections and paragraphs cancel unopened,
    so the leaves that are left over locate the edits."""
    if a == b:
        return 1.0
    chars = lambda c: sum(n * sum(int(k[i + LEAF_HEX:i + LEAF_HEX + 2], 16) for i in range(0, len(k), LEAF_HEX + 2)) for k, n in c.items())
    split = [Counter(x.split(":", 1)[1].split("/")) for x in (a, b)]
    flat = [Counter(x.split(":", 1)[1].replace("/", "").replace(",", "") for x in (s,)) for s in (a, b)]
    total = chars(flat[0]) + chars(flat[1])
    if not total:
        return 0.0
    for sep in (",", ""):
        split = list(_opened(*split, sep))
    return 1.0 - (chars(split[0] - split[1]) + chars(split[1] - split[0])) / total


def edits(a: str, b: str) -> tuple[list[str], list[str]]:
    """The leaves that only one of two fingerprints has."""
    split = [Counter(x.split(":", 1)[1].split("/")) for x in (a, b)]
    for sep in (",", ""):
        split = list(_opened(*split, sep))
    return sorted((split[0] - split[1]).elements()), sorted((split[1] - split[0]).elements())


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _id(x):
    return None if x is None or x != x else int(x)


def compared(doc_id, text: str, follower: str, own: str | None = None) -> tuple[tuple, str]:
    """A row of the result, and the follower's fingerprint for the next call."""
    half = len(text) // 2
    edited = text[:len(text) - half] + follower[:half]
    fp, fe, fn = own or fingerprint(text), fingerprint(edited), fingerprint(follower)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return (doc_id, len(text), sha, fp, fe, likeness(fp, fe), likeness(fp, fn)), fn


def fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """``documents`` -> one row per document (see SCHEMA), against the text edited with the next
    document in descending doc_id (null ids last; equal ids by text; after the last, the first).

    The rows are range-sorted once; a task holds one document and its follower. Only the first row of
    each partition is needed elsewhere, by the last row of the partition before it: those two rows
    per partition are joined on the partition's number. A null text counts as empty; a table of one
    row follows itself; an empty one gives no rows. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    n = partitions or max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(n, *order).sortWithinPartitions(*order, "text").drop("tie")
        .withColumn("part", F.spark_partition_id())
    )

    def inner(batches):
        """Rows whose follower is in the same partition."""
        last = own = None
        for pdf in batches:
            out = []
            for i, text in zip(pdf["doc_id"], pdf["text"]):
                if last is not None:
                    row, own = compared(*last, text, own)
                    out.append(row)
                last = (_id(i), text)
            if out:
                df = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
                yield df.assign(doc_id=df["doc_id"].astype("Int64"))

    def borders(batches):
        """First and last row of a partition."""
        first = last = None
        for pdf in batches:
            if first is None and len(pdf):
                first = pdf.iloc[:1].assign(kind="first")
            if len(pdf):
                last = pdf.iloc[-1:].assign(kind="last")
        if first is not None:
            both = pd.concat([first, last], ignore_index=True)
            yield both.assign(doc_id=[_id(x) for x in both["doc_id"]]).astype({"doc_id": "Int64"})

    def closing(batches):
        for pdf in batches:
            out = [compared(_id(i), a, b)[0] for i, a, b in zip(pdf["doc_id"], pdf["text"], pdf["next_text"])]
            df = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            yield df.assign(doc_id=df["doc_id"].astype("Int64"))

    edge = rows.mapInPandas(borders, "doc_id long, text string, part int, kind string")
    # which partition follows which: numbers only, one per partition
    used = edge.filter("kind = 'first'").select("part")
    ring = used.agg(F.sort_array(F.collect_list("part")).alias("parts")).select("parts", F.posexplode("parts").alias("k", "part")).select(
        "part", F.element_at("parts", ((F.col("k") + 1) % F.size("parts") + 1).cast("int")).alias("next_part"))
    head = edge.filter("kind = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    joined = edge.filter("kind = 'last'").join(ring, "part").join(head, "next_part").select("doc_id", "text", "next_text")
    return rows.mapInPandas(inner, SCHEMA).unionByName(joined.mapInPandas(closing, SCHEMA))
