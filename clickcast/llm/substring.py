"""Operator 6: substring dedup by De Bruijn compaction.

Token k-mers that are the least in some window ("anchors") become the nodes of a sparse De Bruijn
graph, and the words from one anchor to the next an edge. Equal windows have equal anchors at equal
places, so a window whose anchor occurs once in the corpus cannot repeat, and only repeated anchors
go on. A node where several different edges leave or enter branches; between branches (and the ends
of a document's repeated run) consecutive edges compact into one path. Paths found twice are
verified whole by the digests of the words between their anchors, one row per path and document.
Stretches of windows that lie inside no such path are likewise compared whole first; windows of
stretches that occur once are compared one by one, with each other and with those of one
representative of each path and stretch. So every repeated window is found, and a group of copies
costs a few rows per document, not one per window.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickcast.llm.common import coded_words, few_rows_at_once, free_name, landed, mixed, passes, sieve, sifted, tidy, with_row_id, words

WINDOW = 35               # words of a repeated window
KMER = 16                 # words of a node; WINDOW - KMER + 1 k-mers begin in a window
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
ROWS_AT_ONCE = 600         # documents that are hashed together


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def running_sums(h: np.ndarray) -> np.ndarray:
    """Sums of h[j] * BASE**-j before each word, modulo 2**64: the difference of two, times BASE**start,
    is a polynomial hash of the words between."""
    return np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(h * powers(BASE_INVERSE, len(h)))))


def least_positions(h: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the least value in each window of ``width`` values."""
    at, span = np.arange(len(h)), 1
    while span < width:
        step = min(span, width - span)
        a, b = at[:len(at) - step], at[step:]
        at = np.where(h[b] < h[a], b, a)
        span += step
    return at


class Anchors(NamedTuple):
    doc: np.ndarray      # which text of the batch
    index: np.ndarray    # of the anchor in its text
    place: np.ndarray    # first word, in its text
    h: np.ndarray        # hash of its k-mer
    first: np.ndarray    # first window whose anchor it is
    count: np.ndarray    # windows whose anchor it is
    edge: np.ndarray     # digest of the words from it through the next anchor; 0 at a text's last


def anchors_of(texts: pa.Array, window: int = WINDOW, k: int = KMER) -> Anchors:
    """The anchors of a batch of texts. All texts are hashed in one run of words; windows that cross
    from one text to the next are left out."""
    codes, sizes, distinct = coded_words(texts)
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))[codes]
    n = len(h) - window + 1
    if n <= 0:
        return Anchors(*(np.empty(0, t) for t in (int, int, int, np.uint64, int, int, np.uint64)))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    start = np.cumsum(sizes) - sizes
    sums = running_sums(h)
    km = mixed((sums[k:] - sums[:-k]) * powers(BASE, len(h) - k + 1))
    at = np.flatnonzero(owner[:n] == owner[window - 1:])  # windows inside one text
    if not len(at):
        return Anchors(*(np.empty(0, t) for t in (int, int, int, np.uint64, int, int, np.uint64)))
    q = least_positions(km, window - k + 1)[at]
    new = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (owner[at[1:]] != owner[at[:-1]])))
    count = np.diff(np.append(new, len(at)))
    q, lo = q[new], at[new]
    doc = owner[lo]
    last = np.append(doc[1:] != doc[:-1], True)
    stop = np.where(last, q, np.append(q[1:], 0)) + k
    edge = mixed((sums[stop] - sums[q]) * powers(BASE, len(h) + 1)[q] + (stop - q).astype(np.uint64))
    begins = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    index = np.arange(len(q)) - np.repeat(begins, np.diff(np.append(begins, len(q))))
    return Anchors(doc, index, q - start[doc], km[q], lo - start[doc], count, np.where(last, 0, edge).astype(np.uint64))


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """(h): anchors that occur at two or more places. Counts are summed per batch before the shuffle."""

    def count(batches):
        for rb in batches:
            for at in range(0, rb.num_rows, ROWS_AT_ONCE):
                h, n = np.unique(anchors_of(rb.column("text").slice(at, ROWS_AT_ONCE)).h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], ["h", "n"])

    return docs.select("text").mapInArrow(tidy(count), "h long, n byte").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")


def occurrences(docs: DataFrame, repeated: Broadcast) -> DataFrame:
    """The anchors that the sieve lets through, with their coordinates: row_id, h, place (index << 32 | first word), windows (first << 32
    | count), edge."""

    def run(batches):
        for rb in batches:
            ids = rb.column("row_id").to_numpy()
            for at in range(0, rb.num_rows, ROWS_AT_ONCE):
                x = anchors_of(rb.column("text").slice(at, ROWS_AT_ONCE))
                x = Anchors(*(v[passes(repeated.value, x.h.view(np.int64))] for v in x))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at:][x.doc]), pa.array(x.h.view(np.int64)), pa.array((x.index << 32) | x.place),
                     pa.array((x.first << 32) | x.count), pa.array(x.edge.view(np.int64))], ["row_id", "h", "place", "windows", "edge"])

    return docs.select("row_id", "text").mapInArrow(tidy(run), "row_id long, h long, place long, windows long, edge long")


def compact_paths(occ: DataFrame) -> DataFrame:
    """Repeated anchors -> (row_id, first window, last window, digest) of the compacted paths."""
    by_row = Window.partitionBy("row_id").orderBy("place")
    index = F.shiftright("place", 32)
    chained = occ.withColumn("to_h", F.when(F.shiftright(F.lead("place").over(by_row), 32) == index + 1, F.lead("h").over(by_row)))
    chained = landed(chained.select("row_id", "h", "place", "windows", "edge", "to_h"), "graph-edges")
    edges = chained.filter("to_h is not null").select("h", "to_h", "edge").distinct()
    leaving = edges.groupBy("h").count().filter("count > 1").select("h")
    entering = edges.groupBy("to_h").count().filter("count > 1").select(F.col("to_h").alias("h"))
    branches = leaving.union(entering).distinct().withColumn("branch", F.lit(True))
    flagged = chained.join(branches, "h", "left").select("row_id", "place", "edge", "to_h", F.coalesce("branch", F.lit(False)).alias("branch"))
    # one row per compacted path: edges of a row numbered by the cuts before them
    cut = F.col("branch") | F.lag("to_h").over(by_row).isNull()
    numbered = flagged.withColumn("cut", cut.cast("int")).withColumn("path", F.sum("cut").over(by_row)).filter("to_h is not null")
    item = F.struct("place", "edge")
    paths = numbered.groupBy("row_id", "path").agg(F.sort_array(F.collect_list(item)).alias("items"))
    start = F.col("items")[0]["place"]
    return paths.select(
        "row_id", (F.shiftright(start, 32)).cast("int").alias("first_anchor"), F.size("items").alias("n_edges"),
        F.sha2(F.concat_ws(",", F.transform("items", lambda x: x["edge"].cast("string"))), 256).alias("digest"))


def window_digests(line: bytes, at: list[int], first: int, stop: int, window: int = WINDOW) -> list[bytes]:
    """Digests of the windows that begin at the words ``first`` to ``stop`` - 1; ``at``: where in the
    line each word begins."""
    return [xxhash.xxh128_digest(line[a:b - 1]) for a, b in zip(at[first:stop], at[first + window:stop + window])]


def spelled_windows(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(row_id, start, stop, digest, windows, kind) of the documents that have repeated anchors. Kind 0:
    a verified path's span. Kind 1: a stretch of neighbouring windows in no verified path, the digest
    of its words, and those of its windows. Kind 2: the windows of a path that its representative shows."""

    def run(batches):
        for rb in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            out = []
            lists = {c: (rb.column(c).values.to_numpy(zero_copy_only=False), rb.column(c).offsets.to_numpy()) for c in ("place", "windows", "n_edges", "chosen")}
            for k, (row, text) in enumerate(zip(rb.column("row_id").to_pylist(), rb.column("text").to_pylist())):
                place, wins, edges, chosen = (v[o[k]:o[k + 1]] for v, o in lists.values())
                ws = words(text)
                line = b" ".join(ws)
                at = np.concatenate(([0], np.cumsum([len(w) + 1 for w in ws]))).tolist()
                node = edges == 0
                where = dict(zip((place[node] >> 32).tolist(), (place[node] & 0xFFFFFFFF).tolist()))
                delta = np.zeros(len(ws) + 1, np.int64)
                np.add.at(delta, wins[node] >> 32, 1)
                np.add.at(delta, (wins[node] >> 32) + (wins[node] & 0xFFFFFFFF), -1)
                open_ = np.cumsum(delta) > 0
                for i, n, shown in zip((place[~node] >> 32).tolist(), edges[~node].tolist(), chosen[~node].tolist()):
                    a, b = where[i], where[i + n] + KMER
                    if b - a >= WINDOW:
                        open_[a:b - WINDOW + 1] = False
                        out.append((row, a, b, None, window_digests(line, at, a, b - WINDOW + 1) if shown else None, 2 if shown else 0))
                turns = np.flatnonzero(np.diff(open_.astype(np.int8), prepend=0, append=0))
                for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()):
                    stop = b - 1 + WINDOW
                    out.append((row, a, stop, xxhash.xxh128_digest(line[at[a]:at[stop] - 1]), window_digests(line, at, a, b), 1))
            cols = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["row_id", "start", "stop", "digest", "windows", "kind"])

    return docs.select("row_id", "text").join(known, "row_id").mapInArrow(
        tidy(run), "row_id long, start int, stop int, digest binary, windows array<binary>, kind int")


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, Broadcast]:
    """``docs`` (row_id, text) -> (row_id, starts, stops): word spans that some repeated window covers,
    one row per document that has any; and a sieve of the row ids that can have some."""
    nodes = landed(repeated_anchors(docs), "graph-nodes")
    occ = landed(occurrences(docs, sieve(nodes, "h")).join(nodes, "h"), "graph-places")
    paths = landed(compact_paths(occ), "graph-paths")
    twice = paths.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("row_id", "first_anchor")).alias("least")).filter("n > 1")
    verified = paths.join(twice, "digest").select(
        "row_id", "first_anchor", "n_edges",
        ((F.col("least.row_id") == F.col("row_id")) & (F.col("least.first_anchor") == F.col("first_anchor"))).alias("chosen"))

    # what is known of each document: its repeated anchors, and the verified paths among them
    marks = occ.select("row_id", "place", "windows", F.lit(0).alias("n_edges"), F.lit(False).alias("chosen")).unionByName(
        verified.select("row_id", F.shiftleft(F.col("first_anchor").cast("long"), 32).alias("place"), F.lit(0).cast("long").alias("windows"), "n_edges", "chosen"))
    known = marks.groupBy("row_id").agg(F.collect_list(F.struct("place", "windows", "n_edges", "chosen")).alias("m")).select(
        "row_id", "m.place", "m.windows", "m.n_edges", "m.chosen")
    rows = sieve(occ.select("row_id").distinct(), "row_id")
    spelled = landed(spelled_windows(sifted(docs.select("row_id", "text"), rows, "row_id", True), known), "graph-windows")

    # stretches with equal words repeat as a whole; the others are compared window by window, with each
    # other, with one of each group of equal stretches, and with the shown paths
    stretches = spelled.filter("kind = 1")
    alike = stretches.groupBy("digest").agg(F.count("*").alias("n"), F.first("windows").alias("windows"))
    alike = landed(alike, "graph-stretches")
    whole = stretches.select("row_id", "start", "stop", "digest").join(alike.filter("n > 1").select("digest"), "digest", "left_semi")
    single = stretches.join(alike.filter("n = 1").select("digest"), "digest", "left_semi")
    windows = alike.select(F.explode("windows").alias("w"), F.least("n", F.lit(2)).alias("weight")).union(
        spelled.filter("kind = 2").select(F.explode("windows").alias("w"), F.lit(2).alias("weight")))
    again = windows.groupBy("w").agg(F.sum("weight").alias("n")).filter("n > 1").select("w")
    hits = single.select("row_id", "start", F.posexplode("windows").alias("k", "w")).join(again, "w", "left_semi").select(
        "row_id", (F.col("start") + F.col("k")).alias("start"), (F.col("start") + F.col("k") + WINDOW).alias("stop"))
    spans = hits.union(whole.select("row_id", "start", "stop")).union(spelled.filter("kind <> 1").select("row_id", "start", "stop"))
    return spans.groupBy("row_id").agg(F.collect_list(F.struct("start", "stop")).alias("s")).select(
        "row_id", F.col("s.start").alias("starts"), F.col("s.stop").alias("stops")), rows


def kept_words(ws: list[bytes], starts, stops) -> list[bytes]:
    """The words outside the spans [start, stop)."""
    delta = np.zeros(len(ws) + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, stops, -1)
    return list(itertools.compress(ws, (np.cumsum(delta[:-1]) == 0).tolist()))


def deduplicated(docs: DataFrame, n_words: str = "n_words__", n_removed: str = "n_removed__") -> DataFrame:
    """``docs`` -> all its columns, with the text without its repeated words (left words joined by one
    space if any word went, else as it was), and its words and removed words in the columns ``n_words`` and
    ``n_removed``, whose names the caller chooses so that ``docs`` has them not.

    Null, empty and short texts have no window and stay. Repeated rows count as further occurrences,
    so both lose their windows. Ids may be null or repeat; an empty table gives no rows."""
    few_rows_at_once(docs.sparkSession)
    row, first, last = (free_name(docs, c) for c in ("row_id", "starts", "stops"))
    ids = with_row_id(docs, "substring-rows", row)
    spans, rows = repeated_spans(ids.select(F.col(row).alias("row_id"), "text"))
    cut = spans.select(F.col("row_id").alias(row), F.col("starts").alias(first), F.col("stops").alias(last))
    joined = sifted(ids, rows, row, True).join(cut, row, "left").drop(row)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(n_words, T.LongType()), T.StructField(n_removed, T.LongType())])

    def strip(batches):
        yield from (out for rb in batches for at in range(0, rb.num_rows, ROWS_AT_ONCE) for out in stripped(rb.slice(at, ROWS_AT_ONCE)))

    def outside(batches):
        """Documents that the sieve holds back have no repeated window."""
        for rb in batches:
            for at in range(0, rb.num_rows, ROWS_AT_ONCE):
                part = rb.slice(at, ROWS_AT_ONCE)
                yield from stripped(part.filter(pa.array(~passes(rows.value, part.column(row).to_numpy()))))

    def stripped(rb):
        texts, n, gone = rb.column("text").to_pylist(), [], []
        starts, stops = (rb.column(c) if c in rb.schema.names else None for c in (first, last))
        for k, some in enumerate(starts.is_valid().to_pylist() if starts is not None else [False] * len(texts)):
            ws = words(texts[k])
            n.append(len(ws))
            gone.append(0)
            if some:
                left = kept_words(ws, starts[k].values.to_numpy(), stops[k].values.to_numpy())
                gone[-1] = len(ws) - len(left)
                texts[k] = b" ".join(left).decode("utf-8", "surrogatepass") if gone[-1] else texts[k]
        cols = [pa.array(texts, pa.string()) if c == "text" else rb.column(c) for c in names]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*names, n_words, n_removed])

    return joined.mapInArrow(tidy(strip), schema).unionByName(ids.mapInArrow(tidy(outside), schema))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each document of ``documents``."""
    out = deduplicated(docs.select("doc_id", "text"))
    blanks = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return out.select("doc_id", F.col("n_words__").alias("n_words"), F.col("n_removed__").alias("n_removed"),
                      F.sha2(F.btrim(blanks, F.lit(" ")), 256).alias("kept_sha256"))
