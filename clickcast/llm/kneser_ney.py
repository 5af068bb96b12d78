"""Operator 4: quality classifier from an interpolated modified Kneser-Ney model.

A character model of order ``ORDER`` is estimated from trusted text with joins and aggregations over
its n-grams: counts, continuation counts, the three discounts of each order, and the mass each context
leaves to the next lower order. The corpus is cut into blocks; the distinct n-grams of a block are
joined with the model by n-gram, so a frequent one is one row per block, and go back to the block,
where each document's perplexity is summed up. A document is kept if its perplexity is at most a
quantile of held-out trusted documents of its language.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickcast.llm.common import give_back, landed, sieve, sifted, tidy, with_row_id

ORDER = 4
QUANTILE, SLACK = 0.98, 1.25  # of the perplexity of held-out trusted documents; factor on it
LEAST_DOCS = 20           # trusted documents a language needs for a quantile of its own
BLOCK_BITS = 12           # 4,096 neighbouring rows of a file are scored together
SLICE = 2_000_000         # characters whose n-grams are looked up together
BEGIN, END = "\x02", "\x03"
UNSEEN = 1 / 0x110000      # what the lowest order is interpolated with: any code point


def symbols(text: str | None) -> str:
    """A text as the model reads it: runs of ASCII blanks are one space; marks around it."""
    return BEGIN * (ORDER - 1) + " ".join((text or "").split()) + END


def grams(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct ORDER-grams of a batch, the gram at each place, and the document of each place."""
    marked = [symbols(t) for t in texts]
    n_chars = 0x110000
    cp = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in marked])
    doc = np.repeat(np.arange(len(texts)), sizes)
    there = np.bincount(cp, minlength=n_chars) > 0
    char = np.flatnonzero(there)
    code = (np.cumsum(there) - 1)[cp]
    bits = max(1, int(len(char) - 1).bit_length())
    n = len(cp) - ORDER + 1
    if n <= 0:
        return [], np.empty(0, int), np.empty(0, int)
    at = np.flatnonzero(doc[:n] == doc[ORDER - 1:])
    if bits * ORDER <= 63:
        key = np.zeros(n, np.int64)
        for k in range(ORDER):
            key = (key << bits) | code[k:n + k]
        gram, distinct = pd.factorize(key[at])
        spelled = np.stack([char[(distinct >> (bits * (ORDER - 1 - k))) & ((1 << bits) - 1)] for k in range(ORDER)], 1)
    else:  # more characters than fit: number the pairs, and pairs of them
        pair, pairs = pd.factorize((code[:-1].astype(np.int64) << 32) | code[1:])
        gram, distinct = pd.factorize((pair[at] << 32) | pair[at + 2])
        halves = pairs[distinct >> 32], pairs[distinct & 0xFFFFFFFF]
        spelled = np.stack([char[c] for half in halves for c in (half >> 32, half & 0xFFFFFFFF)], 1)
    line = spelled.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [line[i:i + ORDER] for i in range(0, len(line), ORDER)], gram, doc[at]


def in_slices(texts: list[str | None], chars: int):
    """Index ranges of about ``chars`` characters (or one text): the memory that a step takes."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= chars or i == len(texts) - 1:
            yield first, i + 1
            first, held = i + 1, 0


def counted_grams(texts: DataFrame) -> DataFrame:
    """(g, c): ORDER-grams of all texts with their counts, summed per batch before the shuffle."""

    def run(batches):
        for rb in batches:
            all_texts = rb.column("text").to_pylist()
            for a, b in in_slices(all_texts, 4_000_000):
                found, gram, _ = grams(all_texts[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(np.bincount(gram, minlength=len(found)))], ["g", "c"])

    return texts.select("text").mapInArrow(tidy(run), "g string, c long").groupBy("g").agg(F.sum("c").alias("c"))


def kneser_ney(top: DataFrame) -> DataFrame:
    """(g, c) of order ORDER -> (s, p, left): for every n-gram ``s`` of orders 1 to ORDER its interpolated
    probability ``p`` after its context, and what ``s`` as a context leaves to the lower order."""
    counts = {ORDER: landed(top, "kn-counts")}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: different characters before the n-gram
        counts[n] = landed(counts[n + 1].groupBy(F.substring("g", 2, n).alias("g")).agg(F.count("*").alias("c")), "kn-counts")
    lower, contexts = None, []
    for n in range(1, ORDER + 1):
        n1, n2, n3, n4 = (counts[n].agg(*(F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4))).first())
        d1, d2, d3 = discounts(n1 or 0, n2 or 0, n3 or 0, n4 or 0)
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        rows = counts[n].withColumn("h", F.substring("g", 1, n - 1)).withColumn("cut", F.least(cut, F.col("c").cast("double")))
        left = rows.groupBy("h").agg(F.sum("c").alias("total"), (F.sum("cut") / F.sum("c")).alias("left"))
        joined = rows.join(left, "h")
        if lower is None:
            below = F.lit(UNSEEN)
        else:
            joined = joined.withColumn("tail", F.substring("g", 2, n - 1)).join(lower.select(F.col("s").alias("tail"), F.col("p").alias("below")), "tail")
            below = F.col("below")
        lower = landed(joined.select(F.col("g").alias("s"), ((F.col("c") - F.col("cut")) / F.col("total") + F.col("left") * below).alias("p")), f"kn-{n}")
        contexts.append((lower, left.select(F.col("h").alias("s"), "left")))
    probability = contexts[0][0]
    for p, _ in contexts[1:]:
        probability = probability.union(p)
    context = contexts[0][1]
    for _, c in contexts[1:]:
        context = context.union(c)
    return landed(probability.join(context, "s", "full").select("s", "p", "left"), "kn-model")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The modified discounts of counts 1, 2 and 3 or more from the numbers of n-grams with counts 1 to 4;
    plain values where a number is 0."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.05), k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def log_probabilities(found: list[str], model: dict[str, tuple[float, float]]) -> np.ndarray:
    """log10 of the probability of each ORDER-gram's last character after the others."""
    none = (None, None)
    known: dict[str, float] = {}

    def p(s: str) -> float:
        if s in known:
            return known[s]
        own, _ = model.get(s, none)
        if own is None:
            left = model.get(s[:-1], none)[1]
            below = p(s[1:]) if len(s) > 1 else UNSEEN
            own = below * (1.0 if left is None else left)
        known[s] = own
        return own

    return np.log10(np.maximum([p(s) for s in found], 1e-300)) if found else np.empty(0)


def perplexities(rows: DataFrame, model: DataFrame) -> DataFrame:
    """``rows`` (row_id, doc_id, text) -> (row_id, doc_id, n_symbols, perplexity)."""
    block = F.shiftright("row_id", BLOCK_BITS)

    def needed(batches):
        for rb in batches:
            blocks = rb.column("block").to_numpy()
            for b in np.unique(blocks):
                at = np.flatnonzero(blocks == b)
                own, distinct = rb.column("text").take(pa.array(at)).to_pylist(), set()
                for i, j in in_slices(own, SLICE):
                    distinct.update(grams(own[i:j])[0])
                parts = {s[i:j] for s in distinct for i in range(ORDER) for j in range(i + 1, ORDER + 1)} | {""}
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), b)), pa.array(list(parts), pa.string())], ["block", "s"])

    def packed(batches):
        pack = zstandard.ZstdCompressor(3)
        for rb in batches:
            blocks = rb.column("block").to_numpy()
            for b in np.unique(blocks):
                own = rb.take(pa.array(np.flatnonzero(blocks == b)))
                body = pack.compress(pickle.dumps([own.column(c).to_pylist() for c in ("row_id", "doc_id", "text")]))
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([body], pa.binary())], ["block", "payload"])

    cut = rows.withColumn("block", block)
    keys = cut.select("block", "text").mapInArrow(tidy(needed), "block long, s string").join(model, "s")
    payload = cut.mapInArrow(tidy(packed), "block long, payload binary")

    def run(_, bodies: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        known = {s: (None if p != p else p, None if left != left else left) for s, p, left in zip(own["s"], own["p"], own["left"])}
        del own
        out = []
        for body in bodies["payload"]:
            row, ids, texts = pickle.loads(zstandard.ZstdDecompressor().decompress(body))
            for a, b in in_slices(texts, SLICE):
                found, gram, doc = grams(texts[a:b])
                n = np.bincount(doc, minlength=b - a)
                total = np.bincount(doc, log_probabilities(found, known)[gram], b - a)
                out.append(pd.DataFrame({"row_id": row[a:b], "doc_id": pd.array(ids[a:b], dtype="Int64"), "n_symbols": n, "perplexity": 10 ** (-total / np.maximum(n, 1))}))
        known = texts = found = gram = doc = None
        give_back()
        return pd.concat(out)

    return payload.groupBy("block").cogroup(keys.groupBy("block")).applyInPandas(run, "row_id long, doc_id long, n_symbols long, perplexity double")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, held_out) of the documents labelled good (quality 1); one in five is held out for the thresholds."""
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1")
    return good.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"))


def training_rows(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The trusted ``rows`` (row_id, doc_id, text, lang) that are not held out: all of them."""
    picked = landed(rows.select("row_id", "doc_id").join(ids.filter("not held_out"), "doc_id", "left_semi").select("row_id"), "kn-picked")
    return sifted(rows.select("row_id", "text"), sieve(picked, "row_id"), "row_id", True).join(picked, "row_id", "left_semi")


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` and ``labels`` -> (doc_id, lang, n_symbols, perplexity, threshold, kept), one row per
    document.

    A null or empty text is the end mark alone. Languages (null is one) with fewer than LEAST_DOCS
    held-out trusted documents take the quantile over all. Without trusted text nothing can be judged:
    the threshold is null and every document is kept. Repeated rows are judged alike; null ids stay
    null; other columns are not read. Thresholds cover all held-out trusted documents.
    """
    ids = landed(trusted_ids(labels), "kn-trusted")
    rows = with_row_id(docs.select("doc_id", "text", "lang"), "kn-rows")
    model = kneser_ney(counted_grams(training_rows(rows, ids)))
    scores = perplexities(rows.select("row_id", "doc_id", "text"), model)
    # languages come back by row id; the scores are small rows
    scored = landed(scores.join(rows.select("row_id", "lang"), "row_id"), "kn-scores")
    held = scored.join(ids.filter("held_out").select("doc_id"), "doc_id", "left_semi")
    at = F.percentile_approx("perplexity", QUANTILE, 10_000)
    overall = held.agg((at * SLACK).alias("t")).scalar()
    own = held.groupBy("lang").agg(F.count("*").alias("n"), (at * SLACK).alias("own")).filter(F.col("n") >= LEAST_DOCS)
    own = own.select(F.col("lang").alias("own_lang"), "own")
    judged = scored.join(own, F.col("lang").eqNullSafe(F.col("own_lang")), "left").withColumn("threshold", F.coalesce("own", overall))
    return judged.select("doc_id", "lang", "n_symbols", "perplexity", "threshold",
                         F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))
