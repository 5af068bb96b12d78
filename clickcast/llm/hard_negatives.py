"""Operator 13: hard negatives by Strassen multiplication of anchor and candidate tiles.

1. Vectors become integer vectors, written once with a row id; rows that take no part are left out.
2. Candidates and anchors are dealt into blocks of ``BLOCK`` rows by a hash of their row ids, and every
   anchor block meets every candidate block in a task of its own: a stated query set against all rows.
   A block is shipped once per block of the other side, against ``BLOCK`` products of vectors per row
   shipped, so the arithmetic, not the shuffle, is the cost at any size.
3. In a task, tiles are multiplied by Strassen's recursion on int64, zero-padded to even sides. Sums and
   products are exact modulo 2**64, so scores are exact as long as they fit a long themselves; that is
   checked before the first tile.
4. The first pass multiplies rows of equal labels only and leaves a bounded heap of the best positives
   per anchor. The second leaves, for each of those positives, a bounded heap of the best rows of other
   labels in the window its score allows. Heaps of the same key from different blocks merge to one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickcast.llm.common import landed, tidy

BLOCK = 8192             # rows of a block, on either side
TILE_ROWS = 256          # anchors multiplied at once with a block of candidates
LEAF = 32                # a side at which the recursion multiplies directly
SCALE = 256
NOTHING = np.iinfo(np.int64).min

MINED = "anchor_row long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
HEAP = "anchor_row long, slot int, score long, vec_id long"


# ---------------------------------------------------------------- multiplication

def padded(x: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """``x`` with zeros below and to the right."""
    if x.shape == (rows, cols):
        return x
    out = np.zeros((rows, cols), x.dtype)
    out[:x.shape[0], :x.shape[1]] = x
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The matrix product of two int64 tiles by Strassen's seven products, recursively until a side is
    ``leaf`` or less. Odd sides are padded with zeros, which add nothing. Integer sums wrap at 2**64, so
    the result is exact wherever the product itself fits 64 bits."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    hm, hk, hn = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
    a, b = padded(a, 2 * hm, 2 * hk), padded(b, 2 * hk, 2 * hn)
    a11, a12, a21, a22 = a[:hm, :hk], a[:hm, hk:], a[hm:, :hk], a[hm:, hk:]
    b11, b12, b21, b22 = b[:hk, :hn], b[:hk, hn:], b[hk:, :hn], b[hk:, hn:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * hm, 2 * hn), np.int64)
    out[:hm, :hn] = p1 + p4 - p5 + p7
    out[:hm, hn:] = p3 + p5
    out[hm:, :hn] = p2 + p4
    out[hm:, hn:] = p1 - p2 + p3 + p6
    return out[:m, :n]


# ---------------------------------------------------------------- the integer table

def integer_vectors(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, dims, reach, v) of the rows that take part: ``v`` holds floor(256 * x) of every
    component as little-endian int64, ``reach`` the greatest magnitude. A component whose 256-fold
    leaves the long range fails the job."""

    def run(batches):
        for rb in batches:
            flat = rb.column("x").flatten()  # skips rows that are null
            whole = rb.column("x")
            sizes = np.diff(whole.offsets.to_numpy())
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            bad = np.bincount(owner, weights=~np.isfinite(values), minlength=len(sizes)) > 0
            keep = ~bad
            values = np.floor(SCALE * values[keep[owner]])
            if len(values) and np.abs(values).max() >= 2.0 ** 62:
                raise ValueError("an embedding component is too large for integer scores")
            q, ends = values.astype("<i8"), np.cumsum(sizes[keep])
            starts = ends - sizes[keep]
            v = [q[a:b].tobytes() for a, b in zip(starts, ends)]
            reach = [int(np.abs(q[a:b]).max()) if b > a else 0 for a, b in zip(starts, ends)]
            rows = rb.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [rows.column("vec_id"), rows.column("label"), pa.array(sizes[keep].astype(np.int32)), pa.array(reach, pa.int64()), pa.array(v, pa.binary())],
                ["vec_id", "label", "dims", "reach", "v"])

    rows = embeddings.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("x"),
    ).filter("label is not null and x is not null and not exists(x, c -> c is null)")
    return rows.mapInArrow(tidy(run), "vec_id long, label long, dims int, reach long, v binary")


def matrix(v: pd.Series, dims: int) -> np.ndarray:
    """The vectors as rows, shorter ones padded with zeros."""
    out = np.zeros((len(v), dims), np.int64)
    for i, raw in enumerate(v):
        q = np.frombuffer(raw, "<i8")
        out[i, :len(q)] = q
    return out


# ---------------------------------------------------------------- heaps

def by_id(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows in the order that settles ties: smaller ``vec_id`` first, null last, then the row id."""
    return rows.sort_values(["vec_id", "row_id"], na_position="last", ignore_index=True)


def best_first(scores: np.ndarray) -> np.ndarray:
    """Column numbers by score descending, ties by column."""
    return np.argsort(~scores, axis=1, kind="stable")  # ~ reverses the order and cannot overflow


def positive_heaps(anchors: pd.DataFrame, cands: pd.DataFrame, keep: int) -> Iterator[pd.DataFrame]:
    """The ``keep`` best candidates of each anchor's label in this block, the anchor's own row left out."""
    cands = by_id(cands)
    dims = int(max(anchors["dims"].max(), cands["dims"].max()))
    own = {k: g for k, g in cands.groupby("label")}
    for label, group in anchors.groupby("label"):
        fits = own.get(label)
        if fits is None:
            continue
        right, ids, rows = np.ascontiguousarray(matrix(fits["v"], dims).T), fits["vec_id"].to_numpy(), fits["row_id"].to_numpy()
        for at in range(0, len(group), TILE_ROWS):
            tile = group.iloc[at:at + TILE_ROWS]
            scores = strassen(matrix(tile["v"], dims), right)
            scores[tile["row_id"].to_numpy()[:, None] == rows[None, :]] = NOTHING
            order = best_first(scores)[:, :keep]
            found = np.take_along_axis(scores, order, 1)
            there = found != NOTHING
            yield pd.DataFrame({
                "anchor_row": np.broadcast_to(tile["row_id"].to_numpy()[:, None], found.shape)[there], "slot": np.int32(0),
                "score": found[there], "vec_id": ids[order][there]})


def window_heaps(anchors: pd.DataFrame, cands: pd.DataFrame, keep: int, low: int, high: int) -> Iterator[pd.DataFrame]:
    """For each positive of each anchor the ``keep`` best candidates of other labels whose score ``s``
    satisfies low * positive <= 100 * s <= high * positive."""
    cands = by_id(cands)
    dims = int(max(anchors["dims"].max(), cands["dims"].max()))
    right, ids, labels = np.ascontiguousarray(matrix(cands["v"], dims).T), cands["vec_id"].to_numpy(), cands["label"].to_numpy()
    for at in range(0, len(anchors), TILE_ROWS):
        tile = anchors.iloc[at:at + TILE_ROWS]
        scores = strassen(matrix(tile["v"], dims), right)
        scores[tile["label"].to_numpy()[:, None] == labels[None, :]] = NOTHING
        order = best_first(scores)
        scores = np.take_along_axis(scores, order, 1)
        out = []
        for i, (row, positives) in enumerate(zip(tile["row_id"], tile["positives"])):
            falling = ~scores[i]  # ascending
            for slot, p in enumerate(positives):
                p = int(p)
                floor, ceiling = -(-low * p // 100), high * p // 100  # exact: Python's integers
                if floor > ceiling:
                    continue
                a = int(np.searchsorted(falling, ~ceiling, "left"))
                b = min(a + keep, int(np.searchsorted(falling, ~floor, "right")))
                out.append((row, slot, scores[i, a:b], ids[order[i, a:b]]))
        if out:
            sizes = [len(s) for _, _, s, _ in out]
            yield pd.DataFrame({
                "anchor_row": np.repeat([r for r, *_ in out], sizes), "slot": np.repeat([s for _, s, *_ in out], sizes).astype(np.int32),
                "score": np.concatenate([s for _, _, s, _ in out]), "vec_id": np.concatenate([v for *_, v in out])})


def merged_heaps(heaps: DataFrame, keep: int) -> DataFrame:
    """One heap per (anchor_row, slot) with places from 1. Each task first cuts what it holds of a key
    to ``keep`` rows (Spark's group limit), so a merge reads at most ``keep`` rows a task and key."""
    best = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return heaps.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= keep)


def over_blocks(anchors: DataFrame, cands: DataFrame, n_anchor: int, n_cand: int, heaps) -> DataFrame:
    """``heaps(anchors, candidates)`` of every pair of an anchor block and a candidate block."""

    def run(key, a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        made = list(heaps(a, c)) if len(a) and len(c) else []
        out = pd.concat(made) if made else pd.DataFrame({"anchor_row": [], "slot": [], "score": [], "vec_id": []})
        return out.assign(vec_id=out["vec_id"].astype("Int64"))

    def dealt(rows, own, other, n_own, n_other):
        return rows.withColumn(own, F.pmod(F.xxhash64("row_id"), F.lit(n_own)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    anchors = anchors.toDF(*anchors.columns)  # columns of their own: both sides come from one table
    a = dealt(anchors, "a", "c", n_anchor, n_cand).groupBy("a", "c")
    c = dealt(cands, "c", "a", n_cand, n_anchor).groupBy("a", "c")
    return a.cogroup(c).applyInPandas(run, HEAP)


# ---------------------------------------------------------------- the operator

def mine(embeddings: DataFrame, anchors: str = "vec_id % 100 = 0", relabel: str = "label", positives: int = 5, negatives: int = 10,
         low: int = 30, high: int = 90, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_row, anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on (vec_id, label), ``relabel`` an expression for the label to use. An
    anchor's positives are its ``positives`` best other rows of the same label; for each, the
    ``negatives`` best rows of other labels with low % to high % of the positive's score are ranked.
    Scores are integer inner products of floor(256 * component); the higher wins, then the smaller id.

    Rows with a null label, a null vector or a null or non-finite component take no part. A row without
    an id does, as a candidate; it comes last among equal scores. Vectors of unequal lengths count as
    padded with zeros, so an empty vector scores 0. Repeated rows are rows of their own: each is an
    anchor if one is, and a copy of an anchor is a positive of it. Only the three named columns are
    read, whatever else there is. An empty table, or one without anchors, gives no rows. Scores that
    could leave the long range raise a ValueError.
    """
    rows = integer_vectors(embeddings, id_col, vector_col, label_col).withColumn("label", F.expr(relabel).cast("long"))
    rows = landed(rows.withColumn("row_id", F.monotonically_increasing_id()), "negatives-vectors")
    size = rows.agg(F.count("*"), F.count(F.when(F.expr(anchors), 1)), F.max("reach"), F.max("dims")).first()
    if size[0] and size[3] * size[2] ** 2 * 100 >= 2 ** 63:
        raise ValueError(f"integer scores could leave the long range: {size[3]} components of up to {size[2]}")
    n_cand, n_anchor = -(-size[0] // BLOCK) or 1, -(-size[1] // BLOCK) or 1
    rows = rows.drop("reach")
    chosen = rows.filter(F.expr(anchors))

    first = over_blocks(chosen, rows, n_anchor, n_cand, lambda a, c: positive_heaps(a, c, positives))
    found = landed(merged_heaps(first, positives), "negatives-positives")
    slots = found.groupBy(F.col("anchor_row").alias("row_id")).agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("s"))
    windows = chosen.join(slots, "row_id").withColumn("positives", F.transform("s", lambda x: x["score"])).drop("s")

    second = over_blocks(windows, rows, n_anchor, n_cand, lambda a, c: window_heaps(a, c, negatives, low, high))
    ranked = merged_heaps(second, negatives).select(
        "anchor_row", F.col("slot") + 1, F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    ).toDF("anchor_row", "place", "rank", "negative_id", "negative_score")
    named = found.select("anchor_row", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = chosen.select(F.col("row_id").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    return ranked.join(named, ["anchor_row", "place"]).join(ids, "anchor_row").select(
        "anchor_row", "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
