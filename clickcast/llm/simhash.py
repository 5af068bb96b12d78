"""Operator 2: SimHash near-duplicates, compared in bit-sliced blocks.

1. Each document gets a SimHash of its word shingles; equal signatures collapse into one class, so a
   group of exact copies is one row from here on.
2. Classes meet in tables keyed by some of the signature's bits. For a 64-bit signature and a small
   radius the tables are exact: the bits are cut into blocks, and two signatures within the radius
   agree on at least ``blocks - radius`` of them. For wide signatures the keys are bit samples.
3. Buckets above ``TILE`` rows are cut into tiles by hash, and pairs of tiles are compared, so no
   bucket is gathered in one task. In a task, 64 signatures stand side by side as vertical bit
   planes; a signature's distances to all 64 grow in carry-save bitwise counters, and a block is
   abandoned once every lane exceeds the radius.
4. A task gives back only a spanning forest of the links it saw, never all pairs; components of those
   edges come from alternating large-star and small-star rounds in Spark.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickcast.llm.common import few_rows_at_once, free_name, landed, sieve, sifted, tidy, with_row_id, words

SEED = 42
TILE = 8192                # rows of a bucket that one task compares with as many others
GROUP_ROWS = 1024          # texts of a group of near copies that one task compares with as many others,
GROUP_CHARS = 1 << 23      # and their characters
SHINGLES_AT_ONCE = 1 << 16
PAIRS_AT_ONCE = 1 << 15
BROADCAST_ROWS = 200_000   # oversized buckets: at most (rows / TILE) of them, 16 bytes each
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---------------------------------------------------------------- signatures

def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each ``width``-word shingle, repeats included (fewer words: of the whole sequence)."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    line = b" ".join(w).lower()  # bytes.lower touches A-Z alone
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()
    n = max(1, len(w) - width + 1)
    last = ends[width - 1:] or ends[-1:]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(line[a:b], SEED) for a, b in zip(starts[:n], last)), np.uint64, n)


def widened(h: np.ndarray, n_words: int) -> np.ndarray:
    """``n_words`` 64-bit hashes from each hash; the first is the hash itself."""
    out = np.empty((len(h), n_words), np.uint64)
    out[:, 0] = h
    for k in range(1, n_words):  # splitmix64 of (hash + k * golden ratio)
        z = h + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = z ^ (z >> np.uint64(31))
    return out


def signatures(texts, width: int, n_words: int, distinct: bool) -> np.ndarray:
    """One row of ``n_words`` 64-bit words per text: a bit is 1 if over half the hashes have it.
    No words: all zero. ``distinct`` counts each shingle once."""
    out = np.zeros((len(texts), n_words), np.uint64)
    rows, hashes, held = [], [], 0

    def flush():
        bits = np.unpackbits(widened(np.concatenate(hashes), n_words).view(np.uint8), axis=1, bitorder="little")
        sizes = np.array([len(x) for x in hashes])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        got = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64)
        out[rows] = got

    for i, text in enumerate(texts):
        h = shingle_hashes(text, width)
        if distinct:
            h = np.unique(h)
        if not len(h):
            continue
        if len(h) > SHINGLES_AT_ONCE:  # a very long text: add its counts up in parts
            ones = sum(np.unpackbits(widened(h[k:k + SHINGLES_AT_ONCE], n_words).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                       for k in range(0, len(h), SHINGLES_AT_ONCE))
            out[i] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)
            continue
        rows.append(i)
        hashes.append(h)
        held += len(h)
        if held * n_words >= SHINGLES_AT_ONCE * 2:
            flush()
            rows, hashes, held = [], [], 0
    if rows:
        flush()
    return out


# ---------------------------------------------------------------- tables

def block_masks(radius: int, blocks: int) -> np.ndarray:
    """Exact tables for 64 bits: each keeps ``blocks - radius`` of the blocks."""
    cuts = np.linspace(0, 64, blocks + 1).astype(int)
    part = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(cuts, cuts[1:])]
    return np.array([[sum(c)] for c in itertools.combinations(part, blocks - radius)], np.uint64)


def sample_masks(n_words: int, key_bits: int, tables: int, seed: int = 7) -> np.ndarray:
    """Masks of ``key_bits`` bits each, drawn with a fixed seed."""
    rng = np.random.default_rng(seed)
    out = np.zeros((tables, n_words), np.uint64)
    for t in range(tables):
        for b in rng.choice(64 * n_words, key_bits, replace=False):
            out[t, b // 64] |= np.uint64(1) << np.uint64(b % 64)
    return out


def bucket_keys(sig: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """(tables, rows) keys: a mix of the table's number and the kept bits."""
    out = np.empty((len(masks), len(sig)), np.uint64)
    for t, mask in enumerate(masks):
        z = np.full(len(sig), (t + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for k, m in enumerate(mask):
            z = (z ^ (sig[:, k] & m)) * np.uint64(0xBF58476D1CE4E5B9)
            z ^= z >> np.uint64(29)
        out[t] = z
    return out


# ---------------------------------------------------------------- bit-sliced comparison

def planes_of(sig: np.ndarray) -> np.ndarray:
    """(blocks, bits): word ``b`` of a block holds bit ``b`` of its 64 signatures, one per lane."""
    n = len(sig)
    blocks = -(-n // 64)
    bits = np.zeros((blocks * 64, sig.shape[1] * 64), np.uint8)
    bits[:n] = np.unpackbits(np.ascontiguousarray(sig).view(np.uint8), axis=1, bitorder="little")
    lanes = bits.reshape(blocks, 64, -1).transpose(0, 2, 1)
    return np.ascontiguousarray(np.packbits(lanes, axis=2, bitorder="little")).view(np.uint64)[:, :, 0]


def _add3(a, b, c):
    """Carry-save adder: three planes of weight 1 into one of weight 1 and one of weight 2."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def within(planes, sig, query, block, lanes, radius: int):
    """For each (query row, block): the lanes within ``radius``. Sixteen bits are added at a time;
    pairs without a lane left are dropped."""
    n_bits = planes.shape[1]
    high = max(1, (n_bits // 16).bit_length())
    left = np.arange(len(query))
    alive = lanes.copy()
    acc = [np.zeros(len(query), np.uint64) for _ in range(4 + high)]
    limit = [(radius >> k) & 1 for k in range(4 + high)]
    for start in range(0, n_bits, 16):
        diff = []
        for b in range(start, start + 16):
            q = (sig[query[left], b // 64] >> np.uint64(b % 64)) & np.uint64(1)
            diff.append(planes[block[left], b] ^ (np.uint64(0) - q))
        ones, twos, fours, eights = acc[:4]
        carry8 = []
        for half in (diff[:8], diff[8:]):
            carry4 = []
            for quarter in (half[:4], half[4:]):
                ones, t0 = _add3(ones, quarter[0], quarter[1])
                ones, t1 = _add3(ones, quarter[2], quarter[3])
                twos, f = _add3(twos, t0, t1)
                carry4.append(f)
            fours, e = _add3(fours, *carry4)
            carry8.append(e)
        eights, carry = _add3(eights, *carry8)
        acc[:4] = ones, twos, fours, eights
        for k in range(4, 4 + high):
            acc[k], carry = acc[k] ^ carry, acc[k] & carry
        over, same = np.uint64(0), FULL  # lanes whose count exceeds the radius
        for k in range(3 + high, -1, -1):
            over, same = (over, same & acc[k]) if limit[k] else (over | (same & acc[k]), same & ~acc[k])
        alive = alive & ~over
        on = alive != 0
        if not on.all():
            left, alive, acc = left[on], alive[on], [a[on] for a in acc]
        if not len(left):
            break
    return left, alive


def forest(sig: np.ndarray, start: np.ndarray, side: np.ndarray, cross: np.ndarray, radius: int,
           doubtful: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Root row of each row, for the links among the rows of a bucket (rows sorted by bucket;
    ``start``: first row of a row's bucket; ``cross``: link only rows of different ``side``). Pairs
    beyond ``radius`` but within ``doubtful`` bits link nothing; of those between two roots the closest
    comes back, as rows (a, b)."""
    n = len(sig)
    unsure = np.empty((0, 3), np.int64)
    root = np.arange(n)
    row = np.arange(n)
    n_blocks = row // 64 - start // 64 + 1
    n_blocks[row == start] = 0
    planes = planes_of(sig)
    side_bits = np.packbits(np.pad(side.astype(np.uint8), (0, -n % 64)).reshape(-1, 64), axis=1, bitorder="little").view(np.uint64)[:, 0]
    upto = np.cumsum(n_blocks)
    first = 0
    while first < n:
        done = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, done + PAIRS_AT_ONCE)))
        q = np.repeat(row[first:last], n_blocks[first:last])
        if len(q):
            block = q // 64 - (np.repeat(upto[first:last], n_blocks[first:last]) - 1 - np.arange(done, upto[last - 1]))
            lo = np.clip(start[q] - 64 * block, 0, 64)
            hi = np.clip(q - 64 * block, 0, 64)
            ones = lambda k: np.where(k >= 64, FULL, (np.uint64(1) << np.minimum(k, 63).astype(np.uint64)) - np.uint64(1))
            lanes = ones(hi) & ~ones(lo)
            other = np.where(side[q], ~side_bits[block], side_bits[block])
            lanes &= np.where(cross[q], other, FULL)
            on = lanes != 0
            got, alive = within(planes, sig, q[on], block[on], lanes[on], radius if doubtful is None else doubtful)
            if len(got):
                bits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                k, lane = np.nonzero(bits)
                i, j = q[on][got[k]], block[on][got[k]] * 64 + lane
                if doubtful is not None:
                    far = np.bitwise_count(sig[i] ^ sig[j]).sum(1, dtype=np.int64)
                    unsure = closest(np.concatenate([unsure, np.stack([i, j, far], 1)[far > radius]]), root)
                    i, j = i[far <= radius], j[far <= radius]
                a, b = root[i], root[j]
                new = a != b
                if new.any():
                    pairs = np.unique(np.stack([np.minimum(a[new], b[new]), np.maximum(a[new], b[new])], 1), axis=0)
                    parent: dict[int, int] = {}

                    def find(x):
                        while (p := parent.get(x, x)) != x:
                            parent[x] = parent.get(p, p)
                            x = p
                        return x

                    for x, y in pairs.tolist():
                        x, y = find(x), find(y)
                        if x != y:
                            parent[max(x, y)] = min(x, y)
                    moved = np.array(sorted(parent))
                    to = np.array([find(x) for x in moved.tolist()])
                    place = np.minimum(np.searchsorted(moved, root), len(moved) - 1)
                    root = np.where(moved[place] == root, to[place], root)
        first = last
    return root, closest(unsure, root)[:, :2]


def closest(pairs: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Of pairs (a, b, distance) of different roots the closest for each two roots."""
    a, b = root[pairs[:, 0]], root[pairs[:, 1]]
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((pairs[:, 2], hi, lo))
    order = order[(a != b)[order]]
    lo, hi = lo[order], hi[order]
    new = np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) if len(order) else np.empty(0, bool)
    return pairs[order[new]]


def _links(batches, radius: int, n_words: int):
    """Sorted rows (key, a, b, node, side, sig) -> edges (node, node) of a spanning forest."""
    held = []

    def edges(pdf):
        key = pdf[["key", "a", "b"]].to_numpy()
        new = np.ones(len(pdf), bool)
        new[1:] = (key[1:] != key[:-1]).any(1)
        start = np.maximum.accumulate(np.where(new, np.arange(len(pdf)), 0))
        size = np.bincount(np.cumsum(new) - 1)
        keep = np.repeat(size > 1, size)
        if not keep.any():
            return None
        pdf = pdf[keep]
        new = new[keep]
        start = np.maximum.accumulate(np.where(new, np.arange(len(pdf)), 0))
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint64).reshape(-1, n_words)
        node = pdf["node"].to_numpy()
        root, _ = forest(sig, start, pdf["side"].to_numpy(), (pdf["a"] != pdf["b"]).to_numpy(), radius)
        linked = np.flatnonzero(root != np.arange(len(root)))
        x, y = node[linked], node[root[linked]]
        both = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], 1), axis=0)
        return pd.DataFrame({"u": both[:, 0], "v": both[:, 1]})

    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        if sum(map(len, held)) < 8 * TILE:
            continue
        pdf = pd.concat(held, ignore_index=True)
        tail = pdf[["key", "a", "b"]].to_numpy()
        cut = len(pdf) - int((tail == tail[-1]).all(1)[::-1].argmin()) if not (tail == tail[-1]).all() else 0
        if cut and (out := edges(pdf[:cut])) is not None:
            yield out
        held = [pdf[cut:]]
    if held and (out := edges(pd.concat(held, ignore_index=True))) is not None:
        yield out


# ---------------------------------------------------------------- components

def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) -> (node, root): the smallest node reachable, for every node on an edge.

    Alternating large-star and small-star rounds; each is an aggregation and a join, so a node with
    many neighbours is never gathered. The edges are written to the shared folder each round."""
    edges = landed(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = landed(large.filter("u <> v").distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = landed(small.filter("u <> v").distinct(), "small-star")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


# ---------------------------------------------------------------- operator

def similar(sig: np.ndarray, sets: list[np.ndarray], side: np.ndarray, cross: bool, radius: int, similarity: float) -> list[tuple[int, int]]:
    """Rows (i, j) of a spanning forest of the links among the rows of a tile: pairs within ``radius`` bits
    (``cross``: of different ``side``) whose sets have a Jaccard similarity of ``similarity`` or more.
    Every such pair is compared, unless links found before join its rows already."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    distinct, code = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.zeros(len(distinct), bool)
    root = np.arange(len(sig))
    links = []

    def test(i, j):
        """Links row ``i`` to the rows ``j`` that are similar."""
        n = sizes[j]
        first = np.cumsum(n) - n
        common = np.add.reduceat(own[code[np.repeat(starts[j] - first, n) + np.arange(n.sum())]], first, dtype=np.int64)
        for k in j[common >= similarity * (n + sizes[i] - common)].tolist():
            if root[k] != root[i]:
                links.append((i, k))
                root[root == root[k]] = root[i]

    for i in range(1, len(sig)):
        far = np.bitwise_count(sig[:i] ^ sig[i]).sum(1, dtype=np.int64)
        j = np.flatnonzero((far <= radius) & (np.minimum(sizes[:i], sizes[i]) >= similarity * np.maximum(sizes[:i], sizes[i])) & (sizes[:i] > 0))
        if cross:
            j = j[side[j] != side[i]]
        if not len(j):
            continue
        mine = code[starts[i]:starts[i] + sizes[i]]
        own[mine] = True
        j = j[np.argsort(far[j], kind="stable")]
        closest_of_trees = np.unique(root[j], return_index=True)[1]  # mostly decides about the others
        test(i, j[closest_of_trees])
        j = np.delete(j, closest_of_trees)
        j = j[root[j] != root[i]]
        if len(j):
            test(i, j)
        own[mine] = False
    return links


def _similar(batches, width: int, radius: int, similarity: float):
    """Sorted rows (group, a, b, node, side, sig, text) -> edges (node, node) of a spanning forest."""
    rows = (row for rb in batches for row in zip(*(rb.column(c).to_pylist() for c in ("group", "a", "b", "node", "side", "sig", "text"))))
    edges = []
    for (_, a, b), tile in itertools.groupby(rows, lambda row: row[:3]):
        own = [(node, side, sig, np.unique(shingle_hashes(text, width))) for *_, node, side, sig, text in tile]
        if len(own) > 1:
            node, side, sig, sets = zip(*own)
            sig = np.frombuffer(b"".join(sig), np.uint64).reshape(len(own), -1)
            edges += [(node[i], node[j]) for i, j in similar(sig, sets, np.array(side), a != b, radius, similarity)]
        if len(edges) >= TILE:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges)], ["u", "v"])
            edges = []
    if edges:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges)], ["u", "v"])


def tiled(rows: DataFrame, key: str, crowded: DataFrame, own) -> DataFrame:
    """``rows`` with the tiles (a, b) that each meets others in, and its ``side`` there; ``crowded`` (key,
    tiles) are the keys with more than one tile, ``own`` a hash that deals rows out to them."""
    n_crowded = crowded.count()
    side = crowded if n_crowded > BROADCAST_ROWS else F.broadcast(crowded)
    dealt = rows.join(side, key, "left") if n_crowded else rows.withColumn("tiles", F.lit(None).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(own, F.coalesce("tiles", F.lit(1))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)))
    dealt = dealt.select(key, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
                         (F.col("own") > F.col("other")).alias("side"), *(c for c in rows.columns if c != key))
    return dealt.repartition(key, "a", "b").sortWithinPartitions(key, "a", "b")


def similar_links(docs: DataFrame, classes: DataFrame, groups: DataFrame, width: int, radius: int, similarity: float) -> DataFrame:
    """Edges (u, v) that join the classes of each group (node, root) whose texts' sets of ``width``-word
    shingles have a Jaccard similarity of ``similarity`` or more, among pairs within ``radius`` bits. A
    group's texts meet in tiles. A bitmap keeps the texts of other classes out of the shuffle."""
    wanted = landed(classes.join(groups, "node").select("node", F.col("root").alias("group"), "sig", F.col("least_row").alias("__row")), "near-dup-groups")
    texts = sifted(docs.select("__row", "text"), sieve(wanted, "__row"), "__row", True).join(wanted, "__row")
    texts = landed(texts.select("group", "node", "sig", "text"), "near-dup-texts")
    tiles = F.greatest(F.ceil(F.count("*") / GROUP_ROWS), F.ceil(F.sum(F.length("text")) / GROUP_CHARS)).cast("int")
    crowded = landed(texts.groupBy("group").agg(tiles.alias("tiles")).filter("tiles > 1"), "near-dup-crowded")
    placed = tiled(texts, "group", crowded, F.xxhash64("node"))
    return placed.mapInArrow(tidy(lambda it: _similar(it, width, radius, similarity)), "u long, v long")


def clusters(docs: DataFrame, width: int, n_words: int, radius: int, masks: np.ndarray, distinct: bool,
             similarity: float | None = None) -> DataFrame:
    """``docs`` (doc_id, text, others) -> (doc_id, others, sig, root, component_id): the class that stands
    for the row's component, and the component's smallest doc_id. With ``similarity``, links by bits only
    say which classes are compared; those link whose shingle sets have it (``docs`` then has ``__row``)."""
    few_rows_at_once(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema) + ", sig binary"

    def sign(batches):
        for pdf in batches:
            sig = signatures(list(pdf["text"]), width, n_words, distinct)
            yield pdf[rest].astype({"doc_id": "Int64"}).assign(sig=[r.tobytes() for r in sig])

    def tables(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                p = pdf[at:at + 2048]
                sig = np.frombuffer(b"".join(p["sig"]), np.uint64).reshape(-1, n_words)
                keys = bucket_keys(sig, masks).view(np.int64)
                yield pd.DataFrame({"key": keys.ravel(), "node": np.tile(p["node"].to_numpy(), len(masks)), "sig": np.tile(p["sig"].to_numpy(), len(masks))})

    signed = landed(docs.mapInPandas(tidy(sign), schema), "simhash")
    more = [F.min("__row").alias("least_row")] if "__row" in rest else []
    classes = signed.groupBy("sig").agg(F.min("doc_id").alias("least_id"), *more)
    classes = landed(classes.withColumn("node", F.monotonically_increasing_id()), "simhash-classes")
    keyed = classes.select("node", "sig").mapInPandas(tidy(tables), "key long, node long, sig binary")
    crowded = landed(keyed.groupBy("key").count().filter(F.col("count") > TILE)
                     .select("key", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")), "simhash-crowded")
    placed = tiled(keyed, "key", crowded, F.xxhash64("sig"))
    edges = placed.mapInPandas(tidy(lambda it: _links(it, radius, n_words)), "u long, v long")
    if similarity is not None:
        edges = similar_links(docs, classes, landed(components(edges), "near-dup-trees"), width, radius, similarity)
    roots = components(edges)
    rooted = classes.join(roots, "node", "left").select("sig", "least_id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return signed.join(rooted.join(least, "root").select("sig", "root", "component_id"), "sig")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, blocks: int = 6) -> DataFrame:
    """``documents`` -> (doc_id, fingerprint, component_id), one row per input row: 64-bit SimHash over
    all shingles with repeats, linked at ``radius`` or fewer differing bits, exactly.

    A null or blank text has fingerprint zero and is linked like any other. Equal rows stay rows of
    their own, in one component. ``component_id`` is the smallest non-null doc_id of the component,
    null if it has none. Other columns are not read. An empty table gives no rows.
    """
    found = clusters(docs.select("doc_id", "text"), width, 1, radius, block_masks(radius, blocks), distinct=False)
    return found.select("doc_id", F.lower(F.hex(_big_endian("sig"))).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, width: int = 4, radius: int = 4, blocks: int = 6) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps: of each component the one with the smallest
    doc_id (nulls last; of equal ids, one row). All columns come back, whatever their names.

    Texts without words, null ones included, share fingerprint zero, so one of them stays. Equal rows
    are one group. An empty table gives no rows."""
    row = free_name(docs, "row_id")
    ids = with_row_id(docs, "near-dup-rows", row)
    found = clusters(ids.select("doc_id", F.col(row).alias("__row"), "text"), width, 1, radius, block_masks(radius, blocks), distinct=False)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__row")
    stays = found.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.__row").alias(row))
    return ids.join(stays, row, "left_semi").select(*docs.columns)


def _big_endian(name: str):
    """Signatures are stored little-endian; hex digits are written from the highest byte."""
    return F.concat(*(F.substring(F.col(name), k, 1) for k in range(8, 0, -1)))


def jaccard_radius(similarity: float, n_bits: int, margin: float = 0.0) -> int:
    """Differing bits expected at a Jaccard similarity (cosine 2J / (1 + J)), plus ``margin``
    standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(n_bits * p + margin * math.sqrt(n_bits * p * (1 - p)))


def distinct_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8, n_words: int = 4,
                       key_bits: int = 16, tables: int = 48, doubt: float = 3.0) -> DataFrame:
    """``docs`` without near copies: of each component the row with the smallest doc_id stays (nulls last;
    of equal ids, one row).

    Pairs meet if their ``64 * n_words``-bit SimHashes over distinct ``width``-word shingles agree on one of
    ``tables`` samples of ``key_bits`` bits: at a Jaccard similarity of 0.8 that misses 3 %, at 0.9 none in
    ten thousand. Pairs in up to ``doubt`` standard deviations more bits than ``similarity`` makes likely
    form groups; in a group, every pair within these bits links if its shingle sets have the ``similarity``,
    and none by bits alone. All columns come back, whatever their names. Texts without words, null ones
    included, have equal signatures and no shingles, so one of them stays. An empty table gives no rows."""
    row = free_name(docs, "row_id")
    ids = with_row_id(docs, "near-dup-rows", row)
    far = jaccard_radius(similarity, 64 * n_words, doubt)
    found = clusters(ids.select("doc_id", F.col(row).alias("__row"), "text"), width, n_words, far, sample_masks(n_words, key_bits, tables),
                     distinct=True, similarity=similarity)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__row")
    stays = found.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.__row").alias(row))
    return ids.join(stays, row, "left_semi").select(*docs.columns)
