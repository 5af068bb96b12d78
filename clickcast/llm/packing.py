"""Operator 5: packing along a space-filling curve.

A document's subword ids are counted in hashed buckets; the unit vector of counts is projected to
three dimensions, and its cell's place on a Hilbert curve is the sort key. Documents are range-sorted
by that key, so neighbours in a sequence are alike, and each range partition cuts its stream of ids
into sequences. What is left at the end of a partition becomes sequences of power-of-two lengths, so
no sequence needs padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickcast.llm.common import coded_words, few_rows_at_once, landed, tidy
from clickcast.llm.tokens import default_tokenizer, encoder, gathered

LENGTH = 2048
END_ID = 1
END = np.array([END_ID], np.uint16).tobytes()
ROWS_AT_ONCE = 1500
BUCKETS, DIMS, BITS, REACH = 256, 3, 10, 4.0


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer cells (rows, dims): Gray-code transform from the highest
    bit down, then the bits of all dimensions interleaved."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[dims - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents given by their ids."""
    rng = np.random.default_rng(11)
    bucket = rng.integers(0, BUCKETS, 1 << 16)
    axes = rng.standard_normal((BUCKETS, DIMS))
    v = np.stack([np.bincount(bucket[x], minlength=BUCKETS) for x in ids]).astype(float)
    v = np.sqrt(v)  # so that the most frequent pieces do not drown the rest
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    at = (v @ axes + REACH) / (2 * REACH)
    return hilbert_key(np.clip((at * (1 << BITS)).astype(int), 0, (1 << BITS) - 1))


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids: uint16 bytes ending in END_ID, key, tie). ``tie`` numbers the rows of a task, so
    that equal documents do not all fall in one range."""

    def run(batches):
        enc, n = encoder(tokenizer), 0
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                rb = whole.slice(at, ROWS_AT_ONCE)
                codes, sizes, distinct = coded_words(rb.column("text"))
                ids, _, counts = gathered(enc.encode_words(distinct.to_pylist()), codes, sizes)
                own = np.split(ids, np.cumsum(counts)[:-1])
                order = np.arange(n, n + len(own)) * 2654435761 % (1 << 32) * (1 << 20) + part
                n += len(own)
                yield pa.RecordBatch.from_arrays(
                    [rb.column("doc_id"), pa.array([x.tobytes() + END for x in own], pa.binary()), pa.array(curve_keys(own)), pa.array(order)],
                    ["doc_id", "ids", "key", "tie"])
        enc.forget()

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, ids binary, key long, tie long")


def cut(stream: Iterator[tuple], length: int = LENGTH) -> Iterator[tuple]:
    """(doc_id, ids) in order -> (doc_id, start, ids, doc_tokens, sequence, offset). Full sequences go
    out as they fill; the rest is cut into its powers of two, the largest first."""
    pending, filled, seq = [], 0, 0
    for doc_id, ids in stream:
        at = 0
        while at < len(ids):
            take = min(len(ids) - at, length - filled)
            pending.append((doc_id, at, ids[at:at + take], len(ids), seq, filled))
            at, filled = at + take, filled + take
            if filled == length:
                yield from pending
                pending, filled, seq = [], 0, seq + 1
    left, room, offset = filled, 0, 0
    for doc_id, start, ids, total, _, _ in pending:
        at = 0
        while at < len(ids):
            if not room:
                room, offset = 1 << (left.bit_length() - 1), 0
            take = min(len(ids) - at, room)
            yield doc_id, start + at, ids[at:at + take], total, seq, offset
            at, room, offset, left = at + take, room - take, offset + take, left - take
            seq += not room


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``documents`` -> one row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens,
    sequence_id, offset. Sequences have LENGTH ids or a power of two.

    A null or empty text is the end id alone. Repeated rows are packed each; null ids stay null. An
    empty table gives no rows. ``tokenizer`` is the path of a tokenizer file, the same on all workers.
    """
    few_rows_at_once(docs.sparkSession)
    ids = landed(encoded(docs, tokenizer or default_tokenizer()), "pack-ids")
    placed = ids.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")

    def run(batches):
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        stream = ((i, np.frombuffer(x, np.uint16)) for pdf in batches for i, x in zip(pdf["doc_id"], pdf["ids"]))
        out, held = [], 0
        frame = lambda: pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])
        for i, start, piece, total, seq, offset in cut(stream):
            i = None if i is None or i != i else int(i)
            out.append((i, start, len(piece), piece.astype("<u4").tobytes(), total, (part << 40) + seq, offset))
            held += len(piece)
            if held > 1 << 20:
                yield frame().astype({"doc_id": "Int64"})
                out, held = [], 0
        if out:
            yield frame().astype({"doc_id": "Int64"})

    return placed.select("doc_id", "ids").mapInPandas(tidy(run), PIECES)


def pieces_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
