"""Operator 12: phrase collocations counted in quotient filters.

1. Texts become blocks of word codes with a dictionary of their own, written once per language. Words
   are counted from the dictionaries; those frequent enough get dense ids, and each block's dictionary
   joins them, so no worker ever holds the whole vocabulary.
2. Level by level (2 to 5 words), the n-grams of a block whose parts are frequent are counted. An n-gram
   is its packed word ids, permuted by an invertible Feistel pass. The top bits of the permuted key are
   the quotient, which says where in the filter a key belongs; the rest is kept in full, so the
   counters are exact and the phrase can be had back from them.
3. A task merges the filters of its blocks as they fill up and sends them out cut by ranges of the
   quotient. The permutation makes the ranges alike in size, however often one word or phrase occurs;
   a range's sorted filters merge into one, and only phrases at the floor or above leave it.
4. Cuts, scores, absorbed phrases and ranks are joins and aggregates over the frequent phrases.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickcast.llm.common import few_bytes_at_once, few_rows_at_once, landed, mixed, passes, sieve, tidy

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
ABSORB = 100             # per cent of a phrase's count that a longer one must reach to absorb it
BLOCK_CHARS = 1 << 24
HELD = 1 << 21           # n-grams a task holds before it merges them and sends them out
RANGE_WORDS = 1 << 21    # words of the corpus per range of quotients
BREAKS = r"[.,;:!?\x0A-\x0D]+"
BREAK = "."              # cannot be a word: it is cut out of all of them

BLOCKS = "lang string, words array<string>, counts array<long>, n_codes int, codes binary"
FILTERS = "lang string, section long, entries int, sub int, runs binary, rests binary, counters binary, spilled binary"


# ---------------------------------------------------------------- blocks of coded words

def coded_block(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, counts, codes) of texts: code k is word k - 1, 0 a break between pieces."""
    cut = pc.replace_substring_regex(pc.ascii_lower(texts.cast(pa.large_string())), BREAKS, f" {BREAK} ")
    cut = pc.binary_join_element_wise(cut, pa.scalar(f" {BREAK}", pa.large_string()), pa.scalar("", pa.large_string()))
    flat = pc.ascii_split_whitespace(cut).flatten().dictionary_encode()  # only blanks and tabs are left
    seen, at = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False)
    special = [k for k in (pc.index(seen, "").as_py(), pc.index(seen, BREAK).as_py())]
    is_word = np.ones(len(seen), bool)
    is_word[[k for k in special if k >= 0]] = False
    code = np.where(is_word, np.cumsum(is_word), 0).astype("<u4")
    if special[0] >= 0:  # what stands between neighbouring blanks
        at = at[at != special[0]]
    codes = code[at]
    return seen.filter(pa.array(is_word)), np.bincount(codes, minlength=is_word.sum() + 1)[1:], codes


def squeezed(codes: np.ndarray, n_words: int) -> bytes:
    """Codes in two bytes where they fit, compressed: blocks meet their ids in a shuffle."""
    return pa.compress(codes.astype("<u2" if n_words < 1 << 16 else "<u4").tobytes(), codec="zstd", asbytes=True)


def unsqueezed(raw: bytes, n_codes: int, n_words: int) -> np.ndarray:
    kind = np.dtype("<u2" if n_words < 1 << 16 else "<u4")
    return np.frombuffer(pa.decompress(raw, decompressed_size=n_codes * kind.itemsize, codec="zstd"), kind)


def word_blocks(docs: DataFrame) -> DataFrame:
    """Texts by language in blocks of about ``BLOCK_CHARS`` bytes; a text is never cut."""

    def run(batches):
        held, size = {}, 0

        def blocks():
            for lang, parts in held.items():
                words, counts, codes = coded_block(pa.chunked_array(parts).combine_chunks())
                if len(words):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]), pa.array([words], pa.list_(pa.large_string())).cast(pa.list_(pa.string())),
                         pa.array([counts], pa.list_(pa.int64())), pa.array([len(codes)], pa.int32()), pa.array([squeezed(codes, len(words))], pa.binary())],
                        ["lang", "words", "counts", "n_codes", "codes"])

        for rb in batches:
            text, langs = rb.column("text").cast(pa.large_string()), rb.column("lang").dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = text.filter(pc.equal(langs.indices, k))
                for part in slices(own):
                    held.setdefault(lang, []).append(part)
                    size += pc.sum(pc.binary_length(part)).as_py()
                    if size >= BLOCK_CHARS:
                        yield from blocks()
                        held, size = {}, 0
        yield from blocks()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).filter("text <> ''")
    return rows.mapInArrow(tidy(run), BLOCKS)


def slices(texts: pa.Array):
    """Runs of neighbouring texts of up to a block's size, or one longer text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + BLOCK_CHARS, "right")))
        yield texts[at:to]
        at = to


def dense_ids(rows: DataFrame, name: str, column: str) -> DataFrame:
    """``rows`` written with ids from 1 without gaps: place in its part file plus the rows of the parts
    before it, which are summed over one row per part."""
    placed = landed(rows.withColumn("_part", F.spark_partition_id()).withColumn(
        "_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(F.count("*").alias("_rows")).withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    return placed.join(parts.drop("_rows"), "_part").withColumn(column, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def encoded_blocks(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """(lang, ids binary): the blocks with vocabulary ids (uint32); 0 for a break or a rare word."""
    own = blocks.select("block", "lang", F.posexplode("words").alias("pos", "word"))
    there = F.when(F.col("id").isNotNull(), F.struct("pos", "id"))  # collect_list passes over nulls
    # merged at every size: nothing bounds the vocabulary, so it is never broadcast
    known = own.join(ids.hint("merge"), ["lang", "word"], "left").groupBy("block").agg(F.collect_list(there).alias("known"))

    def run(batches):
        for rb in batches:
            out = []
            for codes, n_codes, size, known in zip(rb.column("codes"), rb.column("n_codes").to_pylist(), rb.column("size").to_pylist(), rb.column("known")):
                table, known = np.zeros(size + 1, "<u4"), known.values
                table[known.field("pos").to_numpy() + 1] = known.field("id").to_numpy()
                got = table[unsqueezed(codes.as_buffer(), n_codes, size)]
                there = (got != 0) | (np.concatenate(([1], got[:-1])) != 0)  # one 0 is as good as many
                out.append(got[there].tobytes())
            yield pa.RecordBatch.from_arrays([rb.column("lang"), pa.array(out, pa.binary())], ["lang", "ids"])

    joined = blocks.select("block", "lang", "n_codes", "codes", F.size("words").alias("size")).join(known, "block")
    return joined.select("lang", "n_codes", "codes", "size", "known").mapInArrow(tidy(run), "lang string, ids binary")


# ---------------------------------------------------------------- quotient filters

def feistel(words: np.ndarray, bits: int, back: bool = False) -> np.ndarray:
    """Permute n-grams (n, rows) of ``bits``-bit words: each word in turn takes in a hash of all others.
    ``back`` undoes it."""
    words, mask = words.copy(), np.uint64((1 << bits) - 1)
    turns = range(len(words) - 1, -1, -1)
    for i in reversed(turns) if back else turns:
        h = np.full(words.shape[1], 0x9E3779B97F4A7C15 + i, np.uint64)
        for j in range(len(words)):
            if j != i:
                h = mixed(h + words[j])
        words[i] = (words[i] - h if back else words[i] + h) & mask
    return words


def limbs_of(words: np.ndarray, bits: int) -> np.ndarray:
    """(limbs, rows) uint64: the words of ``bits`` bits side by side, as many as fit a limb."""
    per = 64 // bits
    out = []
    for at in range(0, len(words), per):
        x = words[at].copy()
        for w in words[at + 1:at + per]:
            x = (x << np.uint64(bits)) | w
        out.append(x)
    return np.stack(out)


def words_of(limbs: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The inverse of ``limbs_of``."""
    per, mask, out = 64 // bits, np.uint64((1 << bits) - 1), []
    for k, x in enumerate(limbs):
        inside = min(per, n - k * per)
        out += [(x >> np.uint64(bits * (inside - 1 - i))) & mask for i in range(inside)]
    return np.stack(out)


def summed(limbs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge filters given one after the other: keys ascending, each once, with its summed count."""
    if not limbs.shape[1]:
        return limbs, counts
    order = np.argsort(limbs[0], kind="stable") if len(limbs) == 1 else np.lexsort(limbs[::-1])
    limbs, counts = limbs[:, order], counts[order]
    first = np.concatenate(([True], (limbs[:, 1:] != limbs[:, :-1]).any(axis=0)))
    return limbs[:, first], np.add.reduceat(counts, np.flatnonzero(first))


class Layout:
    """How n-grams of ``n`` words of ``bits`` bits lie in a filter cut into 2**cut ranges."""

    def __init__(self, n: int, bits: int, cut: int):
        self.n, self.bits = n, bits
        per = 64 // bits
        self.head_bits = bits * min(n, per)       # of the first limb; the quotient is its top bits
        self.cut = min(cut, self.head_bits)
        self.tail = [8 * -(-bits * min(per, n - at) // 64) for at in range(per, n, per)]

    def sections(self, limbs: np.ndarray) -> np.ndarray:
        return (limbs[0] >> np.uint64(self.head_bits - self.cut)).astype(np.int64) if self.cut else np.zeros(limbs.shape[1], np.int64)

    def packed(self, limbs: np.ndarray, counts: np.ndarray) -> tuple:
        """One range: quotient runs, remainders and counters. About as many quotients as entries; a
        remainder takes the bytes that the quotient leaves over, a counter one byte, or nine."""
        sub = min(self.head_bits - self.cut, max(0, int(limbs.shape[1]).bit_length() - 1))
        rest = self.head_bits - self.cut - sub
        inside = limbs[0] & np.uint64((1 << (rest + sub)) - 1)
        runs = np.bincount((inside >> np.uint64(rest)).astype(np.int64), minlength=1 << sub)
        width = -(-rest // 8)
        rests = (inside & np.uint64((1 << rest) - 1)).astype("<u8")[:, None].view(np.uint8)[:, :width].tobytes()
        rests += b"".join(x.astype("<u8").tobytes() for x in limbs[1:])
        big = counts >= 255
        counters = np.where(big, 255, counts).astype(np.uint8).tobytes()
        return limbs.shape[1], sub, runs_bytes(runs), rests, counters, counts[big].astype("<i8").tobytes()

    def unpacked(self, section: int, entries: int, sub: int, runs: bytes, rests: bytes, counters: bytes, spilled: bytes):
        rest = self.head_bits - self.cut - sub
        width = -(-rest // 8)
        head = np.zeros((entries, 8), np.uint8)
        head[:, :width] = np.frombuffer(rests, np.uint8, entries * width).reshape(entries, width)
        quotient = np.repeat(np.arange(1 << sub, dtype=np.uint64), runs_from(runs, 1 << sub))
        first = head.view("<u8").ravel() | (quotient << np.uint64(rest)) if rest < 64 else head.view("<u8").ravel().copy()
        if self.cut:
            first |= np.uint64(section) << np.uint64(self.head_bits - self.cut)
        limbs = [first, *np.frombuffer(rests, "<u8", offset=entries * width).reshape(-1, entries)] if len(rests) > entries * width else [first]
        counts = np.frombuffer(counters, np.uint8).astype(np.int64)
        counts[counts == 255] = np.frombuffer(spilled, "<i8")
        return np.stack(limbs), counts


def runs_bytes(runs: np.ndarray) -> bytes:
    kind = "<u1" if runs.max() < 256 else "<u4"
    return runs.astype(kind).tobytes()


def runs_from(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(raw, "<u1" if len(raw) == size else "<u4").astype(np.int64)


def gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each window of ``n`` ids, for sieves only."""
    size = max(0, len(ids) - n + 1)
    h = np.full(size, n, np.uint64)
    for k in range(n):
        h = mixed((h + np.uint64(0x9E3779B97F4A7C15)) ^ ids[k:k + size].astype(np.uint64))
    return h.view(np.int64)


# ---------------------------------------------------------------- counting a level

def level_counts(encoded: DataFrame, layout: Layout, floor: int, parts) -> DataFrame:
    """(lang, ids array<long>, f, h) of the n-grams that occur ``floor`` times or more. ``parts`` is a
    sieve of the frequent (n - 1)-grams, or None at two words: ids are frequent words already."""
    n = layout.n

    def fill(batches):
        held, size = {}, 0

        def sent():
            for lang, filters in held.items():
                limbs, counts = summed(np.concatenate([f[0] for f in filters], 1), np.concatenate([f[1] for f in filters]))
                section = layout.sections(limbs)
                cuts = [0, *(np.flatnonzero(np.diff(section)) + 1), len(section)]
                rows = [(lang, int(section[a]), *layout.packed(limbs[:, a:b], counts[a:b])) for a, b in itertools.pairwise(cuts)]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4))]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "section", "entries", "sub", "runs", "rests", "counters", "spilled"])

        for rb in batches:
            for lang, raw in zip(rb.column("lang").to_pylist(), rb.column("ids")):
                ids = np.frombuffer(raw.as_buffer(), "<u4")
                at = np.flatnonzero(np.logical_and.reduce([ids[k:len(ids) - n + 1 + k] != 0 for k in range(n)])) if len(ids) >= n else np.empty(0, np.int64)
                if parts is not None and len(at):
                    known = passes(parts.value, gram_hashes(ids, n - 1))
                    at = at[known[at] & known[at + 1]]
                for some in np.array_split(at, -(-len(at) // HELD) or 1):
                    if not len(some):
                        continue
                    words = np.stack([ids[some + k].astype(np.uint64) for k in range(n)])
                    limbs = limbs_of(feistel(words, layout.bits), layout.bits)
                    limbs, counts = summed(limbs, np.ones(len(some), np.int64))
                    held.setdefault(lang, []).append((limbs, counts))
                    size += len(counts)
                    if size >= HELD:
                        yield from sent()
                        held, size = {}, 0
        yield from sent()

    def merge(key, group):
        filters = [layout.unpacked(key[1].as_py(), *(c.as_py() for c in row)) for row in zip(*(group.column(c) for c in (
            "entries", "sub", "runs", "rests", "counters", "spilled")))]
        limbs, counts = summed(np.concatenate([f[0] for f in filters], 1), np.concatenate([f[1] for f in filters]))
        often = counts >= floor
        words = feistel(words_of(limbs[:, often], n, layout.bits), layout.bits, back=True).astype(np.int64)
        flat, offsets = words.T.reshape(-1), np.arange(0, n * words.shape[1] + 1, n, dtype=np.int32)
        h = gram_hashes(flat, n)[::n] if len(flat) else np.empty(0, np.int64)
        return pa.table({
            "lang": pa.array([key[0].as_py()] * words.shape[1], pa.string()), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
            "f": pa.array(counts[often]), "h": pa.array(h)})

    filters = encoded.mapInArrow(tidy(fill), FILTERS)
    return filters.groupBy("lang", "section").applyInArrow(merge, "lang string, ids array<long>, f long, h long")


# ---------------------------------------------------------------- the operator

def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vocabulary (lang, word, f, id), phrases (lang, ids, f), totals (lang, n)): all words and all
    phrases of 2 to ``longest`` words that occur ``min_count`` times or more in a language."""
    spark = docs.sparkSession
    few_rows_at_once(spark)
    few_bytes_at_once(spark)
    blocks = landed(word_blocks(docs).withColumn("block", F.monotonically_increasing_id()), "phrase-blocks")
    totals = blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    counted = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")) \
        .agg(F.sum("w.counts").alias("f")).filter(F.col("f") >= min_count)
    vocabulary = dense_ids(counted, "phrase-vocabulary", "id")
    size = vocabulary.count()
    bits = max(1, size.bit_length())
    if bits > 32:
        raise ValueError("more than 2**32 frequent words")
    words = totals.agg(F.sum("n")).first()[0] or 0
    cut = min(48, max(0, words // RANGE_WORDS).bit_length())
    encoded = landed(encoded_blocks(blocks, vocabulary.drop("f")), "phrase-ids")
    levels, parts = [], None
    for n in range(2, longest + 1):
        level = landed(level_counts(encoded, Layout(n, bits, cut), min_count, parts), f"phrase-{n}")
        levels.append(level)
        if n < longest:
            parts = sieve(level, "h")
    phrases = levels[0]
    for level in levels[1:]:
        phrases = phrases.unionByName(level)
    return vocabulary, phrases.drop("h"), totals


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, absorb: int = ABSORB) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score), the first ``top`` phrases of each language.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends; words are runs without
    blank or tab, and a phrase lies within one piece. n counts the language's words, a the phrase's
    occurrences, overlapping ones included; l and r count the two sides of its weakest cut, the one of
    least floor(1000 a n / (l r)), then the leftmost. A phrase goes if a longer one that contains it
    occurs at least ``absorb`` per cent as often; as counts never rise with length, looking one word
    further decides that. Scores are exact decimals of 38 digits.

    A null text counts as empty, a null language as ``und``; empty texts, or texts of separators alone,
    count nothing. Equal rows each count. Only ``text`` and ``lang`` are read, whatever other columns
    there are. Equal score and count rank by the phrase's UTF-8 bytes. An empty table, or no phrase
    frequent enough, gives no rows.
    """
    vocabulary, phrases, totals = phrase_counts(docs, min_count, longest)
    parts = phrases.unionByName(vocabulary.select("lang", F.array("id").alias("ids"), "f"))
    sides = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1))).select(
        "lang", "ids", F.col("f").alias("a"), "k", F.slice("ids", F.lit(1), F.col("k")).alias("left"),
        F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("right"))
    cuts = sides.join(parts.toDF("lang", "left", "l"), ["lang", "left"]).join(parts.toDF("lang", "right", "r"), ["lang", "right"]).join(totals, "lang")
    whole = "cast({} as decimal(19,0))".format
    score = F.expr(f"(cast(1000 as decimal(4,0)) * {whole('a')} * {whole('n')}) div ({whole('l')} * {whole('r')})").cast("long")
    weakest = cuts.groupBy("lang", "ids", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    n = F.size("ids")
    longer = phrases.filter(n > 2).select(
        "lang", F.explode(F.array(F.slice("ids", F.lit(1), n - 1), F.slice("ids", F.lit(2), n - 1))).alias("ids"), F.col("f").alias("longer"))
    longer = longer.groupBy("lang", "ids").agg(F.max("longer").alias("longer"))
    left = weakest.join(longer, ["lang", "ids"], "left").filter(f"longer is null or 100 * longer < {int(absorb)} * a").select(
        "lang", "ids", "a", "n", "cut.score", "cut.l", "cut.r")
    order = [F.desc("score"), F.desc("a")]
    near = left.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= top).drop("place")
    spelled = (
        near.select("lang", "ids", F.posexplode("ids").alias("at", "id")).join(vocabulary.select("id", "word"), "id")
        .groupBy("lang", "ids").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
        .select("lang", "ids", F.array_join(F.transform("w", lambda w: w["word"]), " ").alias("phrase"))
    )
    last = Window.partitionBy("lang").orderBy(*order, "phrase")
    return (
        near.join(spelled, ["lang", "ids"]).withColumn("rank", F.row_number().over(last).cast("long")).filter(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
