"""Operator 10: quality rules with suffix-array repetition.

Each batch of documents gets one suffix array over its words (suffixes end with their document, so
no match crosses documents). Adjacent suffixes and their longest common prefixes bound the LCP
intervals: the longest match of a suffix with any other is the larger of its two neighbouring LCPs.
The spans of matches of at least ``MIN_REPEAT`` words are united; a document goes if they cover too
much of it, or if one repeat is too long. Everything about a document is in its own text, so there is
no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from clickcast.llm.common import words

WINDOW, MAX_WINDOW_PERCENT, MIN_WORDS = 5, 20, 10  # the base rule
MIN_REPEAT = 10          # words; shorter matches are ordinary phrases
MAX_COVERED_PERCENT = 15  # of the words inside repeats; the base rule implies no more than 20
MAX_REPEAT = 100         # words of the longest repeat
BATCH_WORDS = 200_000    # words that share a suffix array, or one longer document
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"


def suffix_array(word_ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of the concatenated documents and the ranks after 1, 2, 4, ... words.

    Prefix doubling in which only suffixes that still share their prefix are sorted again. Two
    positions have equal ranks at level k exactly if their next 2**k words are there and equal.
    """
    n = len(word_ids)
    ends = np.append(np.flatnonzero(np.diff(doc)), n - 1)
    end_of = ends[np.searchsorted(ends, np.arange(n))]

    def ranked(order, key, base):
        """Ranks of the rows ``order``, sorted by ``key``: the place of the first equal one."""
        first = np.ones(len(order), bool)
        first[1:] = key[order][1:] != key[order][:-1]
        at = np.maximum.accumulate(np.where(first, base, 0))
        again = ~first | np.append(~first[1:], False)
        return at, again

    key = doc * (int(word_ids.max(initial=0)) + 1) + word_ids
    order = np.argsort(key, kind="stable")
    at, again = ranked(order, key, np.arange(n))
    rank = np.empty(n, np.int64)
    rank[order] = at
    levels, active, k = [rank.copy()], order[again], 1
    while len(active):
        after = active + k
        second = np.where(after <= end_of[active], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + second
        short = second == 0  # fewer than 2k words are left: shares its prefix with none
        order = np.argsort(key, kind="stable")
        group = rank[active][order]
        start = np.ones(len(order), bool)
        start[1:] = group[1:] != group[:-1]
        place = np.arange(len(order))
        base = group + place - np.maximum.accumulate(np.where(start, place, 0))
        at, again = ranked(order, key, base)
        rank[active[order]] = at
        levels.append(rank.copy())
        active, k = active[order][again & ~short[order]], 2 * k
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa, levels


def longest_matches(word_ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position, the length of its suffix's longest match elsewhere in its document."""
    n = len(word_ids)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    sa, levels = suffix_array(word_ids, doc)
    a, b = sa[:-1], sa[1:]
    lcp = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    length = np.zeros(len(live), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a[live] + length, b[live] + length
        inside = (x < n) & (y < n)
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        length += (inside & (levels[k][x] == levels[k][y]) & (x != y)) * (1 << k)
    lcp[live] = length
    np.maximum.at(best, a, lcp)
    np.maximum.at(best, b, lcp)
    return best


def covered(length: np.ndarray, least: int) -> np.ndarray:
    """Positions inside the union of the spans [p, p + length[p]) that have ``least`` words."""
    n = len(length)
    p = np.flatnonzero(length >= least)
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, p, 1)
    np.add.at(delta, p + length[p], -1)
    return np.cumsum(delta[:-1]) > 0


def repetition(texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
    """(words, words in repeated 5-word windows, words in repeats of MIN_REPEAT, longest repeat)."""
    batch, total = [], 0
    for i, t in enumerate(texts):
        batch.append(words(t))
        total += len(batch[-1])
        if total >= BATCH_WORDS or i == len(texts) - 1:
            sizes = np.array([len(w) for w in batch])
            if total:
                ids = pd.factorize(np.array([x for w in batch for x in w], dtype=object))[0].astype(np.int64)
                doc = np.repeat(np.arange(len(batch)), sizes)
                length = longest_matches(ids, doc)
                sums = [np.bincount(doc, c, len(batch)).astype(int) for c in (covered(length, WINDOW), covered(length, MIN_REPEAT))]
                longest = np.zeros(len(batch), np.int64)
                np.maximum.at(longest, doc, length)
                yield from zip(sizes.tolist(), sums[0].tolist(), sums[1].tolist(), longest.tolist())
            else:
                yield from ((0, 0, 0, 0) for _ in batch)
            batch, total = [], 0


def text_counts(text: str | None) -> tuple[int, int, int]:
    """(code points in words, symbols, lines with a word that repeat an earlier line)."""
    if not text:
        return 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            again += line in seen
            seen.add(line)
    blanks = len(raw) - len(raw.translate(None, BLANKS))
    return len(text) - blanks, len(raw) - len(raw.translate(None, SYMBOLS)), again


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, n_covered_words long, longest_repeat long")


def quality(docs: DataFrame) -> DataFrame:
    """``documents`` -> one row per document: base counts, the base verdict, words covered by repeats
    of MIN_REPEAT words, the longest repeat, and ``kept``.

    A null or blank text has zero counts and fails the base rule (too few words). Ids may be null or
    repeat; each row is judged alone. Only doc_id and text are read. An empty table gives no rows.
    """

    def judge(batches):
        for pdf in batches:
            out = []
            for i, text, (n, rep5, cov, longest) in zip(pdf["doc_id"], pdf["text"], repetition(list(pdf["text"]))):
                failed = n < MIN_WORDS or 100 * rep5 > MAX_WINDOW_PERCENT * n
                out.append((i, n, *text_counts(text), rep5, failed,
                            not failed and 100 * cov <= MAX_COVERED_PERCENT * n and longest <= MAX_REPEAT, cov, longest))
            out = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            yield out.assign(doc_id=pd.array([None if x is None or x != x else int(x) for x in pdf["doc_id"]], dtype="Int64"))

    return docs.select("doc_id", "text").mapInPandas(judge, SCHEMA)
