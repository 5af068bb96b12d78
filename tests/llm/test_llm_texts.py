"""Packing (5), quality rules (10), shared helpers and the pipeline."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import DOCS, SMALL, compare, docs, labels
from pyspark.sql import functions as F

from clickcast.llm import common, packing, quality_rules, tokens


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.PieceEncoder(tokens.default_tokenizer())


AWKWARD = ["", "a\x01b c", "It's <|endoftext|> x<|startoftext|>y", "é́  nb\u00a0sp cáfe　z", "ÀÉ İstanbul ǅ 'S we'RE 1234",
           "ŸŁ ÞORN ſß Ω καὶ 日本 ½ ²x x_y _a '' ''S", "<|ENDOFTEXT|> ³", "\x1c a\x85b \x0b\x0c", "\U0001f600\U0001f600 ok"]


def test_piece_ids_equal_the_tokenizer(tokenizer):
    for text in AWKWARD + [t or "" for _, t, *_ in DOCS]:
        want = tokenizer.whole.encode(text, add_special_tokens=False).ids
        got = b"".join(tokenizer.encode_words([w.decode() for w in common.words(text)]))
        assert np.frombuffer(got, np.uint16).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x1c\x85\u3000abÉ", max_size=20)), max_size=6))
def test_coded_words_are_the_words(texts):
    codes, sizes, distinct = common.coded_words(pa.array(texts, pa.string()))
    names, at = distinct.to_pylist(), 0
    for t, n in zip(texts, sizes):
        assert [names[c] for c in codes[at:at + n]] == re.findall(r"[^\x20\x09-\x0D]+", t or "")
        at += n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=12))
def test_cut_puts_each_id_in_one_piece_without_padding(sizes):
    seqs, at = defaultdict(int), defaultdict(int)
    for doc, start, ids, total, seq, offset in packing.cut(((i, np.arange(n)) for i, n in enumerate(sizes)), 16):
        assert start == at[doc] and ids.tolist() == list(range(start, start + len(ids))) and total == sizes[doc]
        assert offset == seqs[seq]
        at[doc] += len(ids)
        seqs[seq] += len(ids)
    assert list(at.values()) == sizes
    assert all(n <= 16 and n & (n - 1) == 0 for n in seqs.values())


def test_hilbert_neighbours_are_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert_key(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_packing_cases(spark, tokenizer):
    got = packing.pack(docs(spark)).collect()
    want = sorted((str(i), np.array(tokenizer.whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, t, *_ in DOCS)
    seqs, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length
        seqs[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for v in seqs.values():
        end = 0
        for offset, length in sorted(v):
            assert offset == end
            end += length
        assert end <= packing.LENGTH and end & (end - 1) == 0
    ids = []
    for i, rows in pieces.items():  # equal ids: follow each document from its start to its length
        heads = [r for r in rows if r.start == 0]
        for head in heads:
            same = sum(h.doc_tokens == head.doc_tokens for h in heads)
            parts = sorted((r for r in rows if r.doc_tokens == head.doc_tokens), key=lambda r: r.start)
            if same == 1:
                ids.append((str(i), b"".join(bytes(r.ids) for r in parts)))
            else:
                assert sum(r.length for r in parts) == same * head.doc_tokens
    assert set(ids) <= set(want) and len(ids) >= len(want) - 2
    for r in packing.pieces_digest(packing.pack(docs(spark))).filter("doc_id = 1").collect():
        assert r.ids_crc32 == zlib.crc32(dict(want)["1"][4 * r.start:4 * (r.start + r.length)])
    assert packing.pack(docs(spark, [])).count() == 0


def brute_longest(ws):
    n = len(ws)
    best = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and ws[i + k] == ws[j + k]:
                k += 1
            best[i] = max(best[i], k)
    return best


def test_suffix_array_against_brute_force():
    rng = random.Random(1)
    for t in range(80):
        texts = [[rng.choice("ab" if t % 2 else "abcdefg") for _ in range(rng.choice([0, 1, 2, 5, 30]))] for _ in range(5)]
        flat = [w for x in texts for w in x]
        if flat:
            ids = pd.factorize(np.array(flat, dtype=object))[0].astype(np.int64)
            doc = np.repeat(np.arange(5), [len(x) for x in texts])
            assert quality_rules.longest_matches(ids, doc).tolist() == [v for x in texts for v in brute_longest(x)]


def test_quality_cases_equal_sql(spark):
    d = docs(spark, clash=False)
    got = quality_rules.quality(d).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    frame = pd.DataFrame({"doc_id": pd.array([r[0] for r in DOCS], dtype="Int64"), "text": [r[1] for r in DOCS]})
    compare("op10_quality_rules", got, {"documents": frame})
    assert quality_rules.quality(docs(spark, [])).count() == 0
    assert quality_rules.quality(docs(spark)).count() == len(DOCS)


def test_quality_limits_repeats(spark):
    rng = random.Random(0)
    fresh = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    part = fresh(110)
    rows = [(1, " ".join(fresh(3000))), (2, " ".join(part + fresh(2780) + part)), (3, " ".join(fresh(500) + part[:12] * 1 + fresh(400) + part[:12])),
            (4, "a b\na b\n\na b\n" + " ".join(fresh(40)))]
    got = {r.doc_id: r for r in quality_rules.quality(docs(spark, [(*r, "en", "a", 1) for r in rows])).collect()}
    assert got[1].kept and got[3].kept and got[3].longest_repeat == 12 and got[3].n_covered_words == 24
    assert not got[2].kept and not got[2].base_failed and got[2].longest_repeat == 110
    assert got[4].n_dup_lines == 2


def test_quality_covered_share_rejects_by_itself(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]

    def text(k, total=1000):
        """``k`` passages of 12 words, each twice, among fresh words."""
        parts = [fresh(12) for _ in range(k)]
        ws = [w for p in parts + parts for w in p + fresh(3)]
        return " ".join(ws + fresh(total - len(ws)))

    rows = [(1, text(7)), (2, text(6))]
    got = quality_rules.quality(docs(spark, [(*r, "en", "a", 1) for r in rows]))
    r = {r.doc_id: r for r in got.collect()}
    assert r[1].n_covered_words == 168 and not r[1].base_failed and r[1].longest_repeat == 12 and not r[1].kept
    assert r[2].n_covered_words == 144 and r[2].kept
    compare("op10_quality_rules", got.drop("n_covered_words", "longest_repeat"), {"documents": pd.DataFrame(rows, columns=["doc_id", "text"])})


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "substring dedup", "mixing", "packing"]
    d = docs(spark, clash=False)
    for c in ("__row", "__score", "score", "row_id", "starts", "n_words", "n_removed__"):
        d = d.selectExpr("*", f"'{c}' as {c}")
    stage = dict(corpus_pipeline.STAGES)
    for name, f in corpus_pipeline.STAGES[:4]:
        out = f(spark, d, SMALL)
        assert out.columns == d.columns, name
        assert all(r["__row"] == "__row" and r.score == "score" and r.row_id == "row_id" for r in out.collect()), name
        assert f(spark, d.limit(0), SMALL).count() == 0
    kept = stage["simhash near-dedup"](spark, d, SMALL).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id in (1, 10, 5)) == [1, 5]
    out = stage["substring dedup"](spark, d, SMALL).collect()
    assert {r.doc_id for r in out} >= {1, 2, 3, 4, 8, 10} and all(r.n_chars == len(r.text) for r in out if r.doc_id == 7)


def test_pipeline_run(spark):
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, SMALL)
    n = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).groupBy().agg(F.max("n"), F.sum("n")).first()
    assert n[0] == packing.LENGTH and n[1] > 10_000
    toxic = corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
    assert toxic.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert labels(spark).count() == 6
