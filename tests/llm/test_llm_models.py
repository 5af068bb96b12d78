"""LM scoring (3), the quality classifier (4) and toxicity (8)."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_cases import DOCS, docs, labels

from clickcast.llm import kneser_ney, lm, toxicity


def test_lm_base_columns_against_brute_force(spark):
    got = sorted(lm.score(docs(spark)).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    rows = [(i, (t or "").encode().lower().split() + [b"\n"], zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2) for i, t, *_ in DOCS]
    c = Counter(w for _, ws, held in rows if not held for w in ws)
    n, v = sum(c.values()), len(c)
    for r, (i, ws, held) in zip(got, sorted(rows, key=lambda r: (str(r[0]), len(r[1])))):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, held, len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert -1e9 < r.score < 0
    assert lm.score(docs(spark, [])).count() == 0


def test_lm_windows_score_each_symbol_once():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 200, 30)
    classes = rng.integers(0, 9, lengths.sum())
    x, y = lm.windows(classes, lengths, 9)
    assert (y[y >= 0] == classes).all()
    first = np.cumsum(lengths) - lengths
    rows, places = np.nonzero(y >= 0)
    for k in rng.choice(len(rows), 200):  # what a place sees last is the symbol before it
        want = 9 if k in first else classes[k - 1]
        assert x[rows[k], lm.CONTEXT + places[k]] == want


def test_lm_probabilities_sum_to_one_and_see_no_future():
    k = lm.OWN_CLASSES + lm.REST_CLASSES
    rng = np.random.default_rng(1)
    w = lm.new_weights(np.log(np.full(k, 1 / k)))
    x = rng.integers(0, k + 1, (2, lm.CONTEXT + lm.STRIDE))
    p = np.stack([np.exp(lm.log_probabilities(w, x, np.full((2, lm.STRIDE), c))) for c in range(k)])
    assert np.allclose(p.sum(0), 1, atol=1e-4)
    later = x.copy()
    later[:, lm.CONTEXT + 5:] = rng.integers(0, k, later[:, lm.CONTEXT + 5:].shape)
    y = rng.integers(0, k, (2, lm.STRIDE))
    assert np.allclose(lm.log_probabilities(w, x, y)[:, :5], lm.log_probabilities(w, later, y)[:, :5], atol=1e-5)
    counts = rng.integers(0, 50, lm.SYMBOLS).astype(float)
    own = lm.own_classes(counts)
    tracked = np.flatnonzero(own < 0)[:500]
    cls, inside = lm.shared_classes(counts, own, tracked, rng.random((500, 2 * lm.OWN_CLASSES + 2)))
    assert np.allclose(np.bincount(cls, np.exp(inside)), 1)


def test_lm_gradient_is_the_slope():
    k = lm.OWN_CLASSES + lm.REST_CLASSES
    rng = np.random.default_rng(2)
    w = {n: v.astype(np.float64) for n, v in lm.new_weights(np.log(np.full(k, 1 / k))).items()}
    x = rng.integers(0, k + 1, (3, lm.CONTEXT + lm.STRIDE))
    y = rng.integers(-1, k, (3, lm.STRIDE))
    loss = lambda: -(lm.log_probabilities(w, x, np.maximum(y, 0))[y >= 0]).mean()
    g = lm.gradient(w, x, y)
    for name, v in w.items():
        at = tuple(rng.integers(0, n) for n in v.shape) if name != "embed" else (x[0, 20], 3)
        v[at] += 1e-4
        up = loss()
        v[at] -= 2e-4
        down = loss()
        v[at] += 1e-4
        assert g[name][at] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=1e-5), name


def test_lm_trains_on_all_training_documents(spark, monkeypatch):
    rows = [(i, f"a word w{i % 50}", "en", "a", 1) for i in range(3000)]
    seen, own_classes = [], lm.own_classes
    monkeypatch.setattr(lm, "own_classes", lambda counts: seen.append(counts[lm.END]) or own_classes(counts))
    got = lm.score(docs(spark, rows)).collect()
    assert len(got) == 3000 and seen == [sum(not r.held_out for r in got)]


def brute_kn(texts):
    """Interpolated modified Kneser-Ney as in the papers, by dictionaries."""
    n_max = kneser_ney.ORDER
    counts = {n_max: Counter(s[i:i + n_max] for t in texts for s in [kneser_ney.symbols(t)] for i in range(len(s) - n_max + 1))}
    for n in range(n_max - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cut = {}
    for n, c in counts.items():
        of = Counter(c.values())
        cut[n] = kneser_ney.discounts(of[1], of[2], of[3], of[4])

    def p(s):
        n = len(s)
        if n == 0:
            return kneser_ney.UNSEEN
        after = {g: c for g, c in counts[n].items() if g[:-1] == s[:-1]}
        total = sum(after.values())
        if not total:
            return p(s[1:])
        d = lambda c: min(cut[n][min(c, 3) - 1], c)
        own = after.get(s, 0)
        return (own - d(own) if own else 0) / total + sum(map(d, after.values())) / total * p(s[1:])

    return p


def test_kneser_ney_against_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aab cé") for _ in range(rng.randrange(0, 40))) for _ in range(40)] + [None, ""]
    model = kneser_ney.kneser_ney(kneser_ney.counted_grams(spark.createDataFrame([(t,) for t in texts], "text string")))
    known = {r.s: (r.p, r.left) for r in model.collect()}
    p = brute_kn(texts)
    other = ["abé c", "zzz a", "日 a", "a  \n b"]
    found, gram, doc = kneser_ney.grams(texts + other)
    assert np.allclose(kneser_ney.log_probabilities(found, known), [math.log10(p(s)) for s in found])
    for h in ("aab", "a b", "\x02\x02\x02"):  # a distribution over the characters seen and unseen
        seen = {s[-1] for s in known if len(s) == 1}
        assert sum(p(h + c) for c in seen) <= 1 + 1e-9


def test_quality_classifier_cases(spark):
    d, lab = docs(spark), labels(spark)
    got = kneser_ney.quality_filter(d, lab).collect()
    assert len(got) == len(DOCS) and all(r.n_symbols >= 1 and r.perplexity > 0 for r in got)
    assert all(r.kept for r in kneser_ney.quality_filter(d, labels(spark, [(1, 0, 0)])).collect())
    assert kneser_ney.quality_filter(docs(spark, []), lab).count() == 0


def test_quality_classifier_tells_junk_from_clean_text(spark):
    rng = random.Random(8)
    syl = "ka lo mi ten ra shu ve nor".split()
    clean = lambda: " ".join("".join(rng.choice(syl) for _ in range(rng.randrange(1, 4))) for _ in range(60))
    junk = lambda: " ".join(rng.choice(["%%%", "||", "$$&", "QX!!"]) + rng.choice(syl) for _ in range(60))
    rows = [(i, junk() if i % 10 == 0 else clean(), "en", "a", 1) for i in range(600)]
    lab = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in kneser_ney.quality_filter(docs(spark, rows), lab).collect()}
    assert not any(got[i] for i in range(300, 600) if i % 10 == 0)
    assert sum(got[i] for i in range(300, 600) if i % 10) >= 0.98 * 270


def test_rare_language_keeps_its_own_threshold_under_many_labels(spark):
    rng = random.Random(4)
    text = lambda syl: " ".join("".join(rng.choice(syl) for _ in range(rng.randrange(1, 4))) for _ in range(30))
    main, rare = "ka lo mi ten ra shu ve nor".split(), "ö ßa żu éh ïw ñy çx ûq ðj þz".split()
    rows = [(i, text(rare if i < 200 else main), "xx" if i < 200 else "en", "a", 1) for i in range(600)]
    lab = spark.range(400_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    got = kneser_ney.quality_filter(docs(spark, rows), lab).collect()
    for lang in ("xx", "en"):
        held = [r.perplexity for r in got if r.lang == lang and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
        assert len(held) >= kneser_ney.LEAST_DOCS
        want = sorted(held)[math.ceil(kneser_ney.QUANTILE * len(held)) - 1] * kneser_ney.SLACK
        assert [r.threshold for r in got if r.lang == lang] == pytest.approx([want] * (200 if lang == "xx" else 400))


def test_clauses_rise_with_a_target_and_fall_with_negation_and_reports():
    weight = {"idiot": 1.0}.get
    classes = lambda t: toxicity.word_class(t, lambda x: weight(x, 0.0))
    run = lambda t: sum(toxicity.clause_scores(toxicity.tokens(t), classes))
    plain = run("the idiot came")
    assert run("you are an idiot") > plain > run("he is not an idiot") > 0
    assert run('she said "idiot" today') < plain
    assert run("I will kill you") > 0 == run("I will not kill you") == run("kill time")
    assert run("nothing here. at all") == 0
    assert run("idiot, idiot") > plain


def by_hand(found, weight):
    """The clause scores by the rules of the grammar, without automata."""
    out, clause, said, quoted = [], [], False, False
    for t in [*found, "."]:
        if t in toxicity.PAUSES | toxicity.ENDS:
            words = [w for w, *_ in clause]
            negated = lambda i: any(w in toxicity.NEGATIONS for w in words[max(0, i - toxicity.NEGATION_REACH):i])
            x = sum(weight(w) * (0.4 if negated(i) else 1) * (0.5 if both else 1) for i, (w, both) in enumerate(clause))
            target = any(w in toxicity.TARGETS for w in words)
            if target and any(w in toxicity.THREATS and not negated(i) for i, w in enumerate(words)):
                x += 0.3 if said or quoted else 1.0
            if x:
                out.append(x * (1.5 if target else 1))
            clause, said = [], said and t in toxicity.PAUSES
        elif t in toxicity.QUOTES:
            quoted = not quoted
        else:
            said = said or t in toxicity.REPORTS
            clause.append((t, said and quoted))
    return out


def cascade(found, classes):
    """One transducer after the other, each over all that the one before wrote."""
    read = [classes(t) for t in found] + [(toxicity.END, 0.0)]
    arcs = [[] for _ in read]
    told = [c for c, _ in read]
    for machine in toxicity.CASCADE:
        state = 0
        for i, c in enumerate(told):
            arc = machine[state][c]
            arcs[i].append(arc)
            state, told[i] = arc.to, arc.out
    out, x = [], 0.0
    for (_, w), own, c in zip(read, arcs, told):
        x += w * math.prod(a.gain for a in own)
        if c == toxicity.END:
            for a in own:
                x = x * a.factor + a.bonus
            out += [x] if x else []
            x = 0.0
    return out


def test_the_composed_grammar_equals_its_cascade_and_the_rules():
    weight = lambda t: {"idiot": 1.0, "dolt": 0.7}.get(t, 0.0)
    classes = lambda t: toxicity.word_class(t, weight)
    words = ["idiot", "dolt", "you", "not", "never", "said", "kill", "hurt", "house", "tree", ".", ",", ":", '"', "\n"]
    rng = random.Random(8)
    for _ in range(3000):
        found = [rng.choice(words) for _ in range(rng.randrange(25))]
        got = toxicity.clause_scores(found, classes)
        assert got == pytest.approx(cascade(found, classes)) and got == pytest.approx(by_hand(found, weight)), found
    assert len(toxicity.GRAMMAR) <= math.prod(map(len, toxicity.CASCADE))


def test_every_precise_term_is_kept(spark):
    """No limit on the lexicon: 2,500 words that only toxic texts have."""
    rows = [(" ".join(f"{w}" for w in names), 1) for names in [[chr(97 + k // 676 % 26) + chr(97 + k // 26 % 26) + chr(97 + k % 26) + "zq" for k in range(2500)]] * 20]
    rows += [(f"plain words {k}", 0) for k in range(400)]
    assert len(toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int")).terms) > 2000


def test_toxicity_cases(spark):
    got = toxicity.toxicity(docs(spark), labels(spark)).collect()
    assert len(got) == len(DOCS)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    assert toxicity.toxicity(docs(spark, []), labels(spark)).count() == 0
    none = toxicity.toxicity(docs(spark), labels(spark, [(99, 1, 1)])).collect()
    assert all(r.predicted == 0 for r in none)


def test_toxicity_learns_words_and_stems_and_ignores_held_out_labels(spark):
    rng = random.Random(6)
    filler = lambda n: [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}{rng.randrange(99)}" for _ in range(n)]
    rows, lab = [], []
    for i in range(900):
        w, toxic = filler(40), i % 6 == 0
        if toxic:
            w.insert(rng.randrange(40), rng.choice(["dolt", "zubba" + rng.choice("xyz") * 2]))
        rows.append((i, " ".join(w), "en", "a", 1))
        held = zlib.crc32(str(i).encode()) % 5 == 0
        lab.append((i, 1, int(not toxic if held else toxic)))  # held-out labels are wrong on purpose
    got = toxicity.toxicity(docs(spark, rows), spark.createDataFrame(lab, "doc_id long, quality int, toxic int")).collect()
    assert sum(r.predicted == int(r.doc_id % 6 == 0) for r in got) >= 890


def test_grams_of_many_characters():
    """More code points than a packed key has room for: the same n-grams as by hand."""
    from clickcast.llm import kneser_ney as K
    texts = ["".join(chr(0x4E00 + k % 20000) + chr(0x20000 + k % 30000) for k in range(40000)), "ab ab", None, ""]
    found, gram, doc = K.grams(texts)
    want = [(d, s[i:i + K.ORDER]) for d, s in enumerate(map(K.symbols, texts)) for i in range(len(s) - K.ORDER + 1)]
    assert [(int(d), found[g]) for g, d in zip(gram, doc)] == want
    assert len(set(found)) == len(found)


def test_counts_without_the_own_document():
    texts = [["a", "b", "a"], ["a"], [], ["c", "b"]]
    names = ["a", "b", "c"]
    word = np.array([names.index(w) for t in texts for w in t])
    doc = np.repeat(np.arange(4), [len(t) for t in texts])
    total = np.array([sum(t.count(n) for t in texts) for n in names])
    want = [sum(t.count(w) for j, t in enumerate(texts) if j != i) for i, own in enumerate(texts) for w in own]
    assert lm.others(total[word], word, doc, 3).tolist() == want
    none = lm.mixtures((0.25,), np.array([0.0, 0.5]), np.log([0.1, 0.2]))[0]
    assert np.exp(none) == pytest.approx([0.075, 0.275])


def test_lm_beats_the_base_on_held_out_documents(spark):
    """The given documents, with many words that no training document has."""
    held = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    score, base, n = (sum(getattr(r, c) for r in held) for c in ("score", "base_score", "n_tokens"))
    print("held-out per token", score / n, base / n, sum(r.score < r.base_score for r in held) / len(held))
    assert score > base


def test_lm_learns_what_held_out_texts_say(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{k}" for k in np.minimum(rng.geometric(0.05, 40), 90)), "en", "a", 1) for i in range(1500)]
    held = [r for r in lm.score(docs(spark, rows)).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.n_tokens for r in held) * np.log10(1 / 92)
    assert sum(r.score for r in held) > 1.05 * sum(r.base_score for r in held)


def test_lm_one_pass_is_the_model_place_by_place():
    """Probabilities against the model written out, and finite ones and gradients where exponents overflow."""
    k = lm.OWN_CLASSES + lm.REST_CLASSES
    rng = np.random.default_rng(3)
    w = {n: v.astype(np.float64) for n, v in lm.new_weights(np.log(rng.dirichlet(np.ones(k)))).items()}
    x, y = rng.integers(0, k + 1, (2, lm.CONTEXT + lm.STRIDE)), rng.integers(0, k, (2, lm.STRIDE))
    softmax = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    want = np.empty(y.shape)
    for r, t in np.ndindex(y.shape):
        e = (w["embed"][x[r]] + w["place"])[:lm.CONTEXT + t + 1]
        share = softmax((e[-1] @ w["wq"]) @ (e @ w["wk"]).T * lm.WIDTH ** -0.5)
        u = np.maximum((e[-1] + share @ (e @ w["wv"]) @ w["wo"]) @ w["w1"] + w["b1"], 0)
        want[r, t] = np.log(softmax(u @ w["w2"] + w["b2"])[y[r, t]])
    assert np.allclose(lm.log_probabilities(w, x, y), want)
    w["b2"] += 800  # changes nothing but the size of the exponents
    assert np.isfinite(lm.log_probabilities(w, x, y)).all()
    assert all(np.isfinite(v).all() for v in lm.gradient(w, x, y).values())


def test_lm_spells_each_distinct_word_of_a_block_once(spark, monkeypatch):
    """One spelling of a block serves training and scoring: no symbols are written beside the blocks."""
    landed, seen = lm.landed, []
    monkeypatch.setattr(lm, "landed", lambda df, name: seen.append(name) or landed(df, name))
    got = lm.score(docs(spark)).collect()
    assert len(got) == len(DOCS) and sorted(seen) == ["lm-blocks", "lm-scores", "lm-words"]


def test_lm_words_spelled_flat_as_one_by_one():
    from clickcast.llm.tokens import PieceEncoder, default_tokenizer
    words = ["the", "", "qu1ck", "İstanbul", "日本", "don't", "[UNK]", "\U0001f600", "x\u0085y", *(f"w{k}" for k in range(70_000)), "ǅ"]
    a, b = PieceEncoder(default_tokenizer()), PieceEncoder(default_tokenizer())
    lengths, flat = a.spelled(words)
    one_by_one = b.encode_words(words)
    assert lengths.tolist() == [len(w) // 2 for w in one_by_one] and flat.tobytes() == b"".join(one_by_one)


def test_lm_blocks_are_cut_between_documents(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(i % 40)), "en", "a", 1) for i in range(300)]
    rows += [(1000, "a b " * 400, "en", "a", 1), (1001, None, "en", "a", 0)]
    key = lambda r: (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens)
    whole = sorted(lm.score(docs(spark, rows)).collect(), key=key)
    frame = docs(spark, rows).selectExpr("doc_id", "coalesce(text, '') text", "doc_id % 7 = 2 held_out").coalesce(1)
    monkeypatch.setattr(lm, "BLOCK_WORDS", 100)
    parts = [lm.unpacked(bytes(r.payload)) for r in lm.blocks(frame, lm.default_tokenizer()).filter("payload is not null").collect()]
    assert [i for b in parts for i in b.ids] == [r[0] for r in rows] and len(parts) > 20
    assert all(len(np.unique(b.codes)) == len(b.lengths) and len(b.codes) == b.sizes.sum() for b in parts)
    assert all(b.sizes.sum() - b.sizes.max() <= 100 for b in parts)
    cut = sorted(lm.score(docs(spark, rows)).collect(), key=key)
    assert [key(r) for r in cut] == [key(r) for r in whole]
    assert [r.base_score for r in cut] == pytest.approx([r.base_score for r in whole])
