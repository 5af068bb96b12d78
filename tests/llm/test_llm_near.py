"""SimHash near-dedup (2), substring dedup (6) and fingerprints (7)."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import xxhash
from llm_cases import DOCS, PASSAGE, SMALL, docs

from clickcast.llm import fingerprints, simhash, substring

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_simhash(rows):
    fps = []
    for _, text in rows:
        w = WORDS.findall((text or "").translate(LOW))
        sh = [" ".join(w[k:k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, f"{fps[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def test_simhash_cases(spark):
    got = simhash.near_duplicates(docs(spark)).collect()
    assert sorted(map(tuple, got), key=str) == brute_simhash([r[:2] for r in DOCS])
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_simhash_small_table_against_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = simhash.near_duplicates(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    assert sorted(map(tuple, got), key=str) == brute_simhash([tuple(r) for r in rows])


def brute_roots(sig, group, side, cross, radius):
    """Label of each row's component among allowed pairs."""
    n = len(sig)
    label = list(range(n))
    for a in range(n):
        for b in range(a):
            d = int(np.bitwise_count(sig[a] ^ sig[b]).sum())
            if group[a] == group[b] and d <= radius and (not cross[a] or side[a] != side[b]):
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def test_bit_sliced_forest_against_brute_force():
    rng = np.random.default_rng(3)
    for words, radius, n in ((1, 4, 300), (4, 44, 200), (1, 0, 70), (1, 20, 150)):
        base = rng.integers(0, 1 << 63, (5, words), dtype=np.uint64)
        sig = base[rng.integers(0, 5, n)].copy()
        for row in sig:
            for b in rng.choice(64 * words, rng.integers(0, 2 * radius + 3), replace=False) if radius else []:
                row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        group = np.sort(rng.integers(0, 6, n))
        start = np.searchsorted(group, group)
        side, cross = rng.random(n) < 0.5, group % 2 == 1
        root, unsure = simhash.forest(sig, start, side, cross, radius)
        assert not len(unsure)
        want = brute_roots(sig, group, side, cross, radius)
        assert len({*zip(root.tolist(), want)}) == len(set(root.tolist())) == len(set(want))
        same, unsure = simhash.forest(sig, start, side, cross, radius, radius + 6)
        assert (same == root).all()
        wider = brute_roots(sig, group, side, cross, radius + 6)
        for a, b in unsure.tolist():  # doubtful pairs join different trees, and with them all wider links are covered
            assert same[a] != same[b] and radius < int(np.bitwise_count(sig[a] ^ sig[b]).sum()) <= radius + 6
            x, y = sorted((root[a], root[b]))
            root = np.where(root == y, x, root)
        assert len({*zip(root.tolist(), wider)}) == len(set(wider))


def test_oversized_buckets_are_tiled_without_losing_links(spark, monkeypatch):
    rows = [(i, " ".join(f"t{(k * 7 + (i if k == i % 50 else 0)) % 60}" for k in range(200)), "en", "a", 1) for i in range(120)]
    monkeypatch.setattr(simhash, "TILE", 16)
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute_simhash([r[:2] for r in rows])


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (201, 200), (200, 201)]
    random.Random(1).shuffle(chain)
    got = dict(map(tuple, simhash.components(spark.createDataFrame(chain, "u long, v long")).collect()))
    want = {k: 0 for k in range(61)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}
    assert got == want
    assert simhash.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_exact_tables_find_every_pair_within_the_radius():
    masks = simhash.block_masks(4, 6)
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.integers(0, 1 << 63, (1, 1), dtype=np.uint64)
        b = a.copy()
        for k in rng.choice(64, 4, replace=False):
            b[0, 0] ^= np.uint64(1) << np.uint64(k)
        assert (simhash.bucket_keys(a, masks) == simhash.bucket_keys(b, masks)).any()


def test_one_of_each_group_of_near_copies_stays(spark):
    rng = random.Random(5)
    base = [[f"v{rng.randrange(5000)}" for _ in range(150)] for _ in range(8)]
    rows = [(100 + k, " ".join(w), "en", "a", 1) for k, w in enumerate(base)]
    rows += [(200 + k, " ".join(w[:70] + ["edited"] + w[71:]), "en", "a", 1) for k, w in enumerate(base)]
    rows += [(None, " ".join(base[0]), "en", "a", 1), (100, " ".join(base[0]), "en", "a", 1), (300, None, "en", "a", 1), (301, "", "en", "a", 1)]
    d = docs(spark, rows)
    out = simhash.distinct_documents(d)
    assert out.columns == d.columns
    assert sorted(r.doc_id for r in out.collect()) == [*range(100, 108), 300]
    assert simhash.distinct_documents(docs(spark, [])).count() == 0


def brute_distinct(rows, similarity=0.8, width=5):
    """The smallest id of each component of the pairs whose shingle sets are similar."""
    sets = []
    for _, t, *_ in rows:
        w = t.split()
        sets.append({tuple(w[p:p + width]) for p in range(len(w) - width + 1)})
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common >= similarity * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((label[a], label[b]))
                label = [x if v == y else v for v in label]
    return sorted(rows[k][0] for k in set(label))


def replaced(rng, base, places):
    out = list(base)
    for p in places:
        out[p] = f"x{rng.randrange(10**9)}"
    return out


def test_documents_of_a_template_below_the_similarity_all_stay(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"v{rng.randrange(10**6)}" for _ in range(605)]
    rows = [(k, " ".join(replaced(rng, base, rng.sample(range(5, 600, 10), 9))), "en", "a", 1) for k in range(150)]
    want = brute_distinct(rows)
    assert len(want) > 110
    assert sorted(r.doc_id for r in simhash.distinct_documents(docs(spark, rows)).collect()) == want
    monkeypatch.setattr(simhash, "GROUP_ROWS", 32)  # the group in tiles
    assert sorted(r.doc_id for r in simhash.distinct_documents(docs(spark, rows)).collect()) == want


def test_groups_link_by_any_pair_around_the_similarity(spark):
    rng, rows = random.Random(3), []
    for g in range(12):
        base = [f"g{g}v{rng.randrange(10**6)}" for _ in range(405)]
        for side in (base, replaced(rng, base, range(5, 85, 10))):
            rows += [(len(rows) + k, " ".join(replaced(rng, side, rng.sample(range(85, 400, 10), rng.randrange(4)))), "en", "a", 1) for k in range(6)]
    want = brute_distinct(rows)
    assert 12 < len(want) < 24  # some of the two groups link, some do not
    assert sorted(r.doc_id for r in simhash.distinct_documents(docs(spark, rows)).collect()) == want


def brute_substring(rows, window=35):
    seen = Counter()
    ws = [WORDS.findall(t or "") for _, t in rows]
    for w in ws:
        seen.update(tuple(w[p:p + window]) for p in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, ws):
        gone = set()
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p:p + window])] > 1:
                gone.update(range(p, p + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring_cases(spark):
    got = substring.digest(docs(spark)).collect()
    assert sorted(map(tuple, got), key=str) == brute_substring([r[:2] for r in DOCS])
    assert substring.digest(docs(spark, [])).count() == 0
    d = docs(spark)
    assert substring.deduplicated(d).columns == [*d.columns, "n_words__", "n_removed__"]


def test_substring_random_overlaps_and_periods(spark):
    rng = random.Random(2)
    parts = [[f"{rng.choice('abcdefg')}{rng.randrange(9)}" for _ in range(rng.choice([10, 34, 35, 36, 50, 90]))] for _ in range(12)]
    parts += [["a", "b"] * 30, ["z"] * 80, ["q", "r", "s"] * 13]
    rows = []
    for i in range(160):
        w = [x for _ in range(rng.randrange(1, 6)) for x in rng.choice(parts)]
        for _ in range(rng.randrange(0, 3)):
            w.insert(rng.randrange(len(w)), f"u{rng.randrange(10**6)}")
        rows.append((i, " ".join(w)))
    got = substring.digest(docs(spark, [(*r, "en", "a", 1) for r in rows])).collect()
    assert sorted(map(tuple, got), key=str) == brute_substring(rows)


def test_least_positions_are_leftmost():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 5, 200).astype(np.uint64)
    for width in (1, 2, 3, 20):
        want = [i + int(np.argmin(h[i:i + width])) for i in range(len(h) - width + 1)]
        assert substring.least_positions(h, width).tolist() == want


def test_fingerprint_cases(spark):
    order = sorted(((i, t or "") for i, t, *_ in DOCS if i is not None), key=lambda r: -r[0])
    for parts in (1, 3, 40):
        got = fingerprints.fingerprints(docs(spark), parts).collect()
        assert len(got) == len(DOCS)
        by = {}
        for r in got:
            by.setdefault(r.doc_id, []).append(r)
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by[1][0].fingerprint == by[10][0].fingerprint == fingerprints.fingerprint(DOCS[0][1])
        for (i, text), (j, after) in zip(order, order[1:]):
            if i in (5, 6, 7, 8) or j in (5, 7):  # neighbours among equal ids are a matter of the tie rule
                continue
            half = len(text) // 2
            edited = text[:len(text) - half] + after[:half]
            assert by[i][0].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert by[i][0].edited_fingerprint == fingerprints.fingerprint(edited)
    last = by[None][0]  # null ids come last; after the last, the first
    text, first = DOCS[4][1], DOCS[12][1]
    half = len(text) // 2
    assert last.edited_sha256 == hashlib.sha256((text[:len(text) - half] + first[:half]).encode()).hexdigest()
    assert fingerprints.fingerprints(docs(spark, [])).count() == 0
    alone = fingerprints.fingerprints(docs(spark, [(1, "abcd", "en", "a", 4)])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and alone.near_next == 1.0


def test_fingerprints_tell_texts_apart_and_locate_edits():
    rng = random.Random(4)
    text = "\n".join(" ".join(f"w{rng.randrange(999)}" for _ in range(30)) + "." for _ in range(40))
    f = fingerprints.fingerprint
    variants = {text, text + "\n", text + " ", "", "\n", " ", text.replace("w1 ", "w2 "), text[1:]}
    assert len({f(t) for t in variants}) == len(variants)
    lines = text.split("\n")
    lines[20] = "something else here."
    a, b = f(text), f("\n".join(lines))
    assert 0.9 < fingerprints.likeness(a, b) < 1 and fingerprints.likeness(a, b) == fingerprints.likeness(b, a)
    gone, new = fingerprints.edits(a, b)
    assert gone and new and set(new) <= set(fingerprints.leaves(lines[20]))
    assert fingerprints.likeness(a, f(PASSAGE)) < 0.1 and fingerprints.likeness(f(""), f("")) == 1.0


def test_one_of_each_group_equals_components(spark):
    """The pipeline's stage: per component of the operator's own links, the least id; whole rows."""
    d = docs(spark).selectExpr("*", "1 as __row", "'x' as component_id")
    out = simhash.one_of_each_group(d)
    want = {r.component_id for r in simhash.near_duplicates(docs(spark)).collect()}
    assert out.columns == d.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)
    small = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {r.component_id for r in simhash.near_duplicates(small).collect()}
    assert sorted(r.doc_id for r in simhash.one_of_each_group(small).collect()) == sorted(want)
    assert simhash.one_of_each_group(docs(spark, [])).count() == 0
