"""Operator 11: secret scans over a trigram inverted index (DataFrame functions only).

1. Each rule's regular expression yields a Boolean query over trigrams of the lower-cased text: an OR of
   ANDs that every match must satisfy, whichever way it matches.
2. The index holds postings (trigram, row id). A scan needs the postings of its rules' trigrams alone;
   ``postings`` makes those, or all trigrams of all texts where rules are not known yet.
3. Postings of a row are counted per branch of each query; a row is a candidate of a rule if some branch
   has all its trigrams there. Candidates alone are verified with the expression. A rule that no trigram
   must accompany is run over all texts.
4. Matches become spans: gaps and matches of a text alternate, so running sums of their lengths give
   the places; only lengths are shuffled for that.
"""

from __future__ import annotations

import itertools
from re import _constants as sre
from re import _parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickcast.llm.common import free_name, landed, with_row_id

MOST_STRINGS = 64   # strings that a part of an expression may stand for, beyond that it counts as anything
MOST_BRANCHES = 64
ANYTHING = frozenset([frozenset()])  # the query that every text satisfies


class Rule(NamedTuple):
    """A kind of secret: an expression that Java and Python read alike and that never matches nothing;
    matches whose ``group`` is shorter than ``least`` code points are dropped."""
    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: The base rules.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)

#: Public formats of keys.
ADDED = (
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY[A-Z ]*-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{20,}"),
    Rule("login", r"://[A-Za-z0-9._%+-]+:([^\x20\x09-\x0D:@/]{6,})@", 1, 6),
)


# ---------------------------------------------------------------- Boolean queries

def trigrams(s: str) -> frozenset:
    return frozenset(s[k:k + 3] for k in range(len(s) - 2))


def either(*queries: frozenset) -> frozenset:
    """OR; a branch that asks for more than another one is superfluous."""
    branches = frozenset().union(*queries)
    return frozenset(b for b in branches if not any(o < b for o in branches))


def both(a: frozenset, b: frozenset) -> frozenset:
    """AND; where that has too many branches, the more telling side alone, which every match satisfies too."""
    if len(a) * len(b) > MOST_BRANCHES:
        return max(a, b, key=lambda q: min(map(len, q)))
    return either(frozenset(x | y for x in a for y in b))


def of_strings(strings: frozenset) -> frozenset:
    """One of these strings occurs: all its trigrams do."""
    return either(frozenset(trigrams(s) for s in strings))


class _Part(NamedTuple):
    """What a piece of an expression can match: exactly ``strings``, or (None) anything with ``query``."""
    strings: frozenset | None
    query: frozenset


EMPTY = _Part(frozenset([""]), ANYTHING)


def _after(a: _Part, b: _Part, open_: list) -> _Part:
    """``a`` then ``b``. ``open_`` collects what is known of strings that cannot be carried on."""
    if b.strings is not None and a.strings is not None and len(a.strings) * len(b.strings) <= MOST_STRINGS:
        return _Part(frozenset(x + y for x in a.strings for y in b.strings), ANYTHING)
    for part in (a, b):
        open_.append(part.query if part.strings is None else of_strings(part.strings))
    return _Part(frozenset([""]), ANYTHING) if b.strings is None else b


def _sequence(items) -> _Part:
    """A concatenation. Strings are carried on from item to item as long as they are few."""
    known, exact, done = EMPTY, True, []
    for op, arg in items:
        part = _item(op, arg)
        fits = part.strings is not None and len(known.strings) * len(part.strings) <= MOST_STRINGS
        exact &= fits
        known = _after(known, part, done)
    if exact:
        return known
    query = of_strings(known.strings)
    for q in done:
        query = both(query, q)
    return _Part(None, query)


def _item(op, arg) -> _Part:
    if op is sre.LITERAL:
        return _Part(frozenset([chr(arg).lower() if arg < 128 else chr(arg)]), ANYTHING)
    if op is sre.IN:
        chars = set()
        for kind, what in arg:
            if kind is sre.LITERAL:
                chars.add(what)
            elif kind is sre.RANGE and what[1] - what[0] < MOST_STRINGS:
                chars.update(range(what[0], what[1] + 1))
            else:
                return _Part(None, ANYTHING)
        strings = frozenset(chr(c).lower() if c < 128 else chr(c) for c in chars)
        return _Part(strings, ANYTHING) if len(strings) <= 8 else _Part(None, ANYTHING)
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(p.strings is not None for p in parts):
            strings = frozenset().union(*(p.strings for p in parts))
            if len(strings) <= MOST_STRINGS:
                return _Part(strings, ANYTHING)
        return _Part(None, either(*(p.query if p.strings is None else of_strings(p.strings) for p in parts)))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, inner = arg
        part = _sequence(inner)
        if part.strings is not None and high <= 4:
            strings = frozenset("".join(t) for k in range(low, high + 1) for t in itertools.product(part.strings, repeat=k)) \
                if len(part.strings) ** high <= MOST_STRINGS else None
            if strings is not None and len(strings) <= MOST_STRINGS:
                return _Part(strings, ANYTHING)
        if low == 0:
            return _Part(None, ANYTHING)
        return _Part(None, part.query if part.strings is None else of_strings(part.strings))
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return EMPTY
    return _Part(None, ANYTHING)


def trigram_query(regex: str) -> frozenset:
    """Branches of trigrams (of lower-cased text): every text in which ``regex`` matches holds all
    trigrams of one branch. A branch without trigrams: nothing is known of the texts.

    A-Z is lower-cased throughout, so an expression's case does not matter; other letters are taken as
    they stand, and case-blind expressions must not hold any."""
    part = _sequence(parser.parse(regex))
    return part.query if part.strings is None else of_strings(part.strings)


# ---------------------------------------------------------------- the index

def postings(rows: DataFrame, vocabulary=None, row: str = "row_id", text: str = "text") -> DataFrame:
    """(trigram, row id), each pair once. With a ``vocabulary``, the postings of those trigrams; else of
    all trigrams of the lower-cased texts."""
    rows = rows.select(F.col(row).alias("row_id"), F.lower(text).alias("folded"))  # once a text, however often it is read
    folded = F.col("folded")
    if vocabulary is None:
        found = F.array_distinct(F.regexp_extract_all(folded, F.lit(r"(?s)(?=([^\x{DC00}-\x{DFFF}]..))"), F.lit(1)))
    else:
        found = F.array_compact(F.array(*(F.when(F.contains(folded, F.lit(t)), F.lit(t)) for t in sorted(vocabulary))))
    # outer, as the filter that Spark puts before a plain explode would lower-case the text once a trigram
    return rows.select("row_id", F.explode_outer(found).alias("trigram")).filter("trigram is not null").select("trigram", "row_id")


def candidates(index: DataFrame, queries: dict[str, frozenset]) -> DataFrame:
    """(row_id, kinds): the rows that satisfy a query. The postings of each branch's trigrams intersect
    where a row has as many of them as the branch has; the counters of a row have a fixed size."""
    branches = {f"b{k}": (kind, branch) for k, (kind, branch) in enumerate(
        (kind, sorted(b)) for kind, q in queries.items() for b in sorted(q, key=sorted))}
    counted = index.filter(F.col("trigram").isin(sorted({t for _, b in branches.values() for t in b}))).groupBy("row_id").agg(
        *(F.count_if(F.col("trigram").isin(b)).alias(name) for name, (_, b) in branches.items()))

    def satisfied(kind: str) -> Column:
        hits = [F.col(name) == len(b) for name, (k, b) in branches.items() if k == kind]
        return F.exists(F.array(*hits), lambda x: x)

    kinds = F.array_compact(F.array(*(F.when(satisfied(kind), F.lit(kind)) for kind in queries)))
    return counted.select("row_id", kinds.alias("kinds")).filter(F.size("kinds") > 0)


# ---------------------------------------------------------------- verification

def matches(rows: DataFrame, rule: Rule, number: int) -> DataFrame:
    """(row_id, kind_no, kind, start, end, secret) of one rule in (row_id, text), leftmost and without
    overlaps; code points, end exclusive."""
    regex = F.lit(rule.regex)
    part = F.struct(
        F.transform(F.split("text", rule.regex, -1), lambda x: F.length(x)).alias("gaps"),
        F.regexp_extract_all("text", regex, F.lit(0)).alias("hits"),
        F.regexp_extract_all("text", regex, F.lit(rule.group)).alias("values"))
    one = (
        rows.filter(F.col("text").rlike(rule.regex)).select("row_id", part.alias("p"))
        .select("row_id", F.posexplode(F.arrays_zip("p.gaps", "p.hits", "p.values")).alias("at", "m"))
        .filter("m.hits is not null")  # the gap behind the last match
        .select("row_id", "at", F.col("m.gaps").alias("gap"), F.length("m.hits").alias("size"),
                (F.length("m.values") >= rule.least).alias("holds"), F.col("m.hits").alias("hit"))
        .withColumn("secret", F.when(F.col("holds"), F.col("hit"))).drop("hit")
    )
    upto = Window.partitionBy("row_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return one.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(upto)).filter("holds").select(
        "row_id", F.lit(number).alias("kind_no"), F.lit(rule.kind).alias("kind"), (F.col("end") - F.col("size")).alias("start"), "end", "secret")


def find_secrets(rows: DataFrame, rules=BASE + ADDED, row: str = "row_id", text: str = "text") -> DataFrame:
    """(row_id, kind_no, kind, start, end, secret), one row per match, for rows with an id.

    Places count code points, end exclusive; ``kind_no`` is the rule's place in ``rules``. Spans of
    different rules may overlap, those of one rule don't. Null or empty texts have none, equal texts
    have equal ones. No rows, or no rules: no spans. Only ``row`` and ``text`` are read.
    """
    rows = rows.select(F.col(row).alias("row_id"), F.col(text).cast("string").alias("text"))
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    blind = [r for r in rules if frozenset() in queries[r.kind]]
    telling = {r.kind: queries[r.kind] for r in rules if r not in blind}
    spans = None
    if telling:
        vocabulary = {t for q in telling.values() for b in q for t in b}
        found = landed(candidates(postings(rows, vocabulary), telling), "secret-candidates")
        picked = landed(rows.join(found, "row_id"), "secret-texts")  # candidates' texts, read once per rule
    for number, rule in enumerate(rules):
        source = rows if rule in blind else picked.filter(F.array_contains("kinds", rule.kind))
        got = matches(source, rule, number)
        spans = got if spans is None else spans.unionByName(got)
    if spans is None:
        return rows.limit(0).selectExpr("row_id", "0 as kind_no", "'' as kind", "0L as start", "0L as end", "text as secret")
    return spans


def secrets(docs: DataFrame, base=BASE, added=ADDED, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` -> (doc_id, n_<kind> of each base rule, base_sha256, spans), one row per input row.

    ``spans`` lists kind:start:end of all rules by start, then by the rules' order, joined by commas;
    ``base_sha256`` is the digest of that list for the base rules alone. A null or empty text, or one
    without secrets, has an empty list. Repeated rows, and rows whose id is null or occurs again, each
    keep a row of their own; other columns are not read. An empty table gives no rows.
    """
    row = free_name(docs, "row_id")
    rows = with_row_id(docs.select(id_col, text), "secret-rows", row)
    spans = find_secrets(rows, base + added, row, text)
    listed = spans.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("start", "kind_no", "kind", "end"))).alias("s"))

    def joined(s: Column) -> Column:
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    s = F.coalesce("s", F.array().cast("array<struct<start:bigint,kind_no:int,kind:string,end:bigint>>"))
    out = rows.select(F.col(row).alias("row_id"), F.col(id_col).alias(id_col)).join(listed, "row_id", "left").withColumn("s", s)
    def count(kind: str) -> Column:
        return F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(
        id_col, *(count(r.kind) for r in base), F.sha2(joined(F.filter("s", lambda x: x["kind_no"] < len(base))), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))
