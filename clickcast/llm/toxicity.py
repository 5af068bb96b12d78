"""Operator 8: toxicity by a weighted finite-state pattern grammar.

Five transducers read a document's tokens one after the other. The insult transducer spells a word
and writes its class, with the weight of the longest listed stem (a lexicon induced from training
labels) on the arc. Those of negation, reported speech, threat and target rewrite classes and put
factors on their arcs. Their composition is one automaton, built once as a table; it scores a clause
when it reads its end. A logistic curve over the clause scores, fitted to the training labels, gives
the score.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickcast.llm.common import few_rows_at_once, landed, tidy

MAX_LABELLED = 20_000     # labelled training rows that the lexicon and the curve are fitted to, at most
MIN_DOCS, MIN_PRECISION = 3, 0.85
MIN_EVIDENCE = 9.0        # log-likelihood gain over the toxic share, about the log of the terms tried
STEMS = (3, 4, 5, 6, 7, 8)  # lengths of word beginnings that may be a stem; whole words up to 8 letters end in $
NEGATION_REACH = 3        # tokens

#: Closed word classes of the grammar in English, German, French and Spanish.
THREATS = frozenset("kill hurt destroy beat punch shoot stab burn hang töten umbringen schlagen tuer frapper detruire matar golpear quemar".split())
TARGETS = frozenset("you your youre u he she they him her them this these du dich dir ihr euch sie er tu toi te vous il elle ils usted ustedes tú ti él ella".split())
NEGATIONS = frozenset("not no never none neither nor dont doesnt isnt arent nicht kein keine nie niemals pas jamais aucun nunca ni ningún".split())
REPORTS = frozenset("said says say wrote writes called calls quoted quote reported sagte sagt schrieb dit écrit dijo dice escribió".split())

TOKEN = re.compile(r"[^\W\d_]+|[.!?;:,|\n\"“”«»]")
PAUSES, ENDS, QUOTES = frozenset(":,"), frozenset(".!?;|\n"), frozenset("\"“”«»")


class Lexicon(NamedTuple):
    terms: dict[str, float]

    def weight(self, token: str) -> float:
        best = self.terms.get(token + "$", 0.0) if len(token) <= STEMS[-1] else 0.0
        for k in STEMS:
            if len(token) >= k:
                best = max(best, self.terms.get(token[:k], 0.0))
        return best


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def terms_of(found: list[str]) -> set[str]:
    out = set()
    for t in set(found):
        if len(t) >= STEMS[0]:
            out.update(t[:k] for k in STEMS if k <= len(t))
        if len(t) <= STEMS[-1] and t.isalpha():
            out.add(t + "$")
    return out


# ---------------------------------------------------------------- the transducers

#: Classes that the transducers read and write. The last three are ends of clauses, as written by those
#: of reported speech and threat.
OTHER, TARGET, NEGATION, REPORT, THREAT, INSULT, QUOTE, PAUSE, END, END_SAID, END_THREAT, END_THREAT_SAID = range(12)
N_CLASSES = 12


class Arc(NamedTuple):
    """Reads a class, goes to state ``to`` and writes ``out``. A word's weight w counts w * ``gain`` in its
    clause; an end of a clause turns its sum x into x * ``factor`` + ``bonus``."""

    to: int
    out: int
    gain: float = 1.0
    factor: float = 1.0
    bonus: float = 0.0


Transducer = list[list[Arc]]  # [state][class read]; state 0 is the first


def transducer(n_states: int, arc) -> Transducer:
    return [[arc(s, c) for c in range(N_CLASSES)] for s in range(n_states)]


def word_class(token: str, weight) -> tuple[int, float]:
    """What the insult transducer writes for a whole token, and the weight on its way."""
    if token in QUOTES:
        return QUOTE, 0.0
    if token in PAUSES:
        return PAUSE, 0.0
    if token in ENDS:
        return END, 0.0
    for words, c in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT)):
        if token in words:
            return c, 0.0
    w = weight(token)
    return (INSULT, w) if w else (OTHER, 0.0)


def negation_arc(s: int, c: int) -> Arc:
    """State: tokens that the negation still reaches. A negated threat is none, a negated insult weighs less."""
    if c in (PAUSE, END):
        return Arc(0, c)
    if c == QUOTE:
        return Arc(s, c)
    to = NEGATION_REACH if c == NEGATION else max(0, s - 1)
    return Arc(to, OTHER if s and c == THREAT else c, gain=0.4 if s and c == INSULT else 1.0)


def report_arc(s: int, c: int) -> Arc:
    """State: 1 after a verb of saying, until an end that is no pause; plus 2 inside quotes."""
    said, quoted = s & 1, s & 2
    if c == QUOTE:
        return Arc(said | (2 - quoted), OTHER)
    if c == REPORT:
        return Arc(1 | quoted, OTHER)
    if c in (PAUSE, END):
        return Arc(quoted | (said if c == PAUSE else 0), END_SAID if s else END)
    return Arc(s, c, gain=0.5 if c == INSULT and s == 3 else 1.0)


def threat_arc(s: int, c: int) -> Arc:
    """State: 1 after a threat of this clause."""
    if c == THREAT:
        return Arc(1, OTHER)
    if c in (END, END_SAID):
        return Arc(0, (END_THREAT if c == END else END_THREAT_SAID) if s else c)
    return Arc(s, c)


def target_arc(s: int, c: int) -> Arc:
    """State: 1 after a target of this clause, which raises it and makes a threat count."""
    if c == TARGET:
        return Arc(1, OTHER)
    if c < END:
        return Arc(s, c)
    threat = {END_THREAT: 1.0, END_THREAT_SAID: 0.3}.get(c, 0.0)
    return Arc(0, END, factor=1.5, bonus=1.5 * threat) if s else Arc(0, END)


CASCADE = (transducer(NEGATION_REACH + 1, negation_arc), transducer(4, report_arc), transducer(2, threat_arc), transducer(2, target_arc))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The transducer that reads as ``a`` and writes what ``b`` writes for a's output. Its states are the
    reachable pairs of states; gains and factors multiply, as sums pass through both."""
    number, out = {(0, 0): 0}, []
    for p, q in (pairs := [(0, 0)]):  # grows while it is read
        row = []
        for first in a[p]:
            then = b[q][first.out]
            pair = (first.to, then.to)
            if pair not in number:
                number[pair] = len(pairs)
                pairs.append(pair)
            row.append(Arc(number[pair], then.out, first.gain * then.gain, first.factor * then.factor, first.bonus * then.factor + then.bonus))
        out.append(row)
    return out


GRAMMAR = reduce(compose, CASCADE)


def clause_scores(found: list[str], classes) -> list[float]:
    """Runs the composed automaton over a document's tokens; the scores of its matching clauses.
    ``classes`` maps a token to (class, weight)."""
    out, x, state = [], 0.0, GRAMMAR[0]
    for t in found:
        c, w = classes(t)
        to, written, gain, factor, bonus = state[c]
        state = GRAMMAR[to]
        if w:
            x += w * gain
        elif written == END:
            if x := x * factor + bonus:
                out.append(x)
            x = 0.0
    if x := x * state[END].factor + state[END].bonus:
        out.append(x)
    return out


N_FEATURES = 3


def features(text: str | None, classes) -> list[float]:
    found = tokens(text)
    scores = clause_scores(found, classes) if found else []
    if not scores:
        return [0.0] * N_FEATURES
    total = sum(scores)
    return [min(max(scores), 1.2), np.log1p(total), np.log1p(100 * total / len(found))]


def memo(lexicon: Lexicon):
    """The insult transducer with its last answers kept; most tokens recur."""
    return lru_cache(1 << 17)(lambda token: word_class(token, lexicon.weight))


def labelled(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(text, toxic) of at most ``limit`` labelled training rows, the first by a hash of the id. The
    ids' side of the join has ``limit`` rows at most, so it is broadcast."""
    ids = (
        labels.filter("doc_id is not null and toxic is not null").filter(crc_mod(F.col("doc_id"), 5) != 0)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic")


def learn_lexicon(train: DataFrame) -> Lexicon:
    """Terms that occur in few documents but toxic ones, weighted by their log odds."""

    def count(batches):
        for pdf in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                for t in terms_of(tokens(text)):
                    seen.setdefault(t, [0, 0])[int(toxic > 0)] += 1
            yield pd.DataFrame([(t, a, b) for t, (a, b) in seen.items()], columns=["term", "clean", "toxic"])

    sums = train.mapInPandas(tidy(count), "term string, clean long, toxic long").groupBy("term").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    precise = sums.filter((F.col("toxic") >= MIN_DOCS) & (F.col("toxic") >= MIN_PRECISION * (F.col("toxic") + F.col("clean"))))
    share = train.agg(F.avg((F.col("toxic") > 0).cast("int")).alias("p"))
    n = F.col("toxic") + F.col("clean")
    gain = F.col("toxic") * F.log(F.col("toxic") / n / F.col("p")) + F.when(F.col("clean") > 0, F.col("clean") * F.log(
        F.col("clean") / n / (1 - F.col("p")))).otherwise(0.0)
    precise = precise.withColumn("p", share.scalar()).filter((F.col("p") < 1) & (gain >= MIN_EVIDENCE))
    rows = precise.collect()  # bounded by the words of the toxic texts among at most MAX_LABELLED ids
    return Lexicon(chosen({r.term: (r.toxic, r.clean) for r in rows}))


def chosen(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Of the terms along a word, the longest that has nearly all toxic documents of a shorter one, so
    that a stem says no more than the evidence; then no extensions of a chosen term."""
    out: dict[str, float] = {}
    longer: dict[str, list[str]] = {}
    for t in counts:
        for k in STEMS:
            if k < len(t):
                longer.setdefault(t[:k], []).append(t)
    for term, (toxic, _) in sorted(counts.items(), key=lambda x: (-x[1][0], len(x[0]), x[0])):
        if any(term[:k] in out for k in STEMS if k < len(term)) or any(t in out for t in longer.get(term, ())):
            continue
        same = [t for t in longer.get(term, ()) if counts[t][0] >= 0.95 * toxic]
        term = max(same, key=lambda t: (len(t.rstrip("$")), t.endswith("$")), default=term)
        out[term] = float(np.log((counts[term][0] + 0.5) / (counts[term][1] + 0.5)) / np.log(100))
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 400, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps; without both classes, a constant."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    if not len(y):
        w[0] = -4.0
        return w
    for _ in range(min(steps, 30)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


class Model(NamedTuple):
    lexicon: Lexicon
    curve: np.ndarray


def train_model(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    few_rows_at_once(docs.sparkSession)
    # copies of one text are one observation; the bounded table is read several times
    rows = landed(labelled(docs, labels, limit).dropDuplicates(), "toxic-train")
    lexicon = learn_lexicon(rows)

    def measure(batches):
        classes = memo(lexicon)
        for pdf in batches:
            x = [features(t, classes) for t in pdf["text"]]
            yield pd.DataFrame([(*f, float(y > 0)) for f, y in zip(x, pdf["toxic"])], columns=[*(f"f{k}" for k in range(N_FEATURES)), "y"])

    schema = ", ".join(f"f{k} double" for k in range(N_FEATURES)) + ", y double"
    # bounded: a few numbers for each text of at most MAX_LABELLED ids
    got = np.array([tuple(r) for r in rows.mapInPandas(tidy(measure), schema).collect()], float).reshape(-1, N_FEATURES + 1)
    return Model(lexicon, fit_curve(got[:, :-1], got[:, -1]))


def score_documents(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` (doc_id, text, others) -> all its columns and a score in ``column``. No shuffle."""
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    names = docs.columns

    def run(batches):
        classes = memo(model.lexicon)
        for rb in batches:
            texts = rb.column("text").to_pylist()
            x = np.array([features(t, classes) for t in texts]).reshape(len(texts), N_FEATURES)
            z = model.curve[0] + x @ model.curve[1:]
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in names), pa.array(1 / (1 + np.exp(-z)), pa.float64())], [*names, column])

    return docs.mapInArrow(tidy(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` and ``labels`` -> (doc_id, held_out, score, predicted), one row per document.

    Labels are read only from rows whose crc32(doc_id) mod 5 is not 0, and at most MAX_LABELLED of
    them; several labels of one id count as their largest, null ids and labels are left out. A null
    or empty text has no clause and gets the score of such a text. Without labels every document
    scores low. Repeated rows score alike; other columns are not read.
    """
    model = train_model(docs, labels)
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
