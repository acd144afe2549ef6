"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, reported speech,
other). A clause is read from its end first, by a transducer that marks the
insults with a target anywhere after them and the threats with one within four
words: whom they are aimed at. Four transducers then rewrite and weigh the
symbols from the start: negation weakens what follows within three words,
reported speech what follows in the clause; the insult transducer strengthens
insults with a target before or after, the threat transducer threats that are
aimed at a target; the last reads off what is matched. These four are composed
once into one table of states, so a clause is scored by one walk in each
direction, and words outside a match add nothing. A document's score is a
logistic function of its clause scores.

Insults are weighted terms (words or word beginnings) learned from labelled
documents. Threat verbs are a fixed list: one aimed at a target weighs at least
``THREAT_WEIGHT``, any other only what was learned of it. Targets, negations and
reporting words are fixed lists as well. What is learned comes from a bounded
sample of labelled rows, counted on the executors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import crc_mod, settle

SYMBOLS = OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, AIMED_INSULT, AIMED_THREAT = range(8)
THREAT_WEIGHT = 1.0

# Function words of English, French, German and Spanish.
TARGETS = "you your he she they them him her people everyone tu toi vous il elle ils elles gens du dich dir ihr sie er leute tú usted ustedes él ella ellos ellas gente".split()
NEGATIONS = "not never no isn't aren't don't without ne pas jamais aucun sans nicht kein keine nie ohne nunca jamás ningún sin".split()
REPORTS = "said says say wrote writes quoted called claims dit disait écrit appelle sagte sagt schrieb nannte dijo dice escribió llamó".split()
THREATS = "kill hurt destroy beat stab shoot tuer frapper détruire töten schlagen zerstören matar golpear destruir".split()

TOKENS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]")
ENDS = frozenset(".!?;:\n")


@dataclass
class Transducer:
    """A deterministic weighted transducer: (state, symbol) to (state, symbol, log weight).

    A missing arc keeps state ``rest[state]`` and the symbol at weight 0.
    """

    arcs: dict[tuple[int, int], tuple[int, int, float]]
    rest: dict[int, int] = field(default_factory=dict)
    states: int = 1

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        found = self.arcs.get((state, symbol))
        return found if found is not None else (self.rest.get(state, state), symbol, 0.0)

    def compose(self, then: Transducer, symbols: int = len(SYMBOLS)) -> Transducer:
        """The transducer that feeds this one's output to ``then``."""
        arcs, rest = {}, {}
        for a in range(self.states):
            for b in range(then.states):
                for s in range(symbols):
                    a2, mid, w1 = self.step(a, s)
                    b2, out, w2 = then.step(b, mid)
                    arcs[a * then.states + b, s] = (a2 * then.states + b2, out, w1 + w2)
                rest[a * then.states + b] = arcs[a * then.states + b, OTHER][0]
        return Transducer(arcs, rest, self.states * then.states)


MATCHES = (INSULT, THREAT, AIMED_INSULT, AIMED_THREAT)


def aim(scope: int = 4) -> Transducer:
    """Read from the end: marks insults before any target, and threats within ``scope`` words before one.

    State 0 has seen no target, state 1 one further away, state k + 1 one within k words.
    """
    arcs = {(s, TARGET): (scope + 1, TARGET, 0.0) for s in range(scope + 2)}
    arcs |= {(s, INSULT): (max(s - 1, 1), AIMED_INSULT, 0.0) for s in range(1, scope + 2)}
    arcs |= {(s, THREAT): (s - 1, AIMED_THREAT, 0.0) for s in range(2, scope + 2)}
    return Transducer(arcs, {s: max(s - 1, 1) for s in range(1, scope + 2)}, scope + 2)


def negation(scope: int = 3, weight: float = math.log(0.4)) -> Transducer:
    arcs = {(s, NEGATION): (scope, OTHER, 0.0) for s in range(scope + 1)}
    arcs |= {(s, k): (s - 1, k, weight) for s in range(1, scope + 1) for k in MATCHES}
    return Transducer(arcs, {s: max(0, s - 1) for s in range(scope + 1)}, scope + 1)


def reported(weight: float = math.log(0.6)) -> Transducer:
    arcs = {(s, REPORT): (1, OTHER, 0.0) for s in range(2)} | {(1, k): (1, k, weight) for k in MATCHES}
    return Transducer(arcs, {}, 2)


def insults(weight: float = math.log(1.5)) -> Transducer:
    """An insult with a target before it, or marked as having one after it."""
    arcs = {(s, TARGET): (1, TARGET, 0.0) for s in range(2)} | {(1, INSULT): (1, AIMED_INSULT, weight)}
    arcs |= {(s, AIMED_INSULT): (s, AIMED_INSULT, weight) for s in range(2)}
    return Transducer(arcs, {}, 2)


def threats(weight: float = math.log(2.0)) -> Transducer:
    """A threat at a target; another announced threat in the clause adds nothing to it but itself."""
    return Transducer({(0, AIMED_THREAT): (0, AIMED_THREAT, weight)}, {}, 1)


def matched() -> Transducer:
    return Transducer({(0, k): (0, OTHER, 0.0) for k in (TARGET, NEGATION, REPORT)}, {}, 1)


FORWARD = (negation, reported, insults, threats, matched)


@dataclass
class Grammar:
    """Tables by state and symbol: (next state, mark) from the end, (next state, mark, factor) from the start."""

    back: list[list[tuple[int, int]]]
    ahead: list[list[tuple[int, int, float]]]

    def score(self, symbols: list[int], weights: list[float]) -> float:
        """A clause's score: the weights of its matches, each times the factor of its pattern."""
        marked, state = list(symbols), 0
        for i in range(len(symbols) - 1, -1, -1):
            state, marked[i] = self.back[state][symbols[i]]
        total, state = 0.0, 0
        for symbol, weight in zip(marked, weights, strict=True):
            state, out, factor = self.ahead[state][symbol]
            if out in MATCHES:
                total += (max(weight, THREAT_WEIGHT) if out == AIMED_THREAT else weight) * factor
        return total


def grammar() -> Grammar:
    """The composed grammar."""
    first, *others = [make() for make in FORWARD]
    for then in others:
        first = first.compose(then)
    ahead = [[(nxt, out, math.exp(w)) for nxt, out, w in (first.step(s, k) for k in SYMBOLS)] for s in range(first.states)]
    marks = aim()
    return Grammar([[marks.step(s, k)[:2] for k in SYMBOLS] for s in range(marks.states)], ahead)


class Lexicon(dict):
    """Word to (symbol, weight) by its longest known term; a bounded number of words is remembered."""

    def __init__(self, terms: dict[str, float], bound: int = 300_000):
        super().__init__()
        self.terms, self.bound = terms, bound
        self.lengths = sorted({len(t) for t in terms if not t.endswith("$")}, reverse=True)
        self.fixed = {w: TARGET for w in TARGETS} | {w: NEGATION for w in NEGATIONS} | {w: REPORT for w in REPORTS}

    def __missing__(self, word: str) -> tuple[int, float]:
        found = self._look(word)
        if len(self) >= self.bound:
            self.clear()
        self[word] = found
        return found

    def _look(self, word: str) -> tuple[int, float]:
        if (k := self.fixed.get(word)) is not None:
            return k, 0.0
        threat = word in THREATS
        for term in [word + "$", *(word[:n] for n in self.lengths if n <= len(word))]:
            if (w := self.terms.get(term)) is not None:
                return (THREAT if threat else INSULT), w
        return (THREAT if threat else OTHER), 0.0


def clauses(text: str | None, lexicon: Lexicon, table: Grammar) -> list[float]:
    """Scores above 0 of the clauses of a whole text."""
    out: list[float] = []
    symbols: list[int] = []
    weights: list[float] = []
    found = False
    for token in [*TOKENS.findall(text.lower()), "."] if text else []:
        if token in ENDS:
            if found and (score := table.score(symbols, weights)) > 0:
                out.append(score)
            symbols, weights, found = [], [], False
            continue
        symbol, weight = lexicon[token]
        symbols.append(symbol)
        weights.append(weight)
        found = found or symbol == INSULT or symbol == THREAT
    return out


def features(scores: list[float]) -> list[float]:
    return [math.log1p(max(scores, default=0.0)), math.log1p(sum(scores)), float(bool(scores))]


#: Weights of the features where there is nothing to calibrate them on: a clause of weight 1.5 and more is toxic.
UNFITTED = [2.2, 0.0, 0.0, -2.0]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Logistic regression by Newton's method; the intercept is last. Without rows of both labels, ``UNFITTED``."""
    if len(set(y.tolist())) < 2:
        return np.array(UNFITTED)
    x = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ b)
    return b


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial document counts of words ($ at the end) and word beginnings, by label."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        terms = sorted(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())], names=["term", "pos", "neg"])
        counts[0].clear()
        counts[1].clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen: set[str] = set()
            for w in set(TOKENS.findall(text.lower())) if text else ():
                if w not in ENDS:
                    seen.add(w + "$")
                    seen.update(w[:n] for n in range(3, min(len(w), 8) + 1))
            counts[label].update(seen)
            if len(counts[0]) + len(counts[1]) > 200_000:
                yield flush()
    yield flush()


def weigh(rows: list, n_pos: int, n_neg: int) -> dict[str, float]:
    """Smoothed log-odds weights of (term, pos, neg) document counts."""
    return {term: math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1)) for term, pos, neg in rows}


@dataclass
class Model:
    terms: dict[str, float]
    weights: list[float] | None


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, held_mod: int, held_rem: int, sample_rows: int = 12_000, least: int = 5, purity: float = 0.6, nats: float = 12.0) -> Model:
    """Terms and calibration from at most ``sample_rows`` labelled rows, those with the smallest hash of their id.

    A term needs ``least`` toxic documents, a share of ``purity`` of them, and a
    log likelihood ratio of ``nats`` against the share among all rows. Two rows
    in seven are set aside from that, to calibrate scores on texts whose terms
    were not counted; without both labels among them, fixed weights are taken.
    Terms come to the driver; the sample bounds how many there can be.
    """
    ship(docs.sparkSession)
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (crc_mod(id_col, held_mod) != held_rem)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    order = F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit("toxicity")), F.lit(1 << 30))
    bound = int(min(1.0, 1.1 * sample_rows / max(1, usable.count())) * (1 << 30))
    chosen = usable.where(order < bound).orderBy(order, "_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    rows = settle(rows.select("text", "_y", (F.crc32(F.col("_id").cast("string").cast("binary")) % 7 < 2).alias("_aside")), "labelled")
    aside = rows.where("_aside").select("text", "_y")
    rows = rows.where("not _aside").select("text", "_y")
    n = {r._y: r["count"] for r in rows.groupBy("_y").count().collect()}
    if not n:
        return Model({}, None)
    counts = rows.mapInArrow(_terms, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    base = max(n.get(1, 0), 1) / (sum(n.values()) + 1)
    share = F.col("pos") / (F.col("pos") + F.col("neg"))
    surprise = F.col("pos") * F.log(share / base) - (F.col("pos") - base * (F.col("pos") + F.col("neg")))
    good = counts.where((F.col("pos") >= least) & (share >= purity)).where(surprise >= nats)
    terms = weigh([tuple(r) for r in good.orderBy("term").collect()], n.get(1, 0), n.get(0, 0))
    shared = docs.sparkSession.sparkContext.broadcast(Model(terms, None))
    marked = aside.mapInArrow(_features(shared), "f0 double, f1 double, f2 double, y int").limit(sample_rows).collect()
    x = np.array([[r.f0, r.f1, r.f2] for r in marked], np.float64).reshape(-1, 3)
    return Model(terms, fit(x, np.array([r.y for r in marked], np.float64)).tolist())


def _features(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, table = Lexicon(shared.value.terms), grammar()
        for batch in batches:
            f = np.array([features(clauses(t, lexicon, table)) for t in batch.column(0).to_pylist()], np.float64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(f[:, k]) for k in range(3)), batch.column(1)], names=["f0", "f1", "f2", "y"])

    return run


def score_texts(model: Model, texts: list[str | None], lexicon: Lexicon, table: Grammar) -> np.ndarray:
    if model.weights is None:
        return np.zeros(len(texts))
    f = np.array([features(clauses(t, lexicon, table)) for t in texts], np.float64).reshape(-1, 3)
    w = np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(f @ w[:-1] + w[-1], -30, 30)))


def _run(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lexicon, table = Lexicon(model.terms), grammar()
        for batch in batches:
            p = score_texts(model, batch.column(1).to_pylist(), lexicon, table)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["id", "score"])

    return run


def score(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    held_mod: int = 5,
    held_rem: int = 0,
    **learning,
) -> DataFrame:
    """(``id_col``, score) for every row of ``docs``; higher means likelier toxic.

    Learns from rows of ``labels`` (same id column) whose crc32 modulo
    ``held_mod`` is not ``held_rem``; ids and labels are not inputs of a score.
    Null and empty texts have no clauses and get the score of that, a text of
    any length is read whole. Without labelled rows all scores are 0. Repeated
    rows each get a row, an empty table gives none, and other columns of either
    table are not read.
    """
    model = learn(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, held_mod=held_mod, held_rem=held_rem, **learning)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_run(shared), f"id {kind}, score double").withColumnRenamed("id", id_col)
