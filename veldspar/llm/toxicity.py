"""Toxicity by a weighted finite-state pattern grammar that scores clauses.

Words are read as classes: insults (learned from labels, as words or word beginnings with weights),
threats, targets, negations and verbs of reported speech. Transducers are composed into two automata that
run over each sentence, one from its start and one from its end. The first two transducers mark insults and threats;
each later one rewrites the marks that it reads: as directed at a target on either side, as negated by
what stands before, as reported by a verb on either side. Commas, colons and quotation marks don't end
a sentence, so `he said: "you dolt"` and `you dolt, he said` are both reported. A mark has what either automaton says.
A sentence's score is the weight of its marks by kind. A logistic regression over the kinds' totals, the
strongest mark and their density gives the document's score, so what negation or reporting is
worth is learned too.

Bounds of the fit: learn.PER_CLASS labelled texts of either class, of at most learn.FIT_BYTES each.
Defined cases: null and empty texts get the score of a text without any mark; with no labelled rows,
threats alone count; rows that repeat are scored one by one and get equal scores, as texts without a mark
do; an empty table gives no rows; columns of the input named score or predicted are replaced, others in `keep` stay;
bytes that aren't UTF-8 are read as replacement characters.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, learn

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?;\n]+")
PREFIX = range(3, 9)
LEAST_DF, LEAST_ODDS, LEAST_Z = 4, 3.0, 3.0

THREAT = {"kill", "hurt", "destroy", "burn", "beat", "töten", "schlagen", "vernichten", "tuer", "frapper", "détruire", "matar", "golpear", "destruir"}
TARGET = {"you", "your", "yours", "yourself", "they", "them", "du", "dich", "dir", "ihr", "tu", "toi", "vous", "te", "ti", "usted", "ustedes", "vosotros"}
NEGATION = {"not", "no", "never", "nor", "without", "nicht", "kein", "keine", "nie", "ohne", "pas", "jamais", "sans", "nunca", "jamás", "sin"}
REPORT = {"said", "says", "wrote", "writes", "quoted", "claims", "called", "reported", "sagte", "sagt", "schrieb", "nannte", "dit", "écrit", "appelé", "dijo", "dice", "escribió", "llamó"}

#: Symbols: o other, I insult, T threat, Y target, N negation, R reporting verb. Marks grow flags: d directed, n negated, r reported.
NEAR = 3


class Transducer:
    """Deterministic: (state, symbol) -> (state, symbol); symbols that a state doesn't name pass unchanged to its default state."""

    def __init__(self, arcs: dict, default: dict):
        self.arcs, self.default = arcs, default

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol)) or (self.default.get(state, state), symbol)


def _within(trigger: str, marks: list[str], flag: str, span: int) -> Transducer:
    """Marks within `span` words after the trigger get the flag; span 0: up to the end of the sentence."""
    arcs, default = {}, {}
    for state in range(max(1, span) + 1):
        default[state] = state - 1 if span and state else state
        arcs[state, trigger] = (max(1, span), trigger)
        for m in marks:
            arcs[state, m] = (default[state], m + flag if state else m)
    return Transducer(arcs, default)


INSULTS = Transducer({(0, "i"): (0, "I")}, {0: 0})
THREATS = Transducer({(0, "t"): (0, "T")}, {0: 0})
TARGETS = _within("Y", ["I", "T"], "d", NEAR)
NEGATIONS = _within("N", ["I", "T", "Id", "Td"], "n", NEAR)
REPORTS = _within("R", [m + n for m in ("I", "T", "Id", "Td") for n in ("", "n")], "r", 0)
#: A kind's number: 8 for a threat, plus 4 if directed, 2 if negated, 1 if reported.
KINDS = [m + d + n + r for m in "IT" for d in ("", "d") for n in ("", "n") for r in ("", "r")]


def compose(parts: list[Transducer], symbols: str = "oitYNR") -> dict:
    """The product automaton as a table: (state, symbol) -> (state, output); states are tuples of the parts' states, numbered."""
    number, table, todo = {(0,) * len(parts): 0}, {}, [(0,) * len(parts)]
    while todo:
        state = todo.pop()
        for symbol in symbols:
            out, then = symbol, []
            for p, s in zip(parts, state, strict=True):
                s, out = p.step(s, out)  # noqa: PLW2901
                then.append(s)
            if tuple(then) not in number:
                number[tuple(then)] = len(number)
                todo.append(tuple(then))
            table[number[state], symbol] = (number[tuple(then)], KINDS.index(out) if out in KINDS else -1)
    return table


FORWARD = compose([INSULTS, THREATS, TARGETS, NEGATIONS, REPORTS])
#: Read from the sentence's end; what negates stands before.
BACKWARD = compose([INSULTS, THREATS, TARGETS, REPORTS])


def units(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in PREFIX if k <= len(word))]


class Grammar:
    def __init__(self, weights: dict[str, float], model: np.ndarray | None = None):
        self.weights, self.model = weights, model
        self.memo = common.Memo(self._read)
        if model is not None:
            self.plain = learn.sigmoid(float(self.vector([], 0) @ model))

    def _read(self, word: str) -> tuple[str, float]:
        found = max((self.weights[u] for u in units(word) if u in self.weights), default=0.0)
        if word in THREAT:
            return "t", max(found, 1.0)
        if found:
            return "i", found
        return ("Y" if word in TARGET else "N" if word in NEGATION else "R" if word in REPORT else "o"), 0.0

    def clauses(self, text: str) -> list[list[tuple[int, float]]]:
        """The marks (kind, weight) of each sentence that has one."""
        memo, out = self.memo, []
        for sentence in SENTENCE.split(text):
            read = [memo[w] for w in WORD.findall(sentence)]
            if not any(w for _, w in read):
                continue
            state, kinds = 0, []
            for symbol, _ in read:
                state, kind = FORWARD[state, symbol]
                kinds.append(kind)
            state = 0
            for at in range(len(read) - 1, -1, -1):
                state, kind = BACKWARD[state, read[at][0]]
                if kind >= 0:
                    kinds[at] |= kind
            out.append([(kind, weight) for kind, (_, weight) in zip(kinds, read, strict=True) if kind >= 0])
        return out

    @staticmethod
    def vector(clauses: list[list[tuple[int, float]]], words: int) -> np.ndarray:
        x = np.zeros(len(KINDS) + 5)
        for marks in clauses:
            for kind, weight in marks:
                x[kind] += weight
        total = x[: len(KINDS)].sum()
        x[: len(KINDS)] = np.log1p(x[: len(KINDS)])
        x[-5] = np.log1p(total)
        x[-4] = max((w for c in clauses for _, w in c), default=0.0)
        x[-3] = np.log1p(len(clauses))
        x[-2] = np.log1p(1000 * total / (words + 20))
        x[-1] = 1
        return x

    def features(self, text: str | None) -> np.ndarray:
        words = WORD.findall((text or "").lower())
        memo = self.memo
        if not any(memo[w][1] for w in set(words)):
            return self.vector([], 0)
        return self.vector(self.clauses(text.lower()), len(words))

    def score(self, text: str | None) -> float:
        low = (text or "").lower()
        words = WORD.findall(low)
        memo = self.memo
        if not any(memo[w][1] for w in set(words)):
            return self.plain
        return learn.sigmoid(float(self.vector(self.clauses(low), len(words)) @ self.model))


FOLDS = 4


def lexica(texts: list[str], y: np.ndarray, fold: np.ndarray) -> list[dict[str, float]]:
    """Words and word beginnings that toxic texts have far more often, with their log odds less one standard error.

    One lexicon without each fold, and last that of all texts.
    """
    ones, zeros = [Counter() for _ in range(FOLDS)], [Counter() for _ in range(FOLDS)]
    count = lambda t: {u for w in set(WORD.findall(t.lower())) for u in units(w)}
    for t, label, f in zip(texts, y, fold, strict=True):
        if label:
            ones[f].update(count(t))
    all_ones = sum(ones, Counter())
    wanted = {u for u, n in all_ones.items() if n >= LEAST_DF}
    for t, label, f in zip(texts, y, fold, strict=True):
        if not label:
            zeros[f].update(count(t) & wanted)
    all_zeros = sum(zeros, Counter())
    out = []
    for f in range(FOLDS + 1):
        inside = np.ones(len(y), bool) if f == FOLDS else fold != f
        n1, n0 = max(1, int(y[inside].sum())), max(1, int((1 - y[inside]).sum()))
        found = {}
        for u in wanted:
            a, b = all_ones[u], all_zeros[u]
            if f < FOLDS:
                a, b = a - ones[f][u], b - zeros[f][u]
            if a < LEAST_DF:
                continue
            a, b = a + 0.5, b + 0.5
            odds, error = math.log(a / (n1 + 1)) - math.log(b / (n0 + 1)), math.sqrt(1 / a + 1 / b)
            if odds >= LEAST_ODDS and odds - error >= LEAST_ODDS - 1 and odds / error >= LEAST_Z:
                found[u] = odds - error
        out.append(found)
    return out


def fit(rows: list[tuple[str, int]]) -> Grammar:
    """rows (text, label): the kinds' weights are learned on marks that the lexicon of the other folds finds; the final lexicon is that of all rows."""
    texts, y = [t or "" for t, _ in rows], np.array([v for _, v in rows], float)
    fold = np.arange(len(rows)) % FOLDS
    *parts, whole = lexica(texts, y, fold)
    if 0 < y.sum() < len(y):
        grammars = [Grammar(p) for p in parts]
        model = learn.logistic(np.array([grammars[f].features(t) for t, f in zip(texts, fold, strict=True)]), y)
    else:
        model = np.zeros(len(KINDS) + 5)
        model[-5], model[-1] = 1.0, -3.0
    return Grammar(whole, model)


def train(docs: DataFrame, labels: DataFrame, train, per_class: int = learn.PER_CLASS) -> Grammar:
    rows = learn.sample(docs, labels, "toxic", train, per_class).select("doc_id", "text", "y").collect()
    return fit([(r.text, r.y) for r in sorted(rows, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.y, r.text or ""))])


@lru_cache(2)
def _loaded(blob: bytes) -> Grammar:
    return Grammar(*pickle.loads(blob))


def score(docs: DataFrame, grammar: Grammar, keep: list[str]) -> DataFrame:
    """Columns `keep` of docs, then score (0 to 1) and predicted."""
    spark = docs.sparkSession
    common.tune(spark)
    shared = spark.sparkContext.broadcast(pickle.dumps((grammar.weights, grammar.model)))
    keep = [k for k in keep if k not in ("score", "predicted")]
    docs = docs.select(*keep, *([] if "text" in keep else ["text"]))

    def run(batches):
        g = _loaded(shared.value)
        for b in batches:
            got = [g.score(t) for t in common.strings(b)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(got, pa.float64()), pa.array([int(s >= 0.5) for s in got], pa.int32())], [*keep, "score", "predicted"])

    return docs.mapInArrow(run, common.schema_of(docs, keep, {"score": "double", "predicted": "integer"}))
