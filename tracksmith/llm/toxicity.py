"""Toxicity: a weighted finite-state grammar of insults, threats, targets, negation and reported speech over clauses."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracksmith.session import bounded_batches, written

#: Labelled rows that the lexicon and the weights are fitted on at most: those with the least hash of their id.
FIT_ROWS = 20_000
#: Share of toxic documents among those that hold an entry: for an insult, and for a mere hint (an entry that clean texts hold
#: too) as a multiple of the base rate. Documents that must hold an entry.
PURITY, LIFT, SUPPORT = 0.95, 2.5, 4
#: Log-likelihood against chance that an entry needs beyond the logarithm of how many entries there are: of all entries of a
#: sample, whatever its size, about exp(-1) pass by chance.
BEYOND_CHANCE = 1.0
PREFIXES = range(4, 9)

# Words of the grammar's closed classes, English, German, French, Spanish (parameters of the grammar).
THREAT = "kill hurt beat stab burn destroy punch shoot töte töten schlage verprügle brenne tuer frapper brûler détruire matar golpear quemar destruir".split()
TARGET = "you your yourself he she him her they them du dich dir ihr euch er sie tu toi vous il elle ils elles tú ti usted ustedes él ella ellos".split()
MODAL = "will shall gonna going werde wirst wird werden vais va vont voy vas vamos van".split()
NEGATION = "not never neither nicht kein keine nie ne pas jamais nunca tampoco".split()
REPORT = "said says called wrote quoted claimed sagte schrieb nannte zitierte dit écrit appelé cité dijo escribió llamó citó".split()

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n]+")

# Symbols: one for each class of words; END closes a clause. Hits are (class, marks).
OTHER, INSULT, HINT, VERB, MODALS, YOU, NOT, SAID, END, THREATEN = range(10)
WORDS = (OTHER, INSULT, HINT, VERB, MODALS, YOU, NOT, SAID, END)
HITS = (INSULT, HINT, THREATEN)


class Transducer:
    """A deterministic transducer: arc(state, symbol) gives (next state, symbols written, weight). Arcs are made when first walked."""

    def __init__(self, start, rule) -> None:
        self.start, self.rule, self.arcs = start, rule, {}

    def arc(self, state, symbol):
        found = self.arcs.get((state, symbol))
        if found is None:
            found = self.arcs[state, symbol] = self.rule(state, symbol)
        return found

    def then(self, other: Transducer) -> Transducer:
        """Composition: other reads what this one writes; weights add up."""

        def rule(state, symbol):
            a, b = state
            a, between, weight = self.arc(a, symbol)
            out: tuple = ()
            for x in between:
                b, more, w = other.arc(b, x)
                out, weight = out + more, weight + w
            return (a, b), out, weight

        return Transducer((self.start, other.start), rule)

    def run(self, symbols: list) -> tuple[list, float]:
        """What is written, and the weight of the path."""
        state, out, total = self.start, [], 0.0
        for s in symbols:
            state, more, w = self.arc(state, s)
            out += more
            total += w
        return out, total


def _insults(left: int, s):
    """Writes a hit for an insult; a hint is one, and an insult if another hint or an insult stood up to two words before."""
    if s == INSULT or (s == HINT and left):
        return 2, ((INSULT, ""),), 0.0
    if s == HINT:
        return 2, ((HINT, ""),), 0.0
    return (0 if s == END else max(0, left - 1)), (s,), 0.0


def _threats(state: tuple[int, int], s):
    """Writes a hit where a threat is complete: a verb of harm up to three words after 'will', or its object up to three words after it."""
    will, verb = state
    if s == END:
        return (0, 0), (s,), 0.0
    later = (max(0, will - 1), max(0, verb - 1))
    if s == MODALS:
        return (3, later[1]), (OTHER,), 0.0
    if s == VERB:
        return ((0, 0), ((THREATEN, ""),), 0.0) if will else ((0, 3), (OTHER,), 0.0)
    if s == YOU and verb:
        return (later[0], 0), ((THREATEN, ""), s), 0.0
    return later, (s,), 0.0


def _scope(opener: int, reach: int, mark: str):
    """After opener, hits within reach words are marked; END closes the scope. Reach 0: up to the end of the clause."""
    far = reach or 1

    def rule(left: int, s):
        if s == END:
            return 0, (s,), 0.0
        if s == opener:
            return far, (s,), 0.0
        out = (s[0], s[1] + mark) if isinstance(s, tuple) and left else s
        return (max(0, left - 1) if reach else left), (out,), 0.0

    return Transducer(0, rule)


def _targets(state: tuple, s):
    """Marks a hit that has a target up to four words before or behind it. A hit waits for its target, or for the end of its reach."""
    left, waiting, reach = state
    if s == END:
        return (0, None, 0), ((waiting,) if waiting else ()) + (s,), 0.0
    if s == YOU:
        return (4, None, 0), (((waiting[0], waiting[1] + "t"),) if waiting else ()) + (s,), 0.0
    out, after = (), max(0, left - 1)
    if isinstance(s, tuple):
        if left:
            return (after, waiting, reach), ((s[0], s[1] + "t"),), 0.0
        return (after, s, 4), ((waiting,) if waiting else ()), 0.0
    if waiting and reach == 1:
        out, waiting, reach = (waiting,), None, 0
    return (after, waiting, max(0, reach - 1)), (*out, s), 0.0


#: Insults, then threats, then the scopes of negation and reported speech, then targets: hits come out with marks n, r, t.
GRAMMAR = Transducer(0, _insults).then(Transducer((0, 0), _threats)).then(_scope(NOT, 3, "n")).then(_scope(SAID, 0, "r")).then(Transducer((0, None, 0), _targets))
#: Patterns of matched clauses whose weights are learned: what is said, and how.
PATTERNS = [(k, m) for k in HITS for m in ("", "n", "r", "t", "nr", "nt", "rt", "nrt")]
_INDEX = {p: i for i, p in enumerate(PATTERNS)}
N_FEATURES = len(PATTERNS)


def weighted(weights: np.ndarray) -> Transducer:
    """The grammar composed with an acceptor whose arcs weigh each pattern the first time that a clause holds it."""

    def rule(seen: frozenset, s):
        if s == END:
            return frozenset(), (), 0.0
        if s in _INDEX and s not in seen:
            return seen | {s}, (s,), float(weights[_INDEX[s]])
        return seen, (), 0.0

    return GRAMMAR.then(Transducer(frozenset(), rule))


@dataclass
class Lexicon:
    """Classes of words: learned entries are whole words, or beginnings that end with *; bounded by the fitted sample's words."""

    insults: frozenset[str]
    hints: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self.closed = {w: k for k, ws in ((VERB, THREAT), (MODALS, MODAL), (YOU, TARGET), (NOT, NEGATION), (SAID, REPORT)) for w in ws}
        self.known: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def kind(self, word: str) -> int:
        k = self.known.get(word)
        if k is None:
            if len(self.known) > KNOWN:
                self.known.clear()
            k = self.closed.get(word, OTHER)
            for kind, held in ((INSULT, self.insults), (HINT, self.hints)):
                if word in held or any(len(word) >= n and word[:n] + "*" in held for n in PREFIXES):
                    k = kind
                    break
            self.known[word] = k
        return k

    def clauses(self, text: str | None) -> Iterator[list[int]]:
        """Symbols of the clauses that can match: those with an insult, a hint or a verb of harm. None of a text without words."""
        kinds = self.kind
        for clause in _CLAUSE.split((text or "").lower()):
            symbols = list(map(kinds, _WORD.findall(clause)))
            if not _STARTERS.isdisjoint(symbols):
                yield symbols


_STARTERS = frozenset((INSULT, HINT, VERB))
#: Words whose class a task remembers.
KNOWN = 60_000


def matches(symbols: list[int]) -> set[tuple[int, str]]:
    """Patterns that the grammar finds in a clause."""
    if _STARTERS.isdisjoint(symbols):
        return set()
    return _INDEX.keys() & GRAMMAR.run([*symbols, END])[0]


def length_scale(text: str | None) -> float:
    """What a text's matched clauses are divided by: the root of its length in hundreds of characters, and one."""
    return math.sqrt(1 + len(text or "") / SCALE_CHARS)


SCALE_CHARS = 100


@dataclass
class ToxicityModel:
    """score: logistic of the bias and the weights of all matched clauses' paths, on the scale of the text's length."""

    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def features(self, text: str | None) -> np.ndarray:
        """Clauses of the whole text that match each pattern, on the text's scale."""
        out = np.zeros(N_FEATURES)
        for symbols in self.lexicon.clauses(text):
            for p in matches(symbols):
                out[_INDEX[p]] += 1
        return out / length_scale(text)

    def score(self, texts) -> np.ndarray:
        machine = weighted(self.weights)
        z = np.array([self.bias + sum(machine.run([*c, END])[1] for c in self.lexicon.clauses(t)) / length_scale(t) for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def entries(text: str | None) -> set[str]:
    """Lexicon entries that a text can support: its words and their beginnings."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) >= n}


def is_insult(share: float, e: float, n_entries: int) -> bool:
    return share >= PURITY and e >= math.log(max(1, n_entries)) + BEYOND_CHANCE


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Learn the insult lexicon and the pattern weights from labels(doc_id, label): the rows it may learn from.

    The fit_rows labels with the least hash of their id are used (a bounded sample); null labels are skipped, an id labelled
    twice counts as its larger label, of repeated documents with one id the least text counts. Entries of the sample are
    counted by label in a partial aggregate; those that stand in toxic documents beyond chance are kept. Weights: a ridge
    logistic regression on the pattern counts of the sample.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    chosen = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # at most fit_rows rows of two numbers are broadcast; one document an id is left
    sample = written(docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min(F.coalesce("text", F.lit(""))).alias("text")), "sample")
    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("label") > 0).cast("long")), F.lit(0)).alias("toxic")).first()
    n, toxic = int(totals["n"]), int(totals["toxic"])
    if not toxic or toxic == n:
        return ToxicityModel(Lexicon(frozenset()), np.zeros(N_FEATURES), math.log((toxic + 0.5) / (n - toxic + 0.5)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for t, y in zip(b["text"], b["label"], strict=True):
                held[int(y > 0)].update(entries(t))
            words = list(held[0].keys() | held[1].keys())
            yield pd.DataFrame({"entry": words, "n1": [held[1][w] for w in words], "n0": [held[0][w] for w in words]})

    base = toxic / n
    share = F.col("n1") / (F.col("n1") + F.col("n0"))
    evidence = F.col("n1") * F.log(share / base) + F.when(F.col("n0") > 0, F.col("n0") * F.log((1 - share) / (1 - base))).otherwise(0)
    counted = written(sample.select("text", "label").mapInPandas(count, "entry string, n1 long, n0 long").groupBy("entry").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where(F.col("n1") + F.col("n0") >= SUPPORT), "entries")
    n_entries = counted.count()
    kept = counted.where((F.col("n1") >= SUPPORT) & (share >= min(LIFT * base, PURITY))).select("entry", share.alias("share"), evidence.alias("e")).where(F.col("e") >= math.log(max(1, n_entries)) + BEYOND_CHANCE).collect()
    insults = frozenset(r["entry"] for r in kept if is_insult(r["share"], r["e"], n_entries))
    model = ToxicityModel(Lexicon(insults, frozenset(r["entry"] for r in kept) - insults), np.zeros(N_FEATURES), 0.0)

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([model.features(t).tolist() for t in texts])

    # rows with equal features are one row with two counts: at most fit_rows rows
    rows = sample.select(features("text").alias("x"), "label").groupBy("x").agg(F.count("*").alias("n"), F.sum((F.col("label") > 0).cast("long")).alias("k")).orderBy("x").collect()
    weights, bias = _logistic(np.array([r["x"] for r in rows]), np.array([r["n"] for r in rows], float), np.array([r["k"] for r in rows], float))
    return ToxicityModel(model.lexicon, weights, bias)


def _logistic(x: np.ndarray, n: np.ndarray, k: np.ndarray, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Binomial logistic regression by Newton steps with a ridge on all weights but the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (k - n * p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score in 0 to 1 of every whole text; null and empty texts score the bias. Only the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts))

    return docs.withColumn(out, scores(F.col(text)))


def matched_clauses(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, clause number, clause text and its patterns (such as 'insult:nt') for every clause that matches."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)
    names = {INSULT: "insult", HINT: "hint", THREATEN: "threat"}

    @F.pandas_udf("array<struct<clause: int, clause_text: string, patterns: array<string>>>")
    def clauses(texts: pd.Series) -> pd.Series:
        lexicon, rows = shared.value.lexicon, []
        for t in texts:
            found = []
            for i, c in enumerate(_CLAUSE.split((t or "").lower())):
                if marks := matches([lexicon.kind(w) for w in _WORD.findall(c)]):
                    found.append({"clause": i, "clause_text": c, "patterns": sorted(f"{names[k]}:{m}" for k, m in marks)})
            rows.append(found)
        return pd.Series(rows)

    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(clauses(F.col(text))).alias("c")).select("doc_id", "c.*")
