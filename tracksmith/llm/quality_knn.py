"""Quality classifier: nearest-neighbour voting in a latent-semantic space."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracksmith.session import bounded_batches

#: Labelled rows that the model is fitted on at most: those with the least hash of their id.
FIT_ROWS = 6000
#: Hashed terms, latent dimensions, neighbours that vote, documents in one block of products.
TERMS = 4096
RANK = 48
NEIGHBOURS = 40
BLOCK = 512
#: Votes weigh similarity to this power.
SHARPNESS = 4

_RUNS = re.compile(r"(.)\1+", re.DOTALL)
_CLASSES: dict[str, str] = {}
#: Terms of tokens that a task has met; cleared beyond TOKEN_CACHE entries.
_TOKENS: dict[str, tuple[int, str]] = {}
TOKEN_CACHE = 60_000


def _kind(c: str) -> str:
    if c.isalpha():
        return "A" if c.isupper() else "a"
    return "0" if c.isdigit() else c


def shape(token: str) -> str:
    """A token's letters, capitals and digits by class, runs shortened: Thea,, -> Aa,"""
    if token.isalpha():  # most tokens
        if token.islower():
            return "a"
        if token.isupper():
            return "A"
    return _RUNS.sub(r"\1", "".join(_CLASSES.get(c) or _CLASSES.setdefault(c, _kind(c)) for c in token))


def _term(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % TERMS


def document_terms(text: str | None) -> dict[int, float]:
    """Hashed terms of a whole text with their damped frequencies.

    Terms are words (lower case), token shapes, and terms of repetition: a token equal to the one before, a line equal to
    an earlier one, and the number of different tokens against all on a scale of halves. An empty text has none.
    """
    tokens = (text or "").split()
    if not tokens:
        return {}
    n = len(tokens)
    words: dict[int, int] = {}
    shapes: dict[str, int] = {}
    if len(_TOKENS) > TOKEN_CACHE:
        _TOKENS.clear()
    for token, k in Counter(tokens).items():
        known = _TOKENS.get(token)
        if known is None:
            known = _TOKENS[token] = (_term("w:" + token.lower()), shape(token))
        term, form = known
        words[term] = words.get(term, 0) + k
        shapes[form] = shapes.get(form, 0) + k
    log = math.log1p
    found = {t: log(100 * k / n) for t, k in words.items()}
    for form, k in shapes.items():
        t = _term("s:" + form)
        found[t] = found.get(t, 0) + 2 * log(100 * k / n)
    lines = [x for x in text.split("\n") if x.strip()]
    for name, share in (
        ("r:token", sum(map(str.__eq__, tokens, tokens[1:])) / (n + 10)),
        ("r:line", (len(lines) - len(set(lines))) / (len(lines) + 5)),
        ("r:few", max(0.0, 1 - len(set(tokens)) / n**0.7)),
        ("r:upper", shapes.get("A", 0) / (n + 10)),
    ):
        if share > 0:
            found[_term(name)] = found.get(_term(name), 0) + 4 * log(20 * share)
    return found


@dataclass
class KnnModel:
    """Bounded by FIT_ROWS x RANK: what every task gets."""

    idf: np.ndarray  # TERMS
    basis: np.ndarray  # TERMS x RANK
    vectors: np.ndarray  # labelled rows x RANK, unit length
    votes: np.ndarray  # 0/1
    prior: float

    def project(self, terms: list[dict[int, float]]) -> np.ndarray:
        x = np.zeros((len(terms), TERMS), np.float32)
        for i, t in enumerate(terms):
            if t:
                x[i, list(t)] = list(t.values())
        x *= self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        y = x @ self.basis
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)

    def score(self, terms: list[dict[int, float]]) -> np.ndarray:
        """Exact cosines of a block with all labelled vectors; the nearest vote by similarity. Without a neighbour: the prior."""
        if not len(self.votes):
            return np.full(len(terms), self.prior)
        out = np.empty(len(terms))
        k = min(NEIGHBOURS, len(self.votes))
        for i in range(0, len(terms), BLOCK):
            cosines = self.project(terms[i : i + BLOCK]) @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(float) ** SHARPNESS
            total = weight.sum(axis=1)
            # half a vote of the prior keeps scores off 0 and 1
            out[i : i + BLOCK] = ((weight * self.votes[near]).sum(axis=1) + 0.5 * self.prior) / (total + 0.5)
        return out


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> KnnModel:
    """Fit on labelled rows: labels(doc_id, label) are the rows it may learn from, label null or without a document is skipped.

    The fit_rows labels with the least hash of their id are used (a bounded sample; their term vectors come to the driver).
    An id labelled twice counts as its larger label; of repeated documents with one id the one of least hash counts. Terms'
    document frequencies and the latent space (truncated SVD by subspace iteration from a fixed start) are part of the fit.
    """
    chosen = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("struct<ids: binary, weights: binary>")
    def terms(texts: pd.Series) -> pd.DataFrame:
        found = [document_terms(t) for t in texts]
        return pd.DataFrame({"ids": [np.fromiter(f, np.int32, len(f)).tobytes() for f in found], "weights": [np.fromiter(f.values(), np.float32, len(f)).tobytes() for f in found]})

    # at most fit_rows rows of two numbers: the bound is proven by the limit above; one row an id is left of the documents
    sample = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", terms("text").alias("t")).select("doc_id", "label", F.struct(F.xxhash64("t.ids", "t.weights").alias("h"), "t.ids", "t.weights").alias("t"))
    rows = sample.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("t").alias("t")).orderBy("doc_id").collect()
    y = np.array([r["label"] for r in rows], float)
    x = np.zeros((len(rows), TERMS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["t"]["ids"], np.int32)] = np.frombuffer(r["t"]["weights"], np.float32)
    del rows
    seen = (x > 0).sum(axis=0)
    idf = np.where(seen >= 2, np.log((len(y) + 1) / (seen + 1)) + 0.3, 0).astype(np.float32)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rank = min(RANK, max(1, len(y)))
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((TERMS, rank)).astype(np.float32))[0]
    for _ in range(6):
        q = np.linalg.qr(x.T @ (x @ q))[0] if len(y) else q
    vectors = x @ q
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return KnnModel(idf, q.astype(np.float32), vectors.astype(np.float32), y, float(y.mean()) if len(y) else 0.5)


def score(docs: DataFrame, model: KnnModel, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score in 0 to 1 of every whole text. Null and empty texts score the prior. Nothing but the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score([document_terms(t) for t in texts]))

    return docs.withColumn(out, scores(F.col(text)))
