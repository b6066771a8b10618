"""Quality rules: base counts of a text, and robust multivariate outliers by minimum covariance determinant."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracksmith.llm.text import SPACES, as_bytes, own_names
from tracksmith.session import bounded_batches, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Transformed statistics are whole multiples of 1/UNIT, so that sums are exact and don't depend on their order.
UNIT = 1024
FEATURES = ["f_word_len", "f_symbols", "f_dup_lines", "f_repeats"]
#: Least standard deviation of each feature: a spread below it is not evidence against a text.
FLOORS = [0.10, 0.30, 0.10, 0.10]
#: Words of an average text of the cell that are mixed into the mean word length, so that short texts are not outliers by chance.
SHRINK_WORDS = 100
#: A cell of language and source with fewer rows borrows the estimate of its language, a language with fewer that of all rows.
MIN_CELL = 60
COVERED = 0.75
#: Concentration steps end when no estimate moves; this many at most (each step lowers the determinant, so they do end).
MOST_STEPS = 30
#: Tail probability of a clean text under the robust estimate.
TAIL = 1e-5


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word) of a whole text; null: all 0."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = as_bytes(text).split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window which occurs twice or more in the text, the first occurrence included. Exact: no hashing."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    size = 1
    while size < window:  # numbers of windows of 1, 2, 4, 8 words: pairs of the numbers of their halves
        step = min(size, window - size)
        ids = np.unique(ids[: len(ids) - step] * (int(ids.max()) + 1) + ids[step:], return_inverse=True)[1]
        size += step
    starts = np.flatnonzero(np.bincount(ids)[ids] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def with_counts(docs: DataFrame, text: str = "text", out: str = "counts") -> DataFrame:
    """docs with a struct of text_counts()."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(COUNTS)
    def counts(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_counts(t) for t in texts], columns=[c.split()[0] for c in COUNTS.split(", ")], dtype=np.int64)

    return docs.withColumn(out, counts(F.col(text)))


def chi_square_cdf(x: float, dof: int) -> float:
    """For an even number of degrees of freedom."""
    term = total = math.exp(-x / 2)
    for i in range(1, dof // 2):
        term *= x / 2 / i
        total += term
    return 1 - total


def chi_square_quantile(p: float, dof: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, dof) < p else (lo, mid)
    return hi


def _features(mean_len: Column) -> list[Column]:
    n = F.col("n_words")
    raw = [
        F.log((F.col("word_chars") + SHRINK_WORDS * mean_len) / (n + SHRINK_WORDS)),
        F.log1p(20 * F.col("n_symbols") / (n + 20)),
        F.col("n_dup_lines") / (F.col("n_lines") + 10),
        F.col("n_repeat_words") / (n + 20),
    ]
    return [F.rint(x * UNIT).cast("long").alias(name) for x, name in zip(raw, FEATURES, strict=True)]


_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]


def _distance(centre: str = "centre", inverse: str = "inverse") -> Column:
    d = [F.col(f) - F.col(centre)[i] for i, f in enumerate(FEATURES)]
    terms = [(1 if i == j else 2) * F.col(inverse)[k] * d[i] * d[j] for k, (i, j) in enumerate(_PAIRS)]
    return sum(terms[1:], terms[0])


def _bin(d2: Column) -> Column:
    """Steps of about 1.1 % of the squared distance: about 2,800 bins over all doubles that occur. The innermost bin is first of all."""
    return F.when(d2 <= 1e-3, F.lit(-10_000)).otherwise(F.floor(F.log2(d2) * 64)).cast("int")


def _estimate(cell: pd.DataFrame, consistency: float) -> pd.DataFrame:
    """Mean, inverse covariance and its log determinant of the covered share of a cell: bins by distance, nearest first; of the bin
    where the share ends, the part that it still needs."""
    cell = cell.sort_values("bin")
    n = cell["n"].to_numpy(np.int64)
    before = np.cumsum(n) - n
    share = np.clip((math.ceil(COVERED * n.sum()) - before) / n, 0, 1)
    m = float((share * n).sum())
    total = lambda c: float((share * cell[c].to_numpy(float)).sum()) if (share % 1).any() else float(sum(map(int, cell[c][share > 0])))
    centre = np.array([total(f"s_{f}") for f in FEATURES]) / m
    cov = np.zeros((len(FEATURES),) * 2)
    for i, j in _PAIRS:
        cov[i, j] = cov[j, i] = total(f"p_{i}_{j}") / m - centre[i] * centre[j]
    cov = cov * consistency + np.diag((np.array(FLOORS) * UNIT) ** 2)
    inv = np.linalg.inv(cov)
    key = {k: [cell[k].iloc[0]] for k in ("cell", "start") if k in cell}
    return pd.DataFrame(key | {"centre": [centre.tolist()], "inverse": [[float(inv[i, j]) for i, j in _PAIRS]], "log_det": [float(np.linalg.slogdet(cov)[1])], "cell_rows": [int(n.sum())]})


ESTIMATE = "centre array<double>, inverse array<double>, log_det double, cell_rows long"


def _step(vectors: DataFrame, bins: Column, consistency: float) -> DataFrame:
    """One concentration step for every cell (and start): sums by cell and distance bin (a small table), then the estimate of each cell."""
    sums = [F.count("*").alias("n"), *[F.sum(f).alias(f"s_{f}") for f in FEATURES]]
    sums += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p_{i}_{j}") for i, j in _PAIRS]
    by = [c for c in ("cell", "start") if c in vectors.columns]
    schema = ", ".join(f"{c} {kind}" for c, kind in vectors.select(*by).dtypes) + ", " + ESTIMATE
    binned = vectors.withColumn("bin", bins).groupBy(*by, "bin").agg(*sums)
    return written(binned.groupBy(*by).applyInPandas(lambda cell: _estimate(cell, consistency), schema), "estimates")


def covariance_determinants(vectors: DataFrame, consistency: float) -> DataFrame:
    """The estimate of least determinant of each cell: cell, centre, inverse, log_det, cell_rows.

    Two starts: the coordinatewise medians with the floors as spread, and the mean and covariance of all rows. Both take
    concentration steps over all rows until no estimate moves any more; the one of lesser determinant stays.
    """
    middle = vectors.groupBy("cell").agg(F.array(*[F.expr(f"double(percentile_approx({f}, 0.5, 1000))") for f in FEATURES]).alias("centre"))
    inverse = F.array(*[F.lit(1.0 / (FLOORS[i] * UNIT) ** 2 if i == j else 0.0) for i, j in _PAIRS])
    about = vectors.join(written(middle, "medians"), "cell").withColumn("inverse", inverse).withColumn("start", F.lit(0))
    first = _step(about, _bin(_distance()), consistency)
    all_rows = _step(vectors.withColumn("start", F.lit(1)), F.lit(0), 1.0)
    estimates, mark = first.unionByName(all_rows), None
    for _ in range(MOST_STEPS):
        estimates = _step(vectors.join(estimates, "cell"), _bin(_distance()), consistency)
        now = estimates.agg(F.bit_xor(F.xxhash64("cell", "start", "centre", "inverse"))).first()[0]
        if now == mark:
            break
        mark = now
    best = estimates.groupBy("cell").agg(F.min(F.struct("log_det", "start", "centre", "inverse", "cell_rows")).alias("b"))
    return best.select("cell", "b.centre", "b.inverse", "b.log_det", "b.cell_rows")


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", base: bool = True, min_cell: int = MIN_CELL, tail: float = TAIL) -> DataFrame:
    """One row per row of docs: doc_id, the counts of text_counts(), base_failed, distance2, cell, kept.

    Base rule: fewer than 20 words, or over 30 % of the words in repeated 8-word windows. Verdict for the others: the squared
    Mahalanobis distance of (log mean word length, log symbol rate, share of repeated lines, share of repeated words) from the
    cell's minimum-covariance-determinant estimate must not exceed the chi-square quantile of 1 - tail. Only vectors that
    pass the base rule are estimated from. Cells are (lang, source); those under min_cell rows are joined by language, and
    those still under it in one rest cell (a covariance needs rows). The estimates: covariance_determinants().

    Null text: no words, so base_failed. Null lang or source: a cell of its own. Repeated rows: a row each. Empty: empty.
    Extra columns are not read. Deterministic: the sums are over whole numbers.
    """
    counted = with_counts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source")), "text").select("doc_id", "lang", "source", "counts.*")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = written(counted.withColumn("base_failed", failed if base else F.lit(False)), "counts")
    good = stats.where("not base_failed")
    # sizes of (lang, source), lang and all cells; the mean word length of a language comes from the same table
    sizes = good.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("word_chars").alias("chars"), F.sum("n_words").alias("words"))
    own = F.col("n") >= min_cell
    by_lang = sizes.groupBy("lang").agg(F.sum(F.when(~own, F.col("n"))).alias("rest"), (F.sum("chars") / F.sum("words")).alias("mean_len"))
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    cell = F.when(own, F.concat_ws("\x1f", F.lit("s"), name("lang"), name("source"))).when(F.col("rest") >= min_cell, F.concat_ws("\x1f", F.lit("l"), name("lang"))).otherwise(F.lit("rest"))
    cells = sizes.join(by_lang.withColumnRenamed("lang", "lang_b"), F.col("lang").eqNullSafe(F.col("lang_b"))).select("lang", "source", cell.alias("cell"), "mean_len")
    cells = written(cells, "cells")
    same = F.col("v.lang").eqNullSafe(F.col("c.lang")) & F.col("v.source").eqNullSafe(F.col("c.source"))
    vectors = good.alias("v").join(cells.alias("c"), same).select("cell", *_features(F.col("mean_len")))
    vectors = written(vectors, "vectors")
    dof = len(FEATURES)
    consistency = COVERED / chi_square_cdf(chi_square_quantile(COVERED, dof), dof + 2)
    estimates = written(covariance_determinants(vectors, consistency), "estimates")
    cut = chi_square_quantile(1 - tail, dof)
    judged = (
        stats.alias("v")
        .join(cells.alias("c"), same, "left")
        .select("v.*", "cell", *_features(F.col("mean_len")))
        .join(estimates, "cell", "left")
        .withColumn("distance2", F.when(~F.col("base_failed"), _distance()))
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= cut))
    )
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "kept", "distance2", "cell")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", **options) -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns, which may have any names; nulls are allowed anywhere.

    A verdict depends on text, language and source alone, so rows are judged by a name of these (two hashes of 64 bits).
    """
    name = own_names(docs, "name")["name"]
    parts = [F.col(f"`{text}`"), F.col(f"`{lang}`").cast("string"), F.col(f"`{source}`").cast("string")]
    parts += [p.isNull() for p in parts]
    named = F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("name"), *parts).alias("b"))
    given = docs.select(named.alias("name"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"))
    kept = quality_rules(given, doc_id="name", **options).where("kept").select(F.col("doc_id").alias(name))
    return docs.join(kept, named == F.col(name), "left_semi")
