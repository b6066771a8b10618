"""Cuts, efficiencies, figures of merit and ROC curves."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def even_cuts(low: float, high: float, n: int) -> list[float]:
    return [low + (high - low) * i / (n - 1) for i in range(n)]


def _last_cut(x: str, cuts: list[float], inclusive: bool) -> Column:
    """Number of cuts that x passes: x > cut, or x >= cut. A search in the literal, ascending cuts."""
    at = F.array(*[F.lit(float(c)) for c in cuts])
    return F.size(F.filter(at, lambda c: (F.col(x) >= c) if inclusive else (F.col(x) > c)))


def efficiency_vs_cut(df: DataFrame, x: str, cuts: list[float], inclusive: bool = False, by: list[str] | None = None) -> DataFrame:
    """by, cut, n_pass, n, efficiency, error for every cut: one pass over the data whatever the number of cuts.

    Values are counted by how many cuts they pass; a reverse running sum over that small table gives all cuts. A null
    counts in n and passes none.
    """
    by = by or []
    cuts = sorted(cuts)
    counted = df.groupBy(*by, F.coalesce(_last_cut(x, cuts, inclusive), F.lit(0)).alias("passed")).agg(F.count("*").alias("m"))
    totals = counted.groupBy(*by).agg(F.sum("m").alias("n"))
    grid = totals.withColumn("c", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("passed"), F.lit(float(c)).alias("cut")) for i, c in enumerate(cuts)]))).select(*by, "n", "c.*")
    w = Window.partitionBy(*by).orderBy(F.col("passed").desc()).rowsBetween(Window.unboundedPreceding, 0)
    joined = grid.join(counted, [*by, "passed"], "left").withColumn("n_pass", F.sum(F.coalesce("m", F.lit(0))).over(w))
    p = F.when(F.col("n") > 0, F.col("n_pass") / F.col("n")).otherwise(0.0)
    return joined.select(*by, "cut", "n_pass", "n", p.alias("efficiency"), F.when(F.col("n") > 0, F.sqrt(p * (1 - p) / F.col("n"))).otherwise(0.0).alias("error"))


def single_cut(df: DataFrame, x: str, cut: float, signal: str, inclusive: bool = False) -> DataFrame:
    """Signal and background efficiency and background rejection at one cut."""
    ok = (F.col(x) >= cut) if inclusive else (F.col(x) > cut)
    eff = lambda side: F.avg(F.when(side, ok.cast("double")))
    out = df.agg(eff(F.col(signal)).alias("signal_eff"), eff(~F.col(signal)).alias("background_eff"))
    return out.withColumn("background_rejection", 1 - F.col("background_eff"))


def two_sample_efficiencies(df: DataFrame, x: str, signal: str, cuts: list[float], inclusive: bool = False, by: list[str] | None = None) -> DataFrame:
    """by, cut, eff_signal, eff_background: both samples in one pass."""
    by = by or []
    e = efficiency_vs_cut(df.withColumn("__s", F.col(signal)), x, cuts, inclusive, [*by, "__s"])
    return e.groupBy(*by, "cut").agg(F.max(F.when(F.col("__s"), F.col("efficiency"))).alias("eff_signal"), F.max(F.when(~F.col("__s"), F.col("efficiency"))).alias("eff_background"))


def figure_of_merit(efficiencies: DataFrame, epsilon: float = 1e-10) -> DataFrame:
    """Adds fom = eff_signal / sqrt(eff_background + epsilon) and whether the row is the first maximum."""
    f = efficiencies.withColumn("fom", F.col("eff_signal") / F.sqrt(F.col("eff_background") + epsilon))
    first = F.max(F.struct("fom", (-F.col("cut")).alias("neg"))).over(Window.partitionBy())
    return f.withColumn("best", F.col("cut") == -first["neg"])


def figure_of_merit_ruled(efficiencies: DataFrame, least_signal: float = 0.01) -> DataFrame:
    """fom 0 where the signal efficiency is under least_signal or no background is left; cuts up to the first failing one (kept)."""
    ok = (F.col("eff_signal") >= least_signal) & (F.col("eff_background") > 0)
    f = efficiencies.withColumn("fom", F.when(ok, F.col("eff_signal") / F.sqrt("eff_background")).otherwise(0.0))
    failing = F.min(F.when(F.col("eff_signal") < least_signal, F.col("cut"))).over(Window.partitionBy())
    return f.withColumn("stop", failing).where(F.col("stop").isNull() | (F.col("cut") <= F.col("stop"))).drop("stop")


def roc_curve(efficiencies: DataFrame) -> DataFrame:
    """signal efficiency, background rejection, and the area's trapezoid of each step, in the order of (x, y)."""
    r = efficiencies.select("cut", F.col("eff_signal").alias("x"), (1 - F.col("eff_background")).alias("y"))
    w = Window.orderBy("x", "y", "cut")
    return r.withColumn("area", F.coalesce((F.col("x") - F.lag("x").over(w)) * (F.col("y") + F.lag("y").over(w)) / 2, F.lit(0.0)))


def auc(roc: DataFrame) -> DataFrame:
    return roc.agg(F.sum("area").alias("auc"))


def efficiency_with_error(df: DataFrame, x: str, cuts: list[float], by: list[str] | None = None) -> DataFrame:
    """Inclusive cuts, efficiency and simple binomial error rounded to four digits."""
    e = efficiency_vs_cut(df, x, cuts, True, by)
    return e.withColumn("efficiency", F.round("efficiency", 4)).withColumn("error", F.round("error", 4))


def _beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction, about sqrt(max(a, b)) terms."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(1 - x, b, a)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x) - math.log(a)
    tiny, m = 1e-300, 0
    c, f = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    d = f
    while True:
        m += 1
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d, c = 1 / ((1 + term * d) or tiny), (1 + term / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            return min(1.0, math.exp(log_front) * f)


def _beta_quantile(p: float, a: float, b: float) -> float:
    """Quantile of Beta(a, b) by bisection, in memory that doesn't grow with a and b."""
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _beta_share(mid, a, b) < p else (lo, mid)
    return (lo + hi) / 2


def binomial_interval(counted: DataFrame, k: str = "n_pass", n: str = "n", level: float = 0.6827) -> DataFrame:
    """Exact (Clopper-Pearson) limits low and high of k passes among n, on the few aggregated rows."""
    tail = (1 - level) / 2

    @F.pandas_udf("struct<low: double, high: double>")
    def limits(ks: pd.Series, ns: pd.Series) -> pd.DataFrame:
        kk, nn = ks.to_numpy(float), ns.to_numpy(float)
        low, high = np.zeros(len(kk)), np.ones(len(kk))
        for i, (a, m) in enumerate(zip(kk, nn, strict=True)):
            if m > 0 and a > 0:
                low[i] = _beta_quantile(tail, a, m - a + 1)
            if m > 0 and a < m:
                high[i] = _beta_quantile(1 - tail, a + 1, m - a)
        return pd.DataFrame({"low": low, "high": high})

    return counted.withColumn("__i", limits(k, n)).select(*counted.columns, "__i.low", "__i.high")


def interpolate(curve: DataFrame, at: list[float], x: str = "threshold", values: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Linear interpolation of a curve at given places with flat ends: an as-of join done with lead and a range condition.

    curve is a small table (one row per threshold); the places are literals.
    """
    by, values = by or [], values or ["eff_signal", "eff_background"]
    w = Window.partitionBy(*by).orderBy(x)
    seg = curve.withColumn("__n", F.lead(x).over(w))
    for v in values:
        seg = seg.withColumn(f"__n_{v}", F.lead(v).over(w))
    seg = seg.withColumn("__first", F.row_number().over(w) == 1)
    seg = seg.withColumn("at", F.explode(F.array(*[F.lit(float(a)) for a in at])))
    inside = (F.col("at") >= F.col(x)) & (F.col("__n").isNull() | (F.col("at") < F.col("__n")))
    seg = seg.where(inside | (F.col("__first") & (F.col("at") < F.col(x))))
    share = F.when(F.col("__n").isNull() | (F.col("at") < F.col(x)) | (F.col("__n") == F.col(x)), 0.0).otherwise((F.col("at") - F.col(x)) / (F.col("__n") - F.col(x)))
    return seg.select(*by, "at", *[(F.col(v) + share * (F.coalesce(f"__n_{v}", v) - F.col(v))).alias(v) for v in values])


def roc_from_curves(curve: DataFrame, at: list[float], by: list[str], x: str = "threshold") -> DataFrame:
    """Area under signal efficiency over background efficiency, for each sample's interpolated curve."""
    r = interpolate(curve, at, x, by=by)
    w = Window.partitionBy(*by).orderBy("eff_background", "eff_signal", "at")
    step = (F.col("eff_background") - F.lag("eff_background").over(w)) * (F.col("eff_signal") + F.lag("eff_signal").over(w)) / 2
    return r.withColumn("area", step).groupBy(*by).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("auc"))


def working_point(curve: DataFrame, column: str, wanted: float, order: str = "cut") -> DataFrame:
    """The row nearest to a wanted value; the first of equally near ones."""
    return curve.orderBy(F.abs(F.col(column) - wanted), order).limit(1)


def apply_cut(df: DataFrame, x: str, cut: float, sample: str) -> DataFrame:
    """Per sample: rows, survivors (x > cut) and efficiency."""
    return df.groupBy(sample).agg(F.count("*").alias("n"), F.count_if(F.col(x) > cut).alias("n_pass"), F.avg((F.col(x) > cut).cast("double")).alias("efficiency"))


def peak_cut(lmax: float = 50.0, pmin: float = 0.4, rmin: float = 150.0) -> Column:
    """A profile with its first peak starting early and a prominent last peak that ends late."""
    return (F.col("peak1_left") <= lmax) & (F.col("peak2_prominence") >= pmin) & (F.col("peak2_right") >= rmin)


def peak_and_blob_cut(df: DataFrame, sample: str, blob: str, blob_cut: float, **peak) -> DataFrame:
    """Per sample: efficiency of the peak cut, of the blob cut among its survivors, and their product."""
    ok = peak_cut(**peak)
    p = F.avg(ok.cast("double"))
    b = F.avg(F.when(ok, (F.col(blob) > blob_cut).cast("double")))
    return df.groupBy(sample).agg(F.count("*").alias("n"), p.alias("eff_peak"), F.coalesce(b, F.lit(0.0)).alias("eff_blob"), (p * F.coalesce(b, F.lit(0.0))).alias("efficiency"))


def prominence_scan(df: DataFrame, sample: str, pmins: list[float], lmax: float = 50.0, rmin: float = 150.0) -> DataFrame:
    """Efficiency of the peak cut for each least prominence, by sample: one pass."""
    rest = df.withColumn("__p", F.when(peak_cut(lmax, float("-inf"), rmin), F.col("peak2_prominence")))
    return efficiency_vs_cut(rest, "__p", pmins, True, [sample]).withColumnRenamed("cut", "pmin")


def separation(df: DataFrame, x: str, sample: str, first: str, second: str, by: list[str]) -> DataFrame:
    """|mu1 - mu2| / sqrt(s1^2 + s2^2) of two samples for each group of by, and whether it is the first greatest."""
    side = lambda f, s: f(F.when(F.col(sample) == s, F.col(x)))
    g = df.groupBy(*by).agg(side(F.avg, first).alias("m1"), side(F.avg, second).alias("m2"), side(F.stddev_samp, first).alias("s1"), side(F.stddev_samp, second).alias("s2"))
    spread = F.sqrt(F.col("s1") * F.col("s1") + F.col("s2") * F.col("s2"))
    g = g.withColumn("separation", F.when(spread > 0, F.abs(F.col("m1") - F.col("m2")) / spread).otherwise(0.0))
    best = F.max(F.struct("separation", (-F.col(by[0])).alias("neg"))).over(Window.partitionBy())
    return g.withColumn("best", F.col(by[0]) == -best["neg"])


def event_selection(hits: DataFrame, r: float, least_hits: int, z_inner: tuple[float, float], z_outer: tuple[float, float], roi_kev: tuple[float, float], resolution_kev: float) -> DataFrame:
    """Cut flow in one row: events, those whose hits all pass the radial, length and z cuts in turn, the expected number in the
    energy region after the resolution, step efficiencies (0 counts stand for 0.5) and their product.

    All cuts are flags of one aggregate per event: one shuffle, no joins.
    """
    from tracksmith.operators.hist import normal_cdf

    z = F.col("z")
    two = ((z > z_inner[0]) & (z < z_inner[1])) | ((z > z_outer[0]) & (z < z_outer[1]))
    e = hits.groupBy("event_id").agg(F.bool_and(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) < r).alias("in_r"), F.count("*").alias("n_hits"), F.bool_and(two).alias("in_z"), (F.sum("energy") * 1e3).alias("kev"))
    a = F.col("in_r")
    b = a & (F.col("n_hits") >= least_hits)
    c = b & F.col("in_z")
    share = normal_cdf((roi_kev[1] - F.col("kev")) / resolution_kev) - normal_cdf((roi_kev[0] - F.col("kev")) / resolution_kev)
    n = e.agg(F.count("*").alias("n_events"), F.count_if(a).alias("n_radial"), F.count_if(b).alias("n_length"), F.count_if(c).alias("n_z"), F.coalesce(F.sum(F.when(c, share)), F.lit(0.0)).alias("n_roi"))
    steps = ["n_events", "n_radial", "n_length", "n_z", "n_roi"]
    at = lambda s: F.when(F.col(s) > 0, F.col(s)).otherwise(0.5)
    for last, now in zip(steps, steps[1:], strict=False):
        n = n.withColumn(f"eff_{now[2:]}", at(now) / at(last))
    return n.withColumn("eff_total", F.col("eff_radial") * F.col("eff_length") * F.col("eff_z") * F.col("eff_roi"))


def cleanup_counts(df: DataFrame, cuts: dict[str, Column]) -> DataFrame:
    """Rows that pass each cut and all before it, in order."""
    ok, cols = F.lit(True), [F.count("*").alias("n")]
    for name, c in cuts.items():
        ok = ok & c
        cols.append(F.count_if(ok).alias(f"n_{name}"))
    return df.agg(*cols)


def literal_curve(spark: SparkSession, rows: Iterator[tuple]) -> DataFrame:
    """A curve of (threshold, eff_signal, eff_background) rows."""
    return spark.createDataFrame(list(rows), "threshold double, eff_signal double, eff_background double")
