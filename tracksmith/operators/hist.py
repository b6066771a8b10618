"""Histograms, profiles and fits as aggregates by bin."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def bin_index(x: str | Column, low: float, high: float, n: int) -> Column:
    """Number of the left-closed bin, null outside [low, high): a value on the last edge is outside."""
    x = F.col(x) if isinstance(x, str) else x
    i = F.floor((x - low) / ((high - low) / n)).cast("long")
    return F.when((x >= low) & (x < high), F.least(i, F.lit(n - 1)))


def bins(spark: SparkSession, low: float, high: float, n: int) -> DataFrame:
    """bin, lo, hi, center of n even bins."""
    w = (high - low) / n
    i = F.col("id")
    return spark.range(n).select(i.alias("bin"), (low + i * w).alias("lo"), (low + (i + 1) * w).alias("hi"), (low + (i + 0.5) * w).alias("center"))


def hist1d(df: DataFrame, x: str | Column, low: float, high: float, n: int, by: list[str] | None = None, weight: str | None = None, pdf: bool = False) -> DataFrame:
    """by, bin, lo, hi, center, weight; bins without entries have 0. pdf: sum(weight * width) is 1.

    A partial aggregate by bin; the frame of bins is a literal table that is broadcast (n rows times the groups of by).
    """
    by = by or []
    value = F.sum(weight) if weight else F.count("*").cast("double")
    counted = df.withColumn("bin", bin_index(x, low, high, n)).where("bin is not null").groupBy(*by, "bin").agg(value.alias("weight"))
    frame = bins(df.sparkSession, low, high, n)
    if by:
        frame = df.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).join(F.broadcast(frame), "bin")
    out = frame.join(counted, [*by, "bin"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    if pdf:
        out = out.withColumn("weight", F.col("weight") / (F.sum("weight").over(Window.partitionBy(*by)) * ((high - low) / n)))
    return out.select(*by, "bin", "lo", "hi", "center", "weight")


def hist_edges(df: DataFrame, x: str, edges: list[float], by: list[str] | None = None) -> DataFrame:
    """Histogram over uneven edges (left-closed, last edge outside): the bin is a search in the literal edges."""
    by = by or []
    i = F.lit(None).cast("long")
    for k in reversed(range(len(edges) - 1)):
        i = F.when((F.col(x) >= edges[k]) & (F.col(x) < edges[k + 1]), k).otherwise(i)
    at = F.array(*[F.lit(float(e)) for e in edges])
    lo, hi = F.element_at(at, (F.col("bin") + 1).cast("int")), F.element_at(at, (F.col("bin") + 2).cast("int"))
    counted = df.withColumn("bin", i).where("bin is not null").groupBy(*by, "bin").agg(F.count("*").cast("double").alias("weight"))
    frame = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    frame = frame.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(edges) - 2).cast("long"))))
    return frame.join(counted, [*by, "bin"], "left").select(*by, "bin", lo.alias("lo"), hi.alias("hi"), ((lo + hi) / 2).alias("center"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


def digitize(x: str, edges: list[float]) -> Column:
    """Number (from 1) of the last edge that is not above x; 0 below the first."""
    return sum((F.when(F.col(x) >= e, 1).otherwise(0) for e in edges), F.lit(0))


def log_edges(low: float, high: float, n: int) -> list[float]:
    """n + 1 edges, evenly spaced in the logarithm."""
    a, b = math.log10(low), math.log10(high)
    return [10 ** (a + (b - a) * i / n) for i in range(n + 1)]


def log_hist(df: DataFrame, x: str, low: float, high: float, n: int) -> DataFrame:
    return hist1d(df.where(F.col(x) > 0), F.log10(x), math.log10(low), math.log10(high), n)


def hist2d(df: DataFrame, x: str, y: str, nx: int, ny: int, xlim: tuple[float, float], ylim: tuple[float, float]) -> DataFrame:
    """Counts by (x bin, y bin), only bins with entries."""
    return df.select(bin_index(x, *xlim, nx).alias("xbin"), bin_index(y, *ylim, ny).alias("ybin")).where("xbin is not null and ybin is not null").groupBy("xbin", "ybin").agg(F.count("*").alias("n"))


def profile(df: DataFrame, x: str, y: str, low: float, high: float, n: int, y_bins: int | None = None, y_lim: tuple[float, float] | None = None, least_share: float = 0.0) -> DataFrame:
    """Per x bin: x_mean (bin centre), x_std (half width), y_mean, y_std, n.

    With y_bins, y is first binned within y_lim in every x bin, bins under least_share of the x bin's fullest are dropped, and
    mean and (frequency-corrected) std are those of the remaining bin centres.
    """
    w = (high - low) / n
    binned = df.withColumn("bin", bin_index(x, low, high, n)).where("bin is not null")
    if y_bins:
        step = (y_lim[1] - y_lim[0]) / y_bins
        cells = binned.withColumn("yb", bin_index(y, *y_lim, y_bins)).where("yb is not null").groupBy("bin", "yb").agg(F.count("*").alias("m"))
        cells = cells.withColumn("most", F.max("m").over(Window.partitionBy("bin"))).where(F.col("m") >= least_share * F.col("most")).withColumn("c", y_lim[0] + (F.col("yb") + 0.5) * step)
        total = F.sum("m")
        mean = F.sum(F.col("m") * F.col("c")) / total
        var = (F.sum(F.col("m") * F.col("c") * F.col("c")) - total * mean * mean) / (total - 1)
        out = cells.groupBy("bin").agg(total.alias("n"), mean.alias("y_mean"), F.when(total > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("y_std"))
    else:
        out = binned.groupBy("bin").agg(F.count(y).alias("n"), F.avg(y).alias("y_mean"), F.stddev_samp(y).alias("y_std"))
    return out.select("bin", (low + (F.col("bin") + 0.5) * w).alias("x_mean"), F.lit(w / 2).alias("x_std"), "y_mean", "y_std", "n")


def counts_in_range(hist: DataFrame, low: float, high: float) -> DataFrame:
    """Weight of the bins whose centre lies in [low, high]."""
    return hist.agg(F.coalesce(F.sum(F.when(F.col("center").between(low, high), F.col("weight"))), F.lit(0.0)).alias("counts"))


def efficiency_from_below(hist: DataFrame, low: float, high: float) -> DataFrame:
    """For every bin centre in [low, high] as lower bound: the share of the range's weight at or above it (one reverse running sum)."""
    part = hist.where(F.col("center").between(low, high))
    w = Window.orderBy(F.col("center").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return part.select("center", (F.sum("weight").over(w) / F.sum("weight").over(Window.partitionBy())).alias("efficiency"))


def hist_moments(hist: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Weighted mean and std (population) of bin centres, centre of the first fullest bin, total."""
    w, c = F.col("weight"), F.col("center")
    mean = F.sum(w * c) / F.sum(w)
    var = F.sum(w * c * c) / F.sum(w) - mean * mean
    peak = F.max(F.struct("weight", (-F.col("center")).alias("neg")))
    out = hist.groupBy(*(by or [])).agg(mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"), peak.alias("p"), F.sum(w).alias("total"))
    return out.select(*(by or []), "mean", "std", (-F.col("p.neg")).alias("peak"), "total")


# Polynomial of the error function, absolute error under 1.5e-7 (fixed values).
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
_ERF_P = 0.3275911


def erf(x: Column) -> Column:
    a = F.abs(x)
    t = 1 / (1 + _ERF_P * a)
    poly = F.lit(0.0)
    for c in reversed(_ERF):
        poly = (poly + c) * t
    return F.signum(x) * (1 - poly * F.exp(-a * a))


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / math.sqrt(2)))


def smear(hist: DataFrame, sigma: float) -> DataFrame:
    """Expected weights after a Gaussian resolution: every bin's weight spread over the histogram's own bins.

    hist is the small table of bins, so the join of bins with bins is bounded by the square of their number.
    """
    a = hist.select(F.col("center").alias("from_center"), F.col("weight").alias("w"))
    share = normal_cdf((F.col("hi") - F.col("from_center")) / sigma) - normal_cdf((F.col("lo") - F.col("from_center")) / sigma)
    return hist.drop("weight").join(F.broadcast(a), F.lit(True)).groupBy("bin", "lo", "hi", "center").agg(F.sum(F.col("w") * share).alias("weight"))


def linear_fit(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Least squares y = intercept + slope x with standard errors; null where it has no answer."""
    n, sxx, syy, sxy = F.count(F.expr(f"case when {x} is not null and {y} is not null then 1 end")), F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x)
    out = df.groupBy(*(by or [])).agg(n.alias("n"), sxx.alias("sxx"), syy.alias("syy"), sxy.alias("sxy"), F.regr_avgx(y, x).alias("mx"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    s2 = F.greatest((F.col("syy") - F.col("slope") * F.col("sxy")) / (F.col("n") - 2), F.lit(0.0))
    ok = (F.col("n") > 2) & (F.col("sxx") > 0)
    return out.select(*(by or []), "n", "intercept", "slope", F.when(ok, F.sqrt(s2 * (1 / F.col("n") + F.col("mx") * F.col("mx") / F.col("sxx")))).alias("intercept_err"), F.when(ok, F.sqrt(s2 / F.col("sxx"))).alias("slope_err"))


def _det(m: list[list[Column]]) -> Column:
    if len(m) == 1:
        return m[0][0]
    return sum(((-1) ** j * m[0][j] * _det([row[:j] + row[j + 1 :] for row in m[1:]]) for j in range(len(m))), F.lit(0.0))


def poly_fit(df: DataFrame, x: str, y: str, degree: int, by: list[str] | None = None) -> DataFrame:
    """n, and the least-squares coefficients c0.. of a polynomial with their standard errors c0_err.. (null without spare points).

    Power sums about the group's mean and spread of x in one aggregate; the normal equations are solved on the aggregated row.
    """
    by = by or []
    clean = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if by:
        facts = clean.groupBy(*by).agg(F.avg(x).alias("__m"), F.stddev_pop(x).alias("__s"))
        d = clean.join(facts, by)
    else:
        m = clean.agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).first()
        d = clean.withColumn("__m", F.lit(m["m"])).withColumn("__s", F.lit(m["s"]))
    u = (F.col(x) - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)
    k = degree + 1
    sums = [F.sum(F.pow(u, F.lit(p))).alias(f"s{p}") for p in range(2 * degree + 1)] + [F.sum(F.pow(u, F.lit(p)) * F.col(y)).alias(f"t{p}") for p in range(k)]
    a = d.groupBy(*by).agg(*sums, F.sum(F.col(y) * F.col(y)).alias("yy"), F.first("__m").alias("m"), F.first(F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)).alias("s"))
    mat = [[F.col(f"s{i + j}") for j in range(k)] for i in range(k)]
    minor = lambda r, c: [row[:c] + row[c + 1 :] for i, row in enumerate(mat) if i != r]
    a = a.withColumn("det", _det(mat))
    solved = {f"b{c}": F.try_divide(_det([[F.col(f"t{i}") if j == c else mat[i][j] for j in range(k)] for i in range(k)]), F.col("det")) for c in range(k)}
    inverse = {f"v{i}{j}": F.try_divide((-1) ** (i + j) * (_det(minor(i, j)) if k > 1 else F.lit(1.0)), F.col("det")) for i in range(k) for j in range(i, k)}
    a = a.select("*", *[c.alias(n) for n, c in (solved | inverse).items()])
    rss = F.col("yy") - sum((F.col(f"b{i}") * F.col(f"t{i}") for i in range(1, k)), F.col("b0") * F.col("t0"))
    a = a.withColumn("s2", F.when(F.col("s0") > k, F.greatest(rss, F.lit(0.0)) / (F.col("s0") - k)))
    # back from u = (x - m) / s to powers of x: row i of the change of base
    out = []
    for i in range(k):
        base = {p: math.comb(p, i) * F.pow(-F.col("m"), F.lit(p - i)) / F.pow(F.col("s"), F.lit(p)) for p in range(i, k)}
        terms = [F.col(f"b{p}") * base[p] for p in base]
        spread = [base[p] * base[q] * F.col(f"v{min(p, q)}{max(p, q)}") for p in base for q in base]
        out += [sum(terms[1:], terms[0]).alias(f"c{i}"), F.sqrt(F.col("s2") * F.greatest(sum(spread[1:], spread[0]), F.lit(0.0))).alias(f"c{i}_err")]
    return a.select(*by, F.col("s0").cast("long").alias("n"), *out)


def student_quantile(z: float, dof: Column) -> Column:
    """Quantile of Student's distribution from the normal one, by the expansion in 1 / dof (to 0.1 % from 5 degrees of freedom on)."""
    return z + (z**3 + z) / (4 * dof) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * dof * dof)


def with_intervals(fit: DataFrame, coefficients: list[str], z: float = 1.959964) -> DataFrame:
    """A fit with ``c_low`` and ``c_high`` for each coefficient c that has a ``c_err``; z: normal quantile of the level (95 %)."""
    t = student_quantile(z, F.greatest(F.col("n") - len(coefficients), F.lit(1)))
    return fit.withColumns({f"{c}_{side}": F.col(c) + sign * t * F.col(f"{c}_err") for c in coefficients for side, sign in (("low", -1), ("high", 1))})


def poly_value(x: str | Column, coefficients: list) -> Column:
    """Value of a polynomial with numbers or columns as coefficients."""
    x = F.col(x) if isinstance(x, str) else x
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * x + (c if isinstance(c, Column) else F.lit(float(c)))
    return out


def fit_profile(df: DataFrame, x: str, y: str, low: float, high: float, n: int, degree: int = 1) -> DataFrame:
    p = profile(df, x, y, low, high, n)
    return linear_fit(p, "x_mean", "y_mean") if degree == 1 else poly_fit(p, "x_mean", "y_mean", degree)


def gauss_fit(df: DataFrame, x: str, low: float | None = None, high: float | None = None, by: list[str] | None = None, fixed_mean: float | None = None) -> DataFrame:
    """Maximum-likelihood Gaussian in the open window (low, high): n, mu, sigma, -log L, and errors sigma/sqrt(n), sigma/sqrt(2n)."""
    d = df
    if low is not None:
        d = d.where(F.col(x) > low)
    if high is not None:
        d = d.where(F.col(x) < high)
    mu = F.avg(x) if fixed_mean is None else F.lit(float(fixed_mean))
    sigma = F.stddev_pop(x) if fixed_mean is None else F.sqrt(F.avg((F.col(x) - fixed_mean) * (F.col(x) - fixed_mean)))
    out = d.groupBy(*(by or [])).agg(F.count(x).alias("n"), mu.alias("mu"), sigma.alias("sigma"))
    nll = F.when(F.col("sigma") > 0, F.col("n") * (F.log("sigma") + 0.5 * math.log(2 * math.pi) + 0.5))
    return out.select(*(by or []), "n", "mu", "sigma", nll.alias("nll"), (F.col("sigma") / F.sqrt("n")).alias("mu_err"), (F.col("sigma") / F.sqrt(2 * F.col("n"))).alias("sigma_err"))


def gauss_value(x: str, mu: float, sigma: float, scale: float = 1.0) -> Column:
    u = (F.col(x) - mu) / sigma
    return scale * F.exp(-0.5 * u * u) / (sigma * math.sqrt(2 * math.pi))


def gauss2_value(x: str, one: tuple[float, float, float], two: tuple[float, float, float]) -> Column:
    return gauss_value(x, *one) + gauss_value(x, *two)


def photopeak_fit(df: DataFrame, sensor: str, charge: str, low: float, high: float, n: int, half_window: float) -> DataFrame:
    """Per sensor: its photopeak (first fullest bin), a Gaussian fit in the window about it, and the resolution 2.355 sigma / mu.

    The histogram of all sensors is one aggregate; the window join is on the sensor, whose peaks are one row each.
    """
    h = df.withColumn("bin", bin_index(charge, low, high, n)).where("bin is not null").groupBy(sensor, "bin").agg(F.count("*").alias("m"))
    peak = h.groupBy(sensor).agg(F.max(F.struct("m", (-F.col("bin")).alias("neg"))).alias("p"))
    peak = peak.select(sensor, (low + (-F.col("p.neg") + 0.5) * ((high - low) / n)).alias("peak"))
    near = df.join(peak, sensor).where((F.col(charge) > F.col("peak") - half_window) & (F.col(charge) < F.col("peak") + half_window))
    fit = gauss_fit(near, charge, by=[sensor, "peak"])
    return fit.withColumn("resolution", F.when(F.col("mu") != 0, 2.355 * F.col("sigma") / F.col("mu")))
