"""Histograms, fits, efficiencies."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracksmith.operators import efficiency as ef
from tracksmith.operators import hist as hi


def frame(spark, values, name="x"):
    return spark.createDataFrame([(float(v),) for v in values], f"{name} double")


def weights(h):
    return [r["weight"] for r in h.orderBy("bin").collect()]


def test_last_edge_is_outside(spark):
    d = frame(spark, [0, 0.5, 1, 2, 3, 3.5, -1])
    assert weights(hi.hist1d(d, "x", 0.0, 3.0, 3)) == [2, 1, 1]
    assert weights(hi.hist_edges(d, "x", [0.0, 1.0, 3.0])) == [2, 2]
    assert [r["center"] for r in hi.bins(spark, 0.0, 3.0, 3).orderBy("bin").collect()] == [0.5, 1.5, 2.5]


def test_pdf_sums_to_one(spark):
    h = hi.hist1d(frame(spark, [0.5, 1, 1.5, 2, 3, 4, 5]), "x", 0.0, 6.0, 3, pdf=True)
    assert sum(weights(h)) * 2 == pytest.approx(1)


def test_fits(spark):
    d = spark.createDataFrame([(float(x), 2.0 * x, 1 + 2 * x + 0.5 * x * x, 1 + 2 * x + 0.5 * x * x + 0.1 * x**3) for x in range(-10, 11)], "x double, a double, b double, c double")
    r = hi.linear_fit(d, "x", "a").first()
    assert (r["intercept"], r["slope"]) == (pytest.approx(0, abs=1e-9), pytest.approx(2))
    q = hi.poly_fit(d, "x", "b", 2).first()
    assert [q[f"c{i}"] for i in range(3)] == pytest.approx([1, 2, 0.5])
    c = hi.poly_fit(d.withColumn("x", F.col("x")), "x", "c", 3).first()
    assert [c[f"c{i}"] for i in range(4)] == pytest.approx([1, 2, 0.5, 0.1])


def test_gauss_fit(spark):
    random.seed(42)
    r = hi.gauss_fit(frame(spark, [random.gauss(10, 2) for _ in range(10000)]), "x").first()
    assert r["mu"] == pytest.approx(10, abs=0.1) and r["sigma"] == pytest.approx(2, abs=0.1)
    assert r["mu_err"] == pytest.approx(r["sigma"] / 100)


def test_erf_and_smear(spark):
    got = [r[0] for r in frame(spark, [-2, -0.5, 0, 0.3, 1, 3]).select(hi.erf(F.col("x"))).collect()]
    assert got == pytest.approx([math.erf(x) for x in (-2, -0.5, 0, 0.3, 1, 3)], abs=2e-7)
    h = hi.hist1d(frame(spark, [5.5] * 100), "x", 0.0, 11.0, 11)
    assert sum(weights(hi.smear(h, 1.0))) == pytest.approx(100, abs=0.01)


def test_efficiency_strictness(spark):
    d = frame(spark, [1, 2, 2, 3])
    get = lambda inclusive: [r["n_pass"] for r in ef.efficiency_vs_cut(d, "x", [0.0, 1.0, 2.0, 3.0], inclusive).orderBy("cut").collect()]
    assert get(False) == [4, 3, 1, 0] and get(True) == [4, 4, 3, 1]


def test_merit_takes_the_first_maximum(spark):
    e = spark.createDataFrame([(0.0, 1.0, 1.0), (1.0, 0.8, 0.16), (2.0, 0.4, 0.04)], "cut double, eff_signal double, eff_background double")
    best = ef.figure_of_merit(e, 0.0).where("best").collect()
    assert [r["cut"] for r in best] == [1.0]
    assert ef.auc(ef.roc_curve(e)).first()[0] == pytest.approx(0.4 * (0.96 + 0.84) / 2 + 0.2 * 0.84 / 2)


def test_interpolation_has_flat_ends(spark):
    c = ef.literal_curve(spark, [(0.0, 1.0, 0.9), (1.0, 0.5, 0.1)])
    got = {r["at"]: r["eff_signal"] for r in ef.interpolate(c, [-1.0, 0.0, 0.25, 1.0, 7.0]).collect()}
    assert got == pytest.approx({-1.0: 1.0, 0.0: 1.0, 0.25: 0.875, 1.0: 0.5, 7.0: 0.5})


def test_exact_binomial_limits(spark):
    d = spark.createDataFrame([(0, 10), (5, 10), (10, 10)], "n_pass long, n long")
    r = ef.binomial_interval(d, level=0.95).orderBy("n_pass").collect()
    assert [(r[0]["low"], r[2]["high"])] == [(0, 1)]
    assert (r[0]["high"], r[1]["low"], r[1]["high"]) == (pytest.approx(0.3085, abs=1e-4), pytest.approx(0.1871, abs=1e-4), pytest.approx(0.8129, abs=1e-4))


def test_cut_flow(spark):
    h = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 1.0), (1, 1.0, 0.0, 6.0, 1.0), (2, 90.0, 0.0, 5.0, 2.0)], "event_id long, x double, y double, z double, energy double")
    r = ef.event_selection(h, 50.0, 2, (-10.0, 0.0), (1.0, 10.0), (1900.0, 2100.0), 10.0).first()
    assert (r["n_events"], r["n_radial"], r["n_length"], r["n_z"]) == (2, 1, 1, 1) and r["n_roi"] == pytest.approx(1) and r["eff_total"] == pytest.approx(0.5)


def test_beta_quantile_of_few_and_many():
    """The interval's quantiles against the binomial tail sum, and for a number of events that no array could hold."""
    from math import comb

    for n, k, p in ((1, 1, 0.2), (10, 3, 0.15865), (10, 10, 0.84), (200, 192, 0.5)):
        x = ef._beta_quantile(p, k, n - k + 1)
        assert sum(comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(k, n + 1)) == pytest.approx(p, abs=1e-9)
    low = ef._beta_quantile(0.15865, 3e8, 7e8 + 1)
    assert low == pytest.approx(0.3 - (0.3 * 0.7 / 1e9) ** 0.5, abs=1e-6)
