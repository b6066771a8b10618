"""Exact medians by interval narrowing, components with heavy vertices, pairs of few and of many points, ROC areas."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tracksmith.operators import components as co
from tracksmith.operators import efficiency as ef
from tracksmith.operators import samples as sa
from tracksmith.operators import voxels as vx


@pytest.mark.parametrize("few", [1, 5, 4096])
def test_exact_median(spark, few):
    """One hot group, repeated values, even and odd sizes, one row, infinities, nulls."""
    rng = random.Random(few)
    groups = {"hot": [rng.gauss(0, 1) for _ in range(3001)], "same": [2.5] * 40, "two": [1.0, 4.0], "one": [7.0], "steps": [float(rng.randrange(3)) for _ in range(500)], "far": [-1e300, 1e300, 0.0, 1e-300]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("two", None), ("none", None)]
    rng.shuffle(rows)
    got = {r["part"]: r["median"] for r in sa.exact_median(spark.createDataFrame(rows, "part string, v double"), "v", ["part"], few).collect()}
    assert got == {k: pytest.approx(statistics.median(v)) for k, v in groups.items()}


def brute(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for k, a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = root((k, a)), root((k, b))
            up[max(ra, rb)] = min(ra, rb)
    return {x: root(x)[1] for x in up}


@pytest.mark.parametrize("ordinary", [16, 1 << 20])
def test_components(spark, monkeypatch, ordinary):
    """A chain, a hub, random parts, two keys, self edges, repeats and null ends; with and without heavy keys apart."""
    monkeypatch.setattr(co, "ORDINARY", ordinary)
    rng = random.Random(1)
    edges = [(1, i, i + 1) for i in range(150)] + [(2, 0, i) for i in range(1, 200)] + [(2, rng.randrange(300, 600), rng.randrange(300, 600)) for _ in range(150)] + [(1, 900, 900), (1, None, 5), (2, 7, 0), (2, 7, 0)]
    got = co.connected_components(spark.createDataFrame(edges, "k int, u long, v long"), keys=["k"])
    assert {(r["k"], r["vertex"]): r["component"] for r in got.collect()} == brute(edges)
    assert co.connected_components(spark.createDataFrame([], "k int, u long, v long"), keys=["k"]).count() == 0


def test_edges_fall_from_round_to_round(spark, monkeypatch):
    """Settled components take no further part: the edges that a round writes fall, and a long chain takes few rounds."""
    sizes = []
    counted = co.counted

    def seen(df, name, flag=None):
        out, n = counted(df, name, flag)
        if name == "edges":
            sizes.append(n)
        return out, n

    monkeypatch.setattr(co, "counted", seen)
    edges = [(i, i + 1) for i in range(2000)] + [(5000 + 2 * i, 5001 + 2 * i) for i in range(2000)]
    co.connected_components(spark.createDataFrame(edges, "u long, v long")).count()
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < 1500 and len(sizes) < 12


@pytest.mark.parametrize("radius", [0.0, 2.0, 7.5])
def test_few_and_many_points_pair_alike(spark, radius):
    rng = random.Random(3)
    points = [(e, i, float(rng.randrange(-9, 9)), rng.gauss(0, 5), rng.gauss(0, 5)) for e in range(4) for i in range(5 + 40 * e)] + [(9, i, 1.0, 1.0, 1.0) for i in range(4)]
    df = spark.createDataFrame(points, "event_id long, voxel_id int, x double, y double, z double")
    rows = lambda few: sorted((r["event_id"], r["src"], r["dst"], round(r["dist"], 9)) for r in vx.near_pairs(df, radius, few=few).collect())
    want = sorted((a[0], min(a[1], b[1]), max(a[1], b[1]), round(sum((p - q) ** 2 for p, q in zip(a[2:], b[2:], strict=True)) ** 0.5, 9)) for a in points for b in points if a[0] == b[0] and a[1] < b[1] and sum((p - q) ** 2 for p, q in zip(a[2:], b[2:], strict=True)) ** 0.5 <= radius)
    assert rows(0) == rows(64) == rows(1000) == want


def test_roc_areas(spark):
    """A straight curve has the area of a triangle, a perfect one that of the square; thresholds between points are interpolated."""
    rows = [("straight", 0.0, 1.0, 1.0), ("straight", 1.0, 0.0, 0.0), ("perfect", 0.0, 1.0, 1.0), ("perfect", 0.5, 1.0, 0.0), ("perfect", 1.0, 0.0, 0.0)]
    curve = spark.createDataFrame(rows, "sample string, threshold double, eff_signal double, eff_background double")
    got = {r["sample"]: r["auc"] for r in ef.roc_from_curves(curve, [i / 8 for i in range(9)], ["sample"]).collect()}
    assert got == {"straight": pytest.approx(0.5), "perfect": pytest.approx(1.0)}
    scan = ef.prominence_scan(spark.createDataFrame([("a", 1.0, 0.5, 200.0), ("a", 1.0, 0.1, 200.0), ("a", 90.0, 0.9, 200.0)], "sample string, peak1_left double, peak2_prominence double, peak2_right double"), "sample", [0.05, 0.3])
    assert {r["pmin"]: r["n_pass"] for r in scan.collect()} == {0.05: 2, 0.3: 1}


def test_flat_voxels(spark):
    t = spark.createDataFrame([(1, 2, 3, 1.0, 2.0, 3.0, 0.5, 7)], "event_id long, track_id int, voxel_id int, x double, y double, z double, energy double, other int")
    assert vx.flat_voxels(t).collect()[0].asDict() == {"event_id": 1, "track_id": 2, "voxel_id": 3, "x": 1.0, "y": 2.0, "z": 3.0, "energy_kev": 500.0}
    assert t.where(F.col("event_id") < 0).count() == 0
