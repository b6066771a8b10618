"""Spheres, truth paths and profiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracksmith.operators import blobs as bl
from tracksmith.operators import ends as en
from tracksmith.operators import paths as pa
from tracksmith.operators import profile as pr
from tracksmith.operators import tracks as tr


@pytest.fixture(scope="module")
def line6(spark):
    vox = spark.createDataFrame([(1, float(i), 0.0, 0.0, 0.1 * (i + 1), i + 1) for i in range(6)], "event_id long, x double, y double, z double, energy double, voxel_id int")
    links = tr.radius_links(vox, 1.1)
    t = tr.make_tracks(vox, links)
    return t, *en.find_ends(t, links)


@pytest.mark.parametrize(("radius", "small", "large"), [(0.5, 0.1, 0.6), (1.1, 0.3, 1.1), (10.0, 2.1, 2.1), (0.0, 0.1, 0.6)])
def test_spheres(line6, radius, small, large):
    t, w, _ = line6
    r = bl.sphere_energies(w, t, radius).first()
    assert r["blob1_energy"] == pytest.approx(large) and r["blob2_energy"] == pytest.approx(small)


def test_walk_and_arc_length(line6):
    t, w, steps = line6
    p = pa.path_points(steps, t).orderBy("step").collect()
    assert [r["s"] for r in p] == [0, 1, 2, 3, 4, 5]
    assert pa.path_length(pa.path_points(steps, t)).first()["length"] == 5
    r = bl.end_voxel_energies(pa.path_points(steps, t), 10).first()
    assert (r["count"], pytest.approx(r["blob1_energy"]), pytest.approx(r["blob2_energy"])) == (3, 1.5, 0.6)
    v = bl.variable_spheres(w, t, 1.0, 1.0, 10.0).first()
    assert (v["start_radius"], v["end_radius"]) == (6.0, 5.0) and len(v["blob1_history"]) == 6
    assert bl.skeleton_coverage(pa.project_to_path(t, pa.path_points(steps, t)), 0.5).first()["coverage"] == pytest.approx(1)


def test_blob_order_ties_go_to_the_start(spark):
    vox = spark.createDataFrame([(1, float(i), 0.0, 0.0, 1.0, i + 1) for i in range(4)], "event_id long, x double, y double, z double, energy double, voxel_id int")
    links = tr.radius_links(vox, 1.1)
    t = tr.make_tracks(vox, links)
    r = bl.sphere_energies(en.find_ends(t, links)[0], t, 1.0).first()
    assert r["blob1_cx"] == r["start_cx"]


def test_truth_reentry_makes_a_new_voxel(spark):
    h = spark.createDataFrame([(1, 1, 0.0, 1, 0.1, 0.0, 0.0, 1.0), (1, 1, 1.0, 2, 0.3, 0.0, 0.0, 3.0), (1, 1, 2.0, 3, 1.5, 0.0, 0.0, 1.0), (1, 1, 3.0, 4, 0.5, 0.0, 0.0, 1.0)], "event_id long, particle_id int, time double, hit_id int, x double, y double, z double, energy double")
    t = pa.truth_voxels(h, 1.0).orderBy("island").collect()
    assert [(pytest.approx(r["x"]), r["energy"]) for r in t] == [(0.25, 4), (1.5, 1), (0.5, 1)]


def curve(spark, f):
    return spark.createDataFrame([(1, i, float(i), float(v)) for i, v in enumerate(f)], "event_id long, i int, s double, f double")


def test_peaks_by_hand(spark):
    p = pr.peaks(curve(spark, [1, 4, 2, 3, 0, 5, 1]), 0.0, ["event_id"]).orderBy("rank").collect()
    assert [(r["i"], r["prominence"]) for r in p] == [(5, 5.0), (1, 4.0), (3, 1.0)]
    top = p[0]
    assert (top["left"], top["right"], top["width"]) == (pytest.approx(4.5), pytest.approx(5.625), pytest.approx(1.125))


def test_peaks_against_brute_force(spark):
    f = np.abs(np.sin(np.arange(60) * 0.7) * np.cos(np.arange(60) * 0.13) + 0.1 * np.sin(np.arange(60) * 2.3))
    got = {r["i"]: r["prominence"] for r in pr.peaks(curve(spark, f), 0.0, ["event_id"]).collect()}
    z = np.concatenate([[0], f, [0]])
    want = {}
    for k in range(1, len(z) - 1):
        if z[k] > z[k - 1] and z[k] > z[k + 1]:
            a = max([i for i in range(k) if z[i] > z[k]], default=-1)
            b = min([i for i in range(k + 1, len(z)) if z[i] > z[k]], default=len(z))
            want[k - 1] = z[k] - max(z[a + 1 : k].min(), z[k + 1 : b].min())
    assert got == pytest.approx(want)


def test_maxima_need_prominence(spark):
    m = pr.maxima(curve(spark, [5, 1, 0.5, 1, 3, 1, 0, 0.2, 4]), 0.1, 3, ["event_id"]).orderBy("rank").collect()
    assert [r["i"] for r in m] == [0, 8, 4]


def test_kde_integrates_to_one(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0), (1, 50.0, 2.0), (1, 60.0, 1.0), (1, 100.0, 0.0)], "event_id long, s double, energy double")
    k = pr.energy_kde(s, 5.0, 201, ["event_id"])
    assert k.agg(F.sum("f")).first()[0] * 0.5 == pytest.approx(1, abs=1e-6)


def test_curves_are_sums_of_one_row_a_track(spark):
    """Samples are not sent to every point of the grid, and curves are not written: only the inputs are read."""
    from tracksmith.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    assert {f.rsplit("/", 1)[1] for n in ("k3_maxima", "k6_end_peaks", "k8_valley") for f in QUERIES[n](spark, sf).inputFiles()} == {"lineitem.parquet"}
    plan = QUERIES["k1_energy_kde"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")


def test_curves_as_rows_and_as_arrays(spark):
    """Both forms of a curve, of different lengths in one table, give the same peaks, maxima and ends."""
    long = curve(spark, [1, 4, 2, 3, 0, 5, 1]).unionByName(curve(spark, [2.0, 1.0]).withColumn("event_id", F.lit(9).cast("long")))
    packed = long.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("i", "s", "f"))).alias("c")).select("event_id", F.col("c.s").alias("s"), F.col("c.f").alias("f"))
    for work in (lambda c: pr.peaks(c, 0.0, ["event_id"]), lambda c: pr.maxima(c, 0.1, 3, ["event_id"]), lambda c: pr.end_peaks(c, 2.0, ["event_id"]), lambda c: pr.valley(c, 1.0, ["event_id"])):
        assert sorted(work(long).collect()) == sorted(work(packed).collect()) != []


def test_rounded_density_and_paths_of_one_place(spark):
    """A path of one place is a constant curve; rounded points are those of decimal rounding."""
    rows = [(1, 0.0, 1.0), (1, 0.0, 2.5), *[(2, 0.7 * i, 0.1 + i % 3) for i in range(12)], (3, 0.0, 1.0), (3, 4.0, 2.0)]
    s = spark.createDataFrame(rows, "event_id long, s double, energy double")
    whole = pr.energy_kde(s, 5.0, 64, ["event_id"])
    near = pr.energy_kde(s, 5.0, 64, ["event_id"], digits=8)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, whole.select("event_id", "i", F.round("s", 8), F.round("f", 8)).collect()))
    assert len({(r["s"], r["f"]) for r in whole.where("event_id = 1").collect()}) == 1
    curves = pr.rounded_curves(pr.density(s, 5.0, 64, ["event_id"]), 6, 8, ["event_id"])
    assert sorted(tuple(r) for r in curves.select("event_id", F.posexplode("f")).collect()) == sorted((r[0], r[1], r[3]) for r in near.collect())
    assert "round(" not in near._jdf.queryExecution().optimizedPlan().toString()
    assert {r["event_id"] for r in pr.peaks(curves, 0.2, ["event_id"]).collect()} == {2, 3}
