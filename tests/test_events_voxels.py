"""Literal cases with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracksmith.operators import events as ev
from tracksmith.operators import relational as rel
from tracksmith.operators import tracks as tr
from tracksmith.operators import voxels as vx

HITS = "event_id long, x double, y double, z double, energy double"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_one_voxel(spark):
    h = spark.createDataFrame([(1, v, v, v, v) for v in (0.1, 0.2, 0.3)], HITS)
    r = vx.voxelize(h, 1.0).first()
    assert (r["x"], r["y"], r["z"], r["electrons"], r["voxel_id"]) == (0.5, 0.5, 0.5, 24000, 1)
    assert r["energy"] == pytest.approx(0.6)


def test_negative_cells_floor_downwards(spark):
    h = spark.createDataFrame([(1, -1.5, 0.1, 0.1, 0.1), (1, -1.2, 0.1, 0.1, 0.2)], HITS)
    r = vx.voxelize(h, 1.0).first()
    assert r["x"] == -1.5 and r["energy"] == pytest.approx(0.3)


def test_voxels_keep_the_energy(spark):
    h = spark.range(500).selectExpr("id % 7 as event_id", "cast(id * 37 % 101 as double) / 7 as x", "cast(id * 13 % 89 as double) / 5 as y", "cast(id * 7 % 97 as double) / 3 as z", "1.0 + id % 3 as energy")
    assert vx.voxelize(h, 2.0).agg(F.sum("energy")).first()[0] == pytest.approx(h.agg(F.sum("energy")).first()[0])


def points(spark, xyz, energies=None):
    data = [(1, *map(float, p), 1.0 if energies is None else energies[i], i + 1) for i, p in enumerate(xyz)]
    return spark.createDataFrame(data, HITS + ", voxel_id int")


def test_pair_distances(spark):
    p = points(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0)])
    assert sorted(r["dist"] for r in vx.voxel_distances(p).collect()) == pytest.approx([1, 1, math.sqrt(2)])
    assert vx.voxel_distances(p, 1.0).count() == 2


def test_bucketed_pairs_equal_all_pairs(spark):
    h = spark.range(300).selectExpr("id % 3 as event_id", "cast(id * 37 % 101 as double) / 7 as x", "cast(id * 13 % 89 as double) / 5 as y", "cast(id * 7 % 97 as double) / 3 as z", "1.0 as energy", "cast(id as int) as voxel_id")
    near = vx.near_pairs(h, 3.3).select("event_id", "src", "dst")
    every = vx.voxel_distances(h).where("dist <= 3.3").select("event_id", "src", "dst")
    assert rows(near, "event_id", "src", "dst") == rows(every, "event_id", "src", "dst")
    assert near.count() > 20


def test_nearest_distance(spark):
    p = points(spark, [(0, 0, 0), (1, 0, 0), (5, 0, 0)])
    assert [r["dist"] for r in vx.closest_distance(p).orderBy("voxel_id").collect()] == [1, 1, 4]
    assert vx.closest_distance(p, 2.0).count() == 2


LINE = [(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0), (10, 10, 10)]


def test_tracks(spark):
    p = points(spark, LINE, [0.5, 0.3, 0.4, 0.2, 0.6])
    t = tr.build_tracks(p, 1.5).groupBy("track_id").agg(F.sum("energy").alias("e"), F.count("*").alias("n"))
    assert [(r["track_id"], pytest.approx(r["e"]), r["n"]) for r in t.orderBy("track_id").collect()] == [(1, 1.4, 4), (2, 0.6, 1)]
    assert tr.build_tracks(p, 1.5, 250.0).count() == 4


def test_knn_and_mutual(spark):
    p = points(spark, [(0, 0, 0), (1, 0, 0), (1.9, 0, 0), (9, 0, 0)])
    assert rows(tr.knn_links(p, 1).select("src", "dst"), "src", "dst") == [(1, 2), (2, 3), (3, 4)]
    assert rows(tr.knn_links(p, 1, mutual=True).select("src", "dst"), "src", "dst") == [(2, 3)]


def test_dbscan(spark):
    p = points(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0), (3.4, 0, 0), (50, 0, 0), (60, 0, 0), (60.5, 0, 0), (61, 0, 0)])
    got = {r["voxel_id"]: r["label"] for r in tr.dbscan(p, 1.5, 3).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0, 6: 2, 7: 2, 8: 2}


def events4(spark):
    data = [(1, 10, 20, 30), (1, -50, 60, -70), (2, 150, 0, 0), (3, 0, 0, 150), (4, 1, 1, 1)]
    return spark.createDataFrame([(e, float(x), float(y), float(z), 0.1) for e, x, y, z in data], HITS)


def ids(df):
    return [r[0] for r in df.select("event_id").distinct().orderBy("event_id").collect()]


def test_cuts_ask_all_hits(spark):
    h = events4(spark)
    assert ids(ev.filter_fiducial(h, 100, 100)) == [1, 4]
    assert ids(ev.filter_radial(h, 100)) == [1, 3, 4]
    assert ids(ev.filter_z(h, (-100, -10), (0.5, 100))) == [1, 4]
    assert ids(ev.filter_short(h, 2)) == [1]


def test_energies(spark):
    h = spark.createDataFrame([(1, 0.0, 0.0, 0.0, e) for e in (0.1, 0.2, 0.3)] + [(2, 0.0, 0.0, 0.0, e) for e in (0.4, 0.5)] + [(3, 0.0, 0.0, 0.0, 0.6)], HITS)
    assert [pytest.approx(e) for _, e in rows(ev.energy_deposited(h), "event_id")] == [0.6, 0.9, 0.6]
    assert rows(ev.hits_per_event(h), "event_id") == [(1, 3), (2, 2), (3, 1)]
    p = spark.createDataFrame([(1, 0, 1.0), (1, 0, 1.044), (1, 1, 9.0), (2, 3, 1.0)], "event_id long, mother_id int, kin_energy double")
    assert [pytest.approx(e) for _, e in rows(ev.energy_primary(p), "event_id")] == [2.044, 0.0]


def test_events_by_spec_rank_and_id(spark):
    h = spark.range(1, 21).selectExpr("id as event_id")
    assert ids(rel.choose_events(h, "1:5:20,3,18:19")) == [1, 3, 6, 11, 16, 18, 19]
    assert ids(rel.choose_events(h, first=3)) == [1, 2, 3]
    assert ids(rel.choose_events(h, first=2, from_rank=4)) == [4, 5]
    with pytest.raises(KeyError):
        rel.get_event(h, 99)
    with pytest.raises(ValueError):
        rel.validate_parameters(0.0, 1.0, 1.0)


def test_components_are_label_free(spark):
    from tracksmith.operators.components import connected_components

    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 202), (202, 201)]
    got = {r["vertex"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 201: 200, 202: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_nearest_in_growing_cells(spark):
    """Growing cells give the rows of all pairs: clustered, flat, equal and lone points, nulls, fewer than k, an empty table."""
    rng = random.Random(5)
    rows = [(e, i, *(rng.choice((0.0, 100.0)) + rng.random() * e * 10 for _ in "xyz")) for e in range(1, 4) for i in range(20 * e)]
    rows += [(4, i, float(i // 2), 0.0, 0.0) for i in range(9)] + [(5, i, 1.0, 1.0, 1.0) for i in range(3)] + [(6, 0, 1.0, 1.0, 1.0), (7, 0, None, 1.0, 1.0), (7, 1, 1.0, 1.0, 1.0), (None, 0, 1.0, 1.0, 1.0)]
    p = spark.createDataFrame(rows, "event_id int, voxel_id int, x double, y double, z double")
    want = {}
    for k in (1, 3):
        want[k] = set()
        for e, i, *a in rows:
            if e is None or None in a:
                continue
            near = sorted((math.sqrt(sum((s - t) * (s - t) for s, t in zip(a, b, strict=True))), j) for f, j, *b in rows if f == e and j != i and None not in b)
            want[k] |= {(e, i, j) for _, j in near[:k]}
    q, t = p.withColumnRenamed("voxel_id", "src"), p.withColumnRenamed("voxel_id", "dst")
    for k, few in ((1, 0), (3, 0), (1, 30), (3, 64)):
        got = [(r["event_id"], r["src"], r["dst"]) for r in vx.nearest(q, t, k, ["event_id"], True, few).collect()]
        assert len(got) == len(set(got)) and set(got) == want[k]
    assert vx.nearest(q.where("false"), t.where("false"), 1, ["event_id"], True, 0).count() == 0


def test_few_targets_are_not_searched_by_cells(spark):
    """within() by one join on the keys and by cells finds the same pairs; few targets send no query to 27 cells."""
    rng = random.Random(5)
    rows = lambda n, e: [(e, i, *[rng.uniform(-9, 9) for _ in "xyz"]) for i in range(n)]
    frame = lambda r: spark.createDataFrame([*r, (1, 999, None, 0.0, 0.0)], "event_id long, id int, x double, y double, z double")
    q, t = frame(rows(20, 1) + rows(20, 2)), frame(rows(40, 1) + rows(90, 2))
    got = [sorted((r["event_id"], r["q"]["id"], r["t"]["id"], r["dist"]) for r in vx.within(q, t, 4.0, ["event_id"], few).collect()) for few in (0, 64, 1000)]
    assert got[0] == got[1] == got[2] != []
    assert "Generate" not in vx.within(q, t, 4.0, ["event_id"], 1000)._jdf.queryExecution().optimizedPlan().toString()
