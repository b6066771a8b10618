"""Tables dealt by event: the same rows as without, and no shuffle between them."""

import random

import pytest
from pyspark.sql import functions as F

from tracksmith import session
from tracksmith.operators import components, ends, tracks, voxels
from tracksmith.plans import QUERIES
from tracksmith.session import dealt_by, written


@pytest.fixture(scope="module")
def points(spark):
    """Events of 1 to 7 points on a coarse grid."""
    rng = random.Random(5)
    rows = [(e, i + 1, *(5.0 * rng.randrange(3) for _ in "xyz"), rng.random()) for e, n in enumerate([1, 2, 3, 4, 5, 6, 7]) for i in range(n)]
    return written(spark.createDataFrame(rows, "event_id long, voxel_id int, x double, y double, z double, energy double").dropDuplicates(["event_id", "x", "y", "z"]))


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def walk(points):
    links = written(tracks.radius_links(written(points, "points"), 7.5), "links")
    t = written(tracks.make_tracks(written(points, "points"), links).drop("track_energy"), "tracks")
    crowd = voxels.near_pairs(points, 7.5, few=4), voxels.nearest(points.withColumnRenamed("voxel_id", "src"), points.withColumnRenamed("voxel_id", "dst"), 2, ["event_id"], True, few=4)
    return [rows(df) for df in (links, t, *crowd, *ends.find_ends(t, links))]


def test_same_rows_dealt_or_not(spark, points):
    plain = walk(points)
    with dealt_by(spark, "event_id", 3):
        assert walk(points) == plain
    assert plain[0] == rows(voxels.near_pairs(points, 7.5, few=4))


def test_dealt_tables_join_without_shuffle(spark, points):
    with dealt_by(spark, "event_id", 3):
        vox = written(points, "points")
        pairs = written(voxels.near_pairs(vox.where("event_id < 6"), 7.5), "links")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            j = tracks.degrees(vox, pairs).groupBy("event_id", "degree").agg(F.count("*").alias("n"))
            assert "Exchange" not in j._jdf.queryExecution().executedPlan().toString()
            assert j.agg(F.sum("n")).first()[0] == vox.count()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("rule", ["combined", "energy", "mst"])
def test_rules_shuffle_nothing(spark, points, rule, monkeypatch):
    """No table that a rule writes from dealt tables is dealt again."""
    plans, deal = [], session.together
    with dealt_by(spark, "event_id", 3):
        vox = written(points, "points")
        links = written(tracks.radius_links(vox, 7.5), "links")
        t = written(tracks.make_tracks(vox, links).drop("track_energy"), "tracks")
        monkeypatch.setattr(session, "together", lambda df: (plans.append(deal(df)._jdf.queryExecution().executedPlan().toString()), deal(df))[1])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            ends.find_ends(t, links, rule)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans and not [p for p in plans if "Exchange" in p]


def test_smoothing_sends_hits_once(spark):
    out = QUERIES["v8_diffuse_grid"](spark, "/root/testdata/sf0.001")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


@pytest.mark.parametrize("query", ["b6_asymmetry_by_radius", "b11_end_stability"])
def test_no_steps_are_made_where_none_are_read(spark, query, monkeypatch):
    """And each track's tables are made once, however many rules are asked."""
    made = []
    own = ends.Tracks.__init__
    monkeypatch.setattr(ends, "ways", lambda *_: pytest.fail("steps made"))
    monkeypatch.setattr(ends.Tracks, "__init__", lambda self, *a: (made.append(1), own(self, *a))[1])
    assert QUERIES[query](spark, "/root/testdata/sf0.001").count() and made == [1]


@pytest.mark.parametrize("query", ["b15_satellite_distance", "b16_event_statistics", "b17_batch_summary"])
def test_track_statistics_shuffle_hits_only(spark, query, monkeypatch):
    """Tracks are made without rounds from tables dealt by event; only hits are sent, and what is summed up over all events."""
    plans, deal = [], session.together
    monkeypatch.setattr(session, "together", lambda df: (plans.append(deal(df)._jdf.queryExecution().executedPlan().toString()), deal(df))[1])
    monkeypatch.setattr(components, "_contracted", lambda *_: pytest.fail("rounds for small events"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        last = QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) > 3 and sum(p.count("Exchange") for p in plans) == 1
    assert last.count("Exchange") == (2 if query.startswith("b17") else 0)


def test_components_by_row_or_by_rounds(spark):
    """Keys of few edges and of many give the same components; repeated and self edges, and keys apart."""
    rng = random.Random(8)
    rows = [(k, rng.randrange(12), rng.randrange(12)) for k in range(30) for _ in range(k % 13 + 1)] + [(99, 3, 3), (98, 2, 1), (98, 1, 2)]
    edges = spark.createDataFrame(rows, "k int, u long, v long")
    want = [tuple(r) for r in components.connected_components(edges, keys=["k"], few=0).collect()]
    for few in (3, 64):
        assert sorted(tuple(r) for r in components.connected_components(edges, keys=["k"], few=few).collect()) == sorted(want)
    assert (98, 2, 1) in want and not [w for w in want if w[0] == 99]
