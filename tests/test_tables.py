"""Round trips of readers and writers."""

import pytest
from pyspark.sql import functions as F

from tracksmith.operators import hist as hi
from tracksmith.operators import tracks as tr
from tracksmith.sources import tables as tb


@pytest.fixture
def at(tmp_path):
    return str(tmp_path / "out")


def test_checked_names_the_missing_column(spark):
    with pytest.raises(ValueError, match="label"):
        tb.checked(spark.range(1).selectExpr("id as event_id", "1 as x", "1 as y", "1 as z", "1 as time", "1 as energy", "1 as particle_id", "1 as hit_id"), tb.HITS_SCHEMA)


def test_info(spark, at):
    c = spark.createDataFrame([("num_events", "100"), ("saved_events", "7"), ("min_energy", "2300 keV"), ("other", "x")], tb.CONFIGURATION_SCHEMA)
    info = tb.generation_info(c, "a.h5")
    tb.write_csv(info, at)
    r = tb.read_csv(spark, at, tb.INFO_SCHEMA).first()
    assert (r["num_events"], r["saved_events"], r["min_energy_keV"], r["max_energy_keV"]) == (100, 7, 2300.0, None)


def test_events_and_tracks(spark, at):
    v = spark.createDataFrame([(e, float(i), 0.0, 0.0, 1.0, i) for e in (1, 2) for i in (1, 2, 9)], "event_id long, x double, y double, z double, energy double, voxel_id int")
    tb.write_events(v, spark.createDataFrame([(2,)], "event_id long"), at, {"run": 5})
    assert spark.read.parquet(f"{at}/hits").select("event_id").distinct().collect()[0][0] == 2
    assert spark.read.parquet(f"{at}/metadata").first()["run"] == 5
    links = tr.radius_links(v, 1.5)
    t = tr.make_tracks(v, links)
    tb.write_tracks(t, links, f"{at}/t", {"max_distance": 1.5})
    a, b, p = tb.read_tracks(spark, f"{at}/t")
    assert (a.count(), b.count(), p.first()["value"]) == (6, 2, 1.5)
    c = tr.event_categories(t)
    tb.write_categories(c, f"{at}/c")
    rows, counters = tb.read_categories(spark, f"{at}/c")
    assert rows.count() == c.count() and counters.where("category = 'two_primary'").first()["n_events"] == 2


def test_summary_defaults(spark, at):
    tb.write_summary(spark.createDataFrame([("bb", 0.5)], "data_type string, eff_total double"), at)
    r = tb.read_summaries(spark, at).first()
    assert (r["data_type"], r["eff_total"], r["eff_roi"]) == ("bb", 0.5, 0.0)
    assert list(r.asDict()) == tb.SUMMARY_KEYS


def test_histograms(spark, at):
    h = hi.hist1d(spark.range(10).selectExpr("cast(id as double) as x"), "x", 0.0, 10.0, 5)
    tb.write_histograms({"a": h, "b": h}, at)
    assert tb.read_histograms(spark, at, "b").agg(F.sum("weight")).first()[0] == 10
    tb.write_histograms({"bad": h.where("bin != 2")}, f"{at}2")
    with pytest.raises(ValueError, match="bad"):
        tb.read_histograms(spark, f"{at}2")


def test_statistics_metadata_results_and_chain(spark, at):
    s = spark.createDataFrame([(1, 30), (2, 4)], "n_tracks long, n_events long")
    tb.write_statistics(s, at)
    assert tuple(tb.read_statistics(spark, at).first()) == (34, 30)
    tb.write_csv(spark.createDataFrame([("sigma", "2.5"), ("name", "x")], "parameter string, value string"), f"{at}m")
    m = tb.read_metadata(spark, f"{at}m")
    assert tb.metadata_value(m, "sigma") == 2.5 and tb.metadata_value(m, "name") is None and tb.metadata_value(m, "none") is None
    spark.createDataFrame([(1, 2.0)], "event int, d1 double").write.parquet(f"{at}r1")
    spark.createDataFrame([(2,)], "event int").write.parquet(f"{at}r2")
    r = tb.read_results(spark, f"{at}r1", f"{at}r2", defaults={"d1": -1.0, "d2": 0.0})
    assert sorted(map(tuple, r.collect())) == [(1, 2.0, 0.0), (2, -1.0, 0.0)]
    assert sorted(tb.chain({"a": spark.range(1), "b": spark.range(2)}).groupBy("sample").count().collect()) == [("a", 1), ("b", 2)]
    assert tb.read_parts(spark, f"{at}r1").count() == 1
