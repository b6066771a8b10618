"""Round trips of every reader and writer: rows of the tables are written to the shared folder and read back from there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.operators import hist as hi
from tracksmith.plans.queries import register
from tracksmith.session import fresh_path
from tracksmith.sources import tables as ta
from tracksmith.sources import views as v

HIT = ["event_id", "x", "y", "z", "time", "energy", "label", "hit_id"]


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return v.hits(spark, d).withColumns({"particle_id": F.col("particle_id").cast("int"), "hit_id": F.col("hit_id").cast("int")})


@register("io1_read_tables", f"with {v.HITS}, {v.PARTICLES}, n as (select event_id, count(*) as n_particles from particles group by 1) select event_id, x, y, z, time, energy, label, hit_id, n_particles from hits join n using (event_id)")
def io1(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "io1")
    _hits(spark, d).write.parquet(f"{path}/hits")
    v.particles(spark, d).withColumn("mother_id", F.col("mother_id").cast("int")).write.parquet(f"{path}/particles")
    read = ta.read_tables(spark, path, ["hits", "particles"])
    n = read["particles"].groupBy("event_id").agg(F.count("*").alias("n_particles"))
    return read["hits"].select(*HIT).join(n, "event_id").withColumn("hit_id", F.col("hit_id").cast("long"))


@register("io2_read_parts", f"with {v.HITS} select event_id, hit_id, energy, true as has_part from hits")
def io2(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "io2")
    _hits(spark, d).repartition("event_id").write.parquet(path)
    return ta.read_parts(spark, path).select("event_id", F.col("hit_id").cast("long").alias("hit_id"), "energy", (F.col("part") >= 0).alias("has_part"))


@register("io3_generation_info", "select 'orders' as file, count(*)::bigint as num_events, sum(o_orderkey % 97 + 10)::bigint as saved_events, sum(o_custkey % 7 + 1)::bigint as \"interacting_events\", min(o_orderkey)::double as \"min_energy_keV\", max(o_orderkey)::double as \"max_energy_keV\" from orders")
def io3(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders").agg(F.count("*").alias("num_events"), F.sum(F.col("o_orderkey") % 97 + 10).alias("saved_events"), F.sum(F.col("o_custkey") % 7 + 1).alias("interacting_events"), F.min("o_orderkey").alias("min_energy"), F.max("o_orderkey").alias("max_energy"))
    rows = [F.struct(F.lit(k).alias("param_key"), F.concat(F.col(k).cast("string"), F.lit(" keV" if "energy" in k else "")).alias("param_value")) for k in o.columns]
    path = fresh_path(spark, "io3")
    o.select(F.explode(F.array(*rows)).alias("r")).select("r.*").write.parquet(f"{path}/configuration")
    return ta.generation_info(ta.read_tables(spark, path, ["configuration"])["configuration"], "orders")


@register("io4_info_csv", f"with {v.SAMPLES} select isotope || '/' || zone as file, generated as num_events, saved as saved_events, single as interacting_events, 2300.5::double as \"min_energy_keV\", 2500.0::double as \"max_energy_keV\" from samples")
def io4(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "io4")
    s = v.samples(spark, d)
    ta.write_csv(s.select(F.concat_ws("/", "isotope", "zone").alias("file"), F.col("generated").alias("num_events"), F.col("saved").alias("saved_events"), F.col("single").alias("interacting_events"), F.lit(2300.5).alias("min_energy_keV"), F.lit(2500.0).alias("max_energy_keV")), path)
    return ta.read_csv(spark, path, ta.INFO_SCHEMA)


@register("io5_write_events", f"with {v.HITS}, k as (select event_id from hits group by 1 having count(*) >= 4) select event_id, hit_id, energy, 'four' as cut from hits where event_id in (select event_id from k)")
def io5(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "io5")
    h = v.hits(spark, d)
    ta.write_events(h, h.groupBy("event_id").count().where("count >= 4"), path, {"cut": "four"})
    meta = spark.read.parquet(f"{path}/metadata").select("cut")
    return spark.read.parquet(f"{path}/hits").select("event_id", F.col("hit_id").cast("long").alias("hit_id"), "energy").crossJoin(F.broadcast(meta))  # one row of metadata


@register("io6_write_tracks", f"with {v.HITS} select event_id, hit_id as voxel_id, energy, hit_id - 1 as n_links, 5.0::double as size from hits")
def io6(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "io6")
    vox = v.hits(spark, d).select("event_id", F.col("hit_id").cast("long").alias("voxel_id"), "energy")
    links = vox.alias("a").join(vox.alias("b"), (F.col("a.event_id") == F.col("b.event_id")) & (F.col("a.voxel_id") < F.col("b.voxel_id"))).select(F.col("a.event_id").alias("event_id"), F.col("a.voxel_id").alias("src"), F.col("b.voxel_id").alias("dst"))
    ta.write_tracks(vox, links, path, {"size": 5.0})
    voxels, edges, parameters = ta.read_tracks(spark, path)
    n = edges.groupBy("event_id", F.col("dst").alias("voxel_id")).agg(F.count("*").alias("n_links"))
    size = parameters.where("name = 'size'").select(F.col("value").alias("size"))
    return voxels.join(n, ["event_id", "voxel_id"], "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long"))).crossJoin(F.broadcast(size))  # one row


@register("io7_chain", f"with {v.HITS} select label as sample, event_id, hit_id, case when label = 'A' then energy end as energy from hits where label in ('A', 'R')")
def io7(spark: SparkSession, d: str) -> DataFrame:
    h = v.hits(spark, d).select("event_id", F.col("hit_id").cast("long").alias("hit_id"), "energy", "label")
    parts = {}
    for s, cols in (("A", ["event_id", "hit_id", "energy"]), ("R", ["event_id", "hit_id"])):
        path = fresh_path(spark, "io7")
        h.where(F.col("label") == s).select(*cols).write.parquet(path)
        parts[s] = spark.read.parquet(path)
    return ta.chain(parts)


@register("io8_read_results", f"with {v.HITS} select event_id, hit_id, case when event_id % 2 = 0 then energy else -1 end as d1, 0.5::double as d2 from hits")
def io8(spark: SparkSession, d: str) -> DataFrame:
    h = v.hits(spark, d).select("event_id", F.col("hit_id").cast("long").alias("hit_id"), F.col("energy").alias("d1"))
    paths = [fresh_path(spark, "io8") for _ in (0, 1)]
    h.where("event_id % 2 = 0").write.parquet(paths[0])
    h.where("event_id % 2 <> 0").drop("d1").write.parquet(paths[1])
    return ta.read_results(spark, *paths, defaults={"d1": -1.0, "d2": 0.5})


@register("io9_merge_csv", f"with {v.HITS} select event_id, hit_id, label from hits")
def io9(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "io9")
    ta.write_csv(v.hits(spark, d).select("event_id", "hit_id", "label"), path)
    return ta.read_csv(spark, path, ta.schema("event_id long, hit_id long, label string"), "*.csv", "event_id")


@register("io10_event_summary", f"with {v.HITS} select event_id, count(*) as n_hits, min(energy) as least, max(energy) as most from hits group by 1")
def io10(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "io10")
    ta.write_csv(v.hits(spark, d).groupBy("event_id").agg(F.count("*").alias("n_hits"), F.min("energy").alias("least"), F.max("energy").alias("most")), path)
    return ta.read_csv(spark, path, ta.schema("event_id long, n_hits long, least double, most double"))


@register("io11_categories", f"with {v.HITS} select case label when 'A' then 'single' when 'N' then 'two_primary' else 'two_secondary' end as category, count(distinct event_id) as n_events, count(*) as n_tracks, count(*) as n_read from hits group by 1")
def io11(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "io11")
    kind = F.when(F.col("label") == "A", "single").when(F.col("label") == "N", "two_primary").otherwise("two_secondary")
    ta.write_categories(v.hits(spark, d).select("event_id", F.col("hit_id").alias("track_id"), "energy", kind.alias("category")), path)
    tracks, counters = ta.read_categories(spark, path)
    return counters.select("category", "n_events", "n_tracks").join(tracks.groupBy("category").agg(F.count("*").alias("n_read")), "category")


@register("io12_summary_json", f"with {v.HITS} select label as data_type, 0.0::double as cut_blobs, count(*)::double as cut_fid, max(energy) as eff_total from hits group by 1")
def io12(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "io12")
    ta.write_summary(v.hits(spark, d).groupBy(F.col("label").alias("data_type")).agg(F.count("*").cast("double").alias("cut_fid"), F.max("energy").alias("eff_total")), path)
    return ta.read_summaries(spark, path).select("data_type", "cut_blobs", "cut_fid", "eff_total")


@register("io13_statistics_json", f"with {v.HITS}, e as (select event_id, count(*) as n from hits group by 1) select count(*)::bigint as n_events, count(*) filter (n = 1)::bigint as n_single from e")
def io13(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "io13")
    e = v.hits(spark, d).groupBy("event_id").agg(F.count("*").alias("n_tracks"))
    ta.write_statistics(e.groupBy("n_tracks").agg(F.count("*").alias("n_events")), path)
    return ta.read_statistics(spark, path)


@register("io14_histograms", f"with {v.HITS}, u as (select 'x' as name, x as a from hits union all select 'y', y from hits), b as (select name, floor((a + 25) / 5)::int as bin, count(*)::double as weight from u where a >= -25 and a < 25 group by 1, 2) select name, bin, -25.0 + 5 * bin as lo, -20.0 + 5 * bin as hi, -22.5 + 5 * bin as center, weight from b")
def io14(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "io14")
    h = v.hits(spark, d)
    ta.write_histograms({x: hi.hist1d(h, x, -25.0, 25.0, 10).withColumn("weight", F.col("weight").cast("double")) for x in "xy"}, path)
    return ta.read_histograms(spark, path).where("weight > 0")


@register("io15_metadata", "select r_name as parameter, r_regionkey::varchar as value, r_regionkey::double as as_number from region")
def io15(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "io15")
    ta.write_csv(v.table(spark, d, "region").select(F.col("r_name").alias("parameter"), F.col("r_regionkey").cast("string").alias("value")), path)
    return ta.read_metadata(spark, path).withColumn("as_number", F.expr("try_cast(value as double)"))


@register("io16_concat_runs", f"with {v.SENSORS} select event_id, sensor, charge from sensors")
def io16(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "io16")
    s = v.sensors(spark, d)
    for run in (0, 1, 2):
        s.where(F.pmod("event_id", F.lit(3)) == run).write.parquet(f"{path}/run{run}")
    return ta.read_parts(spark, path).select("event_id", "sensor", "charge")
