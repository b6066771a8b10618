"""Readers and writers: event tables, track tables, histograms, summaries, all as Parquet, CSV or JSON folders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType()}


def schema(text: str) -> T.StructType:
    """A schema of "name type" pairs, without a session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in text.split(", "))])


HITS_SCHEMA = schema("event_id long, x float, y float, z float, time float, energy float, label string, particle_id int, hit_id int")
PARTICLES_SCHEMA = schema("event_id long, particle_name string, mother_id int, kin_energy double, initial_x double, initial_y double, initial_z double, final_volume string")
CONFIGURATION_SCHEMA = schema("param_key string, param_value string")
INFO_SCHEMA = schema("file string, num_events long, saved_events long, interacting_events long, min_energy_keV double, max_energy_keV double")
HISTOGRAM_SCHEMA = schema("name string, bin int, lo double, hi double, center double, weight double")
#: Keys of the cut-flow summary, in order (fixed format).
SUMMARY_KEYS = ["data_type", "energy_resolution_keV"] + [f"{p}_{k}" for p in ("cut", "eff") for k in ("contained", "1trk", "radial", "trkl", "fid", "blobs", "roi", "total")]
SUMMARY_SCHEMA = T.StructType([T.StructField(k, T.StringType() if k == "data_type" else T.DoubleType()) for k in SUMMARY_KEYS])


def checked(df: DataFrame, wanted: T.StructType) -> DataFrame:
    """df with the schema's columns, coordinates and energies as doubles; an absent column is an error at once."""
    if missing := [f.name for f in wanted if f.name not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    cols = [F.col(f.name).cast("double" if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else f.dataType).alias(f.name) for f in wanted]
    return df.select(*cols)


def read_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The named event tables of a folder."""
    known = {"hits": HITS_SCHEMA, "particles": PARTICLES_SCHEMA, "configuration": CONFIGURATION_SCHEMA}
    return {n: checked(spark.read.parquet(f"{folder}/{n}"), known[n]) if n in known else spark.read.parquet(f"{folder}/{n}") for n in names or list(known)}


def read_parts(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """All part files of a folder as one table, with the part number of each row's file (order by it where order matters)."""
    df = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)
    number = F.regexp_extract(F.input_file_name(), r"(\d+)[^/\d]*(?:-[^/]*)?\.parquet", 1)
    return df.withColumn("part", number.cast("int"))


def generation_info(configuration: DataFrame, file: str | Column = "") -> DataFrame:
    """Key/value rows as one info row; "2300 keV" gives 2300."""
    wanted = {"num_events": "num_events", "saved_events": "saved_events", "interacting_events": "interacting_events", "/Generator/ElecPositronPair/min_energy": "min_energy_keV", "/Generator/ElecPositronPair/max_energy": "max_energy_keV", "min_energy": "min_energy_keV", "max_energy": "max_energy_keV"}
    name = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])[F.col("param_key")]
    rows = configuration.select(name.alias("key"), F.split("param_value", " ")[0].alias("value")).where("key is not null")
    keys = ["num_events", "saved_events", "interacting_events", "min_energy_keV", "max_energy_keV"]
    wide = rows.groupBy().pivot("key", keys).agg(F.first("value"))
    kinds = dict(zip(keys, ["long"] * 3 + ["double"] * 2, strict=True))
    return wide.select((F.lit(file) if isinstance(file, str) else file).alias("file"), *[F.expr(f"try_cast({k} as {kinds[k]})").alias(k) for k in keys])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, columns: T.StructType, pattern: str | None = None, sort: str | None = None) -> DataFrame:
    """CSV files of a path or folder with a header, optionally sorted by a column."""
    reader = spark.read.option("header", True).schema(columns)
    df = (reader.option("pathGlobFilter", pattern) if pattern else reader).csv(path)
    return df.orderBy(sort) if sort else df


def write_events(df: DataFrame, kept: DataFrame, path: str, metadata: dict[str, object] | None = None) -> None:
    """Write the rows of the kept events (by semi join), clustered by event, and a one-row metadata table beside them."""
    df.join(kept.select("event_id").distinct(), "event_id", "left_semi").repartition("event_id").write.parquet(f"{path}/hits")
    meta = df.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in (metadata or {}).items()], F.current_timestamp().alias("written_at"))
    meta.write.parquet(f"{path}/metadata")


def write_tracks(tracks: DataFrame, links: DataFrame, path: str, parameters: dict[str, float] | None = None) -> None:
    """Three tables keyed by event and track: voxels, edges, parameters."""
    tracks.write.parquet(f"{path}/voxels")
    links.write.parquet(f"{path}/edges")
    tracks.sparkSession.createDataFrame([(k, float(v)) for k, v in (parameters or {}).items()], "name string, value double").write.parquet(f"{path}/parameters")


def read_tracks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{n}") for n in ("voxels", "edges", "parameters"))


def chain(parts: dict[str, DataFrame]) -> DataFrame:
    """Tables of several samples as one, with a sample column; columns absent in some are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("sample", F.lit(n)) for n, df in parts.items()])


def read_results(spark: SparkSession, *paths: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """Result tables of several runs with merged schemas; missing fields get defaults."""
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    for name, value in (defaults or {}).items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    return df


def write_categories(categories: DataFrame, path: str) -> None:
    """Five-category results, a folder per category, and their counters."""
    from tracksmith.operators.tracks import category_counts

    categories.write.partitionBy("category").parquet(f"{path}/tracks")
    category_counts(categories).write.parquet(f"{path}/counters")


def read_categories(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/tracks"), spark.read.parquet(f"{path}/counters")


def write_summary(summary: DataFrame, path: str) -> None:
    """Cut-flow summaries as JSON with the fixed keys in order."""
    summary.select(*[F.col(k) if k in summary.columns else F.lit(None).cast(SUMMARY_SCHEMA[k].dataType).alias(k) for k in SUMMARY_KEYS]).write.option("ignoreNullFields", "false").json(path)


def read_summaries(spark: SparkSession, *paths: str) -> DataFrame:
    """JSON summaries; missing numbers are 0, a missing type is "unknown"."""
    return spark.read.schema(SUMMARY_SCHEMA).json(list(paths)).na.fill(0.0).na.fill("unknown")


def write_statistics(summary: DataFrame, path: str) -> None:
    """Batch statistics (one row per track multiplicity) as one nested JSON row: counts by multiplicity and the rows themselves."""
    counts = F.map_from_entries(F.collect_list(F.struct(F.col("n_tracks").cast("string"), "n_events"))).alias("counts")
    rows = F.collect_list(F.struct(*summary.columns)).alias("by_multiplicity")  # a handful of multiplicities
    summary.agg(F.sum("n_events").alias("n_events"), counts, rows).select("n_events", F.struct("counts").alias("track_multiplicity"), "by_multiplicity").write.json(path)


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """n_events and the number of single-track events."""
    df = spark.read.schema("n_events long, track_multiplicity struct<counts: map<string, long>>").json(path)
    return df.select("n_events", F.coalesce(F.col("track_multiplicity.counts")["1"], F.lit(0)).alias("n_single"))


def write_histograms(histograms: dict[str, DataFrame], path: str) -> None:
    """Named histograms as one table."""
    named = [h.select(F.lit(n).alias("name"), F.col("bin").cast("int").alias("bin"), "lo", "hi", "center", "weight") for n, h in histograms.items()]
    reduce(DataFrame.unionByName, named).write.parquet(path)


def read_histograms(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Named histograms; one whose bins are not 0, 1, ... without gaps and with fitting edges is an error."""
    h = spark.read.schema(HISTOGRAM_SCHEMA).parquet(path)
    h = h.where(F.col("name") == name) if name else h
    bad = h.groupBy("name").agg((F.count("*") != F.max("bin") + 1).alias("gap"), F.bool_or(F.col("hi") <= F.col("lo")).alias("flat")).where("gap or flat").select("name").take(5)
    if bad:
        raise ValueError(f"malformed histograms: {', '.join(r['name'] for r in bad)}")
    return h


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """parameter, value rows."""
    return read_csv(spark, path, schema("parameter string, value string"))


def metadata_value(metadata: DataFrame, parameter: str, kind: str = "double"):
    """A parameter's value as the wanted type; None where it is absent or doesn't parse."""
    row = metadata.where(F.col("parameter") == parameter).select(F.expr(f"try_cast(value as {kind})")).first()
    return row[0] if row else None
