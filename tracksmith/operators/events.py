"""Event-level aggregates and event cuts: one shuffle on event_id, then semi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_of_events(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("event_id").alias("n_events"))


def hits_per_event(df: DataFrame) -> DataFrame:
    return df.groupBy("event_id").agg(F.count("*").alias("n_hits"))


def energy_deposited(df: DataFrame, scale: float = 1.0) -> DataFrame:
    """Energy per event; scale 1e3 gives keV."""
    return df.groupBy("event_id").agg((F.sum("energy") * scale).alias("energy"))


def energy_primary(particles: DataFrame) -> DataFrame:
    """Kinetic energy of the particles without a mother, per event; 0 for events without such."""
    return particles.groupBy("event_id").agg(F.sum(F.when(F.col("mother_id") == 0, F.col("kin_energy")).otherwise(0.0)).alias("energy"))


def all_hits(df: DataFrame, rule: Column) -> DataFrame:
    """Rows of the events whose every hit meets the rule (a null counts as not met)."""
    good = df.groupBy("event_id").agg(F.bool_and(F.coalesce(rule, F.lit(False))).alias("ok")).where("ok")
    return df.join(good.select("event_id"), "event_id", "left_semi")


def filter_fiducial(df: DataFrame, xyc: float, zc: float) -> DataFrame:
    return all_hits(df, (F.abs("x") < xyc) & (F.abs("y") < xyc) & (F.abs("z") < zc))


def filter_radial(df: DataFrame, r: float) -> DataFrame:
    return all_hits(df, F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) < r)


def filter_z(df: DataFrame, inner: tuple[float, float], outer: tuple[float, float]) -> DataFrame:
    """Events whose every hit lies in one of two open z ranges."""
    z = F.col("z")
    return all_hits(df, ((z > inner[0]) & (z < inner[1])) | ((z > outer[0]) & (z < outer[1])))


def filter_short(df: DataFrame, least_hits: int) -> DataFrame:
    return df.join(hits_per_event(df).where(F.col("n_hits") >= least_hits).select("event_id"), "event_id", "left_semi")


def filter_energy_window(df: DataFrame, low_kev: float, high_kev: float) -> DataFrame:
    """Events whose deposited energy lies in a closed window, decided before any join of hits."""
    good = energy_deposited(df, 1e3).where(F.col("energy").between(low_kev, high_kev)).select("event_id")
    return df.join(good, "event_id", "left_semi")


def energy_window_statistics(df: DataFrame, low_kev: float, high_kev: float) -> DataFrame:
    """Statistics of event energies before and after the window: one pass."""
    e = energy_deposited(df, 1e3)
    inside = F.when(F.col("energy").between(low_kev, high_kev), F.col("energy"))
    cols = []
    for name, c in (("before", F.col("energy")), ("after", inside)):
        cols += [F.count(c).alias(f"n_{name}"), F.avg(c).alias(f"mean_{name}"), F.stddev_samp(c).alias(f"std_{name}"), F.min(c).alias(f"min_{name}"), F.max(c).alias(f"max_{name}")]
    return e.agg(*cols)


def unique_energies(df: DataFrame) -> DataFrame:
    return df.select("event_id", "energy").distinct()


def filter_coincidences(df: DataFrame, track: str = "track_id", n: int = 2, energy: str | None = None, least: float = 0.0) -> DataFrame:
    """Events with exactly n distinct tracks, before and again after an energy cut on rows; with the rows of each (event, track)."""

    def pairs(x: DataFrame) -> DataFrame:
        ok = x.groupBy("event_id").agg(F.countDistinct(track).alias("n")).where(F.col("n") == n)
        return x.join(ok.select("event_id"), "event_id", "left_semi")

    kept = pairs(df)
    if energy:
        kept = pairs(kept.where(F.col(energy) >= least))
    return kept.withColumn("n_rows", F.count("*").over(Window.partitionBy("event_id", track)))


def cylindrical(df: DataFrame) -> DataFrame:
    """Adds edep (if pre_KE, post_KE exist), phi and rho."""
    out = df.withColumn("phi", F.atan2("y", "x")).withColumn("rho", F.hypot("x", "y"))
    return out.withColumn("edep", F.col("pre_KE") - F.col("post_KE")) if "pre_KE" in df.columns else out


def input_order(df: DataFrame) -> DataFrame:
    """Per event: is the hit order sorted by time, the id range, and the distance between the first and the last hit."""
    w = Window.partitionBy("event_id").orderBy("hit_id")
    steps = df.withColumn("late", (F.lag("time").over(w) > F.col("time")).cast("int"))
    ends = lambda f: f(F.struct("hit_id", "x", "y", "z"))
    out = steps.groupBy("event_id").agg(F.coalesce(F.sum("late"), F.lit(0)).alias("n_late"), F.min("hit_id").alias("first_id"), F.max("hit_id").alias("last_id"), F.min("time").alias("t_min"), F.max("time").alias("t_max"), ends(F.min).alias("a"), ends(F.max).alias("b"))
    d2 = sum(((F.col(f"b.{c}") - F.col(f"a.{c}")) * (F.col(f"b.{c}") - F.col(f"a.{c}")) for c in "xyz"), F.lit(0.0))
    return out.select("event_id", (F.col("n_late") == 0).alias("time_sorted"), "n_late", "first_id", "last_id", "t_min", "t_max", F.sqrt(d2).alias("end_distance"))
