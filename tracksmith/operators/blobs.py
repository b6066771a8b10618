"""Energies around track ends and the quality of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.operators.components import counted
from tracksmith.operators.tracks import TRACK
from tracksmith.operators.voxels import nearest, within

SIDES = ("start", "end")


def _ends(walks: DataFrame, tracks: DataFrame) -> DataFrame:
    """TRACK, side, cx, cy, cz: the two ends of each walk as rows."""
    long = walks.select(*TRACK, F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("voxel_id")) for s in SIDES])).alias("e")).select(*TRACK, "e.*")
    return long.join(tracks.select(*TRACK, "voxel_id", *[F.col(c).alias(f"c{c}") for c in "xyz"]), [*TRACK, "voxel_id"]).drop("voxel_id")


def _around(walks: DataFrame, tracks: DataFrame, radius: float) -> DataFrame:
    """TRACK, side, cx, cy, cz, energy, dist: the voxels of the track within radius of either end, found by cells around the ends."""
    ends = _ends(walks, tracks).select(*TRACK, "side", *[F.col(f"c{c}").alias(c) for c in "xyz"])
    near = within(ends, tracks.select(*TRACK, "x", "y", "z", "energy"), radius, TRACK)
    return near.select(*TRACK, F.col("q.side").alias("side"), *[F.col(f"q.{c}").alias(f"c{c}") for c in "xyz"], F.col("t.energy").alias("energy"), "dist")


def _by_radius(walks: DataFrame, tracks: DataFrame, radii: list[float]) -> DataFrame:
    """TRACK, side, radius, energy, count of the spheres of rising radii: each voxel is counted once, at the first radius that
    holds it, and what the spheres gain is added up from radius to radius."""
    grid = F.array(*[F.lit(float(r)) for r in radii])
    first = F.size(F.filter(grid, lambda r: r < F.col("dist")))
    gains = _around(walks, tracks, max(radii)).groupBy(*TRACK, "side", first.alias("first")).agg(F.sum("energy").alias("energy"), F.count("*").alias("count"))
    held = gains.select(*TRACK, "side", F.explode(F.slice(grid, F.col("first") + 1, len(radii))).alias("radius"), "energy", "count")
    return held.groupBy(*TRACK, "side", "radius").agg(F.sum("energy").alias("energy"), F.sum("count").alias("count"))


def _by_side(long: DataFrame, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """keys and one column per side and value."""
    keys = keys or TRACK
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("side") == s, F.col(v))).alias(f"{s}_{v}") for s in SIDES for v in values])


def _blob_order(df: DataFrame, values: list[str]) -> DataFrame:
    """Adds blob1_* (the end of larger energy, compared at 1e-9; ties go to the start) and blob2_*."""
    first = F.round("start_energy", 9) >= F.round("end_energy", 9)
    for v in values:
        a, b = F.col(f"start_{v}"), F.col(f"end_{v}")
        df = df.withColumn(f"blob1_{v}", F.when(first, a).otherwise(b)).withColumn(f"blob2_{v}", F.when(first, b).otherwise(a))
    return df


def sphere_energies(walks: DataFrame, tracks: DataFrame, radius: float) -> DataFrame:
    """TRACK, energy, count and centre of the spheres (dist <= radius) about both ends, by side and as blob1, blob2."""
    long = _around(walks, tracks, radius).groupBy(*TRACK, "side").agg(F.sum("energy").alias("energy"), F.count("*").alias("count"), *[F.first(f"c{c}").alias(f"c{c}") for c in "xyz"])
    values = ["energy", "count", "cx", "cy", "cz"]
    return _blob_order(_by_side(long, values), values)


def asymmetry(a: Column, b: Column) -> Column:
    """(a - b) / (a + b) by size; 0 where both are 0."""
    return F.when(a + b > 0, F.abs(a - b) / (a + b)).otherwise(0.0)


def blob_energies(points: DataFrame, tracks: DataFrame, radius: float) -> DataFrame:
    """TRACK, Eb1, Eb2 in keV about the path's end points, the nearest voxel's energy where a sphere is empty, and their asymmetry.

    points: TRACK, step, x, y, z of a path; the first and the last step are its ends.
    """
    at = F.struct("step", "x", "y", "z")
    ends = points.groupBy(*TRACK).agg(F.min(at).alias("start"), F.max(at).alias("end"))
    long = ends.select(*TRACK, F.explode(F.array(*[F.struct(F.lit(s).alias("side"), *[F.col(f"{s}.{c}").alias(f"c{c}") for c in "xyz"]) for s in SIDES])).alias("e")).select(*TRACK, "e.*")
    ends = long.select(*TRACK, "side", *[F.col(f"c{c}").alias(c) for c in "xyz"])
    own = tracks.select(*TRACK, "voxel_id", "x", "y", "z", "energy")
    near = within(ends, own, radius, TRACK).groupBy(*TRACK, F.col("q.side").alias("side")).agg(F.sum("t.energy").alias("inside"))
    # the coordinates go on only where a sphere is empty, which no path over the track's own voxels has
    found = ends.join(near, [*TRACK, "side"], "left").select(*TRACK, "side", "inside", *[F.when(F.col("inside").isNull(), F.col(c)).alias(c) for c in "xyz"], F.col("inside").isNull().alias("empty"))
    found, n_empty = counted(found, "spheres", "empty")
    energy = F.col("inside")
    if n_empty:
        empty = found.where("empty").select(*TRACK, F.col("side").alias("src"), "x", "y", "z")
        closest = nearest(empty, own.select(*TRACK, F.col("voxel_id").alias("dst"), "x", "y", "z"), 1, TRACK).select(*TRACK, F.col("src").alias("side"), F.col("dst").alias("voxel_id"))
        closest = closest.join(own.select(*TRACK, "voxel_id", F.col("energy").alias("nearest")), [*TRACK, "voxel_id"]).drop("voxel_id")
        found, energy = found.join(closest, [*TRACK, "side"], "left"), F.coalesce("inside", "nearest")
    long = found.select(*TRACK, "side", (energy * 1e3).alias("energy"))
    out = _blob_order(_by_side(long, ["energy"]), ["energy"])
    return out.select(*TRACK, F.col("blob1_energy").alias("Eb1"), F.col("blob2_energy").alias("Eb2"), asymmetry(F.col("blob1_energy"), F.col("blob2_energy")).alias("asymmetry"))


def end_voxel_energies(points: DataFrame, n: int) -> DataFrame:
    """TRACK, start_energy, end_energy, blob1_energy, blob2_energy, count of the first and last n path points, without overlap."""
    w = Window.partitionBy(*TRACK)
    p = points.withColumn("__i", F.row_number().over(w.orderBy("step"))).withColumn("__n", F.count("*").over(w))
    take = F.least(F.lit(n), F.greatest(F.lit(1), F.floor(F.col("__n") / 2)))
    s = p.groupBy(*TRACK).agg(F.sum(F.when(F.col("__i") <= take, F.col("energy"))).alias("start_energy"), F.sum(F.when(F.col("__i") > F.col("__n") - take, F.col("energy"))).alias("end_energy"), F.max(take).alias("count"))
    return _blob_order(s, ["energy"])


def energies_by_radius(walks: DataFrame, tracks: DataFrame, radii: list[float]) -> DataFrame:
    """TRACK, radius, start_energy, end_energy, blob1_energy, blob2_energy, start_count, end_count for each radius: one pass."""
    return _blob_order(_by_side(_by_radius(walks, tracks, radii), ["energy", "count"], [*TRACK, "radius"]), ["energy"])


def asymmetry_by(df: DataFrame, by: str, a: str = "blob1_energy", b: str = "blob2_energy") -> DataFrame:
    """Mean and std of the asymmetry over tracks, by radius or number of voxels."""
    x = asymmetry(F.col(a), F.col(b))
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(x).alias("mean_asymmetry"), F.stddev_samp(x).alias("std_asymmetry"))


def variable_spheres(walks: DataFrame, tracks: DataFrame, seed: float = 3.0, step: float = 1.0, most: float = 10.0, change: float = 0.05) -> DataFrame:
    """Spheres that grow from seed by step until the energy changes by less than a share, or to the greatest radius.

    TRACK and for both blobs energy, radius, count and history (array of radius and energy up to the stop).
    """
    n = int((most - seed) / step + 1e-9) + 1
    radii = [seed + i * step for i in range(n)]
    g = _by_radius(walks, tracks, radii)
    w = Window.partitionBy(*TRACK, "side").orderBy("radius")
    g = g.withColumn("before", F.lag("energy").over(w))
    settled = (F.col("energy") > 0) & (F.col("before") > 0) & (F.abs(F.col("energy") - F.col("before")) / F.col("energy") < change)
    stop = F.min(F.when(settled, F.col("radius"))).over(Window.partitionBy(*TRACK, "side"))
    g = g.withColumn("stop", F.coalesce(stop, F.lit(float(radii[-1])))).where(F.col("radius") <= F.col("stop"))
    last = F.max(F.struct("radius", "energy", "count"))
    long = g.groupBy(*TRACK, "side").agg(last.alias("m"), F.sort_array(F.collect_list(F.struct("radius", "energy"))).alias("history")).select(*TRACK, "side", "m.*", "history")
    values = ["energy", "radius", "count", "history"]
    return _blob_order(_by_side(long, values), values)


def end_point_energy(central: DataFrame, n: int) -> DataFrame:
    """Energy sums of the first and last n points of a central path (they may overlap on short paths)."""
    w = Window.partitionBy(*TRACK)
    p = central.withColumn("__i", F.row_number().over(w.orderBy("step"))).withColumn("__j", F.row_number().over(w.orderBy(F.col("step").desc())))
    return p.groupBy(*TRACK).agg(F.sum(F.when(F.col("__i") <= n, F.col("energy_sum"))).alias("start_energy"), F.sum(F.when(F.col("__j") <= n, F.col("energy_sum"))).alias("end_energy"))


def blob_table(walks: DataFrame, tracks: DataFrame, radius: float, sample: str, cut_kev: float | None = None) -> DataFrame:
    """One row per track: source, event, blob energies in keV and counts, confidence, track energy in keV, length, select."""
    s = sphere_energies(walks, tracks, radius)
    e = tracks.groupBy(*TRACK).agg((F.sum("energy") * 1e3).alias("etrk"))
    t = s.join(walks.select(*TRACK, "confidence", F.col("length").alias("trkl")), TRACK).join(e, TRACK)
    t = t.select(F.lit(sample).alias("source"), F.col("event_id").alias("event"), "track_id", (F.col("blob1_energy") * 1e3).alias("eblob1"), (F.col("blob2_energy") * 1e3).alias("eblob2"), F.col("blob1_count").alias("nblob1"), F.col("blob2_count").alias("nblob2"), "confidence", "etrk", "trkl")
    return t.withColumn("select", F.col("eblob2") >= cut_kev) if cut_kev is not None else t


def clean_blobs(table: DataFrame, least_length: float = 50.0, window_kev: tuple[float, float] = (2400.0, 2500.0), most_blob2: float = 1000.0, most_blob1: float = 1500.0, cut_kev: float = 400.0) -> DataFrame:
    """Tracks within length, energy and blob limits, with select = eblob2 >= cut."""
    ok = (F.col("trkl") >= least_length) & F.col("etrk").between(*window_kev) & (F.col("eblob2") <= most_blob2) & (F.col("eblob1") <= most_blob1)
    return table.where(ok).withColumn("select", F.col("eblob2") >= cut_kev)


def path_efficiency(ends: DataFrame, walks: DataFrame) -> DataFrame:
    """TRACK, efficiency: path length over the straight distance of its ends; null for equal ends."""
    d = F.sqrt(sum(((F.col(f"{c}a") - F.col(f"{c}b")) * (F.col(f"{c}a") - F.col(f"{c}b")) for c in "xyz"), F.lit(0.0)))
    return ends.join(walks.select(*TRACK, "length"), TRACK).select(*TRACK, F.when(d > 0, F.col("length") / d).alias("efficiency"))


def skeleton_coverage(projected: DataFrame, radius: float, keys: list[str] | None = None) -> DataFrame:
    """Share of a track's energy within radius of its path."""
    return projected.groupBy(*(keys or TRACK)).agg((F.sum(F.when(F.col("dist") <= radius, F.col("energy")).otherwise(0.0)) / F.sum("energy")).alias("coverage"), F.max("dist").alias("max_dist"))


def truth_sphere_energies(hits: DataFrame, ends: DataFrame, radius: float) -> DataFrame:
    """event_id, energy of hits strictly within radius of the two truth ends, and their ratio end / start."""
    j = hits.select("event_id", "x", "y", "z", "energy").join(ends, "event_id")
    inside = lambda i: F.sqrt(sum(((F.col(c) - F.col(f"{c}{i}")) * (F.col(c) - F.col(f"{c}{i}")) for c in "xyz"), F.lit(0.0))) < radius
    out = j.groupBy("event_id").agg(*[F.coalesce(F.sum(F.when(inside(i), F.col("energy"))), F.lit(0.0)).alias(n) for i, n in ((1, "start_energy"), (2, "end_energy"))])
    return out.withColumn("ratio", F.when(F.col("start_energy") > 0, F.col("end_energy") / F.col("start_energy")))
