"""Track building: links between voxels, connected components, energy-ranked tracks, and graph summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.operators.components import connected_components
from tracksmith.operators.voxels import closest_distance, near_pairs, nearest

EVENT = ["event_id"]
TRACK = ["event_id", "track_id"]


def threshold(voxels: DataFrame, energy: float) -> DataFrame:
    """Voxels with at least this energy (MeV)."""
    return voxels.where(F.col("energy") >= energy)


def radius_links(voxels: DataFrame, max_distance: float, keys: list[str] | None = None) -> DataFrame:
    return near_pairs(voxels, max_distance, keys)


def knn_links(voxels: DataFrame, k: int, max_distance: float | None = None, mutual: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Undirected links of each voxel to its k nearest (by distance, then voxel_id) in the event; mutual: only if both agree."""
    keys = keys or EVENT
    if max_distance is None:
        near = nearest(voxels.withColumnRenamed("voxel_id", "src"), voxels.withColumnRenamed("voxel_id", "dst"), k, keys, True)
    else:
        pairs = near_pairs(voxels, max_distance, keys)
        both = pairs.select(*keys, "src", "dst", "dist").unionByName(pairs.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), "dist"))
        rank = F.row_number().over(Window.partitionBy(*keys, "src").orderBy("dist", "dst"))
        near = both.withColumn("rank", rank).where(F.col("rank") <= k)
    sides = near.select(*keys, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "dist")
    return sides.groupBy(*keys, "src", "dst").agg(F.min("dist").alias("dist"), F.count("*").alias("n")).where(F.col("n") >= (2 if mutual else 1)).drop("n")


def make_tracks(voxels: DataFrame, links: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """voxels with track_id (1.. by track energy, greatest first; ties by least voxel_id), n_tracks of the event, track_energy.

    Components of the links, all events at once; a voxel without links is a track of its own.
    """
    keys = keys or EVENT
    found = connected_components(links, "src", "dst", keys).withColumnRenamed("vertex", "voxel_id")
    own = voxels.dropna(subset=keys).join(found, [*keys, "voxel_id"], "left").withColumn("component", F.coalesce("component", "voxel_id"))
    w = Window.partitionBy(*keys)
    own = own.withColumn("track_energy", F.sum("energy").over(Window.partitionBy(*keys, "component")))
    # sums of one track differ in the last bits by their order: ranks compare them at 1e-9
    own = own.withColumn("near_energy", F.round("track_energy", 9))  # a column, so that it isn't rounded in each comparison
    own = own.withColumn("track_id", F.dense_rank().over(w.orderBy(F.desc("near_energy"), "component")))
    return own.withColumn("n_tracks", F.max("track_id").over(w).cast("long")).drop("component", "near_energy")


def build_tracks(voxels: DataFrame, max_distance: float, energy_threshold_kev: float = 0.0, method: str = "radius", k: int = 10) -> DataFrame:
    """Threshold, links by radius, knn or mutual knn, components and ranks in one call."""
    kept = threshold(voxels, energy_threshold_kev / 1e3)
    if method not in ("radius", "knn", "mutual"):
        raise ValueError(method)
    links = radius_links(kept, max_distance) if method == "radius" else knn_links(kept, k, max_distance, method == "mutual")
    return make_tracks(kept, links)


def track_links(tracks: DataFrame, links: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Links with the track_id of their ends: the induced edges of each track."""
    keys = keys or EVENT
    return links.join(tracks.select(*keys, F.col("voxel_id").alias("src"), "track_id"), [*keys, "src"])


def dbscan(points: DataFrame, eps: float, min_points: int, keys: list[str] | None = None) -> DataFrame:
    """points with label (1.. by least core voxel_id, 0 noise) and n_clusters of the event.

    Core: at least min_points within eps, itself included. A border point takes the lowest label among its core neighbours.
    """
    keys = keys or EVENT
    pairs = near_pairs(points, eps, keys)
    both = pairs.select(*keys, "src", "dst").unionByName(pairs.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.groupBy(*keys, F.col("src").alias("voxel_id")).agg((F.count("*") + 1).alias("n"))
    core = points.select(*keys, "voxel_id").join(degree, [*keys, "voxel_id"], "left").where(F.coalesce("n", F.lit(1)) >= min_points).select(*keys, "voxel_id")
    src, dst = core.withColumnRenamed("voxel_id", "src"), core.withColumnRenamed("voxel_id", "dst")
    found = connected_components(pairs.join(src, [*keys, "src"], "left_semi").join(dst, [*keys, "dst"], "left_semi"), "src", "dst", keys).withColumnRenamed("vertex", "voxel_id")
    labelled = core.join(found, [*keys, "voxel_id"], "left").withColumn("component", F.coalesce("component", "voxel_id"))
    number = labelled.withColumn("core_label", F.dense_rank().over(Window.partitionBy(*keys).orderBy("component"))).drop("component")
    border = both.join(number.withColumnRenamed("voxel_id", "dst"), [*keys, "dst"]).groupBy(*keys, F.col("src").alias("voxel_id")).agg(F.min("core_label").alias("near_label"))
    out = points.join(number, [*keys, "voxel_id"], "left").join(border, [*keys, "voxel_id"], "left")
    out = out.withColumn("label", F.coalesce("core_label", "near_label", F.lit(0))).drop("core_label", "near_label")
    return out.withColumn("n_clusters", F.max("label").over(Window.partitionBy(*keys)))


def event_categories(tracks: DataFrame) -> DataFrame:
    """One row per track: event_id, track_id, n_tracks, n_voxels, energy, category.

    single; two_primary, two_secondary; three_primary, three_secondary (three or more tracks).
    """
    t = tracks.groupBy("event_id", "track_id", "n_tracks").agg(F.count("*").alias("n_voxels"), F.sum("energy").alias("energy"))
    part = F.when(F.col("track_id") == 1, "primary").otherwise("secondary")
    group = F.when(F.col("n_tracks") == 1, "single").when(F.col("n_tracks") == 2, F.concat(F.lit("two_"), part)).otherwise(F.concat(F.lit("three_"), part))
    return t.withColumn("category", group)


def category_counts(categories: DataFrame) -> DataFrame:
    return categories.groupBy("category").agg(F.countDistinct("event_id").alias("n_events"), F.count("*").alias("n_tracks"), F.sum("energy").alias("energy"))


def single_tracks(tracks: DataFrame) -> DataFrame:
    return tracks.where("n_tracks = 1")


def degrees(tracks: DataFrame, links: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, voxel_id, degree (0 for voxels without links)."""
    keys = keys or EVENT
    ends = links.select(*keys, F.explode(F.array("src", "dst")).alias("voxel_id")).groupBy(*keys, "voxel_id").agg(F.count("*").alias("degree"))
    return tracks.join(ends, [*keys, "voxel_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def graph_summary(tracks: DataFrame, links: DataFrame) -> DataFrame:
    """Per track: vertices, edges, mean and greatest degree, vertices of degree 1 and of degree 3 or more."""
    d = degrees(tracks, links)
    return d.groupBy(*TRACK).agg(
        F.count("*").alias("n_vertices"),
        (F.sum("degree") / 2).cast("long").alias("n_edges"),
        F.avg("degree").alias("mean_degree"),
        F.max("degree").alias("max_degree"),
        F.count_if(F.col("degree") == 1).alias("n_ends"),
        F.count_if(F.col("degree") >= 3).alias("n_branches"),
    )


def satellites(tracks: DataFrame) -> DataFrame:
    """Single-voxel tracks of events with several tracks."""
    n = F.count("*").over(Window.partitionBy(*TRACK))
    return tracks.withColumn("n_voxels", n).where("n_tracks > 1 and n_voxels = 1").select("event_id", "track_id", "voxel_id", (F.col("energy") * 1e3).alias("energy_kev"))


def satellite_distance(tracks: DataFrame) -> DataFrame:
    """Least voxel distance of each other track of an event to its main track (rank 1)."""
    main = tracks.where("track_id = 1").select("event_id", F.col("voxel_id").alias("dst"), "x", "y", "z")
    rest = tracks.where("track_id > 1").select("event_id", F.struct("track_id", "voxel_id").alias("src"), "x", "y", "z")
    return nearest(rest, main, 1, EVENT).groupBy("event_id", F.col("src.track_id").alias("track_id")).agg(F.min("dist").alias("dist"))


def track_extent(tracks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Bounding-box diagonal, z extent and energy-weighted barycentre (plain mean where the energy is 0)."""
    keys = keys or TRACK
    span = {c: F.max(c) - F.min(c) for c in "xyz"}
    e = F.sum("energy")
    centre = [F.when(e != 0, F.sum(F.col(c) * F.col("energy")) / e).otherwise(F.avg(c)).alias(f"bary_{c}") for c in "xyz"]
    return tracks.groupBy(*keys).agg(F.sqrt(sum((s * s for s in span.values()), F.lit(0.0))).alias("extent"), span["z"].alias("z_extent"), *centre)


def occupancy(tracks: DataFrame, pixel: float = 4.0, slot: float = 2.0, n_pixels: int = 64, keys: list[str] | None = None) -> DataFrame:
    """Pixels hit per time slot (a slot is a z range) on a grid centred on the track's barycentre.

    Per track: mean, greatest and least voxels per hit pixel and slot, hit pixels in all, slots (empty ones too), mean hit pixels per slot.
    """
    keys = keys or TRACK
    w = Window.partitionBy(*keys)
    b = tracks.join(track_extent(tracks, keys), keys).withColumn("z0", F.min("z").over(w)).withColumn("z1", F.max("z").over(w))
    half = n_pixels // 2
    b = b.withColumn("px", F.floor((F.col("x") - F.col("bary_x")) / pixel) + half).withColumn("py", F.floor((F.col("y") - F.col("bary_y")) / pixel) + half)
    b = b.withColumn("slot", F.floor((F.col("z") - F.col("z0")) / slot)).withColumn("n_slots", F.floor((F.col("z1") - F.col("z0")) / slot) + 1)
    cells = b.where(F.col("px").between(0, n_pixels - 1) & F.col("py").between(0, n_pixels - 1)).groupBy(*keys, "slot", "px", "py", "n_slots").agg(F.count("*").alias("n"))
    return cells.groupBy(*keys, "n_slots").agg(F.avg("n").alias("mean_count"), F.max("n").alias("max_count"), F.min("n").alias("min_count"), F.count("*").alias("n_pixels"), (F.count("*") / F.first("n_slots")).alias("mean_occupancy"))


def event_statistics(tracks: DataFrame) -> DataFrame:
    """One row per event: tracks, voxels, energy, main-track numbers, nearest-neighbour distances, satellite energies as an array."""
    nn = closest_distance(tracks.select("event_id", "voxel_id", "x", "y", "z")).groupBy("event_id").agg(F.avg("dist").alias("mean_nn"), F.max("dist").alias("max_nn"))
    main = F.col("track_id") == 1
    e = tracks.groupBy("event_id").agg(
        F.max("n_tracks").alias("n_tracks"),
        F.count("*").alias("n_voxels"),
        (F.sum("energy") * 1e3).alias("energy_kev"),
        F.count_if(main).alias("main_voxels"),
        (F.sum(F.when(main, F.col("energy"))) * 1e3).alias("main_energy_kev"),
        (F.max(F.when(main, F.col("z"))) - F.min(F.when(main, F.col("z")))).alias("main_z_extent"),
    )
    return e.join(nn, "event_id", "left")


def batch_summary(statistics: DataFrame) -> DataFrame:
    """Multiplicity counts with shares, and mean, std, least and greatest of the event statistics, by number of tracks."""
    share = F.count("*") / F.sum(F.count("*")).over(Window.partitionBy())
    cols = [f(c).alias(f"{n}_{c}") for c in ("energy_kev", "n_voxels", "mean_nn", "main_z_extent") for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return statistics.groupBy("n_tracks").agg(F.count("*").alias("n_events"), share.alias("share"), *cols)
