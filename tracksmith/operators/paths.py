"""Points along paths, projections, and the comparison of track ends with truth. Walks and steps come from ends.find_ends()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.operators.tracks import TRACK, degrees
from tracksmith.operators.voxels import nearest, within

def vertex_curvature(tracks: DataFrame, links: DataFrame) -> DataFrame:
    """event_id, voxel_id, curvature: mean of 1 - |cos| over pairs of neighbours, as joins of links with links."""
    d = degrees(tracks, links)
    ends = links.select("event_id", F.explode(F.array(*[F.struct(F.col(a).alias("v"), F.col(b).alias("w")) for a, b in (("src", "dst"), ("dst", "src"))])).alias("e")).select("event_id", "e.*")
    at = tracks.select("event_id", "voxel_id", "x", "y", "z")
    steps = ends.join(at.select("event_id", F.col("voxel_id").alias("v"), *[F.col(c).alias(f"{c}v") for c in "xyz"]), ["event_id", "v"]).join(at.select("event_id", F.col("voxel_id").alias("w"), *[F.col(c).alias(f"{c}w") for c in "xyz"]), ["event_id", "w"])
    steps = steps.select("event_id", "v", "w", *[(F.col(f"{c}w") - F.col(f"{c}v")).alias(f"d{c}") for c in "xyz"])
    steps = steps.withColumn("size", F.sqrt(sum((F.col(f"d{c}") * F.col(f"d{c}") for c in "xyz"), F.lit(0.0))))
    a, b = steps.alias("a"), steps.alias("b")
    dot = sum((F.col(f"a.d{c}") * F.col(f"b.d{c}") for c in "xyz"), F.lit(0.0))
    cos = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot / (F.col("a.size") * F.col("b.size"))))
    pairs = a.join(b, (F.col("a.event_id") == F.col("b.event_id")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.w") < F.col("b.w")))
    pairs = pairs.where("a.size > 1e-6 and b.size > 1e-6").groupBy("a.event_id", F.col("a.v").alias("voxel_id")).agg(F.avg(1 - F.abs(cos)).alias("c"))
    out = d.join(pairs, ["event_id", "voxel_id"], "left")
    return out.select("event_id", "voxel_id", F.when(F.col("degree") < 2, 0.0).otherwise(F.coalesce("c", (F.col("degree") > 2).cast("double"))).alias("curvature"))


def path_points(steps: DataFrame, tracks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, step (from 1), voxel_id, x, y, z, energy, s: the steps (keys, step, voxel_id, s) with their voxels."""
    keys = keys or TRACK
    points = steps.select(*keys, "step", "voxel_id", "s").join(tracks.select(*keys, "voxel_id", "x", "y", "z", "energy"), [*keys, "voxel_id"])
    return points.select(*keys, "step", "voxel_id", "x", "y", "z", "energy", "s")


def with_arc_length(points: DataFrame, keys: list[str], order: str = "step") -> DataFrame:
    """points with s: the running sum of distances along the order, 0 at the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = [F.col(c) - F.lag(c).over(w) for c in "xyz"]
    ds = F.coalesce(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]), F.lit(0.0))
    return points.withColumn("__d", ds).withColumn("s", F.sum("__d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__d")


def path_length(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return points.groupBy(*(keys or TRACK)).agg(F.max("s").alias("length"), F.count("*").alias("n_points"))


def central_path(points: DataFrame, tracks: DataFrame, radius: float, keys: list[str] | None = None) -> DataFrame:
    """For each path voxel the energy-weighted centroid of the track's voxels within radius: keys, step, x, y, z, energy_sum, s."""
    keys = keys or TRACK
    near = within(points.select(*keys, "step", "x", "y", "z"), tracks.select(*keys, "x", "y", "z", "energy"), radius, keys)
    e = F.sum("t.energy")
    mean = [F.when(e != 0, F.sum(F.col(f"t.{c}") * F.col("t.energy")) / e).otherwise(F.avg(f"t.{c}")).alias(c) for c in "xyz"]
    return with_arc_length(near.groupBy(*keys, F.col("q.step").alias("step")).agg(*mean, e.alias("energy_sum")), keys)


def project_to_path(tracks: DataFrame, points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every voxel with its nearest path point (first of equals): keys, voxel_id, energy, step, s, dist."""
    keys = keys or TRACK
    found = nearest(tracks.select(*keys, F.col("voxel_id").alias("src"), "x", "y", "z"), points.select(*keys, F.col("step").alias("dst"), "x", "y", "z"), 1, keys)
    found = found.select(*keys, F.col("src").alias("voxel_id"), F.col("dst").alias("step"), "dist")
    out = tracks.select(*keys, "voxel_id", "energy").join(found, [*keys, "voxel_id"]).join(points.select(*keys, "step", "s"), [*keys, "step"])
    return out.select(*keys, "voxel_id", "energy", "step", "s", "dist")


# ---- truth


def truth_voxels(hits: DataFrame, size: float) -> DataFrame:
    """event_id, particle_id, island, x, y, z, energy: a particle's hits in time order, consecutive hits of one cell merged.

    Coming back to a cell starts a new voxel. Positions are energy-weighted means, plain means where the energy is 0.
    """
    w = Window.partitionBy("event_id", "particle_id").orderBy("time", "hit_id")
    cell = F.struct(*[F.floor(F.col(c) / size).alias(c) for c in "xyz"])
    h = hits.withColumn("__c", cell)
    h = h.withColumn("__n", F.when(F.lag("__c").over(w).eqNullSafe(F.col("__c")), 0).otherwise(1)).withColumn("island", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    e = F.sum("energy")
    mean = [F.when(e != 0, F.sum(F.col(c) * F.col("energy")) / e).otherwise(F.avg(c)).alias(c) for c in "xyz"]
    return h.groupBy("event_id", "particle_id", "island").agg(*mean, e.alias("energy"))


def truth_path(hits: DataFrame, size: float, double: bool = True) -> DataFrame:
    """event_id, step, x, y, z, energy, s, primary_electron: truth voxels of particle 1 (reversed if there are two electrons), then 2."""
    v = truth_voxels(hits.where(F.col("particle_id") <= (2 if double else 1)), size)
    first = F.col("particle_id") == 1
    order = F.when(first & F.lit(double), -F.col("island")).otherwise(F.col("island"))
    v = v.withColumn("__o", order).withColumn("step", F.row_number().over(Window.partitionBy("event_id").orderBy("particle_id", "__o")))
    return with_arc_length(v, ["event_id"]).select("event_id", "step", "x", "y", "z", "energy", "s", F.col("particle_id").alias("primary_electron"))


def truth_ends(hits: DataFrame) -> DataFrame:
    """event_id, x1..z1, x2..z2: the last hits of particles 1 and 2 where both are there, else the first and last hit by time."""
    at = F.struct("time", "hit_id", "x", "y", "z")
    pick = lambda p: F.max(F.when(F.col("particle_id") == p, at))
    e = hits.groupBy("event_id").agg(pick(1).alias("l1"), pick(2).alias("l2"), F.min(at).alias("first"), F.max(at).alias("last"))
    both = F.col("l1").isNotNull() & F.col("l2").isNotNull()
    cols = [F.when(both, F.col(f"{a}.{c}")).otherwise(F.col(f"{b}.{c}")).alias(f"{c}{i}") for i, a, b in ((1, "l1", "first"), (2, "l2", "last")) for c in "xyz"]
    return e.select("event_id", *cols)


def _far(a: str, b: str) -> Column:
    d = [F.col(f"{c}{a}") - F.col(f"{c}{b}") for c in "xyz"]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def match_ends(reco: DataFrame, truth: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, d1, d2, total, pairing: the pairing of reco ends (xa.., xb..) with truth ends (x1.., x2..) of smaller total; ties direct."""
    keys = keys or ["event_id"]
    j = reco.join(truth, keys)
    direct, crossed = _far("a", "1") + _far("b", "2"), _far("a", "2") + _far("b", "1")
    ok = direct <= crossed
    return j.select(*keys, F.when(ok, _far("a", "1")).otherwise(_far("a", "2")).alias("d1"), F.when(ok, _far("b", "2")).otherwise(_far("b", "1")).alias("d2"), F.least(direct, crossed).alias("total"), F.when(ok, "direct").otherwise("crossed").alias("pairing"))


def end_points(walks: DataFrame, tracks: DataFrame) -> DataFrame:
    """TRACK, xa, ya, za, xb, yb, zb: coordinates of both ends of each walk."""
    out = walks.select(*TRACK, "start", "end")
    for name, side in (("start", "a"), ("end", "b")):
        at = tracks.select(*TRACK, F.col("voxel_id").alias(name), *[F.col(c).alias(f"{c}{side}") for c in "xyz"])
        out = out.join(at, [*TRACK, name])
    return out.drop("start", "end")


def ends_against_truth(walks: DataFrame, tracks: DataFrame, hits: DataFrame) -> DataFrame:
    """d1, d2, total, pairing, confidence, length of the main track of each event, with success and reason."""
    main = walks.where("track_id = 1")
    m = match_ends(end_points(main, tracks).drop("track_id"), truth_ends(hits))
    out = m.join(main.select("event_id", "confidence", "length"), "event_id")
    worst = F.greatest("d1", "d2")
    return out.withColumn("success", worst <= 10).withColumn("reason", F.when(worst <= 10, "correct").when(F.least("d1", "d2") <= 10, "one_end_wrong").otherwise("both_ends_wrong"))


def comparison_summary(matched: DataFrame) -> DataFrame:
    """Events, mean and std of d1, d2, outliers beyond 10 mm, and mean confidence and length of good and outlying events."""
    good = F.greatest("d1", "d2") <= 10
    cols = [F.count("*").alias("n"), F.count_if(~good).alias("n_outliers")]
    cols += [f(c).alias(f"{n}_{c}") for c in ("d1", "d2") for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    cols += [F.avg(F.when(ok, F.col(c))).alias(f"{c}_{n}") for c in ("confidence", "length") for n, ok in (("good", good), ("outlier", ~good))]
    return matched.agg(*cols)


def nearest_voxel(points: DataFrame, tracks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """For each point (keys, name, x, y, z) the nearest voxel of the event: keys, name, voxel_id, track_id, dist."""
    keys = keys or ["event_id"]
    found = nearest(points.select(*keys, F.col("name").alias("src"), "x", "y", "z"), tracks.select(*keys, F.col("voxel_id").alias("dst"), "x", "y", "z"), 1, keys)
    found = found.select(*keys, F.col("src").alias("name"), F.col("dst").alias("voxel_id"), "dist")
    return found.join(tracks.select(*keys, "voxel_id", "track_id"), [*keys, "voxel_id"]).select(*keys, "name", "voxel_id", "track_id", "dist")


def error_classes(walks: DataFrame, tracks: DataFrame, links: DataFrame, hits: DataFrame) -> DataFrame:
    """event_id, d1, d2, degree1, degree2 (at the voxels nearest to the truth ends), tortuosity, class.

    correct; disconnected (truth ends lie in different tracks); both_not_end, first_not_end, second_not_end (a truth end is
    no vertex of degree 1); spurious_ends (more than two such vertices); wrong_end.
    """
    t = truth_ends(hits)
    points = t.select("event_id", F.explode(F.array(*[F.struct(F.lit(f"t{i}").alias("name"), *[F.col(f"{c}{i}").alias(c) for c in "xyz"]) for i in (1, 2)])).alias("p")).select("event_id", "p.*")
    near = nearest_voxel(points, tracks)
    d = degrees(tracks, links).select("event_id", "voxel_id", "track_id", "degree")
    tips = d.groupBy("event_id", "track_id").agg(F.count_if(F.col("degree") == 1).alias("n_tips")).where("track_id = 1").drop("track_id")
    n = near.join(d.drop("track_id"), ["event_id", "voxel_id"]).groupBy("event_id").agg(*[F.max(F.when(F.col("name") == f"t{i}", F.col(c))).alias(f"{c}{i}") for i in (1, 2) for c in ("degree", "track_id")])
    main = walks.where("track_id = 1")
    ends = end_points(main, tracks).drop("track_id").withColumn("straight", _far("a", "b"))
    m = match_ends(ends, t).join(ends.select("event_id", "straight"), "event_id").join(main.select("event_id", "length"), "event_id").join(n, "event_id").join(tips, "event_id")
    off1, off2 = F.col("degree1") != 1, F.col("degree2") != 1
    kind = F.when(F.greatest("d1", "d2") <= 10, "correct").when(F.col("track_id1") != F.col("track_id2"), "disconnected").when(off1 & off2, "both_not_end").when(off1, "first_not_end").when(off2, "second_not_end").when(F.col("n_tips") > 2, "spurious_ends").otherwise("wrong_end")
    return m.select("event_id", "d1", "d2", "degree1", "degree2", F.when(F.col("straight") > 0, F.col("length") / F.col("straight")).alias("tortuosity"), kind.alias("class"))


def worst_events(classes: DataFrame, k: int = 10) -> DataFrame:
    """The k events whose worse end is farthest off (a top-k report)."""
    return classes.orderBy(F.greatest("d1", "d2").desc(), "event_id").limit(k)


def end_quality(walks: DataFrame, tracks: DataFrame) -> DataFrame:
    """TRACK, efficiency (straight / length), coverage (length / extent), poor, issues, ends on the bounding box."""
    e = end_points(walks, tracks).withColumn("straight", _far("a", "b"))
    box = tracks.groupBy(*TRACK).agg(F.avg("energy").alias("mean_energy"), *[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    ends = walks.select(*TRACK, "start", "end", "confidence", "length")
    for name in ("start", "end"):
        ends = ends.join(tracks.select(*TRACK, F.col("voxel_id").alias(name), F.col("energy").alias(f"e_{name}")), [*TRACK, name])
    j = ends.join(e, TRACK).join(box, TRACK)
    extent = F.sqrt(sum(((F.col(f"hi{c}") - F.col(f"lo{c}")) * (F.col(f"hi{c}") - F.col(f"lo{c}")) for c in "xyz"), F.lit(0.0)))
    eff = F.when(F.col("length") > 0, F.col("straight") / F.col("length")).otherwise(0.0)
    cover = F.col("length") / F.greatest(extent, F.lit(1.0))
    on_box = lambda s: sum((((F.col(f"{c}{s}") == F.col(f"lo{c}")) | (F.col(f"{c}{s}") == F.col(f"hi{c}"))).cast("int") for c in "xyz"), F.lit(0)) > 0
    hot = F.greatest("e_start", "e_end") > 1.5 * F.col("mean_energy")
    issues = F.array_compact(F.array(F.when(~hot, "no_high_energy_end"), F.when(F.col("confidence") < 0.7, "low_confidence"), F.when(eff < 0.3, "low_efficiency"), F.when(cover < 0.5, "low_coverage")))
    return j.select(*TRACK, eff.alias("efficiency"), cover.alias("coverage"), ((eff < 0.3) | (cover < 0.5)).alias("poor"), issues.alias("issues"), on_box("a").alias("start_on_box"), on_box("b").alias("end_on_box"))


def end_stability(one: DataFrame, two: DataFrame) -> DataFrame:
    """TRACK, displacement: the larger shift of the two ends between two solutions, the better of both pairings."""
    b = two.select(*TRACK, *[F.col(f"{c}{s}").alias(f"{c}{n}") for s, n in (("a", "1"), ("b", "2")) for c in "xyz"])
    j = one.join(b, TRACK)
    return j.select(*TRACK, F.least(F.greatest(_far("a", "1"), _far("b", "2")), F.greatest(_far("a", "2"), _far("b", "1"))).alias("displacement"))
