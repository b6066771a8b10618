"""Voxels: hits summed in grid cells, distances between them, smoothing on the grid."""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tracksmith.operators.relational import ELECTRONS_PER_MEV
from tracksmith.session import written


def distance(a: str, b: str) -> Column:
    """Euclidean distance of two aliased rows with x, y, z."""
    d = [F.col(f"{a}.{c}") - F.col(f"{b}.{c}") for c in "xyz"]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def voxelize(hits: DataFrame, size: float, keys: list[str] | None = None, electrons_per_mev: float = ELECTRONS_PER_MEV) -> DataFrame:
    """keys, ix, iy, iz, x, y, z (cell centres), energy, electrons, voxel_id (1.. within the keys, in cell order).

    Cells are floor(coordinate / size); the sums are a partial aggregate before the one shuffle on keys and cell.
    """
    keys = keys or ["event_id"]
    cells = hits.groupBy(*keys, *[F.floor(F.col(c) / size).alias(f"i{c}") for c in "xyz"]).agg(F.sum("energy").alias("energy"))
    centres = [((F.col(f"i{c}") + 0.5) * size).alias(c) for c in "xyz"]
    electrons = F.rint(F.col("energy") * electrons_per_mev).cast("long").alias("electrons")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("ix", "iy", "iz")).alias("voxel_id")
    return cells.select(*keys, "ix", "iy", "iz", *centres, "energy", electrons, number)


def with_voxel_id(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Number the points of each event in coordinate order, for tables that are not voxelised here."""
    keys = keys or ["event_id"]
    return points.withColumn("voxel_id", F.row_number().over(Window.partitionBy(*keys).orderBy("x", "y", "z", "energy")))


def cylindrical_boxes(df: DataFrame, n_phi: int, dz: float, keys: list[str] | None = None) -> DataFrame:
    """Boxes in (phi, z): box energy, energy-weighted radius and number of rows. df has phi, rho, z, edep."""
    keys = keys or ["event_id"]
    width = 2 * math.pi / n_phi
    boxed = df.withColumn("iphi", F.least(F.floor((F.col("phi") + math.pi) / width), F.lit(n_phi - 1))).withColumn("iz", F.floor(F.col("z") / dz))
    return boxed.groupBy(*keys, "iphi", "iz").agg(F.sum("edep").alias("ebox"), (F.sum(F.col("rho") * F.col("edep")) / F.sum("edep")).alias("rbox"), F.count("*").alias("nb"))


#: Events with at most this many points are one cell, so that each point is there once; beyond it points look in their cells.
FEW_POINTS = 64


def near_pairs(points: DataFrame, radius: float, keys: list[str] | None = None, payload: list[str] | None = None, few: int = FEW_POINTS) -> DataFrame:
    """Pairs of points of one event with distance <= radius, each once: keys, src < dst (voxel_id), dist.

    Points of an event of few points meet by event alone: nothing is sent twice. The others by a bucketed range join: cells a hair
    larger than the radius; one side keeps its cell, the other is sent to its cell and the 13 forward neighbours, so the join is
    an equi-join on event and cell. Skew inside an event spreads over its cells.
    """
    keys = keys or ["event_id"]
    side = radius * (1 + 1e-9) if radius > 0 else 1.0
    payload = payload or []
    base = points.select(*keys, "voxel_id", "x", "y", "z", *payload)
    crowded = written(points.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > few).select(*keys), "crowded")
    more = [F.col(f"{s}.{c}").alias(f"{c}_{n}") for c in payload for s, n in (("a", "1"), ("b", "2"))]

    def near(a: DataFrame, b: DataFrame, on: list[str], once: Column) -> DataFrame:
        pairs = a.alias("a").join(b.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on]).withColumn("dist", distance("a", "b")).where((F.col("dist") <= radius) & once)
        return pairs.select(*[F.col(f"a.{k}") for k in keys], F.least("a.voxel_id", "b.voxel_id").alias("src"), F.greatest("a.voxel_id", "b.voxel_id").alias("dst"), "dist", *more)

    ordered = F.col("a.voxel_id") < F.col("b.voxel_id")
    if crowded.isEmpty():
        return near(base, base, keys, ordered)
    sparse = base.join(crowded, keys, "left_anti")
    celled = base.join(crowded, keys, "left_semi").withColumns({f"c{c}": F.floor(F.col(c) / side) for c in "xyz"})
    steps = F.array(*[F.struct(*[F.lit(v).alias(f"d{c}") for c, v in zip("xyz", s, strict=True)]) for s in product((-1, 0, 1), repeat=3) if s >= (0, 0, 0)])
    sent = celled.withColumn("s", F.explode(steps)).select(*keys, "voxel_id", "x", "y", "z", *payload, *[(F.col(f"c{c}") - F.col(f"s.d{c}")).alias(f"c{c}") for c in "xyz"], F.expr("s.dx = 0 and s.dy = 0 and s.dz = 0").alias("same"))
    return near(sparse, sparse, keys, ordered).unionByName(near(celled, sent, [*keys, "cx", "cy", "cz"], ~F.col("b.same") | ordered))


def voxel_distances(points: DataFrame, max_distance: float | None = None, keys: list[str] | None = None) -> DataFrame:
    """All pair distances of each event, up to max_distance. Without it an event's pairs are all made: that is the result asked for."""
    if max_distance is not None:
        return near_pairs(points, max_distance, keys)
    keys = keys or ["event_id"]
    p = points.select(*keys, "voxel_id", "x", "y", "z")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.voxel_id") < F.col("b.voxel_id")]
    return p.alias("a").join(p.alias("b"), on).select(*[F.col(f"a.{k}") for k in keys], F.col("a.voxel_id").alias("src"), F.col("b.voxel_id").alias("dst"), distance("a", "b").alias("dist"))


def _cells(side: Column) -> list[Column]:
    return [F.floor(F.col(c) / (side * (1 + 1e-9))).alias(f"c{c}") for c in "xyz"]


def _neighbour_cells(df: DataFrame) -> DataFrame:
    """Each row once for its cell and each of the 26 around it."""
    steps = F.array(*[F.struct(*[F.lit(v).alias(f"d{c}") for c, v in zip("xyz", s, strict=True)]) for s in product((-1, 0, 1), repeat=3)])
    moved = {f"c{c}": F.col(f"c{c}") + F.col(f"s.d{c}") for c in "xyz"}
    return df.withColumn("s", F.explode(steps)).withColumns(moved).drop("s")


#: Keys with at most this many targets join each query with all of them; beyond it queries look in growing cells.
FEW_TARGETS = 64


def within(queries: DataFrame, targets: DataFrame, radius: float, keys: list[str], few: int = FEW_TARGETS) -> DataFrame:
    """Rows (keys, q, t, dist) of queries and targets with equal keys at most radius apart, q and t being structs of their other columns.

    Keys with at most few targets are one equi-join on the keys: nothing is sent twice, and what follows by the same keys needs no shuffle
    of its own. Of the others the side with queries is sent to its cell and the 26 around it: an equi-join on keys and cell. A null
    coordinate meets nothing.
    """
    pack = lambda df, name: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    near = lambda pairs: pairs.withColumn("dist", distance("q", "t")).where(F.col("dist") <= radius).select(*keys, "q", "t", "dist")
    crowded = written(targets.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > few).select(*keys), "crowded")
    q, t = pack(queries, "q"), pack(targets, "t")
    if crowded.isEmpty():
        return near(q.join(t, keys))
    cell = lambda df, name: df.join(crowded, keys, "left_semi").select("*", *[F.floor(F.col(f"{name}.{c}") / ((radius if radius > 0 else 1.0) * (1 + 1e-9))).alias(f"c{c}") for c in "xyz"])
    spread = near(_neighbour_cells(cell(q, "q")).join(cell(t, "t"), [*keys, "cx", "cy", "cz"]))
    return near(q.join(crowded, keys, "left_anti").join(t.join(crowded, keys, "left_anti"), keys)).unionByName(spread)


def nearest(queries: DataFrame, targets: DataFrame, k: int, keys: list[str], distinct_ids: bool = False, few: int = FEW_TARGETS) -> DataFrame:
    """keys, src, dst, dist: the k targets nearest to each query (by distance, then dst) under equal keys.

    queries has keys, src, x, y, z; targets has keys, dst, x, y, z. With distinct_ids a target whose dst is the query's src doesn't count.
    Queries without a target are left out; those with fewer than k get all there are. Rows with a null coordinate take no part.

    Keys with at most few targets are one equi-join on the keys. The others are searched in growing cells: each key starts with a cell that holds about k targets if they lie evenly, a query sees its cell and the 26
    around it, and is settled by k targets within one cell's side. Only unsettled queries go on, with cells of twice the side, until a
    side spans all points of the key. So the rounds grow with the logarithm of a key's points, and no key's pairs are all made.
    """
    whole = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    queries, targets = queries.select(*keys, "src", "x", "y", "z").where(whole), targets.select(*keys, "dst", "x", "y", "z").where(whole)
    edge = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(f"n{name}"), *[f(c).alias(f"{s}{c}{name}") for c in "xyz" for s, f in (("lo", F.min), ("hi", F.max))])
    span = [F.greatest(f"hi{c}t", f"hi{c}q") - F.least(f"lo{c}t", f"lo{c}q") for c in "xyz"]
    longest, diagonal = F.greatest(*span), F.sqrt(span[0] * span[0] + span[1] * span[1] + span[2] * span[2])
    side = longest / F.ceil(F.cbrt(F.col("nt") / float(k)))
    both = edge(targets, "t").where(F.col("nt") > few).join(edge(queries, "q"), keys)
    box = written(both.select(*keys, F.when(longest > 0, side).otherwise(1.0).alias("side"), diagonal.alias("diagonal")), "boxes")
    crowded = not box.isEmpty()
    a, b = (df.join(box.select(*keys), keys, "left_anti") if crowded else df for df in (queries, targets))
    pairs = a.alias("a").join(b.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in keys]).select(*[F.col(f"a.{c}") for c in keys], "a.src", "b.dst", distance("a", "b").alias("dist"))
    if distinct_ids:
        pairs = pairs.where("src != dst")
    if k == 1:
        direct = pairs.groupBy(*keys, "src").agg(F.min(F.struct("dist", "dst")).alias("m")).select(*keys, "src", "m.dst", "m.dist")
    else:
        direct = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "src").orderBy("dist", "dst"))).where(F.col("rank") <= k).drop("rank")
    if not crowded:
        return direct
    rest, done, width = queries.join(box, keys), [direct], 1.0
    targets = targets.join(box.drop("diagonal"), keys)
    while True:
        cell = _cells(F.col("side") * width)
        a, b = _neighbour_cells(rest.select("*", *cell)), targets.select("*", *cell)
        on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*keys, "cx", "cy", "cz"]]
        pairs = a.alias("a").join(b.alias("b"), on).select(*[F.col(f"a.{c}") for c in keys], "a.src", "b.dst", distance("a", "b").alias("dist"), (F.col("a.side") * width).alias("reach"), "a.diagonal")
        pairs = pairs.where((F.col("dist") <= F.col("reach")) & (F.col("src") != F.col("dst") if distinct_ids else F.lit(True)))
        one = Window.partitionBy(*keys, "src")
        settled = (F.count("*").over(one) >= k) | (F.col("reach") >= F.col("diagonal"))
        seen = pairs.withColumn("settled", settled).where("settled").withColumn("rank", F.row_number().over(one.orderBy("dist", "dst"))).where(F.col("rank") <= k)
        seen = written(seen.select(*keys, "src", "dst", "dist"), "near")
        done.append(seen)
        count = Observation()
        left = rest.where(F.col("side") * width < F.col("diagonal")).join(seen.select(*keys, "src").distinct(), [*keys, "src"], "left_anti")
        rest = written(left.observe(count, F.count("*").alias("n")), "unsettled")
        if not count.get["n"]:
            return reduce(DataFrame.unionByName, done)
        width *= 2


def closest_distance(points: DataFrame, max_distance: float | None = None, keys: list[str] | None = None) -> DataFrame:
    """keys, voxel_id, dist to the nearest other voxel of the event; voxels without one (within max_distance) are left out."""
    keys = keys or ["event_id"]
    if max_distance is None:
        found = nearest(points.withColumnRenamed("voxel_id", "src"), points.withColumnRenamed("voxel_id", "dst"), 1, keys, True)
        return found.select(*keys, F.col("src").alias("voxel_id"), "dist")
    pairs = voxel_distances(points, max_distance, keys)
    both = pairs.select(*keys, F.explode(F.array("src", "dst")).alias("voxel_id"), "dist")
    return both.groupBy(*keys, "voxel_id").agg(F.min("dist").alias("dist"))


def consecutive_distances(points: DataFrame, order: str, keys: list[str] | None = None) -> DataFrame:
    """Distance of each row to the one before it in the order; none for the first."""
    keys = keys or ["event_id"]
    w = Window.partitionBy(*keys).orderBy(order)
    d = [F.col(c) - F.lag(c).over(w) for c in "xyz"]
    return points.withColumn("dist", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).where("dist is not null")


def flat_voxels(tracks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, track_id, voxel_id, x, y, z, energy_kev: positions and energies of all voxels of all tracks, a row each."""
    return tracks.select(*(keys or ["event_id"]), "track_id", "voxel_id", "x", "y", "z", (F.col("energy") * 1e3).alias("energy_kev"))


def track_statistics(voxels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Voxels and energy in keV of each track."""
    return voxels.groupBy(*(keys or ["event_id", "track_id"])).agg(F.count("*").alias("n_voxels"), (F.sum("energy") * 1e3).alias("energy_kev"))


def kernel(sigma: float, size: float, reach: float = 3.0) -> list[tuple[int, float]]:
    """Offsets and weights of a Gaussian on the grid, cut at reach sigmas, summing to 1; one cell for sigma 0."""
    if sigma <= 0:
        return [(0, 1.0)]
    n = max(1, math.ceil(reach * sigma / size))
    w = [math.exp(-0.5 * (i * size / sigma) ** 2) for i in range(-n, n + 1)]
    return [(i - n, v / sum(w)) for i, v in enumerate(w)]


def diffuse_grid(hits: DataFrame, size: float, sigma_t: float, sigma_l: float, least_electrons: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    """Hits smoothed on the grid by a separable Gaussian, without random numbers: keys, ix, iy, iz, x, y, z, electrons.

    Three passes of exploding a literal kernel and summing again by cell; cells with no more than least_electrons go.
    """
    keys = keys or ["event_id"]
    grid = hits.groupBy(*keys, *[F.floor(F.col(c) / size).alias(f"i{c}") for c in "xyz"]).agg((F.sum("energy") * ELECTRONS_PER_MEV).alias("electrons"))
    for c, sigma in (("x", sigma_t), ("y", sigma_t), ("z", sigma_l)):
        if sigma <= 0:
            continue
        steps = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in kernel(sigma, size)])
        spread = grid.withColumn("k", F.explode(steps)).withColumn(f"i{c}", F.col(f"i{c}") + F.col("k.o")).withColumn("electrons", F.col("electrons") * F.col("k.w"))
        grid = spread.groupBy(*keys, "ix", "iy", "iz").agg(F.sum("electrons").alias("electrons"))
    return grid.where(F.col("electrons") > least_electrons).select(*keys, "ix", "iy", "iz", *[((F.col(f"i{c}") + 0.5) * size).alias(c) for c in "xyz"], "electrons")
