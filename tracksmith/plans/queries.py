"""Registered queries over whole tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.operators import efficiency as ef
from tracksmith.operators import events as ev
from tracksmith.operators import hist as hi
from tracksmith.operators import relational as rel
from tracksmith.operators import samples as sa
from tracksmith.operators import tracks as tr
from tracksmith.operators import voxels as vx
from tracksmith.session import dealt_like, written
from tracksmith.sources import views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[F.round(c, other.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


#: These queries deal their tables by event: voxels, tracks, searches and blobs then join where they are.
by_event = dealt_like("event_id", lambda spark, d: v.table(spark, d, "lineitem"))
#: The same in small buckets: a smoothed hit is many cells, which are summed in memory.
by_event_finely = dealt_like("event_id", lambda spark, d: v.table(spark, d, "lineitem"), 50_000)


# ---- filters and projections


@register("p1_get_event", f"with {v.HITS} select * from hits where event_id = (select min(event_id) from hits)")
def p1(spark: SparkSession, d: str) -> DataFrame:
    h = v.hits(spark, d)
    return rel.get_event(h, h.agg(F.min("event_id")).first()[0])


@register("p2_compare", f"with {v.HITS} select event_id, hit_id, energy from hits where energy >= 0.5 and energy < 0.9 and label = 'A'")
def p2(spark: SparkSession, d: str) -> DataFrame:
    return rel.select_by(rel.select_by(rel.select_by(v.hits(spark, d), "energy", ">=", 0.5), "energy", "<", 0.9), "label", "==", "A").select("event_id", "hit_id", "energy")


@register(
    "p3_intervals",
    f"with {v.HITS} select count(*) filter (x > -10 and x < 10) as n_open, count(*) filter (x >= -10.5 and x <= 10.5) as n_closed, count(*) filter (x >= -10.5 and x < 10.5) as n_left, count(*) filter (x > -10.5 and x <= 10.5) as n_right from hits",
)
def p3(spark: SparkSession, d: str) -> DataFrame:
    return v.hits(spark, d).agg(F.count_if(rel.in_range("x", -10.0, 10.0, "open")).alias("n_open"), *[F.count_if(rel.in_range("x", -10.5, 10.5, b)).alias(f"n_{b}") for b in ("closed", "left", "right")])


@register("p4_predicate", f"with {v.HITS} select event_id, hit_id, x * x + y * y as r2 from hits where x * x + y * y < energy * 100")
def p4(spark: SparkSession, d: str) -> DataFrame:
    return rel.select_where(v.hits(spark, d), "x * x + y * y < energy * 100").select("event_id", "hit_id", F.expr("x * x + y * y").alias("r2"))


@register("p5_find_max", f'with {v.HITS} select event_id, min(hit_id) as "index", arg_min(x, hit_id) as x_at_max, max(energy) as "max" from (select *, max(energy) over (partition by event_id) as m from hits) where energy = m group by event_id')
def p5(spark: SparkSession, d: str) -> DataFrame:
    return rel.find_max(v.hits(spark, d), "energy", "hit_id", "x", ["event_id"])


@register("p6_transform", f"with {v.HITS} select event_id, x, y, z, energy, round_even(energy * 40000, 0)::bigint as electrons from hits")
def p6(spark: SparkSession, d: str) -> DataFrame:
    return rel.transform_hits(v.hits(spark, d))


@register("p7_event_spec", f"with {v.HITS} select event_id, count(*) as n_hits from hits where (event_id between 10 and 500 and (event_id - 10) % 7 = 0) or event_id in (3, 5) or event_id between 600 and 700 group by event_id")
def p7(spark: SparkSession, d: str) -> DataFrame:
    return ev.hits_per_event(rel.choose_events(v.hits(spark, d), "10:7:500,3,5,600:700"))


@register("p8_validate", f"with {v.HITS} select count(distinct event_id) as n_with_hits, min(event_id) as first_event, max(event_id) as last_event, 15000 as n_generated, count(distinct event_id) = 15000 as complete, min(event_id) <= 1 and max(event_id) >= 100 as range_inside from hits")
def p8(spark: SparkSession, d: str) -> DataFrame:
    return rel.validate_input(v.hits(spark, d), 15000, 1, 100)


@register("p9_alphas", f"with {v.PARTICLES} select event_id, initial_x as x, initial_y as y, initial_z as z, kin_energy as energy, final_volume as finalv from particles where particle_name = 'alpha'")
def p9(spark: SparkSession, d: str) -> DataFrame:
    return rel.find_alphas(v.particles(spark, d))


@register(
    "p10_diffusion",
    "select o_orderkey, round(3.5 * sqrt(o_custkey % 100), 6) as sigma_t, round(0.9 * sqrt(o_custkey % 100), 6) as sigma_l, round(sqrt(2 * 8.617333e-5 * 300 * (o_custkey % 100) / 500) * 10, 6) as sigma_ion,"
    " round(case when o_custkey % 100 <= 0 then 0.5 else 3.5 * sqrt(o_custkey % 100) * (case when o_custkey % 100 > 50 then 1.5 else 3.0 end) end, 6) as voxel,"
    " round(case when o_custkey % 100 <= 0 then 0.5 else 3.5 * sqrt(o_custkey % 100) * (case when o_custkey % 100 > 50 then 1.5 else 3.0 end) end * (case when o_custkey % 100 <= 0 then 2.5 when o_custkey % 100 > 50 then 1.5 else 2.0 end), 6) as link from orders",
)
def p10(spark: SparkSession, d: str) -> DataFrame:
    drift = F.col("o_custkey") % 100
    size, link = rel.voxel_and_distance(drift, rel.sigma_t_mm(drift))
    return rounded(v.table(spark, d, "orders").select("o_orderkey", rel.sigma_t_mm(drift).alias("sigma_t"), rel.sigma_l_mm(drift).alias("sigma_l"), rel.sigma_t_ion_mm(drift).alias("sigma_ion"), size.alias("voxel"), link.alias("link")))


# ---- events


@register("e1_number_of_events", f"with {v.HITS} select count(distinct event_id) as n_events from hits")
def e1(spark: SparkSession, d: str) -> DataFrame:
    return ev.number_of_events(v.hits(spark, d))


@register("e2_hits_per_event", f"with {v.HITS} select event_id, count(*) as n_hits from hits group by event_id")
def e2(spark: SparkSession, d: str) -> DataFrame:
    return ev.hits_per_event(v.hits(spark, d))


@register("e3_energy_deposited", f"with {v.HITS} select event_id, round(sum(energy) * 1000, 6) as energy from hits group by event_id")
def e3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.energy_deposited(v.hits(spark, d), 1e3))


@register("e4_energy_primary", f"with {v.PARTICLES} select event_id, round(sum(case when mother_id = 0 then kin_energy else 0 end), 9) as energy from particles group by event_id")
def e4(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.energy_primary(v.particles(spark, d)), 9)


def _cut(rule: str) -> str:
    return f"with {v.HITS}, ok as (select event_id from hits group by event_id having bool_and({rule})) select event_id, hit_id from hits where event_id in (select event_id from ok)"


@register("e5_fiducial", _cut("abs(x) < 20 and abs(y) < 20 and abs(z) < 22"))
def e5(spark: SparkSession, d: str) -> DataFrame:
    return ev.filter_fiducial(v.hits(spark, d), 20, 22).select("event_id", "hit_id")


@register("e6_radial", _cut("sqrt(x * x + y * y) < 25"))
def e6(spark: SparkSession, d: str) -> DataFrame:
    return ev.filter_radial(v.hits(spark, d), 25).select("event_id", "hit_id")


@register("e7_two_range_z", _cut("(z > -23 and z < -3) or (z > 1 and z < 23)"))
def e7(spark: SparkSession, d: str) -> DataFrame:
    return ev.filter_z(v.hits(spark, d), (-23, -3), (1, 23)).select("event_id", "hit_id")


@register("e8_short_tracks", f"with {v.HITS} select event_id, hit_id from hits where event_id in (select event_id from hits group by event_id having count(*) >= 6)")
def e8(spark: SparkSession, d: str) -> DataFrame:
    return ev.filter_short(v.hits(spark, d), 6).select("event_id", "hit_id")


@register("e9_energy_window", f"with {v.HITS} select event_id, hit_id, energy from hits where event_id in (select event_id from hits group by event_id having sum(energy) * 1000 between 1500.00001 and 2500.00001)")
def e9(spark: SparkSession, d: str) -> DataFrame:
    return ev.filter_energy_window(v.hits(spark, d), 1500.00001, 2500.00001).select("event_id", "hit_id", "energy")


@register(
    "e9_window_statistics",
    f"with {v.HITS}, e as (select event_id, sum(energy) * 1000 as k from hits group by event_id), f as (select k, case when k between 1500.00001 and 2500.00001 then k end as i from e)"
    " select count(k) as n_before, round(avg(k), 6) as mean_before, round(stddev_samp(k), 6) as std_before, round(min(k), 6) as min_before, round(max(k), 6) as max_before,"
    " count(i) as n_after, round(avg(i), 6) as mean_after, round(stddev_samp(i), 6) as std_after, round(min(i), 6) as min_after, round(max(i), 6) as max_after from f",
)
def e9b(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.energy_window_statistics(v.hits(spark, d), 1500.00001, 2500.00001))


@register("e11_unique_energies", f"with {v.HITS} select distinct event_id, energy from hits")
def e11(spark: SparkSession, d: str) -> DataFrame:
    return ev.unique_energies(v.hits(spark, d))


@register(
    "e12_coincidences",
    f"with {v.HITS}, a as (select *, particle_id as track_id from hits), b as (select * from a where event_id in (select event_id from a group by event_id having count(distinct track_id) = 2)), c as (select * from b where energy >= 0.3), "
    "g as (select * from c where event_id in (select event_id from c group by event_id having count(distinct track_id) = 2)) select event_id, hit_id, track_id, count(*) over (partition by event_id, track_id) as n_rows from g",
)
def e12(spark: SparkSession, d: str) -> DataFrame:
    h = v.hits(spark, d).withColumn("track_id", F.col("particle_id"))
    return ev.filter_coincidences(h, energy="energy", least=0.3).select("event_id", "hit_id", "track_id", "n_rows")


@register("e13_cylindrical", f"with {v.HITS} select event_id, hit_id, round(atan2(y, x), 6) as phi, round(sqrt(x * x + y * y), 6) as rho from hits where particle_id = 1")
def e13(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.cylindrical(v.hits(spark, d)).where("particle_id = 1").select("event_id", "hit_id", "phi", "rho"))


@register(
    "e14_input_order",
    f"with {v.HITS}, s as (select *, case when lag(time) over (partition by event_id order by hit_id) > time then 1 else 0 end as late from hits)"
    " select event_id, sum(late) = 0 as time_sorted, sum(late)::bigint as n_late, min(hit_id) as first_id, max(hit_id) as last_id, min(time) as t_min, max(time) as t_max,"
    " round(sqrt(pow(arg_max(x, hit_id) - arg_min(x, hit_id), 2) + pow(arg_max(y, hit_id) - arg_min(y, hit_id), 2) + pow(arg_max(z, hit_id) - arg_min(z, hit_id), 2)), 6) as end_distance from s group by event_id",
)
def e14(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.input_order(v.hits(spark, d)))


# ---- voxels


def voxel_sql(size: float) -> str:
    """CTE vox: voxels of hits."""
    return (
        f"cells as (select event_id, floor(x / {size})::bigint as ix, floor(y / {size})::bigint as iy, floor(z / {size})::bigint as iz, sum(energy) as energy from hits group by all), "
        f"vox as (select *, (ix + 0.5) * {size} as x, (iy + 0.5) * {size} as y, (iz + 0.5) * {size} as z, row_number() over (partition by event_id order by ix, iy, iz) as voxel_id from cells)"
    )


PAIRS = "pairs as (select a.event_id, a.voxel_id as src, b.voxel_id as dst, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) as dist from vox a join vox b on a.event_id = b.event_id and a.voxel_id < b.voxel_id)"


def track_sql(radius: float, size: float = 5.0, links: str | None = None) -> str:
    """CTEs up to trk: voxels with component, track_id, n_tracks, track_energy. A recursive closure gives the components."""
    links = links or f"links as (select * from pairs where dist <= {radius})"
    return (
        f"recursive {v.HITS}, {voxel_sql(size)}, {PAIRS}, {links}, "
        "both_ as (select event_id, src, dst from links union select event_id, dst, src from links), "
        "reach as (select event_id, voxel_id as v, voxel_id as r from vox union select reach.event_id, reach.v, b.dst from reach join both_ b on reach.event_id = b.event_id and reach.r = b.src), "
        "comp as (select event_id, v as voxel_id, min(r) as component from reach group by event_id, v), "
        "own as (select vox.*, component from vox join comp using (event_id, voxel_id)), "
        "tot as (select event_id, component, sum(energy) as track_energy from own group by event_id, component), "
        "rnk as (select *, row_number() over (partition by event_id order by round(track_energy, 9) desc, component) as track_id, count(*) over (partition by event_id) as n_tracks from tot), "
        "trk as (select own.*, track_energy, track_id, n_tracks from own join rnk using (event_id, component))"
    )


RADIUS = 20.0


def voxels(spark: SparkSession, d: str) -> DataFrame:
    return vx.voxelize(v.hits(spark, d), 5.0)


@register("v1_voxelize", f"with {v.HITS}, {voxel_sql(5.0)} select event_id, ix, iy, iz, x, y, z, round(energy, 9) as energy, round_even(energy * 40000, 0)::bigint as electrons, voxel_id from vox")
def v1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(voxels(spark, d), 9)


@register(
    "v2_cylindrical_boxes",
    f"with {v.HITS} select event_id, least(floor((atan2(y, x) + pi()) / (2 * pi() / 8)), 7)::bigint as iphi, floor(z / 10)::bigint as iz, round(sum(energy), 9) as ebox, round(sum(sqrt(x * x + y * y) * energy) / sum(energy), 6) as rbox, count(*) as nb from hits group by all",
)
def v2(spark: SparkSession, d: str) -> DataFrame:
    h = ev.cylindrical(v.hits(spark, d)).withColumn("edep", F.col("energy"))
    return rounded(vx.cylindrical_boxes(h, 8, 10.0).withColumn("iphi", F.col("iphi").cast("long")), 6, ebox=9)


@register("v3_pair_distances", f"with {v.HITS}, {voxel_sql(5.0)}, {PAIRS} select event_id, src, dst, round(dist, 6) as dist from pairs where dist <= 20")
def v3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vx.voxel_distances(voxels(spark, d), 20.0))


@register("v4_closest_distance", f"with {v.HITS}, {voxel_sql(5.0)}, {PAIRS}, b as (select event_id, src as voxel_id, dist from pairs union all select event_id, dst, dist from pairs) select event_id, voxel_id, round(min(dist), 6) as dist from b group by event_id, voxel_id")
def v4(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vx.closest_distance(voxels(spark, d)))


@register("v5_consecutive", f"with {v.HITS}, l as (select *, lag(x) over w as px, lag(y) over w as py, lag(z) over w as pz from hits window w as (partition by event_id order by hit_id)) select event_id, hit_id, round(sqrt(pow(x - px, 2) + pow(y - py, 2) + pow(z - pz, 2)), 6) as dist from l where px is not null")
def v5(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vx.consecutive_distances(v.hits(spark, d), "hit_id").select("event_id", "hit_id", "dist"))


@register("v6_track_statistics", f"with {track_sql(RADIUS)} select event_id, track_id, count(*) as n_voxels, round(sum(energy) * 1000, 6) as energy_kev from trk group by event_id, track_id")
@by_event
def v6(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vx.track_statistics(tracks(spark, d)))


@register("v6_flat_voxels", f"with {track_sql(RADIUS)} select event_id, track_id, voxel_id, x::double as x, y::double as y, z::double as z, round(energy * 1000, 6) as energy_kev from trk")
@by_event
def v6b(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vx.flat_voxels(tracks(spark, d)))


def _kernel_sql(axis: str, sigma: float, source: str, name: str) -> str:
    values = ", ".join(f"({o}, {w!r}::double)" for o, w in vx.kernel(sigma, 10.0))
    others = ", ".join(f"i{c}" for c in "xyz" if c != axis)
    return f"{name} as (select event_id, {others}, i{axis} + o as i{axis}, sum(electrons * w) as electrons from {source}, (values {values}) as k(o, w) group by all)"


@register(
    "v8_diffuse_grid",
    f"with {v.HITS}, g0 as (select event_id, floor(x / 10)::bigint as ix, floor(y / 10)::bigint as iy, floor(z / 10)::bigint as iz, sum(energy) * 40000 as electrons from hits group by all), "
    + _kernel_sql("x", 4.0, "g0", "g1")
    + ", "
    + _kernel_sql("y", 4.0, "g1", "g2")
    + " select event_id, ix, iy, iz, (ix + 0.5) * 10 as x, (iy + 0.5) * 10 as y, (iz + 0.5) * 10 as z, round(electrons, 4) as electrons from g2 where electrons > 0.5",
)
@by_event_finely
def v8(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vx.diffuse_grid(v.hits(spark, d), 10.0, 4.0, 0.0), 4)


# ---- tracks


def linked_tracks(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tracks (with track_energy) and their links, each written once, since all of them are read several times. Inside dealt_by() only hits are shuffled."""
    vox = written(vx.voxelize(hits, 5.0).select("event_id", "voxel_id", "x", "y", "z", "energy"), "voxels")
    links = written(tr.radius_links(vox, RADIUS), "links")
    return written(tr.make_tracks(vox, links), "tracks"), links


def tracks(spark: SparkSession, d: str) -> DataFrame:
    return linked_tracks(v.hits(spark, d))[0]


@register("g1_threshold", f"with {v.HITS}, {voxel_sql(5.0)} select event_id, voxel_id, round(energy, 9) as energy from vox where energy >= 0.4000001")
def g1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tr.threshold(voxels(spark, d), 0.4000001).select("event_id", "voxel_id", "energy"), 9)


KNN = "near as (select *, row_number() over (partition by event_id, src order by dist, dst) as rank from (select event_id, src, dst, dist from pairs union all select event_id, dst, src, dist from pairs))"


@register("g3_knn_links", f"with {v.HITS}, {voxel_sql(5.0)}, {PAIRS}, {KNN} select event_id, least(src, dst) as src, greatest(src, dst) as dst, round(min(dist), 6) as dist from near where rank <= 2 group by 1, 2, 3")
def g3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tr.knn_links(voxels(spark, d), 2))


@register("g4_mutual_knn", f"with {v.HITS}, {voxel_sql(5.0)}, {PAIRS}, {KNN} select event_id, least(src, dst) as src, greatest(src, dst) as dst, round(min(dist), 6) as dist from near where rank <= 2 group by 1, 2, 3 having count(*) = 2")
def g4(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tr.knn_links(voxels(spark, d), 2, mutual=True))


@register("g5_components", f"with {track_sql(RADIUS)} select event_id, voxel_id, track_id, n_tracks, round(track_energy, 9) as track_energy from trk")
@by_event
def g5(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tracks(spark, d).select("event_id", "voxel_id", "track_id", "n_tracks", "track_energy"), 9)


KNN_LINKS = f"{KNN}, links as (select event_id, least(src, dst) as src, greatest(src, dst) as dst, min(dist) as dist from near where rank <= 1 and dist <= 30 group by 1, 2, 3)"


@register("g6_knn_tracks", f"with {track_sql(0, links=KNN_LINKS)} select event_id, track_id, n_tracks, count(*) as n_voxels, round(sum(energy), 9) as energy from trk group by 1, 2, 3")
def g6(spark: SparkSession, d: str) -> DataFrame:
    t = tr.build_tracks(voxels(spark, d), 30.0, method="knn", k=1)
    return rounded(t.groupBy("event_id", "track_id", "n_tracks").agg(F.count("*").alias("n_voxels"), F.sum("energy").alias("energy")), 9)


@register(
    "g7_dbscan",
    f"with recursive {v.HITS}, {voxel_sql(5.0)}, {PAIRS}, near as (select event_id, src, dst from pairs where dist <= 20 union all select event_id, dst, src from pairs where dist <= 20), "
    "core as (select vox.event_id, vox.voxel_id from vox left join near on near.event_id = vox.event_id and near.src = vox.voxel_id group by 1, 2 having count(near.dst) + 1 >= 3), "
    "cc as (select n.event_id, n.src, n.dst from near n join core a on a.event_id = n.event_id and a.voxel_id = n.src join core b on b.event_id = n.event_id and b.voxel_id = n.dst), "
    "reach as (select event_id, voxel_id as v, voxel_id as r from core union select reach.event_id, reach.v, cc.dst from reach join cc on reach.event_id = cc.event_id and reach.r = cc.src), "
    "lab as (select event_id, v as voxel_id, dense_rank() over (partition by event_id order by min(r)) as label from reach group by event_id, v), "
    "bord as (select n.event_id, n.src as voxel_id, min(label) as label from near n join lab on lab.event_id = n.event_id and lab.voxel_id = n.dst group by 1, 2) "
    "select vox.event_id, vox.voxel_id, coalesce(lab.label, bord.label, 0) as label, max(coalesce(lab.label, bord.label, 0)) over (partition by vox.event_id) as n_clusters from vox left join lab using (event_id, voxel_id) left join bord using (event_id, voxel_id)",
)
def g7(spark: SparkSession, d: str) -> DataFrame:
    return tr.dbscan(voxels(spark, d), 20.0, 3).select("event_id", "voxel_id", "label", "n_clusters")


CATEGORY = "case when n_tracks = 1 then 'single' when n_tracks = 2 then 'two_' else 'three_' end || case when n_tracks = 1 then '' when track_id = 1 then 'primary' else 'secondary' end"


@register("g8_categories", f"with {track_sql(RADIUS)}, t as (select event_id, track_id, n_tracks, count(*) as n_voxels, sum(energy) as energy from trk group by 1, 2, 3) select event_id, track_id, n_tracks, n_voxels, round(energy, 9) as energy, {CATEGORY} as category from t")
@by_event
def g8(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tr.event_categories(tracks(spark, d)), 9)


@register("g8_category_counts", f"with {track_sql(RADIUS)}, t as (select event_id, track_id, n_tracks, sum(energy) as energy from trk group by 1, 2, 3) select {CATEGORY} as category, count(distinct event_id) as n_events, count(*) as n_tracks, sum(round(energy * 1e7)::bigint)::bigint / 1e7::double as energy from t group by 1")
@by_event
def g8b(spark: SparkSession, d: str) -> DataFrame:
    # energies are whole multiples of 1e-7: added up as whole numbers, so that no order of addition shows
    whole = tr.event_categories(tracks(spark, d)).withColumn("energy", F.round(F.col("energy") * 1e7).cast("long"))
    return tr.category_counts(whole).withColumn("energy", F.col("energy") / 1e7)


@register(
    "g9_single_track_window",
    f"with {track_sql(RADIUS)}, ok as (select event_id from hits group by event_id having sum(energy) * 1000 between 1000.00001 and 2500.00001) select event_id, voxel_id, round(energy, 9) as energy from trk where n_tracks = 1 and event_id in (select event_id from ok)",
)
@by_event
def g9(spark: SparkSession, d: str) -> DataFrame:
    kept = ev.filter_energy_window(v.hits(spark, d), 1000.00001, 2500.00001)
    return rounded(tr.single_tracks(linked_tracks(kept)[0]).select("event_id", "voxel_id", "energy"), 9)


@register(
    "g10_graph_summary",
    f"with {track_sql(RADIUS)}, deg as (select event_id, v as voxel_id, count(*) as degree from (select event_id, src as v from links union all select event_id, dst from links) group by 1, 2), "
    "d as (select trk.event_id, track_id, coalesce(degree, 0) as degree from trk left join deg using (event_id, voxel_id)) "
    "select event_id, track_id, count(*) as n_vertices, (sum(degree) // 2)::bigint as n_edges, round(avg(degree), 6) as mean_degree, max(degree) as max_degree, count(*) filter (degree = 1) as n_ends, count(*) filter (degree >= 3) as n_branches from d group by 1, 2",
)
@by_event
def g10(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tr.graph_summary(*linked_tracks(v.hits(spark, d))))


@register("g11_satellites", f"with {track_sql(RADIUS)}, s as (select *, count(*) over (partition by event_id, track_id) as n from trk) select event_id, track_id, voxel_id, round(energy * 1000, 6) as energy_kev from s where n_tracks > 1 and n = 1")
@by_event
def g11(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tr.satellites(tracks(spark, d)))


@register("b12_extent", f"with {track_sql(RADIUS)} select event_id, track_id, round(sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)), 6) as extent, max(z) - min(z) as z_extent, round(sum(x * energy) / sum(energy), 6) as bary_x, round(sum(y * energy) / sum(energy), 6) as bary_y, round(sum(z * energy) / sum(energy), 6) as bary_z from trk group by 1, 2")
@by_event
def b12(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tr.track_extent(tracks(spark, d)))


@register(
    "b14_occupancy",
    f"with {track_sql(RADIUS)}, c as (select event_id, track_id, sum(x * energy) / sum(energy) as bx, sum(y * energy) / sum(energy) as by_, min(z) as z0, max(z) as z1 from trk group by 1, 2), "
    "p as (select event_id, track_id, floor((z - z0) / 2) as slot, floor((x - bx) / 4) as px, floor((y - by_) / 4) as py, (floor((z1 - z0) / 2) + 1)::bigint as n_slots, count(*) as n from trk join c using (event_id, track_id) where floor((x - bx) / 4) between -32 and 31 and floor((y - by_) / 4) between -32 and 31 group by all) "
    "select event_id, track_id, n_slots, round(avg(n), 6) as mean_count, max(n) as max_count, min(n) as min_count, count(*) as n_pixels, round(count(*) / n_slots, 6) as mean_occupancy from p group by 1, 2, 3",
)
@by_event
def b14(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tr.occupancy(tracks(spark, d)))


@register("b15_satellite_distance", f"with {track_sql(RADIUS)} select a.event_id, a.track_id, round(min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))), 6) as dist from trk a join trk b on a.event_id = b.event_id and a.track_id > 1 and b.track_id = 1 group by 1, 2")
@by_event
def b15(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tr.satellite_distance(tracks(spark, d)))


STATS = (
    "nn as (select event_id, avg(dist) as mean_nn, max(dist) as max_nn from (select event_id, voxel_id, min(dist) as dist from (select event_id, src as voxel_id, dist from pairs union all select event_id, dst, dist from pairs) group by 1, 2) group by 1), "
    "st as (select event_id, max(n_tracks) as n_tracks, count(*) as n_voxels, sum(energy) * 1000 as energy_kev, count(*) filter (track_id = 1) as main_voxels, sum(energy) filter (track_id = 1) * 1000 as main_energy_kev, max(z) filter (track_id = 1) - min(z) filter (track_id = 1) as main_z_extent from trk group by 1)"
)


@register("b16_event_statistics", f"with {track_sql(RADIUS)}, {STATS} select event_id, n_tracks, n_voxels, round(energy_kev, 6) as energy_kev, main_voxels, round(main_energy_kev, 6) as main_energy_kev, main_z_extent, round(mean_nn, 6) as mean_nn, round(max_nn, 6) as max_nn from st left join nn using (event_id)")
@by_event
def b16(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tr.event_statistics(tracks(spark, d)))


_B17 = ", ".join(f"round({f}({c}), 6) as {n}_{c}" for c in ("energy_kev", "n_voxels", "mean_nn", "main_z_extent") for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")) if not (c == "n_voxels" and n in ("min", "max")))


@register("b17_batch_summary", f"with {track_sql(RADIUS)}, {STATS} select n_tracks, count(*) as n_events, round(count(*) / sum(count(*)) over (), 6) as share, min(n_voxels) as min_n_voxels, max(n_voxels) as max_n_voxels, {_B17} from st left join nn using (event_id) group by 1")
@by_event
def b17(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tr.batch_summary(tr.event_statistics(tracks(spark, d))))


# ---- histograms and fits


def _hist1d_sql(x: str, source: str, low: float, high: float, n: int) -> str:
    w = (high - low) / n
    return f"c as (select least(floor(({x} - {low}) / {w})::bigint, {n - 1}) as bin, count(*)::double as weight from {source} where {x} >= {low} and {x} < {high} group by 1), b as (select i as bin, {low}::double + i * {w}::double as lo, {low}::double + (i + 1) * {w}::double as hi, {low}::double + (i + 0.5) * {w}::double as center from range({n}) t(i)), h as (select bin, lo, hi, center, coalesce(weight, 0.0::double) as weight from b left join c using (bin))"


ROUND_BINS = "bin, round(lo, 6) as lo, round(hi, 6) as hi, round(center, 6) as center, round(weight, 6) as weight"


@register("h1_hist1d", f"with {v.HITS}, {_hist1d_sql('energy', 'hits', 0.0, 1.0, 25)} select {ROUND_BINS} from h")
def h1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hi.hist1d(v.hits(spark, d), "energy", 0.0, 1.0, 25))


@register("h1_pdf", f"with {v.HITS}, {_hist1d_sql('energy', 'hits', 0.0, 1.0, 25)} select bin, round(lo, 6) as lo, round(hi, 6) as hi, round(center, 6) as center, round(weight / (sum(weight) over () * 0.04), 6) as weight from h")
def h1b(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hi.hist1d(v.hits(spark, d), "energy", 0.0, 1.0, 25, pdf=True))


@register("h1_uneven", f"with {v.HITS}, b as (select * from (values (0, 0.0::double, 0.1::double), (1, 0.1, 0.35), (2, 0.35, 0.9), (3, 0.9, 1.05)) t(bin, lo, hi)) select bin::bigint as bin, lo, hi, round((lo + hi) / 2, 6) as center, (select count(*) from hits where energy >= lo and energy < hi)::double as weight from b")
def h1c(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hi.hist_edges(v.hits(spark, d), "energy", [0.0, 0.1, 0.35, 0.9, 1.05]))


@register("h3_digitize", f"with {v.HITS} select (energy >= 0.1)::int + (energy >= 0.35)::int + (energy >= 0.9)::int as bin, count(*) as n from hits group by 1")
def h3(spark: SparkSession, d: str) -> DataFrame:
    return v.hits(spark, d).groupBy(hi.digitize("energy", [0.1, 0.35, 0.9]).alias("bin")).agg(F.count("*").alias("n"))


@register("h4_hist2d", f"with {v.HITS} select floor((x + 25) / 5)::bigint as xbin, floor((y + 25) / 5)::bigint as ybin, count(*) as n from hits where x >= -25 and x < 25 and y >= -25 and y < 25 group by 1, 2")
def h4(spark: SparkSession, d: str) -> DataFrame:
    return hi.hist2d(v.hits(spark, d), "x", "y", 10, 10, (-25.0, 25.0), (-25.0, 25.0))


@register("h5_profile", f"with {v.HITS} select least(floor((x + 25) / 5)::bigint, 9) as bin, (-25 + (least(floor((x + 25) / 5), 9) + 0.5) * 5)::double as x_mean, 2.5::double as x_std, round(avg(energy), 6) as y_mean, round(stddev_samp(energy), 6) as y_std, count(energy) as n from hits where x >= -25 and x < 25 group by 1, 2")
def h5(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hi.profile(v.hits(spark, d), "x", "energy", -25.0, 25.0, 10))


@register(
    "h5_profile_binned",
    f"with {v.HITS}, c as (select least(floor((x + 25) / 5)::bigint, 9) as bin, floor(energy / 0.05)::bigint as yb, count(*) as m from hits where x >= -25 and x < 25 and energy >= 0 and energy < 1 group by 1, 2), "
    "k as (select *, (yb + 0.5) * 0.05 as y from (select *, max(m) over (partition by bin) as most from c) where m >= 0.5 * most), s as (select bin, sum(m) as n, sum(m * y) / sum(m) as mu from k group by bin) "
    "select bin, (-25 + (bin + 0.5) * 5)::double as x_mean, 2.5::double as x_std, round(any_value(mu), 6) as y_mean, round(sqrt(sum(m * pow(y - mu, 2)) / (any_value(n) - 1)), 6) as y_std, any_value(n)::bigint as n from k join s using (bin) group by bin",
)
def h5b(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hi.profile(v.hits(spark, d), "x", "energy", -25.0, 25.0, 10, 20, (0.0, 1.0), 0.5))


@register("h7_efficiency_from_below", f"with {v.HITS}, {_hist1d_sql('energy', 'hits', 0.0, 1.0, 25)}, p as (select * from h where center between 0.2 and 0.9) select round(center, 6) as center, round(sum(weight) over (order by center desc) / sum(weight) over (), 6) as efficiency from p")
def h7(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hi.efficiency_from_below(hi.hist1d(v.hits(spark, d), "energy", 0.0, 1.0, 25), 0.2, 0.9))


@register("h8_moments", f"with {v.HITS}, {_hist1d_sql('energy', 'hits', 0.0, 1.0, 25)} select round(sum(weight * center) / sum(weight), 6) as mean, round(sqrt(sum(weight * center * center) / sum(weight) - pow(sum(weight * center) / sum(weight), 2)), 6) as std, round(min_by(center, (-weight, center)), 6) as peak, sum(weight) as total from h")
def h8(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hi.hist_moments(hi.hist1d(v.hits(spark, d), "energy", 0.0, 1.0, 25)))


_T = "(1 / (1 + 0.3275911 * abs(u)))"
_ERF_SQL = f"sign(u) * (1 - (((((1.061405429 * {_T} - 1.453152027) * {_T}) + 1.421413741) * {_T} - 0.284496736) * {_T} + 0.254829592) * {_T} * exp(-u * u))"


@register(
    "h9_smear",
    f"with {v.HITS}, {_hist1d_sql('energy', 'hits', 0.0, 1.0, 25)}, j as (select t.bin, t.lo, t.hi, t.center, s.weight as w, (t.hi - s.center) / 0.05 / sqrt(2) as u1, (t.lo - s.center) / 0.05 / sqrt(2) as u0 from h t, h s) "
    f"select bin, round(lo, 6) as lo, round(hi, 6) as hi, round(center, 6) as center, round(sum(w * 0.5 * ({_ERF_SQL.replace('u', 'u1').replace('mu1', 'mu')} - ({_ERF_SQL.replace('u', 'u0')}))), 3) as weight from j group by 1, 2, 3, 4",
)
def h9(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hi.smear(hi.hist1d(v.hits(spark, d), "energy", 0.0, 1.0, 25), 0.05), 6, weight=3)


@register(
    "h10_log_hist",
    f"with {v.HITS}, {voxel_sql(5.0)}, {PAIRS}, l as (select log10(dist) as x from pairs where dist > 0), {_hist1d_sql('x', 'l', 0.5, 2.0, 15)} select {ROUND_BINS} from h",
)
def h10(spark: SparkSession, d: str) -> DataFrame:
    pairs = vx.voxel_distances(voxels(spark, d))
    return rounded(hi.log_hist(pairs, "dist", 10**0.5, 100.0, 15))


@register(
    "h11_sample_hists",
    f"with {v.HITS}, a as (select label, floor(energy / 0.1)::bigint as bin, count(*)::double as weight from hits where energy >= 0 and energy < 1 group by 1, 2), f as (select label, i as bin from (select distinct label from hits), range(10) t(i)) "
    "select label, bin, round(bin * 0.1::double, 6) as lo, round((bin + 1) * 0.1::double, 6) as hi, round((bin + 0.5) * 0.1::double, 6) as center, coalesce(weight, 0.0::double) as weight from f left join a using (label, bin)",
)
def h11(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hi.hist1d(v.hits(spark, d), "energy", 0.0, 1.0, 10, ["label"]))


@register(
    "h12_linear_fit",
    f"with {v.HITS}, f as (select label, count(*) as n, regr_sxx(energy, x) as sxx, regr_syy(energy, x) as syy, regr_sxy(energy, x) as sxy, avg(x) as mx, regr_slope(energy, x) as slope, regr_intercept(energy, x) as intercept from hits group by label) "
    "select label, n, round(intercept, 6) as intercept, round(slope, 6) as slope, round(sqrt((syy - slope * sxy) / (n - 2) * (1 / n + mx * mx / sxx)), 6) as intercept_err, round(sqrt((syy - slope * sxy) / (n - 2) / sxx), 6) as slope_err from f",
)
def h12(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hi.linear_fit(v.hits(spark, d), "x", "energy", ["label"]))


@register("h15_gauss_fit", f"with {v.HITS} select label, count(*) as n, round(avg(energy), 6) as mu, round(stddev_pop(energy), 6) as sigma, round(count(*) * (ln(stddev_pop(energy)) + 0.5 * ln(2 * pi()) + 0.5), 4) as nll, round(stddev_pop(energy) / sqrt(count(*)), 6) as mu_err, round(stddev_pop(energy) / sqrt(2 * count(*)), 6) as sigma_err from hits where energy > 0.2 and energy < 0.8 group by label")
def h15(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hi.gauss_fit(v.hits(spark, d), "energy", 0.2, 0.8, ["label"]), 6, nll=4)


@register(
    "h17_photopeak",
    f"with {v.SENSORS}, h as (select sensor, least(floor(charge / 2)::bigint, 49) as bin, count(*) as m from sensors where charge >= 0 and charge < 100 group by 1, 2), p as (select sensor, (min_by(bin, (-m, bin)) + 0.5) * 2 as peak from h group by 1) "
    "select sensor, peak, count(*) as n, round(avg(charge), 6) as mu, round(stddev_pop(charge), 6) as sigma, round(case when stddev_pop(charge) > 0 then count(*) * (ln(nullif(stddev_pop(charge), 0)) + 0.5 * ln(2 * pi()) + 0.5) end, 4) as nll, "
    "round(stddev_pop(charge) / sqrt(count(*)), 6) as mu_err, round(stddev_pop(charge) / sqrt(2 * count(*)), 6) as sigma_err, round(2.355 * stddev_pop(charge) / avg(charge), 6) as resolution from sensors join p using (sensor) where charge > peak - 5 and charge < peak + 5 group by 1, 2",
)
def h17(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hi.photopeak_fit(v.sensors(spark, d), "sensor", "charge", 0.0, 100.0, 50, 5.0), 6, nll=4)


@register("h18_gauss_value", f"with {v.HITS} select event_id, hit_id, round(2 * exp(-0.5 * pow((energy - 0.5) / 0.2, 2)) / (0.2 * sqrt(2 * pi())) + exp(-0.5 * pow((energy - 0.8) / 0.1, 2)) / (0.1 * sqrt(2 * pi())), 6) as value from hits")
def h18(spark: SparkSession, d: str) -> DataFrame:
    return rounded(v.hits(spark, d).select("event_id", "hit_id", hi.gauss2_value("energy", (0.5, 0.2, 2.0), (0.8, 0.1, 1.0)).alias("value")))


# ---- efficiencies

CUTS = ef.even_cuts(0.0, 10000.0, 41)
_CUTS = "cuts as (select (i * 250)::double as cut from range(41) t(i))"
_TWO = f"with {v.SCORES}, {_CUTS}, e as (select cut, avg((score > cut)::int) filter (signal) as s, avg((score > cut)::int) filter (not signal) as b from scores, cuts group by cut)"


@register("f1_efficiency_vs_cut", f"with {v.SCORES}, {_CUTS}, c as (select cut, count(*) filter (score > cut) as k, count(*) as n from scores, cuts group by cut) select cut, k as n_pass, n, round(k / n, 6) as efficiency, round(sqrt(k / n * (1 - k / n) / n), 6) as error from c")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ef.efficiency_vs_cut(v.scores(spark, d), "score", CUTS))


@register("f2_single_cut", f"with {v.SCORES} select round(avg((score > 1500)::int) filter (signal), 6) as signal_eff, round(avg((score > 1500)::int) filter (not signal), 6) as background_eff, round(1 - avg((score > 1500)::int) filter (not signal), 6) as background_rejection from scores")
def f2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ef.single_cut(v.scores(spark, d), "score", 1500.0, "signal"))


@register("f3_two_samples", f"{_TWO} select cut, round(s, 6) as eff_signal, round(b, 6) as eff_background from e")
def f3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_two(spark, d))


def _two(spark: SparkSession, d: str) -> DataFrame:
    return ef.two_sample_efficiencies(v.scores(spark, d), "score", "signal", CUTS)


@register("f4_figure_of_merit", f"{_TWO}, f as (select *, s / sqrt(b + 1e-10) as fom from e) select cut, round(s, 6) as eff_signal, round(b, 6) as eff_background, round(fom, 4) as fom, cut = (select min(cut) from f where fom = (select max(fom) from f)) as best from f")
def f4(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ef.figure_of_merit(_two(spark, d)), 6, fom=4)


@register("f5_ruled_merit", f"{_TWO}, f as (select *, (select min(cut) from e where s < 0.01) as stop from e) select cut, round(s, 6) as eff_signal, round(b, 6) as eff_background, round(case when s >= 0.01 and b > 0 then s / sqrt(nullif(b, 0)) else 0 end, 6) as fom from f where stop is null or cut <= stop")
def f5(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ef.figure_of_merit_ruled(_two(spark, d)))


@register("f6_roc", f"{_TWO}, r as (select cut, s as x, 1 - b as y from e) select cut, round(x, 6) as x, round(y, 6) as y, round(coalesce((x - lag(x) over w) * (y + lag(y) over w) / 2, 0), 6) as area from r window w as (order by x, y, cut)")
def f6(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ef.roc_curve(_two(spark, d)))


@register("f6_auc", f"{_TWO}, r as (select cut, s as x, 1 - b as y from e), a as (select (x - lag(x) over w) * (y + lag(y) over w) / 2 as area from r window w as (order by x, y, cut)) select round(sum(area), 6) as auc from a")
def f6b(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ef.auc(ef.roc_curve(_two(spark, d))))


@register("f7_efficiency_error", f"with {v.SCORES}, {_CUTS}, c as (select cut, count(*) filter (score >= cut) as k, count(*) as n from scores, cuts group by cut) select cut, k as n_pass, n, round(k / n, 4) as efficiency, round(sqrt(k / n * (1 - k / n) / n), 4) as error from c")
def f7(spark: SparkSession, d: str) -> DataFrame:
    return ef.efficiency_with_error(v.scores(spark, d), "score", CUTS)


@register("f8_binomial_interval")
def f8(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ef.binomial_interval(ef.efficiency_vs_cut(v.scores(spark, d), "score", CUTS)))


AT = [100.0, 625.0, 1300.0, 4444.0, 9999.0, 12000.0]


@register(
    "f9_interpolate",
    f"{_TWO}, q as (select unnest([100.0, 625.0, 1300.0, 4444.0, 9999.0, 12000.0])::double as a_), a as (select a_, max(cut) as c0 from q join e on cut <= a_ group by a_), b as (select a_, c0, (select min(cut) from e where cut > c0) as c1 from a) "
    "select a_ as \"at\", round(l.s + coalesce((a_ - c0) / (c1 - c0) * (u.s - l.s), 0), 6) as eff_signal, round(l.b + coalesce((a_ - c0) / (c1 - c0) * (u.b - l.b), 0), 6) as eff_background from b join e l on l.cut = c0 left join e u on u.cut = c1",
)
def f9(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ef.interpolate(_two(spark, d), AT, "cut"))


@register("f11_working_point", f"{_TWO} select cut, round(s, 6) as eff_signal, round(b, 6) as eff_background from e order by abs(s - 0.5), cut limit 1")
def f11(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ef.working_point(_two(spark, d), "eff_signal", 0.5))


@register("f12_apply_cut", f"with {v.SCORES} select signal, count(*) as n, count(*) filter (score > 2000) as n_pass, round(avg((score > 2000)::int), 6) as efficiency from scores group by signal")
def f12(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ef.apply_cut(v.scores(spark, d), "score", 2000.0, "signal"))


@register(
    "f14_separation",
    f"with {v.HITS}, g as (select hit_id % 5 as radius, avg(energy) filter (label = 'A') as m1, avg(energy) filter (label = 'R') as m2, stddev_samp(energy) filter (label = 'A') as s1, stddev_samp(energy) filter (label = 'R') as s2 from hits group by 1), "
    "s as (select *, abs(m1 - m2) / sqrt(s1 * s1 + s2 * s2) as separation from g) select radius, round(m1, 6) as m1, round(m2, 6) as m2, round(s1, 6) as s1, round(s2, 6) as s2, round(separation, 6) as separation, separation = (select max(separation) from s) as best from s",
)
def f14(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ef.separation(v.hits(spark, d).withColumn("radius", F.col("hit_id") % 5), "energy", "label", "A", "R", ["radius"]))


@register(
    "f10_roc_from_curves",
    f"with {v.SCORES}, {_CUTS}, e as (select doc_id % 3 as sample, cut, avg((score > cut)::int) filter (signal) as s, avg((score > cut)::int) filter (not signal) as b from scores, cuts group by 1, 2), a as (select (i * 100)::double as a_ from range(101) t(i)), "
    "r as (select l.sample, a_, l.s + coalesce((a_ - l.cut) / 250 * (u.s - l.s), 0) as s, l.b + coalesce((a_ - l.cut) / 250 * (u.b - l.b), 0) as b from a join e l on l.cut = floor(a_ / 250) * 250 left join e u on u.sample = l.sample and u.cut = l.cut + 250), "
    "w as (select sample, (b - lag(b) over o) * (s + lag(s) over o) / 2 as area from r window o as (partition by sample order by b, s, a_)) select sample, round(coalesce(sum(area), 0), 6) as auc from w group by 1",
)
def f10(spark: SparkSession, d: str) -> DataFrame:
    """Areas of three samples' interpolated curves at a hundred thresholds."""
    curves = ef.two_sample_efficiencies(v.scores(spark, d).withColumn("sample", F.col("doc_id") % 3), "score", "signal", CUTS, by=["sample"])
    return rounded(ef.roc_from_curves(curves, [100.0 * i for i in range(101)], ["sample"], "cut"))


_SELECTED = (
    f"with {v.HITS}, e as (select event_id, bool_and(sqrt(x * x + y * y) < 30) as in_r, count(*) as n_hits, bool_and((z > -24 and z < -1) or (z > 0 and z < 24)) as in_z, sum(energy) * 1000 as kev from hits group by 1), "
    f"p as (select *, 0.5 * ({_ERF_SQL.replace('(u)', '(u1)').replace('-u * u', '-u1 * u1')} - ({_ERF_SQL.replace('(u)', '(u0)').replace('-u * u', '-u0 * u0')})) as share from (select *, (2500 - kev) / 50 / sqrt(2) as u1, (1500 - kev) / 50 / sqrt(2) as u0 from e)), "
    "n as (select count(*) as n_events, count(*) filter (in_r) as n_radial, count(*) filter (in_r and n_hits >= 3) as n_length, count(*) filter (in_r and n_hits >= 3 and in_z) as n_z, coalesce(sum(share) filter (in_r and n_hits >= 3 and in_z), 0) as n_roi from p), "
    "q as (select *, "
    + ", ".join(f"(case when n_{b} > 0 then n_{b} else 0.5 end)::double / (case when n_{a} > 0 then n_{a} else 0.5 end) as eff_{b}" for a, b in (("events", "radial"), ("radial", "length"), ("length", "z"), ("z", "roi")))
    + " from n)"
)


@register("f15_cut_flow", f"{_SELECTED} select * replace (round(n_roi, 6) as n_roi, round(eff_radial, 6) as eff_radial, round(eff_length, 6) as eff_length, round(eff_z, 6) as eff_z, round(eff_roi, 6) as eff_roi), round(eff_radial * eff_length * eff_z * eff_roi, 6) as eff_total from q")
def f15(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ef.event_selection(v.hits(spark, d), 30.0, 3, (-24.0, -1.0), (0.0, 24.0), (1500.0, 2500.0), 50.0))


@register("f16_cleanup", f"with {v.HITS} select count(*) as n, count(*) filter (energy > 0.1) as n_energy, count(*) filter (energy > 0.1 and abs(x) < 20) as n_x, count(*) filter (energy > 0.1 and abs(x) < 20 and label <> 'N') as n_label from hits")
def f16(spark: SparkSession, d: str) -> DataFrame:
    return ef.cleanup_counts(v.hits(spark, d), {"energy": F.col("energy") > 0.1, "x": F.abs("x") < 20, "label": F.col("label") != "N"})


# ---- several samples


@register(
    "j1_match_events",
    "with a as (select o_custkey as event_id, max(o_orderkey) as a from orders where o_orderkey % 2 = 0 group by 1), b as (select o_custkey as event_id, max(o_orderkey) as b from orders where o_orderkey % 3 = 0 group by 1), c as (select o_custkey as event_id, max(o_orderkey) as c from orders where o_orderkey % 5 = 0 group by 1) "
    "select coalesce(a.event_id, b.event_id, c.event_id) as event_id, coalesce(a, -1) as a, coalesce(b, -1) as b, coalesce(c, -1) as c from a full join b on a.event_id = b.event_id full join c on c.event_id = coalesce(a.event_id, b.event_id)",
)
def j1(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders").select(F.col("o_custkey").alias("event_id"), "o_orderkey")
    return sa.match_events({n: o.where(F.col("o_orderkey") % m == 0) for n, m in (("a", 2), ("b", 3), ("c", 5))}, "o_orderkey")


@register(
    "j2_efficiency_chain",
    f"with {v.SAMPLES} select isotope, zone, grouping_id(isotope, zone) as level, sum(generated)::bigint as generated, sum(saved)::bigint as saved, sum(single)::bigint as single, round(sum(saved) / sum(generated), 8) as eff_saved, round(sum(single) / sum(saved), 8) as eff_single, round(sum(single) / sum(generated), 8) as eff_total from samples group by rollup (isotope, zone)",
)
def j2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sa.efficiency_chain(v.samples(spark, d), ["isotope", "zone"], "generated", ["saved", "single"]), 8)


@register("j3_pivot_ratio", f"with {v.SAMPLES} select isotope, sum(saved) filter (zone = '1-URGENT')::bigint as \"1-URGENT\", sum(saved) filter (zone = '5-LOW')::bigint as \"5-LOW\", round(sum(saved) filter (zone = '1-URGENT') / sum(saved) filter (zone = '5-LOW'), 8) as ratio from samples group by 1")
def j3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sa.pivot_ratio(v.samples(spark, d), ["isotope"], "zone", ["1-URGENT", "5-LOW"], F.sum("saved")), 8)


@register("j4_weighted_mean", f"with {v.SAMPLES} select zone, round(sum(single / saved * saved) / sum(saved), 8) as mean, sum(saved)::bigint as weight from samples group by zone")
def j4(spark: SparkSession, d: str) -> DataFrame:
    s = v.samples(spark, d).withColumn("eff", F.col("single") / F.col("saved"))
    return rounded(sa.weighted_mean(s, "eff", "saved", ["zone"]), 8)


@register("j6_comparison", f"with {v.SAMPLES} select isotope, zone, generated, round(saved / generated, 4) as eff from samples")
def j6(spark: SparkSession, d: str) -> DataFrame:
    return sa.comparison(v.samples(spark, d).withColumn("eff", F.col("saved") / F.col("generated")), ["isotope", "zone", "generated", "eff"])


@register("j7_signal_background", f"with {v.SAMPLES}, s as (select isotope, (sum(saved) / sum(generated))::double as value from samples group by 1) select isotope, round(value, 8) as value, round((select value from s where isotope = 'F') / value, 8) as ratio, round(1 / value, 6) as rejection from s where isotope <> 'F'")
def j7(spark: SparkSession, d: str) -> DataFrame:
    s = v.samples(spark, d).groupBy("isotope").agg((F.sum("saved") / F.sum("generated")).alias("value"))
    return rounded(sa.signal_background(s, "isotope", "value", "F"), 8, rejection=6)


NAMES = {"1-URGENT": "barrel", "2-HIGH": "barrel", "3-MEDIUM": "endcap"}


@register("j8_activities", f"with {v.SAMPLES} select case when zone in ('1-URGENT', '2-HIGH') then 'barrel' when zone = '3-MEDIUM' then 'endcap' else zone end as name, sum(saved)::bigint as activity from samples group by 1")
def j8(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame(list(NAMES.items()), "zone string, name string")
    return sa.activities(v.samples(spark, d), "zone", "saved", names)


@register(
    "j9_yearly",
    f"with {v.SAMPLES}, a as (select zone as name, sum(single) / 1e6 as activity from samples group by 1), e as (select zone as name, sum(saved) / sum(generated) as efficiency from samples where isotope = 'O' and zone <> '5-LOW' group by 1), "
    "y as (select name, activity * 31557600 as produced, activity * 31557600 * coalesce(efficiency, 0) as selected from a left join e using (name)) select name, round(produced, 4) as produced, round(selected, 4) as selected from y union all select 'TOTAL', round(sum(produced), 4), round(sum(selected), 4) from y",
)
def j9(spark: SparkSession, d: str) -> DataFrame:
    s = v.samples(spark, d)
    a = s.groupBy(F.col("zone").alias("name")).agg((F.sum("single") / 1e6).alias("activity"))
    e = s.where("isotope = 'O' and zone <> '5-LOW'").groupBy(F.col("zone").alias("name")).agg((F.sum("saved") / F.sum("generated")).alias("efficiency"))
    return rounded(sa.yearly(a, e), 4)


def _stats_sql(source: str) -> str:
    one = "select '{c}' as variable, {p} as part, count({c}) as n, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, round(min({c}), 6) as min, round(max({c}), 6) as max, round(quantile_cont({c}, 0.5), 6) as median from {s} group by 2"
    return " union all ".join(one.format(c=c, p=p, s=source) for c in ("energy", "x", "rho") for p in ("case when sel then 'selected' else 'rest' end", "'all'"))


@register("j10_selection_statistics", f"with {v.HITS}, s as (select energy, x, sqrt(x * x + y * y) as rho, energy > 0.5 as sel from hits) {_stats_sql('s')}")
def j10(spark: SparkSession, d: str) -> DataFrame:
    h = ev.cylindrical(v.hits(spark, d)).withColumn("sel", F.col("energy") > 0.5).select("sel", "energy", "x", "rho")
    return rounded(sa.selection_statistics(h, "sel", ["energy", "x", "rho"]))


@register("j11_scan", f"with {v.HITS}, s as (select z, 'energy' as variable, energy as value from hits union all select z, 'x', x from hits) select z, variable, count(*) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std from s group by 1, 2")
def j11(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sa.scan_statistics(v.hits(spark, d).select("z", "energy", "x"), "z", ["energy", "x"]))


@register("j13_analysis_summary", f"with {v.HITS} select particle_id, count(*) as n, round(avg(energy), 6) as mean_energy, round(stddev_samp(energy), 6) as std_energy, min(energy) as min_energy, max(energy) as max_energy from hits group by 1")
def j13(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sa.analysis_summary(v.hits(spark, d), ["energy"], "particle_id"))


# ---- the smallest whole answer: single-track events and their energy histogram


@register(
    "single_track_energies",
    f"with {track_sql(RADIUS)}, ok as (select event_id, sum(energy) as e from trk where n_tracks = 1 group by event_id), w as (select e from ok where event_id in (select event_id from hits group by event_id having sum(energy) * 1000 between 200.00001 and 4000.00001)), {_hist1d_sql('e', 'w', 0.0, 4.0, 40)} select {ROUND_BINS} from h",
)
@by_event
def single_track_energies(spark: SparkSession, d: str) -> DataFrame:
    kept = ev.filter_energy_window(v.hits(spark, d), 200.00001, 4000.00001)
    single = tr.single_tracks(linked_tracks(kept)[0])
    return rounded(hi.hist1d(single.groupBy("event_id").agg(F.sum("energy").alias("e")), "e", 0.0, 4.0, 40))
