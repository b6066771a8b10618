"""Registered queries on paths, blobs, profiles and whole chains, with the SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.operators import blobs as bl
from tracksmith.operators import efficiency as ef
from tracksmith.operators import ends as en
from tracksmith.operators import events as ev
from tracksmith.operators import hist as hi
from tracksmith.operators import paths as pa
from tracksmith.operators import profile as pr
from tracksmith.operators import relational as rel
from tracksmith.operators import searches as se
from tracksmith.operators import tracks as tr
from tracksmith.operators import voxels as vx
from tracksmith.plans import walk_sql as ws
from tracksmith.plans.queries import RADIUS, by_event, linked_tracks, register, rounded, track_sql, tracks, voxel_sql, voxels
from tracksmith.session import together, written
from tracksmith.sources import views as v

EVENT = ["event_id"]


def _dist(a: str, b: str) -> str:
    return f"sqrt(pow({a}x - {b}x, 2) + pow({a}y - {b}y, 2) + pow({a}z - {b}z, 2))"


# ---- truth

TRUTH_SIZE = 10.0
TRUTH = (
    f"ch as (select *, row_number() over w as o, case when floor(x / {TRUTH_SIZE}) is not distinct from floor(lag(x) over w / {TRUTH_SIZE}) and floor(y / {TRUTH_SIZE}) is not distinct from floor(lag(y) over w / {TRUTH_SIZE}) "
    f"and floor(z / {TRUTH_SIZE}) is not distinct from floor(lag(z) over w / {TRUTH_SIZE}) then 0 else 1 end as n from hits window w as (partition by event_id, particle_id order by time, hit_id)), "
    "isl as (select *, sum(n) over (partition by event_id, particle_id order by o rows unbounded preceding)::bigint as island from ch), "
    "tv as (select event_id, particle_id, island, case when sum(energy) <> 0 then sum(x * energy) / sum(energy) else avg(x) end as x, case when sum(energy) <> 0 then sum(y * energy) / sum(energy) else avg(y) end as y, "
    "case when sum(energy) <> 0 then sum(z * energy) / sum(energy) else avg(z) end as z, sum(energy) as energy from isl group by 1, 2, 3)"
)
TPATH = (
    f"{TRUTH}, st as (select *, row_number() over (partition by event_id order by particle_id, case when particle_id = 1 then -island else island end) as step from tv), "
    f"dd as (select *, coalesce(sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2) + pow(z - lag(z) over w, 2)), 0) as d from st window w as (partition by event_id order by step)), "
    "tp as (select event_id, step, x, y, z, energy, sum(d) over (partition by event_id order by step rows unbounded preceding) as s, particle_id as primary_electron from dd)"
)


def truth(spark: SparkSession, d: str) -> DataFrame:
    return pa.truth_path(v.hits(spark, d), TRUTH_SIZE)


@register("t17_truth_voxels", f"with {v.HITS}, {TRUTH} select event_id, particle_id, island, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z, round(energy, 9) as energy from tv")
def t17(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pa.truth_voxels(v.hits(spark, d), TRUTH_SIZE), 6, energy=9)


@register("t17_truth_path", f"with {v.HITS}, {TPATH} select event_id, step, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z, round(energy, 9) as energy, round(s, 6) as s, primary_electron from tp")
def t17b(spark: SparkSession, d: str) -> DataFrame:
    return rounded(truth(spark, d), 6, energy=9)


@register("t2_path_length", f"with {v.HITS}, {TPATH} select event_id, round(max(s), 6) as length, count(*) as n_points from tp group by 1")
def t2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pa.path_length(truth(spark, d), EVENT))


TENDS = (
    "te as (select event_id, bool_or(particle_id = 1) and bool_or(particle_id = 2) as two, "
    + ", ".join(
        f"case when bool_or(particle_id = 1) and bool_or(particle_id = 2) then arg_max({c}, (time, hit_id)) filter (particle_id = {i}) else {f}({c}, (time, hit_id)) end as {c}{i}" for i, f in ((1, "arg_min"), (2, "arg_max")) for c in "xyz"
    )
    + " from hits group by event_id)"
)


@register("t18_truth_ends", f"with {v.HITS}, {TENDS} select event_id, x1, y1, z1, x2, y2, z2 from te")
def t18(spark: SparkSession, d: str) -> DataFrame:
    return pa.truth_ends(v.hits(spark, d))


@register(
    "t19_match_ends",
    f"with {v.HITS}, {TENDS}, r as (select event_id, arg_min(x, hit_id) as xa, arg_min(y, hit_id) as ya, arg_min(z, hit_id) as za, arg_max(x, hit_id) as xb, arg_max(y, hit_id) as yb, arg_max(z, hit_id) as zb from hits group by 1), "
    "q as (select event_id, sqrt(pow(xa - x1, 2) + pow(ya - y1, 2) + pow(za - z1, 2)) as a1, sqrt(pow(xb - x2, 2) + pow(yb - y2, 2) + pow(zb - z2, 2)) as b2, sqrt(pow(xa - x2, 2) + pow(ya - y2, 2) + pow(za - z2, 2)) as a2, sqrt(pow(xb - x1, 2) + pow(yb - y1, 2) + pow(zb - z1, 2)) as b1 from r join te using (event_id)) "
    "select event_id, round(case when a1 + b2 <= a2 + b1 then a1 else a2 end, 6) as d1, round(case when a1 + b2 <= a2 + b1 then b2 else b1 end, 6) as d2, round(least(a1 + b2, a2 + b1), 6) as total, case when a1 + b2 <= a2 + b1 then 'direct' else 'crossed' end as pairing from q",
)
def t19(spark: SparkSession, d: str) -> DataFrame:
    h = v.hits(spark, d)
    pick = lambda f, s: [f(F.struct("hit_id", c))[c].alias(f"{c}{s}") for c in "xyz"]
    reco = h.groupBy("event_id").agg(*pick(F.min, "a"), *pick(F.max, "b"))
    return rounded(pa.match_ends(reco, pa.truth_ends(h)))


@register(
    "t5_curvature",
    f"with {track_sql(RADIUS)}, e as (select event_id, src as v, dst as w from links union all select event_id, dst, src from links), "
    "s as (select e.event_id, v, w, b.x - a.x as dx, b.y - a.y as dy, b.z - a.z as dz from e join vox a on a.event_id = e.event_id and a.voxel_id = v join vox b on b.event_id = e.event_id and b.voxel_id = w), "
    "c as (select p.event_id, p.v as voxel_id, avg(1 - abs(least(1, greatest(-1, (p.dx * q.dx + p.dy * q.dy + p.dz * q.dz) / (sqrt(p.dx * p.dx + p.dy * p.dy + p.dz * p.dz) * sqrt(q.dx * q.dx + q.dy * q.dy + q.dz * q.dz)))))) as c from s p join s q on p.event_id = q.event_id and p.v = q.v and p.w < q.w group by 1, 2) "
    "select event_id, voxel_id, round(coalesce(c, 0), 6) as curvature from vox left join c using (event_id, voxel_id)",
)
def t5(spark: SparkSession, d: str) -> DataFrame:
    vox = voxels(spark, d)
    return rounded(pa.vertex_curvature(vox, tr.radius_links(vox, RADIUS)))


@register(
    "t15_central_path",
    f"with {v.HITS}, {voxel_sql(5.0)}, {TPATH}, c as (select tp.event_id, step, sum(vox.x * vox.energy) / sum(vox.energy) as x, sum(vox.y * vox.energy) / sum(vox.energy) as y, sum(vox.z * vox.energy) / sum(vox.energy) as z, sum(vox.energy) as energy_sum from tp join vox on tp.event_id = vox.event_id and {_dist('tp.', 'vox.')} <= 15 group by 1, 2), "
    "d as (select *, coalesce(sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2) + pow(z - lag(z) over w, 2)), 0) as d from c window w as (partition by event_id order by step)) "
    "select event_id, step, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z, round(energy_sum, 9) as energy_sum, round(sum(d) over (partition by event_id order by step rows unbounded preceding), 6) as s from d",
)
def t15(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pa.central_path(truth(spark, d), voxels(spark, d), 15.0, EVENT), 6, energy_sum=9)


PROJECTED = f"pj as (select vox.event_id, vox.voxel_id, any_value(vox.energy) as energy, arg_min(tp.step, (round({_dist('vox.', 'tp.')}, 9), tp.step)) as step, arg_min(tp.s, (round({_dist('vox.', 'tp.')}, 9), tp.step)) as s, min({_dist('vox.', 'tp.')}) as dist from vox join tp using (event_id) group by 1, 2)"


@register("t16_project", f"with {v.HITS}, {voxel_sql(5.0)}, {TPATH}, {PROJECTED} select event_id, voxel_id, round(dist, 6) as dist from pj")
def t16(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pa.project_to_path(voxels(spark, d), truth(spark, d), EVENT).select("event_id", "voxel_id", "dist"))


@register("b10_skeleton_coverage", f"with {v.HITS}, {voxel_sql(5.0)}, {TPATH}, {PROJECTED} select event_id, round(sum(case when dist <= 4 then energy else 0 end) / sum(energy), 6) as coverage, round(max(dist), 6) as max_dist from pj group by 1")
def b10(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bl.skeleton_coverage(pa.project_to_path(voxels(spark, d), truth(spark, d), EVENT), 4.0, EVENT))


@register(
    "b22_truth_spheres",
    f"with {v.HITS}, {TENDS}, s as (select h.event_id, coalesce(sum(energy) filter (sqrt(pow(x - x1, 2) + pow(y - y1, 2) + pow(z - z1, 2)) < 12), 0) as a, coalesce(sum(energy) filter (sqrt(pow(x - x2, 2) + pow(y - y2, 2) + pow(z - z2, 2)) < 12), 0) as b from hits h join te using (event_id) group by 1) "
    "select event_id, round(a, 9) as start_energy, round(b, 9) as end_energy, round(case when a > 0 then b / a end, 6) as ratio from s",
)
def b22(spark: SparkSession, d: str) -> DataFrame:
    h = v.hits(spark, d)
    return rounded(bl.truth_sphere_energies(h, pa.truth_ends(h), 12.0), 9, ratio=6)


# ---- profile along truth paths

GRID, BAND = 64, 10.0
KDE = (
    f"tops as (select event_id, max(s) as top, sum(energy) as total from tp group by 1), kd as (select t.event_id, i, any_value(i * top / {GRID - 1}) as s, sum(energy * exp(-0.5 * pow((i * top / {GRID - 1} - tp.s) / {BAND}, 2))) / (any_value(total) * {BAND * math.sqrt(2 * math.pi)!r}) as f "
    f"from tp join tops t using (event_id), range({GRID}) g(i) group by 1, 2)"
)


def kde(spark: SparkSession, d: str) -> DataFrame:
    return pr.energy_kde(truth(spark, d), BAND, GRID, EVENT)


@register("k1_energy_kde", f"with {v.HITS}, {TPATH}, {KDE} select event_id, i, round(s, 6) as s, round(f, 8) as f from kd")
def k1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(kde(spark, d), 8, s=6)


#: The curve rounded as k1 gives it: comparisons of its points don't hang on the order of additions.
CURVE = f"{v.HITS}, {TPATH}, {KDE}, kd8 as (select event_id, i, round(s, 6) as s, round(f, 8) as f from kd)"


def curve(spark: SparkSession, d: str) -> DataFrame:
    return pr.rounded_curves(pr.density(truth(spark, d), BAND, GRID, EVENT), 6, 8, EVENT)


@register(
    "k3_maxima",
    f"with {CURVE}, w as (select *, max(f) over e as hi, min(f) over e as lo, lag(f) over o as p, lead(f) over o as q, min(f) over (o rows between unbounded preceding and current row) as l, min(f) over (o rows between current row and unbounded following) as r, "
    f"case when i < 3 then 'left' when i >= {GRID - 3} then 'right' else 'inside' end as side from kd8 window e as (partition by event_id), o as (partition by event_id order by i)), "
    "x as (select *, row_number() over (partition by event_id, side order by f desc, i) as nth from w), "
    "m as (select *, case when side = 'inside' then f - greatest(l, r) else f - lo end as prominence from x where (side = 'inside' and f > p and f > q) or (side <> 'inside' and nth = 1 and f > 0.5 * hi)) "
    "select event_id, i, s, f, round(prominence, 8) as prominence, row_number() over (partition by event_id order by f desc, i) as rank from m where prominence > 0.1 * (hi - lo)",
)
def k3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pr.maxima(curve(spark, d), keys=EVENT), 8, s=6)


def peaks_sql(curve_: str, keys: str) -> str:
    """CTE pk: the peaks of a curve (keys, i, s, f) with a 0 before and behind it, as profile.peaks() has them at a share of 0.2."""
    return (
        f"fl as (select {keys}, i, f from {curve_} union all select {keys}, unnest([-1, max(i) + 1]), 0.0 from {curve_} group by {keys}), "
        f"tt as (select {keys}, i as k, f as h from (select *, lag(f) over w as p, lead(f) over w as q from fl window w as (partition by {keys} order by i)) where f > p and f > q), "
        f"wl as (select {keys}, k, h, max(i) filter (f > h and i < k) as a, min(i) filter (f > h and i > k) as b from tt join fl using ({keys}) group by {keys}, k, h), "
        f"ba as (select {keys}, k, h, h - greatest(min(f) filter (i < k and (a is null or i > a)), min(f) filter (i > k and (b is null or i < b))) as prominence from wl join fl using ({keys}) group by {keys}, k, h), "
        f"sn as (select {keys}, max(f) - min(f) as span, max(i) as last from {curve_} group by {keys}), "
        f"bb as (select ba.*, last, h - prominence / 2 as level from ba join sn using ({keys}) where prominence >= 0.2 * span), "
        f"cr as (select {keys}, k, h, prominence, last, level, max(i) filter (f < level and i < k) as i1, min(i) filter (f < level and i > k) as i2 from bb join fl using ({keys}) group by {keys}, k, h, prominence, last, level), "
        f"ps as (select cr.*, coalesce(i1 + (level - f1.f) / (g1.f - f1.f), -1.0) as l, coalesce(i2 - 1 + (g2.f - level) / (g2.f - f2.f), last + 1.0) as r from cr "
        + " ".join(f"left join fl {n} on {' and '.join(f'{n}.{k} = cr.{k}' for k in keys.split(', '))} and {n}.i = {at}" for n, at in (("f1", "i1"), ("g1", "i1 + 1"), ("f2", "i2"), ("g2", "i2 - 1")))
        + f"), pk as (select {', '.join(f'ps.{k}' for k in keys.split(', '))}, ps.k as i, c.s, c.f, prominence, r - l as width, least(greatest(l, 0), last) as \"left\", least(greatest(r, 0), last) as \"right\", row_number() over (partition by {', '.join(f'ps.{k}' for k in keys.split(', '))} order by prominence desc, ps.k) as rank from ps join {curve_} c on {' and '.join(f'c.{k} = ps.{k}' for k in keys.split(', '))} and c.i = ps.k)"
    )


def peak_columns_sql(keys: str) -> str:
    """CTE pc: the leftmost and the rightmost peak of each curve as columns."""
    return f"pc as (select {keys}, count(*) as n_peaks, " + ", ".join(f'{f}("{c}", (s, "left", "right", prominence)) as peak{i}_{c}' for i, f in ((1, "arg_min"), (2, "arg_max")) for c in ("left", "right", "prominence")) + f" from pk group by {keys})"


_PEAK_COLS = ", ".join(f"round(peak{i}_{c}, {8 if c == 'prominence' else 5}) as peak{i}_{c}" for i in (1, 2) for c in ("left", "right", "prominence"))
_PEAK_DIGITS = {"peak1_prominence": 8, "peak2_prominence": 8}


@register("k4_peaks", f"with {CURVE}, {peaks_sql('kd8', 'event_id')} select event_id, i, s, f, round(prominence, 8) as prominence, round(width, 5) as width, round(\"left\", 5) as \"left\", round(\"right\", 5) as \"right\", rank from pk")
def k4(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pr.peaks(curve(spark, d), 0.2, EVENT), 5, s=6, f=8, prominence=8)


@register("p11_peak_columns", f"with {CURVE}, {peaks_sql('kd8', 'event_id')}, {peak_columns_sql('event_id')} select event_id, n_peaks, {_PEAK_COLS} from pc")
def p11(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rel.peak_columns(pr.peaks(curve(spark, d), 0.2, EVENT).withColumn("at", F.col("s")), EVENT), 5, **_PEAK_DIGITS)


HPATH = "hp as (select event_id, greatest(1, ceil(max(s) over (partition by event_id) / 8))::int as n_bins, s, energy from tp), hb as (select event_id, n_bins, least(floor(s / 8)::int, n_bins - 1) as bin, sum(energy) as energy from hp group by 1, 2, 3)"


@register("k5_path_histogram", f"with {v.HITS}, {TPATH}, {HPATH} select event_id, n_bins, bin, round(energy, 9) as energy from hb")
def k5(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pr.path_histogram(truth(spark, d), 8.0, EVENT), 9)


def _end_sql(s: str) -> str:
    ok = "bin < 2" if s == "start" else "bin >= n_bins - 2"
    return (
        f"coalesce(sum(energy) filter ({ok}), 0) as total_{s}, coalesce(max(energy) filter ({ok}), 0) as max_{s}, count(*) filter ({ok} and energy > 0.1 * m_{s}) as significant_{s}, "
        f"coalesce(list_sort(list(energy) filter ({ok}), 'desc')[2], 0) as next_{s}, coalesce(sum(energy * ln(energy)) filter ({ok} and energy > 0), 0) as x_{s}"
    )


@register(
    "k5_end_concentration",
    f"with {v.HITS}, {TPATH}, {HPATH}, hm as (select *, max(energy) filter (bin < 2) over (partition by event_id) as m_start, max(energy) filter (bin >= n_bins - 2) over (partition by event_id) as m_end from hb), "
    f"g as (select event_id, any_value(n_bins) as n_bins, {_end_sql('start')}, {_end_sql('end')} from hm group by 1) "
    "select event_id, n_bins, round(total_start, 9) as total_start, round(total_end, 9) as total_end, round(max_start / total_start, 6) as concentration_start, case when total_end > 0 then round(max_end / total_end, 6) else 0 end as concentration_end, significant_start, significant_end, "
    "round(next_start, 9) as next_start, round(next_end, 9) as next_end, round(case when total_start > 0 then ln(total_start) - x_start / total_start else 0 end, 6) + 0.0::double as entropy_start, round(case when total_end > 0 then ln(total_end) - x_end / total_end else 0 end, 6) + 0.0::double as entropy_end from g",
)
def k5b(spark: SparkSession, d: str) -> DataFrame:
    g = pr.end_concentration(pr.path_histogram(truth(spark, d), 8.0, EVENT), 16.0, 8.0, EVENT)
    cols = ["n_bins", "total_start", "total_end", "concentration_start", "concentration_end", "significant_start", "significant_end", "next_start", "next_end", "entropy_start", "entropy_end"]
    out = rounded(g.select("event_id", *cols), 6, total_start=9, total_end=9, next_start=9, next_end=9)
    return out.withColumn("entropy_start", F.col("entropy_start") + 0.0).withColumn("entropy_end", F.col("entropy_end") + 0.0)  # no negative zero


ENDPEAKS = (
    "c as (select *, max(s) over (partition by event_id) as top, lead(s) over o as s_n, lead(f) over o as f_n, lag(s) over o as s_p, lag(f) over o as f_p from kd8 window o as (partition by event_id order by i)), "
    "t as (select event_id, 'start' as side, max(f) as h, arg_min(i, (-f, i)) as k from c where s < 15 group by 1 union all select event_id, 'end', max(f), arg_min(i, (-f, i)) from c where s > top - 15 group by 1), "
    "j as (select t.event_id, side, h, arg_max(c.s + (h / 2 - c.f) / (c.f_n - c.f) * (c.s_n - c.s), c.i) filter (c.f < h / 2 and c.i < k) as a, arg_min(c.s_p + (h / 2 - c.f_p) / (c.f - c.f_p) * (c.s - c.s_p), c.i) filter (c.f < h / 2 and c.i > k) as b, min(c.s) as s0, max(c.s) as s1 from t join c using (event_id) group by 1, 2, 3), "
    "ep as (select event_id, " + ", ".join(f"coalesce(max(h) filter (side = '{x}'), 0) as height_{x}, coalesce(max(coalesce(b, s1) - coalesce(a, s0)) filter (side = '{x}'), 0) as fwhm_{x}" for x in ("start", "end")) + " from j group by 1)"
)


@register("k6_end_peaks", f"with {CURVE}, {ENDPEAKS} select event_id, height_start, round(fwhm_start, 6) as fwhm_start, height_end, round(fwhm_end, 6) as fwhm_end from ep")
def k6(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pr.end_peaks(curve(spark, d), 15.0, EVENT), 8, fwhm_start=6, fwhm_end=6)


_ASYM = "round(case when {0}_start + {0}_end > 0 then (greatest({0}_start, {0}_end) - least({0}_start, {0}_end)) / ({0}_start + {0}_end) else 0 end, 5) as a_{0}"


@register("k7_asymmetries", f"with {CURVE}, {ENDPEAKS} select event_id, {_ASYM.format('height')}, {_ASYM.format('fwhm')} from ep")
def k7(spark: SparkSession, d: str) -> DataFrame:
    out = pr.end_asymmetries(pr.end_peaks(curve(spark, d), 15.0, EVENT), {"a_height": ("height_start", "height_end"), "a_fwhm": ("fwhm_start", "fwhm_end")})
    return rounded(out.select("event_id", "a_height", "a_fwhm"), 5)


@register(
    "k8_valley",
    f"with {CURVE}, {ENDPEAKS}, g as (select event_id, min(f) filter (s >= 15 and s <= top - 15) as m, arg_min(s, (f, s)) filter (s >= 15 and s <= top - 15) as at_, coalesce(stddev_samp(f) filter (s >= 0.25 * top and s <= 0.75 * top), 0) as flat, max(top) as top from c group by 1) "
    "select event_id, coalesce(m, 0) as depth, round(coalesce(at_, top / 2), 7) as depth_at, round(case when m is null then 1 when m > 0 then (height_start + height_end) / (2 * m) else 'inf'::double end, 4) as peak_to_valley, round(case when m is null then 0 else flat end, 7) as flatness from g join ep using (event_id)",
)
def k8(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pr.valley(curve(spark, d), 15.0, EVENT), 7, depth=8, peak_to_valley=4)


@register(
    "k9_end_moments",
    f"with {v.HITS}, {TPATH}, a as (select event_id, s, energy, max(s) over (partition by event_id) as top from tp), b as (select event_id, 'start' as side, s as d, energy from a where s < 30 union all select event_id, 'end', top - s, energy from a where s > top - 30), "
    "c as (select *, d - sum(d * energy) over w / sum(energy) over w as u from b window w as (partition by event_id, side)), "
    "m as (select event_id, side, count(*) as n, sum(energy) as e, sum(energy * u * u) / sum(energy) as m2, sum(energy * pow(u, 3)) / sum(energy) as m3, sum(energy * pow(u, 4)) / sum(energy) as m4 from c group by 1, 2), "
    "z as (select event_id, side, case when n >= 3 and e <> 0 and sqrt(m2) >= 1e-10 then m3 / pow(m2, 1.5) else 0 end as skew, case when n >= 3 and e <> 0 and sqrt(m2) >= 1e-10 then m4 / (m2 * m2) - 3 else 0 end as kurtosis from m) "
    "select event_id, " + ", ".join(f"round(coalesce(max({c}) filter (side = '{x}'), 0), 5) + 0.0::double as {c}_{x}" for x in ("start", "end") for c in ("skew", "kurtosis")) + " from z group by 1",
)
def k9(spark: SparkSession, d: str) -> DataFrame:
    out = rounded(pr.end_moments(truth(spark, d), 30.0, EVENT), 5)
    return out.select("event_id", *[(F.col(c) + 0.0).alias(c) for c in out.columns if c != "event_id"])  # no negative zero


@register(
    "k10_entropy",
    f"with {v.HITS}, {TPATH}, {HPATH}, h9 as (select event_id, n_bins, bin, round(energy, 9) as energy from hb), hm as (select *, max(energy) filter (bin < 2) over (partition by event_id) as m_start, max(energy) filter (bin >= n_bins - 2) over (partition by event_id) as m_end from h9), "
    f"g as (select event_id, any_value(n_bins) as n_bins, sum(energy) as total, max(energy) as most, sum(energy * ln(energy)) filter (energy > 0) as x_, {_end_sql('start')}, {_end_sql('end')} from hm group by 1), "
    "e as (select *, case when total > 0 and most < total then ln(total) - x_ / total else 0 end as entropy, case when total_start > 0 and max_start < total_start then ln(total_start) - x_start / total_start else 0 end as e_s, case when total_end > 0 and max_end < total_end then ln(total_end) - x_end / total_end else 0 end as e_e, "
    "case when total_start > 0 then round(max_start / total_start, 9) else 0 end as c1, case when total_end > 0 then round(max_end / total_end, 9) else 0 end as c2 from g), "
    "f as (select *, case when n_bins > 1 then entropy / ln(n_bins) else 0 end as sh, case when least(2, n_bins) > 1 then e_s / ln(least(2, n_bins)) else 0 end as s_s, case when least(2, n_bins) > 1 then e_e / ln(least(2, n_bins)) else 0 end as s_e from e) "
    "select event_id, round(entropy, 6) as entropy, round(sh, 6) as entropy_share, round(s_s, 6) as entropy_share_start, round(s_e, 6) as entropy_share_end, round(case when s_s + s_e > 0 then (s_e - s_s) / (s_s + s_e) else 0 end, 6) + 0.0::double as entropy_asymmetry, "
    "case when c1 > c2 and significant_start <= significant_end then 'start' when c2 > c1 and significant_end <= significant_start then 'end' when significant_start < significant_end then 'start' when significant_end < significant_start then 'end' else 'ambiguous' end as peak_end from f",
)
def k10(spark: SparkSession, d: str) -> DataFrame:
    g = pr.end_concentration(rounded(pr.path_histogram(truth(spark, d), 8.0, EVENT), 9), 16.0, 8.0, EVENT)
    out = rounded(g.select("event_id", "entropy", "entropy_share", "entropy_share_start", "entropy_share_end", "entropy_asymmetry", "peak_end"))
    return out.withColumn("entropy_asymmetry", F.col("entropy_asymmetry") + 0.0)  # no negative zero


# ---- reconstructed tracks


def _tracks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t, links = linked_tracks(v.hits(spark, d))
    return t.drop("track_energy"), links


def _walk_query(method: str):
    @by_event
    def run(spark: SparkSession, d: str) -> DataFrame:
        """The ends of every track with its way, a row per step (one row without a step where the rule finds no way)."""
        ends, ways = en.find_ends(*_tracks(spark, d), method)
        return rounded(ends.join(ways, tr.TRACK, "left"))

    return run


def _walk_sql(method: str) -> str:
    return f"with {ws.walks(method)} select wk.event_id, wk.track_id, wk.s as start, wk.e as \"end\", round(confidence, 6) as confidence, round(length, 6) as length, step, voxel_id, round(st.s, 6) as s from wk left join wk_st st on st.event_id = wk.event_id and st.track_id = wk.track_id"


for _n, _m in {
    "t4_ends_topology": "topology", "t6_ends_curvature": "curvature", "t7_ends_spatial": "spatial", "t8_ends_energy": "energy", "t9_ends_distance": "distance",
    "t10_ends_edge_energy": "edge_energy", "t11_ends_mst": "mst", "t12_ends_combined": "combined", "t13_walk_mst": "combined_mst",
}.items():
    register(_n, _walk_sql(_m))(_walk_query(_m))


def _walked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tracks, links, walks and their steps."""
    t, links = _tracks(spark, d)
    return t, links, *en.find_ends(t, links)


def _ended(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tracks, links and walks: no steps are made for queries that read none."""
    t, links = _tracks(spark, d)
    return t, links, en.chosen(en.Tracks(t, links)).drop("way")


def _firsts(t: DataFrame) -> DataFrame:
    """TRACK, start, end: the least and the greatest voxel of each track."""
    return t.groupBy(*tr.TRACK).agg(F.min("voxel_id").alias("start"), F.max("voxel_id").alias("end"))


_BETWEEN = "f as (select event_id, track_id, min(voxel_id) as s, max(voxel_id) as e from vd group by 1, 2), wy as (select f.event_id, f.track_id, path from f join {0} t on t.event_id = f.event_id and t.root = f.s and t.v = f.e)"
_ONE_WAY = ws.steps_of("wy") + " select event_id, track_id, step, voxel_id, round(s, 6) as s from wy_st"


@register("t1_shortest_path", f"with {ws.BASE}, {ws.BF}, {_BETWEEN.format('bf')}, {_ONE_WAY}")
@by_event
def t1(spark: SparkSession, d: str) -> DataFrame:
    """The way of fewest links from the least to the greatest voxel of each track."""
    t, links = _tracks(spark, d)
    return rounded(se.shortest_ways(t, links, _firsts(t)))


@register("t3_weighted_path", f"with {ws.BASE}, pl as (select *, gap / (0.5 * (eu + ev) + 1e-6) as w from ed), {ws.cost_trees('wt', 'pl')}, {_BETWEEN.format('wt')}, {_ONE_WAY}")
@by_event
def t3(spark: SparkSession, d: str) -> DataFrame:
    """The way of least cost from the least to the greatest voxel of each track."""
    t, links = _tracks(spark, d)
    return rounded(se.shortest_ways(t, links, _firsts(t), se.link_cost()))


WK = ws.walks("combined")


@register("t14_path_points", f"with {WK} select event_id, track_id, step, voxel_id, x::double as x, y::double as y, z::double as z, round(energy, 9) as energy, round(s, 6) as s from wk_st")
@by_event
def t14(spark: SparkSession, d: str) -> DataFrame:
    t, _, _, steps = _walked(spark, d)
    return rounded(pa.path_points(steps, t), 6, energy=9)


# SQL of what stands on walked ends
_C = ("x", "y", "z")
EP = "ep as (select wk.event_id, wk.track_id, wk.s as vs, wk.e as ve, confidence, length, " + ", ".join(f"{p}.{c} as {c}{p}" for p in "ab" for c in _C) + " from wk join vox a on a.event_id = wk.event_id and a.voxel_id = wk.s join vox b on b.event_id = wk.event_id and b.voxel_id = wk.e)"


def _far_sql(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"({c}{a} - {c}{b}) * ({c}{a} - {c}{b})" for c in _C) + ")"


MATCHED = (
    f"{EP}, {TENDS}, q20 as (select ep.*, {_far_sql('a', 'b')} as straight, {_far_sql('a', '1')} as a1, {_far_sql('b', '2')} as b2, {_far_sql('a', '2')} as a2, {_far_sql('b', '1')} as b1 from ep join te using (event_id) where track_id = 1), "
    "m20 as (select *, case when a1 + b2 <= a2 + b1 then a1 else a2 end as d1, case when a1 + b2 <= a2 + b1 then b2 else b1 end as d2, least(a1 + b2, a2 + b1) as total, case when a1 + b2 <= a2 + b1 then 'direct' else 'crossed' end as pairing from q20)"
)
CLASSES = (
    f"{MATCHED}, tp2 as (select event_id, 1 as i, x1 as x, y1 as y, z1 as z from te union all select event_id, 2, x2, y2, z2 from te), "
    f"nv as (select t.event_id, i, arg_min(v.voxel_id, (round({ws.gap('t.', 'v.')}, 9), v.voxel_id)) as voxel_id from tp2 t join vox v on v.event_id = t.event_id group by 1, 2), "
    "nd as (select nv.event_id, max(degree) filter (i = 1) as degree1, max(degree) filter (i = 2) as degree2, max(vd.track_id) filter (i = 1) as t1, max(vd.track_id) filter (i = 2) as t2 from nv join vd on vd.event_id = nv.event_id and vd.voxel_id = nv.voxel_id group by 1), "
    "ec as (select m.event_id, d1, d2, degree1, degree2, case when straight > 0 then length / straight end as tortuosity, case when greatest(d1, d2) <= 10 then 'correct' when t1 <> t2 then 'disconnected' when degree1 <> 1 and degree2 <> 1 then 'both_not_end' when degree1 <> 1 then 'first_not_end' when degree2 <> 1 then 'second_not_end' when me.n_tips > 2 then 'spurious_ends' else 'wrong_end' end as class "
    "from m20 m join nd using (event_id) join me on me.event_id = m.event_id and me.track_id = 1)"
)


def _spheres_sql(radii: str, source: str = "ep") -> str:
    """CTE sph: per track and radius the energies and counts about both ends, as start_ and end_, and blob1_ and blob2_."""
    inside = lambda p: " + ".join(f"pow(v.{c} - ep.{c}{p}, 2)" for c in _C)
    sums = ", ".join(f"coalesce(sum(v.energy) filter (sqrt({inside(p)}) <= radius), 0) as {n}_energy, count(*) filter (sqrt({inside(p)}) <= radius) as {n}_count" for p, n in (("a", "start"), ("b", "end")))
    blob = ", ".join(f"case when {first} then start_{c} else end_{c} end as blob{k}_{c}" for k, first in ((1, "round(start_energy, 9) >= round(end_energy, 9)"), (2, "not (round(start_energy, 9) >= round(end_energy, 9))")) for c in ("energy", "count"))
    return f"{EP}, sp0 as (select ep.event_id, ep.track_id, radius, {sums} from {source} ep join vd v on v.event_id = ep.event_id and v.track_id = ep.track_id, (select unnest([{radii}]::double[]) as radius) group by 1, 2, 3), sph as (select *, {blob} from sp0)"


_BLOBS = f"{_spheres_sql('12.0')}, bl as (select s.event_id, s.track_id, blob1_energy * 1000 as eb1, blob2_energy * 1000 as eb2, case when blob1_energy + blob2_energy > 0 then abs(blob1_energy - blob2_energy) / (blob1_energy + blob2_energy) else 0 end as asym from sph s)"
_TABLE = (
    f"{_spheres_sql('12.0')}, bt as (select 'hits' as source, s.event_id as event, s.track_id, blob1_energy * 1000 as eblob1, blob2_energy * 1000 as eblob2, blob1_count as nblob1, blob2_count as nblob2, confidence, etrk, length as trkl from sph s join ep using (event_id, track_id) join (select event_id, track_id, sum(energy) * 1000 as etrk from vd group by 1, 2) using (event_id, track_id))"
)
_TABLE_COLS = "source, event, track_id, round(eblob1, 6) as eblob1, round(eblob2, 6) as eblob2, nblob1, nblob2, round(confidence, 6) as confidence, round(etrk, 6) as etrk, round(trkl, 6) as trkl"
_D20 = "round(d1, 6) as d1, round(d2, 6) as d2"
_REASON = "greatest(d1, d2) <= 10 as success, case when greatest(d1, d2) <= 10 then 'correct' when least(d1, d2) <= 10 then 'one_end_wrong' else 'both_ends_wrong' end as reason"
_STARTS = ", ".join(f"xs.{c}{p} as {n}_c{c}" for p, n in (("a", "start"), ("b", "end")) for c in _C)
_BLOB_AT = ", ".join(f"case when round(start_energy, 9) >= round(end_energy, 9) {'then' if k == 1 else 'then'} xs.{c}{'a' if k == 1 else 'b'} else xs.{c}{'b' if k == 1 else 'a'} end as blob{k}_c{c}" for k in (1, 2) for c in _C)
#: Path points of the first and last two steps (one of a path of one).
_FIRSTS = "pn as (select *, row_number() over w as i, count(*) over (partition by event_id, track_id) as n from wk_st window w as (partition by event_id, track_id order by step)), fe as (select event_id, track_id, sum(energy) filter (i <= least(2, greatest(1, n // 2))) as a, sum(energy) filter (i > n - least(2, greatest(1, n // 2))) as b, max(least(2, greatest(1, n // 2))) as count from pn group by 1, 2)"
QUALITY = (
    f"{EP}, qb as (select event_id, track_id, avg(energy) as mean_energy, " + ", ".join(f"min({c}) as lo{c}, max({c}) as hi{c}" for c in _C) + " from vd group by 1, 2), "
    f"qe as (select ep.*, qb.*, a.energy as es, b.energy as ee, {_far_sql('a', 'b')} as straight, sqrt(" + " + ".join(f"(hi{c} - lo{c}) * (hi{c} - lo{c})" for c in _C) + ") as extent from ep join qb using (event_id, track_id) join vox a on a.event_id = ep.event_id and a.voxel_id = vs join vox b on b.event_id = ep.event_id and b.voxel_id = ve), "
    "qq as (select *, case when length > 0 then straight / length else 0 end as eff, length / greatest(extent, 1.0) as cover from qe)"
)
_ON = lambda p: "(" + " or ".join(f"{c}{p} = lo{c} or {c}{p} = hi{c}" for c in _C) + ")"


@register("t20_ends_against_truth", f"with {WK}, {MATCHED} select event_id, {_D20}, round(total, 6) as total, pairing, round(confidence, 6) as confidence, round(length, 6) as length, {_REASON} from m20")
@by_event
def t20(spark: SparkSession, d: str) -> DataFrame:
    t, _, w = _ended(spark, d)
    return rounded(pa.ends_against_truth(w, t, v.hits(spark, d)))


@register("t20_comparison_summary", f"with {WK}, {MATCHED}, g as (select *, greatest(d1, d2) <= 10 as ok from m20) select count(*) as n, count(*) filter (not ok) as n_outliers, round(avg(d1), 6) as mean_d1, round(stddev_samp(d1), 6) as std_d1, round(avg(d2), 6) as mean_d2, round(stddev_samp(d2), 6) as std_d2, round(avg(confidence) filter (ok), 6) as confidence_good, round(avg(confidence) filter (not ok), 6) as confidence_outlier, round(avg(length) filter (ok), 6) as length_good, round(avg(length) filter (not ok), 6) as length_outlier from g")
@by_event
def t20b(spark: SparkSession, d: str) -> DataFrame:
    t, _, w = _ended(spark, d)
    return rounded(pa.comparison_summary(pa.ends_against_truth(w, t, v.hits(spark, d))))


@register("t21_error_classes", f"with {WK}, {CLASSES} select class, count(*) as n, round(avg(d1), 6) as mean_d1, round(avg(d2), 6) as mean_d2 from ec group by 1")
@by_event
def t21(spark: SparkSession, d: str) -> DataFrame:
    t, links, w = _ended(spark, d)
    return pa.error_classes(w, t, links, v.hits(spark, d)).groupBy("class").agg(F.count("*").alias("n"), F.round(F.avg("d1"), 6).alias("mean_d1"), F.round(F.avg("d2"), 6).alias("mean_d2"))


@register("t22_worst_events", f"with {WK}, {CLASSES} select event_id, {_D20}, degree1, degree2, round(tortuosity, 6) as tortuosity, class from ec order by greatest(ec.d1, ec.d2) desc, event_id limit 10")
@by_event
def t22(spark: SparkSession, d: str) -> DataFrame:
    t, links, w = _ended(spark, d)
    return rounded(pa.worst_events(pa.error_classes(w, t, links, v.hits(spark, d))))


@register("t23_end_quality", f"with {WK}, {QUALITY} select qq.event_id, qq.track_id, round(eff, 6) as efficiency, round(cover, 6) as coverage, eff < 0.3 or cover < 0.5 as poor, list_filter([case when not (greatest(es, ee) > 1.5 * mean_energy) then 'no_high_energy_end' end, case when confidence < 0.7 then 'low_confidence' end, case when eff < 0.3 then 'low_efficiency' end, case when cover < 0.5 then 'low_coverage' end], lambda i: i is not null) as issues, {_ON('a')} as start_on_box, {_ON('b')} as end_on_box from qq")
@by_event
def t23(spark: SparkSession, d: str) -> DataFrame:
    t, _, w = _ended(spark, d)
    return rounded(pa.end_quality(w, t))


@register("b1_sphere_energies", f"with {WK}, {_spheres_sql('12.0')} select s.event_id, s.track_id, round(start_energy, 9) as start_energy, start_count, {_STARTS}, round(end_energy, 9) as end_energy, end_count, round(blob1_energy, 9) as blob1_energy, blob1_count, round(blob2_energy, 9) as blob2_energy, blob2_count, {_BLOB_AT} from sph s join ep xs on xs.event_id = s.event_id and xs.track_id = s.track_id")
@by_event
def b1(spark: SparkSession, d: str) -> DataFrame:
    t, _, w = _ended(spark, d)
    return rounded(bl.sphere_energies(w, t, 12.0), 9)


@register("b2_blob_energies", f"with {WK}, {_BLOBS} select event_id, track_id, round(eb1, 6) as \"Eb1\", round(eb2, 6) as \"Eb2\", round(asym, 6) as asymmetry from bl")
@by_event
def b2(spark: SparkSession, d: str) -> DataFrame:
    t, _, _, steps = _walked(spark, d)
    return rounded(bl.blob_energies(pa.path_points(steps, t), t, 12.0))


@register("b3_end_voxels", f"with {WK}, {_FIRSTS} select event_id, track_id, round(a, 9) as start_energy, round(b, 9) as end_energy, count, round(case when a >= b then a else b end, 9) as blob1_energy, round(case when a >= b then b else a end, 9) as blob2_energy from fe")
@by_event
def b3(spark: SparkSession, d: str) -> DataFrame:
    t, _, _, steps = _walked(spark, d)
    return rounded(bl.end_voxel_energies(pa.path_points(steps, t), 2), 9)


_RADII4 = ", ".join(str(3 + i) for i in range(8))
_VARIABLE = (
    f"{_spheres_sql(_RADII4)}, vs as (select event_id, track_id, radius, 'start' as side, start_energy as energy, start_count as count from sph union all select event_id, track_id, radius, 'end', end_energy, end_count from sph), "
    "vl as (select *, lag(energy) over (partition by event_id, track_id, side order by radius) as before from vs), "
    "vt as (select event_id, track_id, side, coalesce(min(radius) filter (energy > 0 and before > 0 and abs(energy - before) / energy < 0.05), 10) as stop from vl group by 1, 2, 3), "
    "vq as (select event_id, track_id, side, vl.energy, vl.radius, vl.count from vl join vt using (event_id, track_id, side) where radius = stop), "
    "vw as (select event_id, track_id, " + ", ".join(f"max({c}) filter (side = '{x}') as {x}_{c}" for x in ("start", "end") for c in ("energy", "radius", "count")) + " from vq group by 1, 2)"
)
_BLOB4 = ", ".join(f"case when round(start_energy, 9) >= round(end_energy, 9) then {a}_{c} else {b}_{c} end as blob{k}_{c}" for k, a, b in ((1, "start", "end"), (2, "end", "start")) for c in ("energy", "radius", "count"))


@register("b4_variable_spheres", f"with {WK}, {_VARIABLE}, v9 as (select * replace (round(start_energy, 9) as start_energy, round(end_energy, 9) as end_energy) from vw) select *, {_BLOB4} from v9")
@by_event
def b4(spark: SparkSession, d: str) -> DataFrame:
    t, _, w = _ended(spark, d)
    return rounded(bl.variable_spheres(w, t).drop("start_history", "end_history", "blob1_history", "blob2_history"), 9)


RADII = [5.0, 10.0, 15.0, 20.0]


@register("b5_energies_by_radius", f"with {WK}, {_spheres_sql('5, 10, 15, 20')} select event_id, track_id, radius, round(start_energy, 9) as start_energy, start_count, round(end_energy, 9) as end_energy, end_count, round(blob1_energy, 9) as blob1_energy, round(blob2_energy, 9) as blob2_energy from sph")
@by_event
def b5(spark: SparkSession, d: str) -> DataFrame:
    t, _, w = _ended(spark, d)
    return rounded(bl.energies_by_radius(w, t, RADII), 9)


@register("b6_asymmetry_by_radius", f"with {WK}, {_spheres_sql('5, 10, 15, 20')}, a as (select radius, case when blob1_energy + blob2_energy > 0 then abs(blob1_energy - blob2_energy) / (blob1_energy + blob2_energy) else 0 end as x from sph) select radius, count(*) as n, round(avg(x), 6) as mean_asymmetry, round(stddev_samp(x), 6) as std_asymmetry from a group by 1")
@by_event
def b6(spark: SparkSession, d: str) -> DataFrame:
    t, _, w = _ended(spark, d)
    return rounded(bl.asymmetry_by(bl.energies_by_radius(w, t, RADII), "radius"))


_CENTRAL = (
    f"ce as (select p.event_id, p.track_id, step, sum(v.energy) as energy_sum from wk_st p join vd v on v.event_id = p.event_id and v.track_id = p.track_id and {ws.gap('p.', 'v.')} <= 12 group by 1, 2, 3), "
    "cn as (select *, row_number() over (partition by event_id, track_id order by step) as i, row_number() over (partition by event_id, track_id order by step desc) as j from ce)"
)


@register("b7_end_point_energy", f"with {WK}, {_CENTRAL} select event_id, track_id, round(sum(energy_sum) filter (i <= 2), 9) as start_energy, round(sum(energy_sum) filter (j <= 2), 9) as end_energy from cn group by 1, 2")
@by_event
def b7(spark: SparkSession, d: str) -> DataFrame:
    t, _, _, steps = _walked(spark, d)
    return rounded(bl.end_point_energy(pa.central_path(pa.path_points(steps, t), t, 12.0), 2), 9)


@register("b8_blob_table", f"with {WK}, {_TABLE} select {_TABLE_COLS}, eblob2 >= 400 as \"select\" from bt")
@by_event
def b8(spark: SparkSession, d: str) -> DataFrame:
    t, _, w = _ended(spark, d)
    return rounded(bl.blob_table(w, t, 12.0, "hits", 400.0))


@register("b9_path_efficiency", f"with {WK}, {EP} select event_id, track_id, round(case when {_far_sql('a', 'b')} > 0 then length / {_far_sql('a', 'b')} end, 6) as efficiency from ep")
@by_event
def b9(spark: SparkSession, d: str) -> DataFrame:
    t, _, w = _ended(spark, d)
    return rounded(bl.path_efficiency(pa.end_points(w, t), w))


_TWO_WALKS = ", ".join([ws.BASE, *ws.NEEDS["combined"], ws.MST, f"wk as (select {ws.FIELDS} from combined)", f"w2 as (select {ws.FIELDS} from mst)"])
_AT = lambda n, w: f"{n} as (select w.event_id, w.track_id, " + ", ".join(f"{p}.{c} as {c}{k}" for p, k in (("a", "1" if n == "e2" else "a"), ("b", "2" if n == "e2" else "b")) for c in _C) + f" from {w} w join vox a on a.event_id = w.event_id and a.voxel_id = w.s join vox b on b.event_id = w.event_id and b.voxel_id = w.e)"


@register("b11_end_stability", f"with {_TWO_WALKS}, {_AT('e1', 'wk')}, {_AT('e2', 'w2')} select event_id, track_id, round(least(greatest({_far_sql('a', '1')}, {_far_sql('b', '2')}), greatest({_far_sql('a', '2')}, {_far_sql('b', '1')})), 6) as displacement from e1 join e2 using (event_id, track_id)")
@by_event
def b11(spark: SparkSession, d: str) -> DataFrame:
    t, links = _tracks(spark, d)
    own = en.Tracks(t, links)
    one, two = (pa.end_points(en.chosen(own, m), t) for m in ("combined", "mst"))
    return rounded(pa.end_stability(one, two))


@register("b18_clean_blobs", f"with {WK}, {_TABLE} select {_TABLE_COLS}, eblob2 >= 400 as \"select\" from bt where trkl >= 20 and etrk between 500 and 4000 and eblob2 <= 1000 and eblob1 <= 1500")
@by_event
def b18(spark: SparkSession, d: str) -> DataFrame:
    t, _, w = _ended(spark, d)
    return rounded(bl.clean_blobs(bl.blob_table(w, t, 12.0, "hits"), 20.0, (500.0, 4000.0)))


@register("b19_preselection", f"with {WK}, {_BLOBS} select count(*) as n, count(*) filter (eb2 >= 400) as n_selected from bl")
@by_event
def b19(spark: SparkSession, d: str) -> DataFrame:
    t, _, _, steps = _walked(spark, d)
    b = bl.blob_energies(pa.path_points(steps, t), t, 12.0)
    return b.agg(F.count("*").alias("n"), F.count_if(F.col("Eb2") >= 400).alias("n_selected"))


K2 = (
    f"pj as (select v.event_id, v.track_id, v.voxel_id, any_value(v.energy) as energy, arg_min(t.s, ({ws.gap('v.', 't.')}, t.step)) as s from vd v join wk_st t on t.event_id = v.event_id and t.track_id = v.track_id group by 1, 2, 3), "
    f"kt as (select event_id, track_id, max(s) as top, sum(energy) as total from pj group by 1, 2), kg as (select t.event_id, t.track_id, i, any_value(i * top / {GRID - 1}) as s, sum(energy * exp(-0.5 * pow((i * top / {GRID - 1} - pj.s) / {BAND}, 2))) / (any_value(total) * {BAND * math.sqrt(2 * math.pi)!r}) as f from pj join kt t using (event_id, track_id), range({GRID}) g(i) group by 1, 2, 3)"
)


@register("k2_reco_kde", f"with {WK}, {K2} select event_id, track_id, i::int as i, round(s, 8) as s, round(f, 8) as f from kg")
@by_event
def k2(spark: SparkSession, d: str) -> DataFrame:
    t, _, _, steps = _walked(spark, d)
    return pr.energy_kde(pa.project_to_path(t, pa.path_points(steps, t)), BAND, GRID, digits=8)


def _event_sql(w: str, m: str) -> str:
    """CTE w_r: of single-track events the matched ends, confidence, length and blob energies of the walks w, named by the method m."""
    at = ", ".join(f"{p}.{c} as {c}{p}" for p in "ab" for c in _C)
    inside = lambda p: " + ".join(f"pow(v.{c} - e.{c}{p}, 2)" for c in _C)
    return (
        f"{w}_e as (select w.event_id, w.track_id, confidence, length, {at} from {w} w join vox a on a.event_id = w.event_id and a.voxel_id = w.s join vox b on b.event_id = w.event_id and b.voxel_id = w.e where w.event_id in (select event_id from trk where n_tracks = 1)), "
        f"{w}_m as (select e.event_id, confidence, length, {_far_sql('a', '1')} as a1, {_far_sql('b', '2')} as b2, {_far_sql('a', '2')} as a2, {_far_sql('b', '1')} as b1 from {w}_e e join te using (event_id)), "
        f"{w}_s as (select e.event_id, sum(v.energy) filter (sqrt({inside('a')}) <= 12) * 1000 as sa, sum(v.energy) filter (sqrt({inside('b')}) <= 12) * 1000 as sb from {w}_e e join vd v on v.event_id = e.event_id and v.track_id = e.track_id group by 1), "
        f"{w}_r as (select event_id, round(case when a1 + b2 <= a2 + b1 then a1 else a2 end, 6) as d1_{m}, round(case when a1 + b2 <= a2 + b1 then b2 else b1 end, 6) as d2_{m}, round(confidence, 6) as confidence_{m}, round(length, 6) as length_{m}, "
        f"round(greatest(sa, sb), 6) as \"Eb1_{m}\", round(least(sa, sb), 6) as \"Eb2_{m}\", round(case when sa + sb > 0 then abs(sa - sb) / (sa + sb) else 0 end, 6) as asymmetry_{m} from {w}_m join {w}_s using (event_id))"
    )


_BOTH_WALKS = ", ".join([ws.BASE, *ws.NEEDS["combined"], ws.MST, ws._combined("combined_mst", True), f"wk as (select {ws.FIELDS} from combined)", f"w2 as (select {ws.FIELDS} from combined_mst)"])


@register("b20_event_analysis", f"with {_BOTH_WALKS}, {TENDS}, {_event_sql('wk', 'combined')}, {_event_sql('w2', 'combined_mst')} select * from wk_r join w2_r using (event_id)")
@by_event
def b20(spark: SparkSession, d: str) -> DataFrame:
    """Truth and reco ends of single-track events by two methods: a wide row per event."""
    h = v.hits(spark, d)
    t, links = _tracks(spark, d)
    t = tr.single_tracks(t)
    out = None
    for m in ("combined", "combined_mst"):
        w, steps = en.find_ends(t, links, m)
        matched = pa.ends_against_truth(w, t, h).select("event_id", *[F.col(c).alias(f"{c}_{m}") for c in ("d1", "d2", "confidence", "length")])
        b = bl.blob_energies(pa.path_points(steps, t), t, 12.0).select("event_id", *[F.col(c).alias(f"{c}_{m}") for c in ("Eb1", "Eb2", "asymmetry")])
        part = matched.join(b, "event_id")
        out = part if out is None else out.join(part, "event_id")
    return rounded(out)


def _reco_curve(t: DataFrame, steps: DataFrame) -> DataFrame:
    """The density along walked paths of two steps or more, rounded as k2 gives it. Along one step it is constant, without a peak."""
    far = steps.where("step = 2").select(*tr.TRACK)
    t, steps = t.join(far, tr.TRACK, "left_semi"), steps.join(far, tr.TRACK, "left_semi")
    return pr.rounded_curves(pr.density(pa.project_to_path(t, pa.path_points(steps, t)), BAND, GRID), 8, 8)


_RECO_PEAKS = f"{K2}, kr as (select event_id, track_id, i::int as i, round(s, 8) as s, round(f, 8) as f from kg), {peaks_sql('kr', 'event_id, track_id')}, {peak_columns_sql('event_id, track_id')}"


@register("b21_event_profiles", f"with {WK}, {_RECO_PEAKS} select event_id, track_id, round(confidence, 5) as confidence, round(length, 5) as length, n_peaks, {_PEAK_COLS} from pc join wk using (event_id, track_id) where event_id in (select event_id from trk where n_tracks = 1)")
@by_event
def b21(spark: SparkSession, d: str) -> DataFrame:
    """Single-track events: path, density along it, its peaks as columns."""
    t, links = _tracks(spark, d)
    t = tr.single_tracks(t)
    w, steps = en.find_ends(t, links)
    p = rel.peak_columns(pr.peaks(_reco_curve(t, steps), 0.2).withColumn("at", F.col("s")), tr.TRACK)
    return rounded(w.select(*tr.TRACK, "confidence", "length").join(p, tr.TRACK), 5, **_PEAK_DIGITS)


_PEAK_BLOB = (
    f"{_RECO_PEAKS}, {_BLOBS}, pb as (select case when track_id = 1 then 'main' else 'satellite' end as sample, peak1_left <= 40 and peak2_prominence >= 0.001 and peak2_right >= 30 as ok, eb2 > 400 as cut from pc join bl using (event_id, track_id)), "
    "pe as (select sample, count(*) as n, avg(ok::int) as p, coalesce(avg(cut::int) filter (ok), 0) as b from pb group by 1)"
)


@register("f13_peak_and_blob_cut", f"with {WK}, {_PEAK_BLOB} select sample, n, round(p, 6) as eff_peak, round(b, 6) as eff_blob, round(p * b, 6) as efficiency from pe")
@by_event
def f13(spark: SparkSession, d: str) -> DataFrame:
    t, links = _tracks(spark, d)
    w, steps = en.find_ends(t, links)
    p = rel.peak_columns(pr.peaks(_reco_curve(t, steps), 0.2).withColumn("at", F.col("s")), tr.TRACK).join(bl.blob_energies(pa.path_points(steps, t), t, 12.0), tr.TRACK)
    p = p.withColumn("sample", F.when(F.col("track_id") == 1, "main").otherwise("satellite"))
    return rounded(ef.peak_and_blob_cut(p, "sample", "Eb2", 400.0, lmax=40.0, pmin=0.001, rmin=30.0))


@register(
    "e10_single_track_events",
    f"with {track_sql(RADIUS)}, ok as (select event_id from hits group by event_id having sum(energy) * 1000 between 500.00001 and 3000.00001), one as (select distinct event_id from trk where n_tracks = 1 and event_id in (select event_id from ok)) select event_id, hit_id from hits where event_id in (select event_id from one)",
)
@by_event
def e10(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the events that are one track within an energy window."""
    kept = ev.filter_energy_window(v.hits(spark, d), 500.00001, 3000.00001)
    single = tr.single_tracks(linked_tracks(kept)[0]).select("event_id").distinct()
    return kept.join(single, "event_id", "left_semi").select("event_id", "hit_id")


_CAT = (
    "ct as (select event_id, track_id, n_tracks, sum(energy) as energy, case when n_tracks = 1 then 'single' when n_tracks = 2 then 'two_' || case when track_id = 1 then 'primary' else 'secondary' end else 'three_' || case when track_id = 1 then 'primary' else 'secondary' end end as category from trk group by 1, 2, 3), "
    "hv as (" + " union all ".join(f"select category, '{c}' as name, -25.0::double as low, 5.0::double as width, {c}::double as value from trk join ct using (event_id, track_id)" for c in "xyz") + " union all select category, 'energy', 0.0, 0.5, energy from ct), "
    "hk as (select category, name, floor((value - low) / width)::bigint as bin, count(*)::double as weight from hv where value >= low and value < low + 10 * width group by 1, 2, 3), "
    "hb as (select category, name, bin, low + bin * width as lo, low + (bin + 1) * width as hi from (select distinct category, name, low, width from hv), range(10) b(bin))"
)


@register("h6_category_histograms", f"with {track_sql(RADIUS)}, {_CAT} select category, bin, lo, hi, (lo + hi) / 2 as center, coalesce(weight, 0.0::double) as weight, name from hb left join hk using (category, name, bin)")
@by_event
def h6(spark: SparkSession, d: str) -> DataFrame:
    """Histograms of x, y, z and of event energy (once per track) by category."""
    t = tracks(spark, d)
    c = tr.event_categories(t)
    parts = [hi.hist1d(t.join(c.select("event_id", "track_id", "category"), tr.TRACK), x, -25.0, 25.0, 10, ["category"]).withColumn("name", F.lit(x)) for x in "xyz"]
    parts.append(hi.hist1d(c, "energy", 0.0, 5.0, 10, ["category"]).withColumn("name", F.lit("energy")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out)


def _quadratic_sql() -> str:
    """Normal equations of a quadratic in u = (x - m) / s by label, solved by cofactors, with errors and 95 % intervals."""
    cof = lambda i, j: "(s{} * s{} - s{} * s{})".format(*(lambda r, c: (r[0] + c[0], r[1] + c[1], r[0] + c[1], r[1] + c[0]))([x for x in range(3) if x != i], [x for x in range(3) if x != j]))
    inv = lambda i, j: f"({'-' if (i + j) % 2 else ''}{cof(i, j)} / det)"
    b = ", ".join(f"{' + '.join(f'{inv(i, j)} * t{j}' for j in range(3))} as b{i}" for i in range(3))
    v_ = ", ".join(f"{inv(i, j)} as v{i}{j}" for i in range(3) for j in range(i, 3))
    base = {0: {0: "1", 1: "(-m / s)", 2: "(m * m / (s * s))"}, 1: {1: "(1 / s)", 2: "(-2 * m / (s * s))"}, 2: {2: "(1 / (s * s))"}}
    c = ", ".join(f"{' + '.join(f'b{p} * {w}' for p, w in base[i].items())} as c{i}, sqrt(s2 * ({' + '.join(f'{w} * {w2} * v{min(p, q)}{max(p, q)}' for p, w in base[i].items() for q, w2 in base[i].items())})) as c{i}_err" for i in range(3))
    t = "(1.959964 + (pow(1.959964, 3) + 1.959964) / (4.0 * (n - 3)) + (5 * pow(1.959964, 5) + 16 * pow(1.959964, 3) + 3 * 1.959964) / (96.0 * (n - 3) * (n - 3)))"
    out = ", ".join(f"round(c{i}, 6) as c{i}, round(c{i}_err, 6) as c{i}_err, round(c{i} - {t} * c{i}_err, 6) as c{i}_low, round(c{i} + {t} * c{i}_err, 6) as c{i}_high" for i in range(3))
    return (
        f"with {v.HITS}, q as (select label, avg(x) as m, stddev_pop(x) as s from hits group by 1), u as (select label, m, s, (x - m) / s as u, energy as y from hits join q using (label)), "
        "p as (select label, any_value(m) as m, any_value(s) as s, count(*)::double as s0, sum(u) as s1, sum(u * u) as s2, sum(pow(u, 3)) as s3, sum(pow(u, 4)) as s4, sum(y) as t0, sum(u * y) as t1, sum(u * u * y) as t2, sum(y * y) as yy from u group by 1), "
        f"d as (select *, s0 * {cof(0, 0)} - s1 * {cof(0, 1)} + s2 * {cof(0, 2)} as det from p), g as (select label, m, s, s0, yy, t0, t1, t2, {b}, {v_} from d), "
        f"r as (select *, (yy - b0 * t0 - b1 * t1 - b2 * t2) / (s0 - 3) as s2 from g), e as (select label, s0::bigint as n, {c} from r) select label, n, {out} from e"
    )


@register("h13_poly_fit", _quadratic_sql())
def h13(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hi.with_intervals(hi.poly_fit(v.hits(spark, d), "x", "energy", 2, ["label"]), ["c0", "c1", "c2"]))


_PROFILE = f"with {v.HITS}, pf as (select least(floor((x + 25) / 5)::bigint, 9) as bin, (-25 + (least(floor((x + 25) / 5), 9) + 0.5) * 5)::double as x, avg(energy) as y from hits where x >= -25 and x < 25 group by 1, 2)"
_LINE = (
    "f as (select count(*) as n, regr_sxx(y, x) as sxx, regr_syy(y, x) as syy, regr_sxy(y, x) as sxy, avg(x) as mx, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept from pf) "
    "select n, round(intercept, 6) as intercept, round(slope, 6) as slope, round(sqrt((syy - slope * sxy) / (n - 2) * (1 / n + mx * mx / sxx)), 6) as intercept_err, round(sqrt((syy - slope * sxy) / (n - 2) / sxx), 6) as slope_err from f"
)


@register("h14_fit_profile", f"{_PROFILE}, {_LINE}")
def h14(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hi.fit_profile(v.hits(spark, d), "x", "energy", -25.0, 25.0, 10))


@register("hits_dense_tracks")
@by_event
def dense(spark: SparkSession, d: str) -> DataFrame:
    """Few events of many voxels: links, components and ends of dense tracks."""
    vox = written(vx.voxelize(together(v.hits_dense(spark, d)), 5.0).select("event_id", "voxel_id", "x", "y", "z", "energy"), "voxels")
    links = written(tr.radius_links(vox, 8.0), "links")
    t = written(tr.make_tracks(vox, links).drop("track_energy"), "tracks")
    return rounded(en.chosen(en.Tracks(t, links)).select(*tr.TRACK, "start", "end", "confidence", "length"))
