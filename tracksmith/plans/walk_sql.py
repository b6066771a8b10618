"""DuckDB SQL of the path searches and end rules: common table expressions after track_sql(), for the queries' oracles.

Searches run from every voxel by recursion over the number of links: a way of n links to a voxel extends the best way of n - 1 links to
a neighbour. The queue order of a search by fewest links is the order of the ways as lists of voxels.
"""

from __future__ import annotations

from tracksmith.plans.queries import RADIUS, track_sql

#: More links than any way in the tracks of the tables these run on.
MOST_LINKS = 24
XYZ = ("x", "y", "z")


def gap(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"pow({a}{c} - {b}{c}, 2)" for c in XYZ) + ")"


BASE = (
    track_sql(RADIUS) + ", "
    "dg as (select event_id, src as voxel_id, count(*) as degree from both_ group by 1, 2), "
    "vd as (select trk.event_id, track_id, trk.voxel_id, x, y, z, energy, coalesce(degree, 0) as degree, row_number() over (partition by trk.event_id, track_id order by trk.voxel_id) - 1 as place from trk left join dg on dg.event_id = trk.event_id and dg.voxel_id = trk.voxel_id), "
    f"ed as (select p.event_id, p.src as u, p.dst as v, {gap('a.', 'b.')} as gap, a.energy as eu, b.energy as ev from both_ p join vox a on a.event_id = p.event_id and a.voxel_id = p.src join vox b on b.event_id = p.event_id and b.voxel_id = p.dst), "
    "me as (select event_id, track_id, count(*) as n, sqrt(" + " + ".join(f"pow(max({c}) - min({c}), 2)" for c in XYZ) + ") as extent, avg(degree) as mean_degree, min(degree) as min_degree, count(*) filter (degree = 1) as n_tips, avg(energy) as mean_energy, max(energy) as max_energy, "
    "min(voxel_id) as v0, coalesce(max(voxel_id) filter (place = 1), min(voxel_id)) as v1, " + ", ".join(f"arg_min(voxel_id, (-{c}, voxel_id)) as high_{c}, arg_min(voxel_id, ({c}, voxel_id)) as low_{c}" for c in XYZ) + " from vd group by 1, 2)"
)


def hop_trees(name: str, edges: str, roots: str = "select event_id, voxel_id as root from vox") -> str:
    """CTE name: event_id, root, v, path, hops, length of fewest links from each root, over the given edges."""
    return (
        f"{name}_r as (select event_id, root, root as v, [root] as path, 0 as hops, 0.0::double as length from ({roots}) "
        f"union all select r.event_id, r.root, e.v, min(list_append(r.path, e.v)), any_value(r.hops) + 1, arg_min(r.length + e.gap, list_append(r.path, e.v)) from {name}_r r join {edges} e on e.event_id = r.event_id and e.u = r.v where not list_contains(r.path, e.v) and r.hops < {MOST_LINKS} group by r.event_id, r.root, e.v), "
        f"{name} as materialized (select event_id, root, v, arg_min(path, hops) as path, min(hops) as hops, arg_min(length, hops) as length from {name}_r group by 1, 2, 3)"
    )


def cost_trees(name: str, edges: str) -> str:
    """CTE name: event_id, root, v, path, dist of least summed w from every voxel; ties by fewer links, then the lower parent."""
    return (
        f"{name}_r as (select event_id, voxel_id as root, voxel_id as v, [voxel_id] as path, 0 as hops, 0.0::double as dist from vox "
        f"union all select r.event_id, r.root, e.v, arg_min(list_append(r.path, e.v), (r.dist + e.w, e.u)), any_value(r.hops) + 1, min(r.dist + e.w) from {name}_r r join {edges} e on e.event_id = r.event_id and e.u = r.v where not list_contains(r.path, e.v) and r.hops < {MOST_LINKS} group by r.event_id, r.root, e.v), "
        f"{name} as materialized (select event_id, root, v, arg_min(path, (dist, hops)) as path, min(dist) as dist from {name}_r group by 1, 2, 3)"
    )


def _pool(name: str, pool: str) -> str:
    """CTE name_p: all pairs of the pool (event_id, track_id, voxel_id, o) in its order, with both voxels and the way between them."""
    return (
        f"{name}_q as (select event_id, track_id, voxel_id, min(o) as o from ({pool}) group by 1, 2, 3), "
        f"{name}_f as (select event_id, track_id, arg_min(voxel_id, o) as p0, coalesce(arg_min(voxel_id, o, 2)[2], arg_min(voxel_id, o)) as p1, count(*) as size from {name}_q group by 1, 2), "
        f"{name}_v as (select q.*, x, y, z, energy, degree from {name}_q q join vd using (event_id, track_id, voxel_id)), "
        f"{name}_p as (select a.event_id, a.track_id, a.voxel_id as a, b.voxel_id as b, a.o as oa, b.o as ob, {gap('a.', 'b.')} as gap, a.energy as ea, b.energy as eb, a.degree as da, b.degree as db, w.length, w.path "
        f"from {name}_v a join {name}_v b on a.event_id = b.event_id and a.track_id = b.track_id and a.o < b.o join bf w on w.event_id = a.event_id and w.root = a.voxel_id and w.v = b.voxel_id)"
    )


def _best(name: str, score: str, where: str = "true", source: str | None = None) -> str:
    """CTE name_b: the first pair of greatest score."""
    return f"{name}_b as (select * from (select *, row_number() over (partition by event_id, track_id order by round({score}, 9) desc, oa, ob) as nth from {source or name + '_p'} where {where}) where nth = 1)"


def _outer(order: int = 0) -> str:
    sides = [f"{s}_{c}" for c in XYZ for s in ("low", "high")]
    return " union all ".join(f"select event_id, track_id, {s} as voxel_id, {order + i} as o from me" for i, s in enumerate(sides))


ALONE = "select event_id, track_id, v0 as s, v0 as e, 1.0::double as confidence, 0.0::double as length, [v0] as path from me where n = 1"

DISTANCE = (
    _pool("ds", f"select vd.event_id, vd.track_id, voxel_id, voxel_id as o from vd join me using (event_id, track_id) where n <= 50 union all select * from ({_outer()}) where (event_id, track_id) in (select (event_id, track_id) from me where n > 50)") + ", " + _best("ds", "gap", "gap > 0") + ", "
    "far as (select me.event_id, me.track_id, coalesce(a, v0) as s, coalesce(b, v1) as e, coalesce(length, 0) as length, coalesce(path, case when v0 = v1 then [v0] end) as path from me left join ds_b using (event_id, track_id)), "
    "distance as (select event_id, track_id, s, e, 0.6::double as confidence, length, path from far)"
)
_COVER = "least(1.0::double, length / greatest(extent, 1.0))"
TOPOLOGY = (
    _pool("tips", "select event_id, track_id, voxel_id, voxel_id as o from vd where degree = 1") + ", " + _best("tips", "length") + ", "
    f"topology as (select event_id, track_id, a as s, b as e, case when n_tips = 2 then case when length / greatest(extent, 1.0) >= 0.5 then 0.85 + 0.1 * {_COVER} else 0.5 + 0.3 * {_COVER} end "
    f"else case when length / greatest(extent, 1.0) >= 0.5 then 0.75 + 0.15 * {_COVER} else 0.4 + 0.3 * {_COVER} end end as confidence, length, path from tips_b join me using (event_id, track_id) where n_tips >= 2 "
    "union all select d.* from distance d join me using (event_id, track_id) where n_tips < 2)"
)
CURVED = (
    "sv as (select e.event_id, u as v, e.v as w, b.x - a.x as dx, b.y - a.y as dy, b.z - a.z as dz from ed e join vox a on a.event_id = e.event_id and a.voxel_id = u join vox b on b.event_id = e.event_id and b.voxel_id = e.v), "
    "cc as (select p.event_id, p.v as voxel_id, avg(1 - abs(least(1, greatest(-1, (p.dx * q.dx + p.dy * q.dy + p.dz * q.dz) / (sqrt(p.dx * p.dx + p.dy * p.dy + p.dz * p.dz) * sqrt(q.dx * q.dx + q.dy * q.dy + q.dz * q.dz)))))) as c from sv p join sv q on p.event_id = q.event_id and p.v = q.v and p.w < q.w group by 1, 2), "
    "cv as (select vd.event_id, vd.track_id, vd.voxel_id, coalesce(c, 0) as c, row_number() over (partition by vd.event_id, vd.track_id order by round(coalesce(c, 0), 9), vd.voxel_id) as o from vd left join cc on cc.event_id = vd.event_id and cc.voxel_id = vd.voxel_id)"
)
CURVATURE = (
    CURVED + ", " + _pool("cu", "select event_id, track_id, voxel_id, o from cv join me using (event_id, track_id) where o <= 6 and n >= 3") + ", "
    "cu_s as (select p.*, 2 / (ca.c + cb.c + 1e-6) as bonus from cu_p p join cv ca on ca.event_id = p.event_id and ca.voxel_id = p.a join cv cb on cb.event_id = p.event_id and cb.voxel_id = p.b), "
    + _best("cu", "length + bonus", "gap >= 2", "cu_s") + ", "
    "curvature as (select f.event_id, f.track_id, coalesce(a, p0) as s, coalesce(b, p1) as e, case when a is null then 0 else least(0.7 + 0.2 * bonus / 10, 0.9) end as confidence, coalesce(length, 0) as length, path from cu_f f left join cu_b using (event_id, track_id) "
    "union all select d.event_id, d.track_id, s, e, 0.7, length, path from distance d join me using (event_id, track_id) where n < 3)"
)
SPATIAL = (
    _pool("sp", f"select * from ({_outer()}) union all select vd.event_id, vd.track_id, voxel_id, voxel_id + 100 from vd join me using (event_id, track_id) where degree = min_degree") + ", " + _best("sp", "length") + ", "
    "spatial as (select f.event_id, f.track_id, coalesce(a, p0) as s, coalesce(b, p1) as e, case when a is null then 0.75 else least(0.95, 0.75 + case when gap / length > 0.8 then 0.1 else 0 end + least(0.1, length / 500) + case when (da + db) / 2.0 < 0.7 * mean_degree then 0.05 else 0 end) end as confidence, "
    f"coalesce(length, 0) as length, path from sp_f f join me using (event_id, track_id) left join sp_b using (event_id, track_id) where n > 1 union all {ALONE})"
)
_WEIGH = "(1 + 0.5 * (ea + eb) / max_energy)"
ENERGY = (
    "hot as (select vd.event_id, vd.track_id, voxel_id, vd.energy, row_number() over (partition by vd.event_id, vd.track_id order by vd.energy desc, voxel_id) as nth from vd join me using (event_id, track_id) where vd.energy >= mean_energy + 0.5 * (max_energy - mean_energy)), "
    f"en_all as (select event_id, track_id, voxel_id, voxel_id as o from hot union all {_outer(1 << 40)}), "
    "crowd as (select event_id, track_id from en_all group by 1, 2 having count(distinct voxel_id) > 20), "
    + _pool("en", f"select * from en_all where (event_id, track_id) not in (select (event_id, track_id) from crowd) union all select * from (select event_id, track_id, voxel_id, nth as o from hot where nth <= 10 union all {_outer(1 << 40)}) where (event_id, track_id) in (select (event_id, track_id) from crowd)") + ", "
    "en_s as (select p.*, max_energy, length / greatest(extent, 1.0) as cover, gap >= 5 and length / greatest(extent, 1.0) >= 0.6 as strict from en_p p join me using (event_id, track_id) where gap >= 3), "
    "en_m as (select *, bool_or(strict) over (partition by event_id, track_id) as any_strict from en_s), "
    + _best("en", f"length * {_WEIGH} * case when any_strict then least(cover, 1.5) else 1 end", "strict or not any_strict", "en_m") + ", "
    "energy as (select f.event_id, f.track_id, coalesce(a, p0) as s, coalesce(b, p1) as e, case when strict then least(0.95, case (ea >= h)::int + (eb >= h)::int when 2 then 0.4 when 1 then 0.25 else 0.1 end + least(0.4, 0.4 * length / greatest(extent, 1.0)) + 0.2 * least(1, gap / greatest(length, 1.0) / 0.8)) "
    "else least(0.5, 0.2 + 0.3 * coalesce(length, 0) / greatest(extent, 1.0)) end as confidence, coalesce(length, 0) as length, path from en_f f join (select *, mean_energy + 0.5 * (max_energy - mean_energy) as h from me) using (event_id, track_id) left join en_b b using (event_id, track_id) where n > 1 "
    f"union all {ALONE})"
)
COSTS = "costs as (select ed.*, gap / (0.5 * (eu + ev) + greatest(1e-6, 1e-6 * greatest(max_energy, 1e-12))) as w from ed join vd on vd.event_id = ed.event_id and vd.voxel_id = u join me on me.event_id = vd.event_id and me.track_id = vd.track_id)"


def length_of(paths: str) -> str:
    """Arc lengths of paths: event_id, root, v, length from the table's path column."""
    return f"(select p.event_id, p.root, p.v, coalesce(sum({gap('a.', 'b.')}), 0) as length from (select *, unnest(range(1, len(path))) as i from {paths}) p join vox a on a.event_id = p.event_id and a.voxel_id = p.path[p.i] join vox b on b.event_id = p.event_id and b.voxel_id = p.path[p.i + 1] group by 1, 2, 3)"


EDGE_ENERGY = (
    COSTS + ", " + cost_trees("wt", "costs") + ", "
    "s1 as (select me.event_id, me.track_id, arg_min(v, (-round(dist, 9), v)) as s from me join wt on wt.event_id = me.event_id and root = v0 where n > 1 group by 1, 2), "
    "s2 as (select s1.event_id, s1.track_id, s, arg_min(v, (-round(dist, 9), v)) as e, arg_min(path, (-round(dist, 9), v)) as path from s1 join wt on wt.event_id = s1.event_id and root = s group by 1, 2, 3), "
    f"s3 as (select event_id, track_id, s as root, e as v, path from s2), s4 as {length_of('s3')}, "
    f"edge_energy as (select s3.event_id, s3.track_id, s3.root as s, s3.v as e, case when {gap('a.', 'b.')} > 0 then least(1, greatest(0, 0.5 + 0.5 * tanh((length / {gap('a.', 'b.')} - 1.05) / 0.25))) else 1 end as confidence, length, path "
    f"from s3 join s4 on s4.event_id = s3.event_id and s4.root = s3.root and s4.v = s3.v join vox a on a.event_id = s3.event_id and a.voxel_id = s3.root join vox b on b.event_id = s3.event_id and b.voxel_id = s3.v union all {ALONE})"
)
MST = (
    "rc as (select event_id, u as es, v as ee, gap as eg, u as v from ed where u < v union select rc.event_id, es, ee, eg, e.v from rc join ed e on e.event_id = rc.event_id and e.u = rc.v where (e.gap, least(e.u, e.v), greatest(e.u, e.v)) < (eg, es, ee)), "
    "tree as (select * from ed where (event_id, least(u, v), greatest(u, v)) not in (select (event_id, es, ee) from rc where v = ee)), "
    + hop_trees("tb", "tree") + ", "
    "m1 as (select me.event_id, me.track_id, arg_min(v, (-hops, v)) as s from me join tb on tb.event_id = me.event_id and root = v0 group by 1, 2), "
    "mst as (select m1.event_id, m1.track_id, s, arg_min(v, (-hops, v)) as e, 1.0::double as confidence, arg_min(length, (-hops, v)) as length, arg_min(path, (-hops, v)) as path from m1 join tb on tb.event_id = m1.event_id and root = s group by 1, 2, 3)"
)
FIELDS = "event_id, track_id, s, e, confidence, length, path"


def _combined(name: str, tree: bool) -> str:
    ranked = "select *, 1 as prior from energy union all select *, 2 from spatial union all select *, 3 from topology union all select *, 4 from curvature" + (" union all select *, 0 from mst" if tree else "")
    pick = lambda c: f"case rule when 't' then t.{c} when 'c' then c.{c} when 'w' then w.{c} when 'e' then n.{c} when 's' then s.{c} else l.{c} end as {c}"
    return (
        f"{name}_l as (select * from (select *, row_number() over (partition by event_id, track_id order by round(length, 9) desc, prior) as nth from ({ranked})) where nth = 1), "
        f"{name}_d as (select t.event_id, t.track_id, case when t.confidence >= 0.85 or m.n < 3 or (m.mean_degree <= 6 and t.confidence >= 0.8) then 't' when m.mean_degree <= 6 then case when c.length > 1.1 * t.length + 1e-9 then 'c' else 't' end "
        "when w.confidence >= 0.85 or w.length > 1.1 * t.length + 1e-9 then 'w' when n.confidence >= 0.85 or n.length > 1.1 * t.length + 1e-9 then 'e' when s.length > 1.2 * t.length + 1e-9 then 's' else 'l' end as rule "
        "from topology t join me m using (event_id, track_id) left join curvature c using (event_id, track_id) left join edge_energy w using (event_id, track_id) left join energy n using (event_id, track_id) left join spatial s using (event_id, track_id)), "
        f"{name} as materialized (select d.event_id, d.track_id, {', '.join(pick(c) for c in ('s', 'e', 'confidence', 'length', 'path'))} from {name}_d d join topology t using (event_id, track_id) left join curvature c using (event_id, track_id) left join edge_energy w using (event_id, track_id) left join energy n using (event_id, track_id) left join spatial s using (event_id, track_id) left join {name}_l l using (event_id, track_id))"
    )


BF = hop_trees("bf", "ed")
NEEDS = {
    "distance": [BF, DISTANCE],
    "topology": [BF, DISTANCE, TOPOLOGY],
    "curvature": [BF, DISTANCE, CURVATURE],
    "spatial": [BF, SPATIAL],
    "energy": [BF, ENERGY],
    "edge_energy": [EDGE_ENERGY],
    "mst": [MST],
    "combined": [BF, DISTANCE, TOPOLOGY, CURVATURE, SPATIAL, ENERGY, EDGE_ENERGY, _combined("combined", False)],
    "combined_mst": [BF, DISTANCE, TOPOLOGY, CURVATURE, SPATIAL, ENERGY, EDGE_ENERGY, MST, _combined("combined_mst", True)],
}


def steps_of(name: str) -> str:
    """CTE name_st: the steps of name's paths (event_id, track_id, path) with their voxels and arc lengths."""
    lag = ", ".join(f"lag({c}) over w as l{c}" for c in XYZ)
    return (
        f"{name}_u as (select event_id, track_id, unnest(path) as voxel_id, unnest(range(1, len(path) + 1)) as step from {name} where path is not null), "
        f"{name}_l as (select u.*, vox.x, vox.y, vox.z, vox.energy, {lag} from {name}_u u join vox using (event_id, voxel_id) window w as (partition by u.event_id, u.track_id order by step)), "
        f"{name}_st as (select event_id, track_id, step::int as step, voxel_id, x, y, z, energy, sum(coalesce({gap('', 'l')}, 0)) over (partition by event_id, track_id order by step rows unbounded preceding) as s from {name}_l)"
    )


def walks(method: str, name: str = "wk") -> str:
    """CTEs up to name: event_id, track_id, s, e, confidence, length, path; and name_st: their steps with arc lengths."""
    return ", ".join([BASE, *NEEDS[method], f"{name} as (select {FIELDS} from {method})", steps_of(name)])
