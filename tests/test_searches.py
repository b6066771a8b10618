"""Searches and end rules over many random graphs at once against brute force in one graph, and literal cases."""

import copy

import brute_graph as g
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracksmith.operators import ends as en
from tracksmith.operators import paths as pa
from tracksmith.operators import searches as se
from tracksmith.operators import tracks as tr
from tracksmith.session import written

VOX = "event_id long, track_id int, voxel_id int, x double, y double, z double, energy double"


def random_graph(rng, n):
    """A connected graph: on a grid (many equal lengths), along a line, or scattered; with no, few or many further links."""
    kind = rng.integers(0, 4) if n < 40 else 3
    xyz = rng.integers(0, 6, (n, 3)) * 5.0 if kind == 0 else np.c_[np.arange(n) * 3.0, rng.normal(0, 1, (n, 2))] if kind == 1 else rng.normal(0, 12, (n, 3))
    xyz = xyz + np.arange(n)[:, None] * 1e-3 * (kind != 1)
    order = rng.permutation(n) if kind != 1 else np.arange(n)
    links = {tuple(sorted((int(order[i]), int(order[rng.integers(max(0, i - 3) if kind < 3 else 0, i)])))) for i in range(1, n)}
    for _ in range(int(rng.choice([0, 0, 1, n // 2, 2 * n, 4 * n])) if n < 40 else 4 * n):
        a, b = rng.integers(0, n, 2)
        if a != b:
            links.add(tuple(sorted((int(a), int(b)))))
    return xyz, rng.random(n) if rng.random() < 0.5 else rng.integers(1, 4, n) * 1.0, sorted(links)


def tables(spark, graphs):
    vox = [(e, 1, i + 1, *map(float, xyz[i]), float(energy[i])) for e, (xyz, energy, _) in graphs.items() for i in range(len(xyz))]
    links = [(e, a + 1, b + 1) for e, (_, _, ls) in graphs.items() for a, b in ls]
    return spark.createDataFrame(vox, VOX), spark.createDataFrame(links, "event_id long, src int, dst int")


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(5)
    graphs = {e: random_graph(rng, int(rng.integers(1, 11))) for e in range(500)} | {e: random_graph(rng, int(rng.integers(40, 70))) for e in range(500, 512)}
    t, links = tables(spark, graphs)
    return graphs, t.cache(), links.cache()


def by_event(ways):
    out = {}
    for r in ways.orderBy("event_id", "step").collect():
        out.setdefault(r["event_id"], []).append((r["step"], r["voxel_id"] - 1, r["s"]))
    return out


def test_fewest_links_and_least_cost(many):
    graphs, t, links = many
    ends = t.groupBy(*tr.TRACK).agg(F.min("voxel_id").alias("start"), F.max("voxel_id").alias("end"))
    few = by_event(se.shortest_ways(t, links, ends))
    least = by_event(se.shortest_ways(t, links, ends, se.link_cost()))
    for e, (xyz, energy, ls) in graphs.items():
        one = g.Graph(xyz, energy, ls)
        want = one.path(0, one.n - 1)
        assert [v for _, v, _ in few[e]] == want and [s for s, _, _ in few[e]] == list(range(1, len(want) + 1))
        assert few[e][-1][2] == pytest.approx(one.length(want), abs=1e-9)
        cost = lambda a, b, o=one: o.gap(a, b) / (0.5 * (o.energy[a] + o.energy[b]) + 1e-6)
        dist, _ = one.weighted_tree(0, cost)
        way = [v for _, v, _ in least[e]]
        assert way[0] == 0 and way[-1] == one.n - 1 and sum(cost(a, b) for a, b in zip(way, way[1:], strict=False)) == pytest.approx(dist[-1], abs=1e-9)


@pytest.mark.parametrize("delta", [None, 0.5, 4.0])
def test_buckets_give_the_same_costs(many, delta):
    """Any width of the buckets ends at the least costs, in a number of rounds that is returned."""
    graphs, t, links = many
    few = {e: x for e, x in graphs.items() if e % 25 == 0 or e > 505}
    keep = F.col("event_id").isin(list(few))
    edges = se.both_ways(links.where(keep), t.where(keep))
    tree, rounds = se.weighted_search(edges, t.where(keep).where("voxel_id = 1").select("event_id", F.col("voxel_id").alias("root")), F.col("gap"), delta)
    got = {(r["event_id"], r["v"] - 1): r["dist"] for r in tree.collect()}
    assert 1 < rounds < 400 and len(got) == sum(len(x) for x, _, _ in few.values())
    for e, (xyz, energy, ls) in few.items():
        one = g.Graph(xyz, energy, ls)
        dist, _ = one.weighted_tree(0, one.gap)
        assert [got[e, v] for v in range(one.n)] == pytest.approx(dist, abs=1e-9)


def test_spanning_forest(many):
    """The links of the least tree, ties by the ends of a link; a tie of the total weight alone would not tell."""
    graphs, t, links = many
    got = {}
    for r in se.spanning_forest(se.both_ways(links, t)).collect():
        got.setdefault(r["event_id"], set()).add((r["src"] - 1, r["dst"] - 1))
    for e, (xyz, energy, ls) in graphs.items():
        tree = g.Graph(xyz, energy, ls).spanning_tree()
        assert got.get(e, set()) == {(a, b) for a in range(tree.n) for b in tree.near[a] if a < b}


def test_long_chain_and_two_parts(spark):
    """A chain of falling gaps defeats pointer moves of one step; a voxel that no link reaches has no way."""
    n = 40
    vox = [(1, 1, i + 1, float(i * 200 - i * i), 0.0, 0.0, 1.0) for i in range(n)] + [(1, 1, 1000, 5.0, 5.0, 5.0, 1.0)]
    t = spark.createDataFrame(vox, VOX)
    links = spark.createDataFrame([(1, i, i + 1) for i in range(1, n)], "event_id long, src int, dst int")
    edges = se.both_ways(links, t)
    assert se.spanning_forest(edges).count() == n - 1
    trees = spark.createDataFrame([(1, 1, v, v - 1 if v > 1 else None, 1.5 if v > 1 else None) for v in range(1, n + 1)], "event_id long, root int, v int, parent int, gap double")
    way = se.ordered_paths(trees, spark.createDataFrame([(1, 1, n), (1, 1, 1)], "event_id long, root int, end int"))
    rows = way.where(f"end = {n}").orderBy("step").collect()
    assert [r["voxel_id"] for r in rows] == list(range(1, n + 1)) and rows[-1]["s"] == pytest.approx(1.5 * (n - 1)) and rows[0]["s"] == 0
    assert way.where("end = 1").collect()[0]["step"] == 1
    ends = spark.createDataFrame([(1, 1, 1, 1000)], "event_id long, track_id int, start int, end int")
    assert se.shortest_ways(t, links.where("src < 20"), ends).count() == 0


@pytest.fixture(scope="module")
def prepared(many):
    return en.Tracks(many[1], many[2])


@pytest.mark.parametrize("rule", list(g.RULES))
def test_rule_against_brute_force(many, prepared, rule):
    graphs = many[0]
    one = copy.copy(prepared)  # the rules share the searches made so far
    one.costs, one.sweeps = [], []
    ends = written(en.RULES[rule](one), "ends")
    ways = en.ways(one, ends)
    got, steps = {r["event_id"]: r for r in ends.collect()}, by_event(ways)
    assert len(got) == len(graphs)
    for e, (xyz, energy, ls) in graphs.items():
        want, r = g.RULES[rule](g.Graph(xyz, energy, ls)), got[e]
        assert (r["start"] - 1, r["end"] - 1) == (want.start, want.end), (e, want, r)
        assert (r["confidence"], r["length"]) == (pytest.approx(want.confidence, abs=1e-9), pytest.approx(want.length, abs=1e-9)), (e, want, r)
        assert [v for _, v, _ in steps.get(e, [])] == want.path and [k for k, _, _ in steps.get(e, [])] == list(range(1, len(want.path) + 1))
        assert not want.path or steps[e][-1][2] == pytest.approx(want.length, abs=1e-9)


LINE = ([(i, 0, 0) for i in range(4)], [(0, 1), (1, 2), (2, 3)], [1] * 4)
SQUARE = ([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)], [(0, 1), (1, 2), (2, 3), (3, 0)], [0.2] * 4)
TURN = ([(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0), (3, 1, 0), (3, 2, 0)], [(i, i + 1) for i in range(5)], [1] * 6)
FORK = ([(0, 0, 0), (1, 0, 0), (2, 1, 0), (3, -3, 0)], [(0, 1), (1, 2), (1, 3)], [1] * 4)
ONE = ([(1, 2, 3)], [], [1])


def test_literal_tracks(spark):
    """A line, a square, a sharp turn, a fork and a single voxel, all in one call."""
    graphs = {i: (np.array(x, float), np.array(e, float), [tuple(sorted(p)) for p in ls]) for i, (x, ls, e) in enumerate([LINE, SQUARE, TURN, FORK, ONE])}
    t, links = tables(spark, graphs)
    ends, ways = en.find_ends(t, links)
    got, steps = {r["event_id"]: r for r in ends.collect()}, by_event(ways)
    pair = lambda e: {got[e]["start"] - 1, got[e]["end"] - 1}
    assert pair(0) == {0, 3} and got[0]["length"] == 3 and got[0]["confidence"] == pytest.approx(0.95) and [v for _, v, _ in steps[0]] == [0, 1, 2, 3]
    assert (pair(1), got[1]["confidence"], got[1]["length"]) == ({0, 2}, 0.6, 2)
    assert pair(2) == {0, 5} and got[2]["length"] == 5
    assert 3 in pair(3) and pair(3) < {0, 2, 3}
    assert (got[4]["start"], got[4]["end"], got[4]["length"]) == (1, 1, 0) and steps[4] == [(1, 0, 0.0)]
    bend = {(r["event_id"], r["voxel_id"]): r["curvature"] for r in pa.vertex_curvature(t, links).collect()}
    assert [bend[1, v] for v in (1, 2, 3, 4)] == pytest.approx([1, 1, 1, 1]) and bend[2, 1] == bend[2, 6] == 0 and bend[2, 4] > 0.5


def test_simple_tracks_need_no_search(spark):
    """One voxel, or two linked ones: their ends come without measures or searches, by each rule that allows it."""
    graphs = {0: (np.array(ONE[0], float), np.ones(1), []), 1: (np.array([(0, 0, 0), (3, 4, 0)], float), np.ones(2), [(0, 1)])}
    for rule in ("combined", "combined_mst", "topology", "distance", "curvature", "mst"):
        t = en.Tracks(*tables(spark, graphs))
        ends = written(en.RULES[rule](t), "ends")
        assert t.measures.count() == t.edges.count() == sum(h.count() for h in [*t.hops, *t.costs, *t.sweeps]) == 0
        got, steps = {r["event_id"]: r for r in ends.collect()}, by_event(en.ways(t, ends))
        for e, (xyz, energy, ls) in graphs.items():
            want = g.RULES[rule](g.Graph(xyz, energy, ls))
            assert (got[e]["start"] - 1, got[e]["end"] - 1, got[e]["length"]) == (want.start, want.end, want.length)
            assert got[e]["confidence"] == pytest.approx(want.confidence) and [v for _, v, _ in steps[e]] == want.path


def test_later_rules_read_open_tracks_only(spark, monkeypatch):
    """A track that topology settles is in no table that the rules behind it read."""
    ring = ([(np.cos(a), np.sin(a), 0) for a in np.arange(9) * 0.7], [(i, (i + 1) % 9) for i in range(9)], np.ones(9))
    t, links = tables(spark, {i: (np.array(x, float), np.array(e, float), [tuple(sorted(p)) for p in ls]) for i, (x, ls, e) in enumerate([LINE, ring])})
    read = []
    rule = en.by_curvature
    monkeypatch.setattr(en, "by_curvature", lambda own, some: (read.extend({r["event_id"] for r in df.collect()} for df in (own.voxels, own.measures, own.edges)), rule(own, some))[1])
    en.find_ends(t, links)
    assert read == [{1}] * 3


def test_no_tracks(spark):
    t, links = tables(spark, {0: (np.zeros((1, 3)), np.ones(1), [])})
    links = spark.createDataFrame([], "event_id long, src int, dst int")
    for rule in g.RULES:
        ends, ways = en.find_ends(t.where("false"), links, rule)
        assert ends.count() == ways.count() == 0
