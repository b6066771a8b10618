"""Searches in the graphs of all tracks at once: frontier rounds, bucketed relaxation, spanning forests, and paths in order.

A search is (event_id, root): voxel numbers are unique in an event and links never leave a track, so a root names its track.
Each round is a few joins and aggregates over the searches that still go on, written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.operators.components import counted
from tracksmith.session import is_dealt, written

SEARCH = ["event_id", "root"]
#: More rounds than this mean a graph far from a track.
MOST_ROUNDS = 100_000


def both_ways(links: DataFrame, points: DataFrame) -> DataFrame:
    """event_id, u, v, gap, eu, ev: every link in both directions with its length and the energies of its ends; written."""
    at = points.select("event_id", F.col("voxel_id").alias("src"), *[F.col(c).alias(f"{c}1") for c in ("x", "y", "z", "energy")])
    to = points.select("event_id", F.col("voxel_id").alias("dst"), *[F.col(c).alias(f"{c}2") for c in ("x", "y", "z", "energy")])
    j = links.select("event_id", "src", "dst").join(at, ["event_id", "src"]).join(to, ["event_id", "dst"])
    gap = F.sqrt(sum(((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in "xyz"), F.lit(0.0)))
    j = j.select("event_id", "src", "dst", gap.alias("gap"), "energy1", "energy2")
    way = lambda u, v, eu, ev: F.struct(F.col(u).alias("u"), F.col(v).alias("v"), "gap", F.col(eu).alias("eu"), F.col(ev).alias("ev"))
    both = F.explode(F.array(way("src", "dst", "energy1", "energy2"), way("dst", "src", "energy2", "energy1")))
    return written(j.select("event_id", both.alias("e")).select("event_id", "e.*"), "edges")


def _looked_up(rows: DataFrame) -> DataFrame:
    """Rows of a round for the join with all links: dealt ones are looked up from the links, which are not sorted for it then."""
    return rows.hint("shuffle_hash") if is_dealt(rows) else rows


def _next_level(edges: DataFrame, level: DataFrame, before: DataFrame | None, hops: int) -> DataFrame:
    """The vertices that the links of a level newly reach: told from the level and the one before it, ordered as a queue would."""
    offers = _looked_up(level.select(*SEARCH, F.col("v").alias("u"), "place", "length")).join(edges, ["event_id", "u"])
    new = offers.groupBy(*SEARCH, "v").agg(F.min(F.struct("place", F.col("u").alias("parent"), (F.col("length") + F.col("gap")).alias("length"))).alias("m"))
    for known in (level, before):
        if known is not None:
            new = new.join(known.select(*SEARCH, "v"), [*SEARCH, "v"], "left_anti")
    place = F.row_number().over(Window.partitionBy(*SEARCH).orderBy("m.place", "v"))
    return new.select(*SEARCH, "v", "m.parent", place.alias("place"), F.lit(hops).alias("hops"), "m.length")


def hop_search(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Trees of fewest links: event_id, root, v, parent (null at the root), hops, length (along the tree) of every reached vertex.

    Level by level. A vertex found from several parents takes the one that the search reached first, where a level is
    ordered by (place of the parent, vertex): the order of a queue that visits neighbours by number. A link of a level leads
    to the level before it, itself or the next, so only two levels are what new vertices are told from.
    """
    edges = edges.select("event_id", "u", "v", "gap")
    start = roots.select(*SEARCH).distinct().select(*SEARCH, F.col("root").alias("v"), F.lit(None).cast(roots.schema["root"].dataType).alias("parent"), F.lit(1).alias("place"), F.lit(0).alias("hops"), F.lit(0.0).alias("length"))
    level, n = counted(start, "level")
    levels = [level]
    while n:
        hops = len(levels)
        if hops > MOST_ROUNDS:
            raise RuntimeError(f"a search did not end in {MOST_ROUNDS} rounds")
        level, n = counted(_next_level(edges, level, levels[-2] if hops > 1 else None, hops), "level")
        levels.append(level)
    return written([d.drop("place") for d in levels], "tree")


def weighted_search(edges: DataFrame, roots: DataFrame, cost: Column, delta: float | None = 4.0) -> tuple[DataFrame, int]:
    """Trees of least summed cost: event_id, root, v, dist, hops, parent of every reached vertex; and the number of rounds.

    Bucketed relaxation: a round takes of each search the vertices that changed and lie in its first bucket (delta mean costs of
    its event wide; None: one bucket, all that changed), offers their costs to their neighbours, and keeps
    the least offer by (cost, links, parent). Equal costs go to fewer links, then to the lower parent. Finished searches leave.
    """
    edges = edges.select("event_id", "u", "v", cost.alias("w"))
    kind = roots.schema["root"].dataType
    state = roots.select(*SEARCH).distinct().select(*SEARCH, F.col("root").alias("v"), F.lit(0.0).alias("dist"), F.lit(0).alias("hops"), F.lit(None).cast(kind).alias("parent"), F.lit(True).alias("open"))
    if delta is not None:
        width = edges.groupBy("event_id").agg((F.avg("w") * delta).alias("width"))
        state = state.join(width, "event_id", "left")
    else:
        state = state.withColumn("width", F.lit(None).cast("double"))
    state, n = counted(state, "state")
    done: list[DataFrame] = []
    rounds = 0
    own = Window.partitionBy(*SEARCH)
    while n:
        rounds += 1
        if rounds > MOST_ROUNDS:
            raise RuntimeError(f"a search did not end in {MOST_ROUNDS} rounds")
        bucket = F.coalesce(F.floor(F.col("dist") / F.col("width")), F.lit(0))
        now = state.where("open").withColumn("b", bucket).withColumn("first", F.min("b").over(own)).where(F.col("b") == F.col("first"))
        offers = _looked_up(now.select(*SEARCH, F.col("v").alias("u"), "dist", "hops", "width")).join(edges, ["event_id", "u"])
        offers = offers.select(*SEARCH, "v", (F.col("dist") + F.col("w")).alias("dist"), (F.col("hops") + 1).alias("hops"), F.col("u").alias("parent"), "width")
        # a union would have to be dealt again: the vertices known so far and the new ones are two parts of the table
        best = offers.groupBy(*SEARCH, "v").agg(F.min(F.struct("dist", "hops", "parent")).alias("m"), F.max("width").alias("width"))
        asked = now.select(*SEARCH, "v", F.lit(True).alias("asked"))
        known = state.withColumn("going", F.max("open").over(own)).where("going").join(asked, [*SEARCH, "v"], "left").join(best.drop("width"), [*SEARCH, "v"], "left")
        offered, has = F.col("m").isNotNull(), ["dist", "hops", "parent"]
        taken = offered & (F.col("m") < F.struct(*has))
        better = offered & (F.struct("m.dist", "m.hops") < F.struct("dist", "hops"))
        known = known.select(*SEARCH, "v", *[F.when(taken, F.col(f"m.{c}")).otherwise(F.col(c)).alias(c) for c in has], ((F.col("open") & F.col("asked").isNull()) | better).alias("open"), "width")
        new = best.join(state.select(*SEARCH, "v"), [*SEARCH, "v"], "left_anti").select(*SEARCH, "v", *[f"m.{c}" for c in has], F.lit(True).alias("open"), "width")
        state, n = counted([known, new], "state", "open")
        done.append(state.withColumn("going", F.max("open").over(own)).where("not going").drop("going"))
    out = [d.select(*SEARCH, "v", "dist", "hops", "parent") for d in done]
    return (written(out, "tree") if out else state.select(*SEARCH, "v", "dist", "hops", "parent")), rounds


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The links (event_id, src, dst, gap) of each component's least spanning tree; equal lengths are ordered by (src, dst).

    Each round every group of vertices takes its least link to another group (such a link is in the tree whatever the groups
    are), groups follow these links to the one where two take the same link, found by pointer jumping, and links inside
    a group are gone. Half of the groups or more merge in a round.
    """
    e = edges.where("u < v").select("event_id", F.col("u").alias("src"), F.col("v").alias("dst"), "gap", F.col("u").alias("a"), F.col("v").alias("b"))
    e, n = counted(e, "links")
    tree: list[DataFrame] = []
    while n:
        sides = e.select("event_id", "gap", "src", "dst", F.explode(F.array(*[F.struct(F.col(g).alias("g"), F.col(to).alias("to")) for g, to in (("a", "b"), ("b", "a"))])).alias("s")).select("event_id", "gap", "src", "dst", "s.*")
        taken = written(sides.groupBy("event_id", "g").agg(F.min(F.struct("gap", "src", "dst", "to")).alias("m")).select("event_id", "g", "m.*"), "taken")
        tree.append(taken.select("event_id", "src", "dst", "gap"))
        back = taken.select("event_id", F.col("g").alias("to"), F.col("to").alias("back"))
        up = taken.join(back, ["event_id", "to"]).select("event_id", "g", F.when((F.col("back") == F.col("g")) & (F.col("g") < F.col("to")), F.col("g")).otherwise(F.col("to")).alias("up"))
        up = _jumped(written(up, "groups"))
        for end in ("a", "b"):
            e = e.join(up.select("event_id", F.col("g").alias(end), F.col("up").alias(f"__{end}")), ["event_id", end])
        e, n = counted(e.select("event_id", "src", "dst", "gap", F.col("__a").alias("a"), F.col("__b").alias("b")).where("a != b"), "links")
    return (written(tree, "tree") if tree else e.select("event_id", "src", "dst", "gap")).distinct()


def _jumped(up: DataFrame) -> DataFrame:
    """event_id, g, up: each group's root, by doubling the pointers until none moves."""
    while True:
        then = up.select("event_id", F.col("g").alias("up"), F.col("up").alias("next"))
        up, moved = counted(up.join(then, ["event_id", "up"]).select("event_id", "g", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")), "groups", "moved")
        up = up.drop("moved")
        if not moved:
            return up


def ordered_paths(trees: DataFrame, ends: DataFrame) -> DataFrame:
    """event_id, root, end, step (from 1 at the root), voxel_id, s (arc length): the way from the root to each end.

    trees: event_id, root, v, parent, gap (to the parent); ends: event_id, root, end. List ranking by pointer doubling: each round every
    vertex looks twice as far up, and the vertices known to lie on a way hand on those that they see, with links and length
    back to the end. A way of n links takes log2(n) rounds; one of none or one takes no join.
    """
    trees = trees.join(ends.select(*SEARCH).distinct(), SEARCH, "left_semi")
    ahead, n = counted(trees.where("parent is not null").select(*SEARCH, "v", F.col("parent").alias("up"), F.lit(1).cast("long").alias("far"), F.col("gap").alias("len")), "ahead")
    way = ends.select(*SEARCH, "end", F.col("end").alias("v"), F.lit(0).cast("long").alias("back"), F.lit(0.0).alias("len_back"))
    way = written(way, "way")
    while n:
        # each row of the way stays, and with the pointer from its vertex (at most one) makes another
        at = lambda v, back, length: F.struct(v.alias("v"), back.alias("back"), length.alias("len_back"))
        seen = F.when(F.col("up").isNotNull(), at(F.col("up"), F.col("back") + F.col("far"), F.col("len_back") + F.col("len")))
        rows = F.explode(F.array_compact(F.array(at(F.col("v"), F.col("back"), F.col("len_back")), seen)))
        way, found = written(way.join(ahead, [*SEARCH, "v"], "left").select(*SEARCH, "end", rows.alias("r")).select(*SEARCH, "end", "r.*"), "way"), ahead
        then = ahead.select(*SEARCH, F.col("v").alias("up"), F.col("up").alias("next"), F.col("far").alias("far2"), F.col("len").alias("len2"))
        ahead, n = counted(found.join(then, [*SEARCH, "up"]).select(*SEARCH, "v", F.col("next").alias("up"), (F.col("far") + F.col("far2")).alias("far"), (F.col("len") + F.col("len2")).alias("len")), "ahead")
    total = way.where(F.col("v") == F.col("root")).select(*SEARCH, "end", F.col("back").alias("links"), F.col("len_back").alias("whole"))
    j = way.join(total, [*SEARCH, "end"])
    return j.select(*SEARCH, "end", (F.col("links") - F.col("back") + 1).cast("int").alias("step"), F.col("v").alias("voxel_id"), F.abs(F.col("whole") - F.col("len_back")).alias("s"))


def hop_gaps(trees: DataFrame) -> DataFrame:
    """hop_search() trees with gap: the length of the link to the parent."""
    at = trees.select(*SEARCH, F.col("v").alias("parent"), F.col("length").alias("before"))
    return trees.join(at, [*SEARCH, "parent"], "left").withColumn("gap", F.col("length") - F.col("before")).drop("before")


def edge_gaps(trees: DataFrame, edges: DataFrame) -> DataFrame:
    """Trees with gap: the length of the link to the parent, from the edges."""
    return trees.join(edges.select("event_id", F.col("u").alias("parent"), "v", "gap"), ["event_id", "parent", "v"], "left")


def link_cost(alpha: float = 1.0, beta: float = 1.0, floor: str | float = 1e-6) -> Column:
    """gap^alpha / (mean energy of the ends + floor)^beta."""
    f = F.col(floor) if isinstance(floor, str) else F.lit(floor)
    return F.pow("gap", F.lit(alpha)) / F.pow(0.5 * (F.col("eu") + F.col("ev")) + f, F.lit(beta))


def shortest_ways(tracks: DataFrame, links: DataFrame, ends: DataFrame, cost: Column | None = None) -> DataFrame:
    """TRACK, step, voxel_id, s between given ends (TRACK, start, end): of fewest links, or of least summed cost of the links.

    Ends that no links connect have no steps; one voxel that is both ends is its own way.
    """
    edges = both_ways(links, tracks)
    roots = ends.select("event_id", F.col("start").alias("root"))
    trees = hop_gaps(hop_search(edges, roots)) if cost is None else edge_gaps(weighted_search(edges, roots, cost)[0], edges)
    found = ordered_paths(trees.select(*SEARCH, "v", "parent", "gap"), ends.select("event_id", F.col("start").alias("root"), "end").distinct())
    owner = ends.select("event_id", "track_id", F.col("start").alias("root"), "end")
    return owner.join(found, [*SEARCH, "end"]).select("event_id", "track_id", "step", "voxel_id", "s")
