"""Connected components of an edge table: keys of few edges in a row each, all others by contraction in rounds that get smaller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tracksmith.session import is_dealt, written

#: Up to so many rows one key may hold them all: a task of narrow rows of this number is an ordinary one.
ORDINARY = 1 << 20
#: Beyond that, a key with over 1 / HEAVY of the rows is heavy: at most HEAVY keys, so their rows of a unique table are broadcast.
HEAVY = 16_384
#: Keys with at most this many edges are settled in a row each, without rounds.
FEW_EDGES = 64


def counted(df: DataFrame | list[DataFrame], name: str, flag: str | None = None) -> tuple[DataFrame, int]:
    """df (or several of equal columns) written to the shared folder, and its number of rows (of those with the flag), counted while they are written."""
    parts = df if isinstance(df, list) else [df]
    seen = [Observation() for _ in parts]
    out = written([p.observe(o, (F.count_if(flag) if flag else F.count("*")).alias("n")) for p, o in zip(parts, seen, strict=True)], name)
    return out, sum(o.get["n"] for o in seen)


def unique_join(left: DataFrame, right: DataFrame, on: list[str], n: int, how: str = "inner") -> DataFrame:
    """left (of n rows, some keys hot) with right (one row per key). Rows of heavy keys meet a broadcast, all others a join.

    Tables dealt by a key of theirs (session.dealt_by) join where they are.
    """
    if n <= ORDINARY or is_dealt(left):
        return left.join(right, on, how)
    heavy = left.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") > max(ORDINARY // 16, n // HEAVY)).select(*on, F.lit(True).alias("__hot"))
    marked = left.join(F.broadcast(heavy), on, "left")
    hot = marked.where("__hot").drop("__hot").join(F.broadcast(right.join(heavy.drop("__hot"), on, "left_semi")), on, how)
    return marked.where("__hot is null").drop("__hot").join(right, on, how).unionByName(hot)


def _joined(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, vertex, component of keys of few edges (keys, u, v): a row per key holds its vertices with labels, which each edge in turn makes one."""
    rows = edges.groupBy(*keys).agg(F.collect_list(F.struct("u", "v")).alias("e"))
    rows = rows.withColumn("vertices", F.array_sort(F.array_distinct(F.flatten(F.transform("e", lambda x: F.array(x["u"], x["v"]))))))
    at = lambda c: (F.array_position("vertices", c) - 1).cast("int")
    rows = rows.withColumn("e", F.transform("e", lambda x: F.struct(at(x["u"]).alias("i"), at(x["v"]).alias("j"))))

    def join(labels: Column, x: Column) -> Column:
        a, b = F.get(labels, x["i"]), F.get(labels, x["j"])
        return F.when(a == b, labels).otherwise(F.transform(labels, lambda label: F.when(label == F.greatest(a, b), F.least(a, b)).otherwise(label)))

    zipped = F.arrays_zip("vertices", F.aggregate("e", F.col("vertices"), join).alias("labels"))
    return rows.select(*keys, F.explode(zipped).alias("z")).select(*keys, F.col("z.vertices").alias("vertex"), F.col("z.labels").alias("component"))


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", keys: list[str] | None = None, most_rounds: int = 100, few: int = FEW_EDGES) -> DataFrame:
    """Map each vertex that has an edge to the least vertex it can reach.

    edges: undirected edges in columns u and v (any orderable type), with optional key columns; components never cross keys.
    Self edges and repeated edges are allowed; edges with a null end are ignored.
    Returns keys, ``vertex``, ``component``. Vertices without edges don't appear; an empty table gives an empty table.

    Keys with at most few edges take no part in the rounds: each is a row of its own. A round lets each vertex follow the first of itself and its neighbours in a hashed order of its own, and that one's choice in turn;
    edges are rewritten to what their ends follow. An edge whose ends follow the same vertex is gone, so a settled component takes
    no further part, and the order by hash leaves about half of the vertices or fewer in any graph, long chains included.
    At the end the rounds' tables are composed, each far smaller than the one before. A vertex of any degree is an aggregate
    with partial sums, and unique_join() splits it where its edges are rewritten.
    """
    keys = keys or []
    e = edges.select(*keys, F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    if keys:
        e = e.dropna(subset=keys)
        if not is_dealt(e):  # dealt edges come from a written table
            e = written(e, "edges")
        crowded = written(e.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > few).select(*keys), "crowded")
        if crowded.isEmpty():
            return _joined(e, keys)
        parts = [_joined(e.join(crowded, keys, "left_anti"), keys), _contracted(e.join(crowded, keys, "left_semi"), keys, most_rounds)]
        return written(parts, "components")
    return _contracted(e, keys, most_rounds)


def _contracted(e: DataFrame, keys: list[str], most_rounds: int) -> DataFrame:
    """keys, vertex, component of edges (keys, u > v), by rounds."""
    e, n = counted(e.distinct(), "edges")
    rounds: list[tuple[DataFrame, int]] = []
    while n:
        if len(rounds) == most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        follow, size = counted(_follow(e, keys, len(rounds)), "follow")
        ahead = follow.select(*keys, F.col("vertex").alias("label"), F.col("label").alias("next"))
        rounds.append((unique_join(follow, ahead, [*keys, "label"], size).select(*keys, "vertex", F.col("next").alias("label")), size))
        labels = rounds[-1][0]
        for end in ("u", "v"):
            e = unique_join(e, labels.select(*keys, F.col("vertex").alias(end), F.col("label").alias(f"__{end}")), [*keys, end], n)
        e = e.select(*keys, F.greatest("__u", "__v").alias("u"), F.least("__u", "__v").alias("v")).where("u != v").distinct()
        e, n = counted(e, "edges")
    if not rounds:
        return e.select(*keys, F.col("u").alias("vertex"), F.col("v").alias("component"))
    found, _ = rounds[-1]
    for labels, size in reversed(rounds[:-1]):
        later = found.select(*keys, F.col("vertex").alias("label"), F.col("label").alias("last"))
        found = unique_join(labels, later, [*keys, "label"], size, "left").select(*keys, "vertex", F.coalesce("last", "label").alias("label"))
    found, size = counted(found, "labels")
    least = found.groupBy(*keys, "label").agg(F.min("vertex").alias("component"))
    return unique_join(found, least, [*keys, "label"], size).select(*keys, "vertex", "component")


def _follow(e: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """keys, vertex, label: of each vertex and its neighbours the first in the round's hashed order."""
    ways = F.array(*[F.struct(F.col(a).alias("vertex"), F.col(b).alias("near")) for a, b in (("u", "v"), ("v", "u"))])
    both = e.select(*keys, F.explode(ways).alias("w")).select(*keys, "w.*")
    rank = lambda c: F.struct(F.xxhash64(F.lit(seed), c).alias("h"), F.col(c).alias("id"))
    least = both.groupBy(*keys, "vertex").agg(F.min(rank("near")).alias("m"))
    return least.select(*keys, "vertex", F.least("m", rank("vertex"))["id"].alias("label"))
