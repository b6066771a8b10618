"""Sharding by a k-d tree: distributed weighted medians along the widest metadata dimension. Native DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracksmith.session import written

#: Intervals of one pass of a median search; the driver sees at most nodes x BINS sums.
BINS = 1024
#: A cut may miss its node's wanted share by this part of a shard, so that equal texts stay together.
TOLERANCE = 0.002


@dataclass
class _Search:
    """The cut of one node: which key component is looked at, its interval, and the weight that goes left of the interval."""

    node: int
    shards: int
    want: float  # bytes that go left
    slack: float
    dim: str = ""
    level: int = 0  # 0: the dimension, 1: the text's hash, 2: the id
    lo: int = 0
    hi: int = 0
    left: float = 0.0  # bytes before the interval
    fixed: list[int] = field(default_factory=list)  # components found equal so far
    cut: list[int] | None = None  # rows whose components come before this go left


#: A group of equal texts beyond a shard is dealt into pieces of this part of a shard.
PIECE = 0.125


def numbered(df: DataFrame, by: list[str], within: list[str], out: str) -> DataFrame:
    """df with ``out``: the row's number from 0 without gaps within its group of by, in the order of within.

    Rows are range-sorted, and partitions' counts of each group are added up: no task sees a whole group.
    """
    sorted_ = written(df.repartitionByRange(*by, *within).sortWithinPartitions(*by, *within).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33).alias("_part")
    # one row per group and partition that holds some of it
    runs = sorted_.groupBy(*by, part).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    runs = runs.withColumn("_offset", F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")).drop("_n")
    return sorted_.withColumn("_part", F.shiftright("_at", 33)).join(runs, [*by, "_part"]).withColumn(out, F.col("_offset") + F.col("_at") - F.col("_first")).drop("_part", "_first", "_offset", "_at")


def with_place(df: DataFrame, name: str, out: str) -> DataFrame:
    """df with the place of a name in the order of all its distinct names, from 0; null is -1."""
    names = df.where(F.col(name).isNotNull()).select(F.col(name).alias("_name")).distinct().withColumn("_all", F.lit(0))
    places = numbered(names, ["_all"], ["_name"], out).drop("_all")
    return df.join(places, F.col(name) == F.col("_name"), "left").withColumn(out, F.coalesce(out, F.lit(-1)).cast("long")).drop("_name")


def _table(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """A literal table of whole numbers with one row per node that is being cut: at most as many as there are shards."""
    values = ", ".join("(" + ", ".join("null" if x is None else f"{x}L" for x in r) + ")" for r in rows)
    return F.broadcast(spark.sql(f"select * from values {values} as t({names})"))


def _coordinate(dims: list[str]) -> Column:
    """The value of the dimension whose number is in column dim."""
    return F.element_at(F.array(*dims), (F.col("dim") + 1).cast("int"))


def _widest(rows: DataFrame, dims: list[str]) -> dict[int, list]:
    """Bytes, and least and greatest value of each dimension, by node."""
    found = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).collect()
    return {r["node"]: [r["bytes"], {d: (r[f"lo_{d}"], r[f"hi_{d}"]) for d in dims}] for r in found}


def _pass(rows: DataFrame, dims: list[str], open_: list[_Search]) -> None:
    """Narrow every open search to the interval where the wanted weight falls."""
    facts = [(s.node, dims.index(s.dim), s.level, s.lo, s.hi, (s.hi - s.lo) // BINS + 1, *[*s.fixed, None, None][:2]) for s in open_]
    facts = _table(rows.sparkSession, "node, dim, level, lo, hi, width, fixed0, fixed1", facts)
    here = rows.join(facts, "node").withColumn("value", _coordinate(dims))
    here = here.where((F.col("fixed0").isNull() | (F.col("value") == F.col("fixed0"))) & (F.col("fixed1").isNull() | (F.col("tie") == F.col("fixed1"))))
    here = here.withColumn("at", F.when(F.col("level") == 0, F.col("value")).when(F.col("level") == 1, F.col("tie")).otherwise(F.col("id"))).where(F.col("at").between(F.col("lo"), F.col("hi")))
    bins = F.floor((F.col("at") - F.col("lo")) / F.col("width")).cast("long")
    table = here.groupBy("node", bins.alias("bin")).agg(F.sum("size").alias("w"), F.min("at").alias("least"), F.max("at").alias("most")).orderBy("node", "bin").collect()
    for s in open_:
        total = s.left
        for r in (r for r in table if r["node"] == s.node):
            if total + r["w"] < s.want:
                total += r["w"]
                continue
            under, over = s.want - total, total + r["w"] - s.want
            single = r["least"] == r["most"]
            if min(under, over) <= s.slack or (s.level == 2 and single):
                s.cut = [*s.fixed, r["least"] if under <= over else r["most"] + 1]
            elif single:
                s.fixed, s.level, s.lo, s.hi, s.left = [*s.fixed, r["least"]], s.level + 1, *_ALL, total
            else:
                s.lo, s.hi, s.left = r["least"], r["most"], total
            break
        else:
            s.cut = [*s.fixed, s.hi + 1]


_ALL = (-(1 << 62), 1 << 62)


def kdtree_shards(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", target_bytes: int | None = None) -> DataFrame:
    """Put every row into one of 0..shards-1 of nearly equal bytes: doc_id, size, text_crc32, shard, slot, and the text's dimensions.

    size: UTF-8 bytes of the text (null: none) plus 1. target_bytes: instead of a number of shards, the bytes that a leaf reaches.
    Equal texts are one point of the tree: its weight is the sum of their sizes, its dimensions are the places of the source and
    language names (of the row with the least id) and the text's size. Only a group that outweighs a shard is dealt by the
    hash of the id into pieces of PIECE of a shard. A node that holds k shards is cut at the weighted quantile k//2 of k along
    its widest dimension (range against the root's range; the first of equals). Along a dimension points are ordered by
    value, then by the text's hash, then by piece.

    Medians are exact to TOLERANCE of a shard, or to the point at the cut if that weighs more: each pass adds up bytes in at
    most BINS intervals per open node (a partial aggregate) and narrows to the interval of the wanted weight; all nodes of a
    level share a pass. slot counts a shard's rows without gaps, see numbered().

    Null and repeated ids and texts are allowed; rows equal in id and text stay together. Empty: empty.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.shiftright(F.xxhash64(whole), 2).alias("tie"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(_ALL[0])).alias("id"),
        F.col(source).cast("string").alias("source"),
        F.col(lang).cast("string").alias("lang"),
    )
    rows = written(rows, "metadata")
    same = ["tie", "text_crc32", "size"]  # a text's name: two hashes and its size
    groups = written(rows.groupBy(*same).agg(F.sum("size").alias("weight"), F.min(F.struct("id", "source", "lang")).alias("r")), "groups")
    total = groups.agg(F.sum("weight")).first()[0] or 0
    shards = shards if target_bytes is None else max(1, -(-total // target_bytes))
    heavy = groups.where(F.col("weight") > total / shards).select(*same, F.ceil(F.col("weight") / (PIECE * total / shards)).alias("pieces"))
    if heavy.isEmpty():
        rows = rows.withColumn("piece", F.lit(0).cast("long"))
        points = groups.withColumn("piece", F.lit(0).cast("long"))
    else:  # fewer heavy groups than shards
        rows = written(rows.join(F.broadcast(heavy), same, "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("id"), "pieces"), F.lit(0).cast("long"))).drop("pieces"), "pieces")
        points = rows.groupBy(*same, "piece").agg(F.sum("size").alias("weight")).join(groups.drop("weight"), same)
    points = points.select(F.col("tie"), F.col("text_crc32"), F.col("size").alias("d_size"), F.col("piece").alias("id"), F.col("weight").alias("size"), "r.source", "r.lang")
    for name in ("source", "lang"):
        points = with_place(points, name, f"d_{name}")
    names = ["d_source", "d_lang", "d_size"]
    # the node stands in the written table, so that no join is one with a constant
    points = written(points.select("tie", "text_crc32", "id", "size", *names, F.lit(1).cast("long").alias("node")), "points")
    held = {1: shards}  # node: how many shards
    root: dict | None = None
    while any(k > 1 for k in held.values()):
        facts = _widest(points, names)
        root = root or next((f[1] for f in facts.values()), {})
        searches = []
        for node, k in held.items():
            if k > 1:
                weight, ranges = facts.get(node, [0, {d: (0, 0) for d in names}])
                s = _Search(node, k, weight * (k // 2) / k, TOLERANCE * weight / k)
                s.dim = max(names, key=lambda d: ((ranges[d][1] - ranges[d][0]) / max(1, root[d][1] - root[d][0]) if root else 0, -names.index(d)))
                s.lo, s.hi = ranges[s.dim]
                if not weight:
                    s.cut = [0]
                searches.append(s)
        while open_ := [s for s in searches if s.cut is None]:
            _pass(points, names, open_)
        for s in searches:
            held |= {2 * s.node: s.shards // 2, 2 * s.node + 1: s.shards - s.shards // 2}
            del held[s.node]
        # points whose components come before the cut's go left; a short cut decides by its first components alone
        cuts = _table(docs.sparkSession, "node, dim, cut0, cut1, cut2", [(s.node, names.index(s.dim), *[*s.cut, None, None][:3]) for s in searches])
        at = _coordinate(names)
        later = F.coalesce((F.col("tie") < F.col("cut1")) | ((F.col("tie") == F.col("cut1")) & F.coalesce(F.col("id") < F.col("cut2"), F.lit(False))), F.lit(False))
        goes = F.when((at < F.col("cut0")) | ((at == F.col("cut0")) & later), 2 * F.col("node")).when(F.col("dim").isNotNull(), 2 * F.col("node") + 1).otherwise(F.col("node"))
        points = points.join(cuts, "node", "left").withColumn("node", goes).drop("dim", "cut0", "cut1", "cut2")
    # leaves in the order of the tree, left to right
    leaf = {node: i for i, node in enumerate(sorted(held, key=lambda n: n / (1 << n.bit_length())))}
    placed = points.join(_table(docs.sparkSession, "node, shard", list(leaf.items())), "node")
    placed = written(placed.select("tie", "text_crc32", (F.col("d_size")).alias("size"), F.col("id").alias("piece"), F.col("shard").cast("int").alias("shard"), "d_source", "d_lang"), "placed")
    out = rows.join(placed, [*same, "piece"]).select("doc_id", "size", "text_crc32", "shard", "d_source", "d_lang", F.col("size").alias("d_size"), "tie", "id")
    return numbered(out, ["shard"], ["tie", "id"], "slot").drop("tie", "id")
