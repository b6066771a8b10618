"""Conversation prefix trie: nodes are distinct turn prefixes; subtree sums roll up in depth bands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.session import written

#: Depths in one band: a node explodes to at most so many ancestors, and a window holds at most so many turns (default).
BAND = 16
#: Conversation ids in one hashed segment of a node's ends.
SEGMENT = 4096
#: Parents with more than 1 / HEAVY of all nodes as children are at most HEAVY rows, which is what makes them broadcastable.
HEAVY = 16_384

NODE = ["depth", "p1", "p2"]


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns: conv_id, part, pos (from 1, by turn, null first; equal turns by their hash), t1, t2 (128 bits of role and text), bytes of
    the text. Parts: conv_id, part, n (turns of the conversation in the part).

    Rows are dealt by ranges of (conv_id, turn), so that a conversation of any length spreads; positions are the place in a
    range's part of the conversation plus the sizes of the parts before it. Texts stay behind at the scan.
    """
    spark = conversations.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), role, text).alias("t2"), F.octet_length(text).alias("bytes")
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = written(rows.repartitionByRange(n, "conv_id", "turn", "t1", "t2").withColumn("part", F.spark_partition_id()), "turns")
    sizes = parts.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "t1", "t2"))
    turns = parts.withColumn("pos", within).join(starts, ["conv_id", "part"]).select("conv_id", "part", (F.col("pos") + F.col("start")).alias("pos"), "t1", "t2", "bytes")
    return turns, sizes


def shared_prefixes(turns: DataFrame, parts: DataFrame, step: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations and their rebuilt turns.

    Each conversation c takes its first h turns from conversation c - c % step (h: crc32 of the decimal id modulo most), then goes
    on with its own after its first h. Returns (conv_id, n: rebuilt turns) and turns as numbered_turns() gives them.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    sizes = parts.groupBy("conv_id").agg(F.sum("n").alias("own"))
    convs = sizes.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % step)
    base = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = convs.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = convs.withColumn("n", F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h")))
    # the base's first turns go to each conversation that may take them; which of these exist, the join tells
    takers = F.filter(F.sequence(F.col("conv_id") - (step - 1), F.col("conv_id") + (step - 1)), lambda c: c - c % step == F.col("conv_id"))
    lent = turns.where(F.col("pos") < most).where(F.col("conv_id") % step == 0).withColumn("conv_id", F.explode(takers)).where(F.col("pos") <= h)
    lent = lent.join(convs.select("conv_id"), "conv_id", "left_semi")
    # positions beyond h move by what the base could not give; a conversation that takes all h keeps them
    short = convs.where(F.col("taken") < F.col("h")).select("conv_id", (F.col("h") - F.col("taken")).alias("gap"))
    short = parts.select("conv_id", "part").join(short, "conv_id")  # a long conversation's parts meet this apart
    own = turns.where(F.col("pos") > h).join(short, ["conv_id", "part"], "left").withColumn("pos", F.col("pos") - F.coalesce("gap", F.lit(0))).drop("gap")
    return convs.select("conv_id", "n"), lent.unionByName(own).drop("part")


def prefixes(convs: DataFrame, turns: DataFrame, band: int = BAND) -> DataFrame:
    """Every prefix of every conversation: conv_id, depth (from 0), p1, p2 (key), q1, q2 (key of the prefix one turn shorter),
    bytes of the last text, ends (it is the whole conversation), up (keys of its prefixes in its band, itself last).

    A key is the exclusive or of hashes salted by position (two of 64 bits), so it is a running aggregate: within bands by a
    window, over bands by a second one of a row per band, which only conversations longer than a band have. A conversation's last prefix is found by its length.
    """
    salted = [F.xxhash64(F.lit(i), "pos", "t1", "t2").alias(f"x{i}") for i in (1, 2)]
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(0).alias("bytes"), F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("x2"))
    rows = roots.unionByName(turns.select("conv_id", "pos", "bytes", *salted)).withColumn("band", F.floor(F.col("pos") / band))
    rows = written(rows, "rebuilt")
    long = rows.groupBy("conv_id", "band").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    long = long.join(convs.where(F.col("n") >= band).select("conv_id"), "conv_id", "left_semi")
    long = long.select("conv_id", "band", *[F.bit_xor(c).over(before).alias(c) for c in ("b1", "b2")]).where("band > 0")
    running = Window.partitionBy("conv_id", "band").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = convs.select("conv_id", F.col("n").alias("pos"), F.lit(True).alias("ends"))
    rows = rows.join(long, ["conv_id", "band"], "left").join(last, ["conv_id", "pos"], "left")
    for i in (1, 2):
        rows = rows.withColumn(f"p{i}", F.bit_xor(f"x{i}").over(running).bitwiseXOR(F.coalesce(f"b{i}", F.lit(0))))
    up = F.collect_list(F.struct("p1", "p2")).over(running)
    key = [F.col(f"p{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"q{i}") for i in (1, 2)]
    return written(rows.select("conv_id", F.col("pos").alias("depth"), "p1", "p2", *key, "bytes", F.coalesce("ends", F.lit(False)).alias("ends"), up.alias("up")), "prefixes")


def _rolled(nodes: DataFrame, paths: DataFrame, values: list[str], deepest: int, band: int) -> DataFrame:
    """NODE and, for each column of values, its sum over the node's subtree.

    nodes: NODE, conv_id (a member) and values; paths: conv_id, depth and up of every prefix, with up reaching back to the
    band's first depth. A node explodes to its ancestors in its band only. Band roots with these sums are a tree of a band-th of
    the depth, completed by the same rollup; then each completed root is added to the ancestors in the band above it.
    """
    own = nodes.join(paths.select("conv_id", "depth", "up"), ["conv_id", "depth"])
    first = (F.floor(F.col("depth") / band) * band).alias("first")
    parts = own.select(first, F.posexplode("up").alias("i", "a"), *values).select((F.col("first") + F.col("i")).alias("depth"), "a.p1", "a.p2", *values)
    total = lambda df: df.groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in values])
    if deepest < band:
        return total(parts)
    inner = written(total(parts), "band-sums")
    # the tree of band roots: depth counts bands, a path is every band-th prefix
    every = paths.where(F.col("depth") % band == 0).select("conv_id", (F.col("depth") / band).cast("long").alias("depth"), F.col("up")[0].alias("k"))
    w = Window.partitionBy("conv_id", F.floor(F.col("depth") / band)).orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = written(every.select("conv_id", "depth", F.collect_list("k").over(w).alias("up")), "band-paths")
    member = nodes.where(F.col("depth") % band == 0).select(*NODE, "conv_id")
    tops = member.join(inner, NODE).withColumn("depth", (F.col("depth") / band).cast("long"))
    done = _rolled(tops, every, values, deepest // band, band).withColumn("depth", F.col("depth") * band)
    done = written(done.join(member, NODE), "band-roots").where("depth > 0")
    above = paths.where((F.col("depth") + 1) % band == 0).select("conv_id", (F.col("depth") + 1).alias("depth"), "up")
    handed = done.join(above, ["conv_id", "depth"]).select((F.col("depth") - band).alias("first"), F.posexplode("up").alias("i", "a"), *values)
    return total(inner.unionByName(handed.select((F.col("first") + F.col("i")).alias("depth"), "a.p1", "a.p2", *values)))


def ends_hashes(ends: DataFrame) -> DataFrame:
    """NODE, ends_sha256: the hash of the ids that end at a node, ascending and comma-joined. ends: NODE, conv_id.

    Ids meet in segments of SEGMENT consecutive ids. A node with one segment is hashed by Spark; the segments of the others
    stream in order through one hash each, a segment a row, so that no node's ids are held at once.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    segments = written(ends.groupBy(*NODE, F.floor(F.col("conv_id") / SEGMENT).alias("segment")).agg(ids.alias("ids")), "ends")
    count = segments.groupBy(*NODE).agg(F.count("*").alias("n"))
    several = count.where("n > 1").select(*NODE)
    one = segments.join(count.where("n = 1").select(*NODE), NODE).select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        names = [*NODE, "ends_sha256"]
        for b in batches:
            done = []
            for d, p1, p2, text in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if (d, p1, p2) != node:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (d, p1, p2), hashlib.sha256(text.encode())
                else:
                    state.update(f",{text}".encode())
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], HASHED)
        if node:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*node, state.hexdigest()), strict=True))], HASHED)

    many = segments.join(several, NODE).repartition(*NODE).sortWithinPartitions(*NODE, "segment").select(*NODE, "ids")
    return one.unionByName(many.mapInArrow(stream, "depth long, p1 long, p2 long, ends_sha256 string"))


HASHED = pa.schema([("depth", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("ends_sha256", pa.string())])


def with_parent(nodes: DataFrame, n_nodes: int) -> DataFrame:
    """nodes with parent_conv_id. Children of the few parents with very many find them in a broadcast, all others by a join."""
    least = max(1024, n_nodes // HEAVY)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    heavy = F.broadcast(parents.where(F.col("n_children") > least).select("depth", "q1", "q2", F.col("parent_conv_id").alias("heavy")))
    marked = nodes.join(heavy, ["depth", "q1", "q2"], "left")
    light = parents.where(F.col("n_children") <= least).drop("n_children")
    found = marked.where("heavy is null and depth > 0").join(light, ["depth", "q1", "q2"]).drop("heavy")
    rest = marked.where("heavy is not null or depth = 0").withColumnRenamed("heavy", "parent_conv_id")
    return found.unionByName(rest)


def prefix_trie(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, the empty prefix (root) included.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless nodes of its
    subtree), saved_tokens (over the subtree, (n_convs - 1) times the bytes of the last text), ends_sha256.

    Null roles and texts are empty; rows of no conversation (null conv_id) are left out; a null turn comes first; rows of equal turn
    are ordered by a hash of role and text, and repeated rows are turns of their own. A conversation whose prefix has no
    base and that has no turns of its own left is a member of the root alone. An empty table has no nodes. Other columns are not read.
    """
    convs, turns = shared_prefixes(*numbered_turns(conversations))
    convs = written(convs, "convs")
    every = prefixes(convs, turns, band)
    merged = every.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("q1").alias("q1"), F.first("q2").alias("q2"), F.max("bytes").alias("bytes"), F.count_if("ends").alias("n_ends"))
    leaf = (F.col("n_ends") == F.col("n_convs")).cast("long")
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    nodes = written(merged.select(*NODE, "q1", "q2", "conv_id", "n_convs", leaf.alias("n_leaves"), saved.alias("saved_tokens")), "nodes")
    deepest, n_nodes = nodes.agg(F.coalesce(F.max("depth"), F.lit(0)), F.count("*")).first()
    totals = _rolled(nodes.select(*NODE, "conv_id", "n_leaves", "saved_tokens"), every, ["n_leaves", "saved_tokens"], deepest, band)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    full = nodes.drop("n_leaves", "saved_tokens").join(totals, NODE).join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    full = full.join(ends_hashes(every.where("ends").select(*NODE, "conv_id")), NODE, "left")
    full = full.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    out = with_parent(written(full, "trie"), n_nodes)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: crc32 of an id's decimal digits, from the polynomial, as DuckDB lists: a table of 256 entries, then one step per character.
CRC = (
    "tab as materialized (select list(list_reduce(range(8), lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, c) order by c) as t from range(256) g(c)), "
    "ids as materialized (select distinct conv_id::bigint as conv_id from conversations where conv_id is not null), "
    "hs as materialized (select conv_id, xor(list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s)::bigint), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 9 as h from ids, tab)"
)
ORACLE_SQL = f"""
with {CRC},
ts as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first) as pos from conversations where conv_id is not null),
cs as (select ts.conv_id, max(pos) as own, any_value(h) as h from ts join hs using (conv_id) group by ts.conv_id),
cb as (select c.conv_id, c.own, c.h, c.conv_id - c.conv_id % 5 as base, least(c.h, coalesce(b.own, 0)) as taken from cs c left join cs b on b.conv_id = c.conv_id - c.conv_id % 5),
rb as (select cb.conv_id, ts.pos, role, text from cb join ts on ts.conv_id = cb.base and ts.pos <= cb.h
  union all select cb.conv_id, ts.pos - cb.h + cb.taken, role, text from cb join ts on ts.conv_id = cb.conv_id and ts.pos > cb.h),
pf as materialized (select conv_id, pos as depth, sha256(string_agg(sha256(role) || sha256(text), '/') over (partition by conv_id order by pos rows unbounded preceding)) as k, strlen(text) as bytes, pos = max(pos) over (partition by conv_id) as ends from rb
  union all select conv_id, 0, 'root', 0, conv_id not in (select conv_id from rb) from cb),
up as (select conv_id, depth, k, bytes, ends, lag(k) over (partition by conv_id order by depth) as parent from pf),
nd as materialized (select k, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(parent) as parent, any_value(bytes) as bytes, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '') as e from up group by k, depth),
kids as (select parent as k, depth - 1 as depth, count(*) as n_children from nd where depth > 0 group by 1, 2),
own as (select nd.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * bytes as saved from nd left join kids using (k, depth)),
roll as (select p.k, p.depth, sum((own.n_children = 0)::int) as n_leaves, sum(own.saved) as saved_tokens from own join pf p on p.conv_id = own.conv_id and p.depth <= own.depth group by 1, 2)
select own.conv_id, own.depth::bigint as depth, pa.conv_id as parent_conv_id, own.n_convs, own.n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, sha256(own.e) as ends_sha256
from own join roll using (k, depth) left join own pa on pa.k = own.parent and pa.depth = own.depth - 1
"""
