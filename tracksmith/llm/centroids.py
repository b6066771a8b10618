"""Centroid clustering of whole-number vectors. Squared distances are gathered from scalar lookup tables and summed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracksmith.session import bounded_batches, written

#: Vectors in one block; a component's place among the block's values fits two bytes.
BLOCK = 4096
#: Components beyond this size count as this size, so that every squared distance of up to 64 of them fits a long.
MOST = 1 << 27
BLOCKS = "n int, ids array<long>, sizes binary, known binary, codes binary"


@dataclass
class Block:
    """Vectors coded by dimension: known[d] holds the values that occur there, codes[d] each vector's place among them."""

    ids: list
    known: list[np.ndarray]
    codes: np.ndarray

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """Squared distances to each centroid: one table per dimension (value by centroid), gathered by code and summed."""
        out = np.zeros((len(self.ids), len(centroids)), np.int64)
        for d, values in enumerate(self.known):
            table = (values[:, None] - centroids[None, :, d]) ** 2
            out += table[self.codes[d]]
        return out

    def sums(self, near: np.ndarray, k: int) -> np.ndarray:
        """Component sums of each cluster's vectors: counts of (cluster, value) times the values, cluster by dimension."""
        out = np.zeros((k, len(self.known)), np.int64)
        for d, values in enumerate(self.known):
            counts = np.bincount(near * len(values) + self.codes[d], minlength=k * len(values))
            out[:, d] = counts.reshape(k, len(values)) @ values
        return out

    def vector(self, i: int) -> list[int]:
        return [int(values[c]) for values, c in zip(self.known, self.codes[:, i], strict=True)]


def whole_rows(column: pa.ListArray, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors with exactly dims finite components, and floor(scale * x) of these."""
    n = len(column)
    valid = np.asarray(column.is_valid())
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0))
    at = np.flatnonzero(valid & (lengths == dims))
    values = pa.compute.list_flatten(column.take(pa.array(at))) if n else column.values[:0]
    x = np.asarray(pa.compute.fill_null(values, np.nan), float).reshape(len(at), dims)
    good = np.isfinite(x).all(1)
    return at[good], np.floor(np.clip(x[good], -MOST / scale, MOST / scale) * scale).astype(np.int64)


def vector_blocks(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 1024) -> DataFrame:
    """The kept vectors as coded blocks of at most BLOCK, written to the shared folder; no shuffle."""
    bounded_batches(vectors.sparkSession, BLOCK)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = whole_rows(b.column(1), dims, scale)
            if not len(at):
                continue
            known, codes = zip(*[np.unique(x[:, d], return_inverse=True) for d in range(dims)], strict=True)
            ids = pa.array([b.column(0).take(pa.array(at)).to_pylist()], pa.list_(pa.int64()))
            packed = [np.array([len(v) for v in known], "<i4"), np.concatenate(known).astype("<i4"), np.array(codes, "<u2").reshape(dims, -1)]
            yield pa.RecordBatch.from_arrays([pa.array([len(at)], pa.int32()), ids, *[pa.array([p.tobytes()], pa.binary()) for p in packed]], names=["n", "ids", "sizes", "known", "codes"])

    return written(vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).mapInArrow(code, BLOCKS), "blocks")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for r in b.to_pylist():
            known = np.frombuffer(r["known"], "<i4").astype(np.int64)
            ends = np.cumsum(np.frombuffer(r["sizes"], "<i4"))
            yield Block(r["ids"], np.split(known, ends[:-1]), np.frombuffer(r["codes"], "<u2").reshape(len(ends), r["n"]).astype(np.int64))


def first_centroids(blocks: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:id``, in that order (equal ids by their components)."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[str, list[int]]] = []
        for block in _blocks(batches):
            keys = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest() for i in block.ids]
            best = sorted(best + [(keys[i], block.vector(i)) for i in sorted(range(len(keys)), key=keys.__getitem__)[:k]])[:k]
        yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.list_(pa.int64()))], names=["key", "x"])

    rows = blocks.mapInArrow(least, "key string, x array<long>").orderBy("key", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def cluster_totals(blocks: DataFrame, centroids: np.ndarray) -> tuple[list[int], list[list[int]], list[int]]:
    """Sizes, component sums and summed distances of the clusters nearest to each centroid.

    Each task adds up its own blocks; Spark adds the tasks' k * (dims + 3) numbers, which alone reach the driver.
    """
    k, dims = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 3), np.int64)
        for block in _blocks(batches):
            far = block.distances(centroids)
            near = far.argmin(1)
            total[:, :dims] += block.sums(near, k)
            least = far[np.arange(len(near)), near]
            for c in range(k):
                own = least[near == c]
                total[c, dims:] += (len(own), int((own >> 32).sum()), int((own & 0xFFFFFFFF).sum()))
        cluster, part = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel()) for a in (cluster, part, total)], names=["cluster", "part", "total"])

    sums = blocks.mapInArrow(partial, "cluster long, part long, total long").groupBy("cluster", "part").agg(F.sum("total").alias("total"))
    found = np.zeros((k, dims + 3), object)
    for r in sums.collect():
        found[r["cluster"], r["part"]] = int(r["total"])
    return list(found[:, dims]), found[:, :dims].tolist(), [int(h) * (1 << 32) + int(low) for h, low in found[:, dims + 1 :]]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, id: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 1024) -> DataFrame:
    """Lloyd rounds over whole-number vectors floor(scale * x), exact in every step.

    Returns id, cluster, distance (squared, to the last centroid), cluster_inertia, inertia, centroid_sha256 per kept vector.
    Kept: vectors with exactly dims components, none null or not finite. Ties of distance go to the smaller cluster number;
    an emptied centroid stays. Repeated rows are vectors of their own, a null id is hashed as the empty string, fewer than
    k kept vectors are as many centroids, and none at all give an empty table. Components beyond MOST / scale count as that;
    an inertia beyond a long is the greatest long. Other columns are not read.

    The vectors are coded once, in blocks: a round reads the blocks, tabulates per dimension the squared difference of each
    value that occurs there to each centroid, and gathers. No vectors are shuffled.
    """
    spark = vectors.sparkSession
    blocks = vector_blocks(vectors, id, vector, dims, scale)
    centroids = first_centroids(blocks, k, seed)
    names = [id, "cluster", "distance"]
    if not len(centroids):
        return spark.createDataFrame([], f"`{id}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        sizes, sums, _ = cluster_totals(blocks, centroids)
        centroids = np.array([[s // n for s in row] if n else old.tolist() for n, row, old in zip(sizes, sums, centroids, strict=True)], np.int64)
    inertias = cluster_totals(blocks, centroids)[2]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            far = block.distances(centroids)
            near = far.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(block.ids, pa.int64()), pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(near)), near])], names=names)

    fit = lambda v: F.lit(min(v, (1 << 63) - 1)).cast("long")
    placed = blocks.mapInArrow(assign, f"`{id}` long, cluster int, distance long")
    return placed.select(
        *names,
        F.array(*[fit(v) for v in inertias])[F.col("cluster")].alias("cluster_inertia"),
        fit(sum(inertias)).alias("inertia"),
        F.array(*[F.lit(h) for h in digests])[F.col("cluster")].alias("centroid_sha256"),
    )


def _round_sql(r: int, k: int, dims: int) -> str:
    return f"""
d{r} as (select v.row, c.c, sum((v.x - c.x) * (v.x - c.x)) as far from v join c{r} c on v.d = c.d group by v.row, c.c),
a{r} as (select row, arg_min(c, (far, c)) as c, min(far) as far from d{r} group by row)"""


def oracle_sql(k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024) -> str:
    """DuckDB SQL of the same rows, a group of common table expressions per round (fixed values as in the contract)."""
    parts = [
        f"""with e as (select row_number() over () as row, vec_id, embedding from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims}),
v as (select row, unnest(range({dims})) as d, floor({scale} * unnest(embedding)::double)::bigint as x from e),
s as (select row, row_number() over (order by sha256('{seed}:' || vec_id::varchar)) - 1 as c from e),
c0 as (select s.c, v.d, v.x from s join v on s.row = v.row where s.c < {k})"""
    ]
    for r in range(rounds):
        parts.append(_round_sql(r, k, dims))
        parts.append(f"""
m{r} as (select a.c, v.d, sum(v.x) as t, count(*) as n from a{r} a join v on a.row = v.row group by a.c, v.d),
c{r + 1} as (select c.c, c.d, case when m.n is null then c.x else ((m.t - ((m.t % m.n) + m.n) % m.n) // m.n)::bigint end as x from c{r} c left join m{r} m on m.c = c.c and m.d = c.d)""")
    parts.append(_round_sql(rounds, k, dims))
    parts.append(f"""
h as (select c, sha256(string_agg(x::varchar, ',' order by d)) as centroid_sha256 from c{rounds} group by c)""")
    last = f"""
select e.vec_id, a.c::int as cluster, a.far::bigint as distance, (sum(a.far) over (partition by a.c))::bigint as cluster_inertia, (sum(a.far) over ())::bigint as inertia, h.centroid_sha256
from a{rounds} a join e on e.row = a.row join h on h.c = a.c"""
    return ",".join(parts) + last
