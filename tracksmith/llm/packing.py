"""Packing documents into sequences: best fit of bounded groups of pieces, then swaps between underfull sequences."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracksmith.llm.lengths import encoding
from tracksmith.session import bounded_batches, written

#: Pieces in one group on average, which one task packs at a time.
GROUP = 32_768
END_ID = 2
#: Texts with this go to the tokenizers library whole; others have the same ids by the same ranks in tiktoken, which is faster.
SPECIAL = "<|"


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """A lower bound of the number of bins: for each k, pieces over capacity - k stand alone, those over half have a bin each, and
    what of the others of at least k doesn't fit beside them needs bins of its own."""
    count = np.bincount(sizes, minlength=capacity + 1)
    n_over, sum_over = np.cumsum(count[::-1])[::-1], np.cumsum((count * np.arange(capacity + 1))[::-1])[::-1]
    half = capacity // 2
    best = -(-int(sizes.sum()) // capacity)
    for k in range(1, half + 1):
        big = int(n_over[half + 1])
        beside = int(sum_over[half + 1]) - (int(sum_over[capacity - k + 1]) if k else 0)
        room = (big - int(n_over[capacity - k + 1])) * capacity - beside
        small = int(sum_over[k]) - int(sum_over[half + 1])
        best = max(best, big + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece: in falling order, each into the fullest bin that has room (a bit per free size tells which)."""
    where = np.zeros(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if fits := mask >> size:
            free = size + (fits & -fits).bit_length() - 1
            b = open_bins[free].pop()
            if not open_bins[free]:
                mask &= ~(1 << free)
        else:
            free, b, n = capacity, n, n + 1
        where[i] = b
        if free > size:
            open_bins[free - size].append(b)
            mask |= 1 << (free - size)
    return where


class Search:
    """Exchanges between bins that raise the sum of squared fills, until no exchange of the emptiest bins does or a bound is met."""

    def __init__(self, sizes: np.ndarray, where: np.ndarray, capacity: int) -> None:
        self.size, self.where, self.capacity = sizes, where.copy(), capacity
        self.fill = np.bincount(where, sizes, int(where.max()) + 1).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)

    def run(self) -> np.ndarray:
        goal, used = least_bins(self.size, self.capacity), int((self.fill > 0).sum())
        for a in np.argsort(self.fill, kind="stable").tolist():
            if used <= goal:
                break
            while 0 < self.fill[a] < self.capacity and self.exchange(a):
                pass
            used -= self.fill[a] == 0
        return self.where

    def exchange(self, a: int) -> bool:
        """The best move, one-for-one, one-for-two or two-for-one exchange that empties bin a further; False if there is none."""
        mine = np.flatnonzero(self.where == a)
        others = np.flatnonzero((self.where != a) & (self.fill[self.where] < self.capacity))
        if not len(others):
            return False
        bins, y = self.where[others], self.size[others]
        room = self.capacity - self.fill[bins] + y  # of the bin without the piece
        lead = self.fill[bins] - self.fill[a]
        # out: single pieces and pairs of a; of a size only one is asked for
        outs = {int(self.size[i]): (i,) for i in mine}
        if len(mine) > 1:
            i, j = np.triu_indices(len(mine), 1)
            both = self.size[mine[i]] + self.size[mine[j]]
            both, at = np.unique(both, return_index=True)
            pairs = {int(s): (mine[i[k]], mine[j[k]]) for s, k in zip(both, at, strict=True) if s < self.capacity}
        else:
            pairs = {}
        best, found = 0, None
        free_bins = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity) & (np.arange(len(self.fill)) != a))
        for x, out in outs.items():  # moves
            gain = np.where(self.capacity - self.fill[free_bins] >= x, x * (self.fill[free_bins] - self.fill[a] + x), 0)
            if len(gain) and gain.max() > best:
                best, found = int(gain.max()), (out, (), int(free_bins[gain.argmax()]))
        for x, out in [*outs.items(), *pairs.items()]:  # one for one, two for one
            gain = np.where((y < x) & (room >= x), (x - y) * (lead + x - y), 0)
            if gain.max() > best:
                k = int(gain.argmax())
                best, found = int(gain[k]), (out, (others[k],), int(bins[k]))
        if found is None and len(outs):
            found = self.pair_in(a, outs, others)
        if found is None:
            return False
        out, back, b = found
        moved = int(self.size[list(out)].sum()) - int(self.size[list(back)].sum() if back else 0)
        self.where[list(out)] = b
        if back:
            self.where[list(back)] = a
        self.fill[b] += moved
        self.fill[a] -= moved
        return True

    def pair_in(self, a: int, outs: dict, others: np.ndarray) -> tuple | None:
        """One piece of a for two of another bin. The two smallest of each bin, and each with its neighbour by size, are tried."""
        order = others[np.lexsort((self.size[others], self.where[others]))]
        bins, y = self.where[order], self.size[order]
        first = np.r_[True, bins[1:] != bins[:-1]]
        least = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        i = np.r_[np.arange(len(order)), np.arange(1, len(order))]
        j = np.r_[least, np.arange(len(order) - 1)]
        ok = (i != j) & (bins[i] == bins[j])
        i, j = i[ok], j[ok]
        if not len(i):
            return None
        both, b = y[i] + y[j], bins[i]
        room, lead = self.capacity - self.fill[b] + both, self.fill[b] - self.fill[a]
        best, found = 0, None
        for x, out in outs.items():
            gain = np.where((both < x) & (room >= x), (x - both) * (lead + x - both), 0)
            if gain.max() > best:
                k = int(gain.argmax())
                best, found = int(gain[k]), (out, (order[i[k]], order[j[k]]), int(b[k]))
        return found


def pack(sizes: np.ndarray, capacity: int, where: np.ndarray | None = None) -> np.ndarray:
    """The bin of each piece, from 0 without gaps: best fit (or the given bins), then exchanges among the underfull bins.

    Never more bins than it began with.
    """
    if not len(sizes):
        return np.zeros(0, np.int64)
    where = best_fit(sizes, capacity) if where is None else np.unique(where, return_inverse=True)[1]
    loose = np.flatnonzero(np.bincount(where, sizes)[where] < capacity)
    if len(loose):
        bins, own = np.unique(where[loose], return_inverse=True)
        where[loose] = bins[Search(sizes[loose], own, capacity).run()]
    return np.unique(where, return_inverse=True)[1]


@lru_cache(2)
def tokenizer(file: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(file)


def token_ids(text: str | None, file: str, ranks_file: str) -> np.ndarray:
    """Ids of a whole text as the tokenizers library gives them, then END_ID."""
    if not text:
        ids = []
    elif SPECIAL in text:
        ids = tokenizer(file).encode(text, add_special_tokens=False).ids
    else:
        ids = encoding(ranks_file).encode_ordinary(text)
    return np.array([*ids, END_ID], "<u4")


def token_pieces(docs: DataFrame, file: str, ranks_file: str, capacity: int = 1024, id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Written pieces: at (number of the piece, unique), id, piece, start, length, ids_crc32 and, if wanted, ids.

    Only documents over the capacity are cut: whole pieces at the end, what is left over first. A null text is empty (its end id alone).
    """
    bounded_batches(docs.sparkSession, 512)
    types = f"at long, `{id}` {docs.schema[id].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for b in batches:
            rows, owner, ids = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                coded = token_ids(t, file, ranks_file)
                ends = range((len(coded) - 1) % capacity + 1, len(coded) + 1, capacity)
                begin = 0
                for k, end in enumerate(ends):
                    part = coded[begin:end]
                    rows.append((at, k, begin, end - begin, zlib.crc32(part.tobytes())))
                    owner.append(i)
                    if with_ids:
                        ids.append(part.astype(np.int32))
                    begin, at = end, at + 1
            number = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if rows else None
            if number:
                columns = [number[0], b.column(0).take(pa.array(owner)), *number[1:]]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["at", id, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return written(docs.select(id, text).mapInArrow(cut, types), "pieces")


PLACES = "at long, length long, sequence_id long, offset long, fill long"


def _packed(groups: DataFrame, capacity: int, round: int) -> DataFrame:
    """PLACES of the pieces, packed group by group. groups: at, length, group, and sequence_id where bins are given."""

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        sizes = rows["length"].to_numpy(np.int64)
        bins = pack(sizes, capacity, rows["sequence_id"].to_numpy() if "sequence_id" in rows else None)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.r_[True, bins[order][1:] != bins[order][:-1]]
        before = ends - sizes[order]
        offset = np.empty(len(bins), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        number = ((int(rows["group"].iloc[0]) << 26) + (round << 25) + bins) * 2
        return pd.DataFrame({"at": rows["at"], "length": sizes, "sequence_id": number, "offset": offset, "fill": np.bincount(bins, sizes).astype(np.int64)[bins]})

    return written(groups.groupBy("group").applyInPandas(place, PLACES), "packed")


def pack_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """at, sequence_id, offset of all pieces (at, length). A full piece is a sequence of its own.

    The others are dealt by a hash into groups of about GROUP, each packed by one task; then the sequences still underfull are
    dealt anew, whole, and exchange pieces with those of other groups. Groups are bounded by their number, which follows the pieces.
    """
    full = pieces.where(F.col("length") == capacity).select("at", (F.col("at") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    small = pieces.where(F.col("length") < capacity).select("at", "length")
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(-(-n // GROUP)))
    n = small.count()
    if not n:
        return full
    places = _packed(small.withColumn("group", deal("at", n)), capacity, 0)
    if n > GROUP:
        loose = places.where(F.col("fill") < capacity)
        again = loose.count()
        if again:
            places = places.where(F.col("fill") == capacity).unionByName(_packed(loose.select("at", "length", "sequence_id", deal("sequence_id", again).alias("group")), capacity, 1))
    return full.unionByName(places.select("at", "sequence_id", "offset"))


def pack_documents(docs: DataFrame, file: str, ranks_file: str, capacity: int = 1024, id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Documents in as few sequences of at most capacity tokens as the search finds: id, piece, start, length, ids_crc32,
    sequence_id, offset and, if wanted, ids, a row per piece (token_pieces()).

    Repeated rows and null ids are documents of their own; equal lengths are placed by the number of the piece; an empty table
    gives none. Other columns are not read.
    """
    pieces = token_pieces(docs, file, ranks_file, capacity, id, text, with_ids)
    return pieces.join(pack_pieces(pieces, capacity), "at").drop("at")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the pieces of each sequence joined in order of their offsets (at most the capacity)."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(rows, lambda r: r["ids"])).alias("ids"))
