"""SimHash near-duplicates found with BK-trees over shards of the fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracksmith.llm.text import as_bytes, own_names
from tracksmith.operators.components import connected_components
from tracksmith.session import bounded_batches, broadcast_if_small, written

#: Fingerprints in one tree; a shard with more is dealt into segments of about this many.
TREE_SIZE = 1024
#: Blocks of a fingerprint: for radius 3 the shards of 10 pairs of five blocks, about 26 equal bits each.
BLOCKS = 5


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The text's 64-bit SimHash over word shingles, unsigned; 0 without words.

    A-Z are lowered; a text with fewer than width words has one shingle, its whole word sequence.
    """
    words = as_bytes(text).lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(width, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), 1 << 16):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", width: int = 3) -> DataFrame:
    """docs with the fingerprint of a text column as a signed long; null texts have 0."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(out, prints(F.col(text)))


class BKTree:
    """Children are keyed by their Hamming distance to the parent; a search follows only edges within the radius."""

    def __init__(self, values=()) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        for v in values:
            self.add(v)

    def add(self, value: int) -> None:
        """Hang a value below the last one on its way; a value that the tree holds already is not added again."""
        at = 0
        while at < len(self.values):
            d = (self.values[at] ^ value).bit_count()
            if not d:
                return
            if d not in self.children[at]:
                self.children[at][d] = len(self.values)
                break
            at = self.children[at][d]
        self.values.append(value)
        self.children.append({})

    def near(self, value: int, radius: int) -> list[int]:
        return [self.values[t] for t in self.near_many(np.array([value], np.uint64), radius)[1].tolist()]

    def near_many(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the query, place of the tree's value) of all pairs within the radius; the queries walk the tree together."""
        found: list[tuple[np.ndarray, int]] = []
        todo = [(0, np.arange(len(queries)))] if self.values and len(queries) else []
        while todo:
            at, active = todo.pop()
            d = np.bitwise_count(queries[active] ^ np.uint64(self.values[at])).astype(np.int16)
            if len(hit := active[d <= radius]):
                found.append((hit, at))
            for e, child in self.children[at].items():
                if len(go := active[np.abs(d - e) <= radius]):
                    todo.append((child, go))
        if not found:
            return np.zeros(0, np.intp), np.zeros(0, np.intp)
        return np.concatenate([h for h, _ in found]), np.repeat([t for _, t in found], [len(h) for h, _ in found])


def _spanning_links(tree_values: np.ndarray, queries: np.ndarray | None, radius: int) -> np.ndarray:
    """Links (rows of two values) of a block that join two of its groups; the others follow from these. queries None: the tree's own values."""
    tree = BKTree(tree_values.tolist())
    asked = tree_values if queries is None else queries
    q, t = tree.near_many(asked, radius)
    held = np.array(tree.values, np.uint64)
    names, at = np.unique(np.concatenate([held, asked]), return_inverse=True)
    t, q = at[: len(held)][t], at[len(held) :][q]
    order = np.argsort(q, kind="stable")
    q, t = q[order], t[order]
    label, links = np.arange(len(names)), []
    for x, near in zip(*(np.unique(q)[:, None].ravel(), np.split(t, np.flatnonzero(np.diff(q)) + 1)), strict=True) if len(q) else ():
        for y in near[np.unique(label[near], return_index=True)[1]].tolist():
            if label[x] != label[y]:
                links.append((names[x], names[y]))
                label[label == label[y]] = label[x]
    return np.array(links, np.uint64).reshape(-1, 2)


def _blocks(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each block as they stream by, sorted by the columns of by."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[by].to_numpy(np.int64)
        for part in np.split(np.arange(len(batch)), np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1):
            rows = batch.iloc[part[0] : part[-1] + 1]
            if held and (held[0][by].iloc[0].to_numpy(np.int64) != keys[part[0]]).any():
                yield pd.concat(held)
                held = []
            held.append(rows)
    if held:
        yield pd.concat(held)


def _search(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(batches, ["band", "key", "a", "b"]):
            values = block["fp"].to_numpy(np.int64).view(np.uint64)
            in_tree = (block["seg"] == block["a"]).to_numpy()
            inside = block["a"].iloc[0] == block["b"].iloc[0]
            yield _frame(_spanning_links(values[in_tree], None if inside else values[~in_tree], radius))

    return run


def _frame(links: np.ndarray) -> pd.DataFrame:
    pairs = links.view(np.int64)
    return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})


def shard_masks(radius: int, blocks: int) -> list[int]:
    """Bit masks of which at least one agrees for any two 64-bit values within the radius.

    64 bits are cut in so many blocks; radius changed bits leave at least blocks - radius blocks equal.
    """
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << hi) - (1 << lo)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def fingerprint_links(prints: DataFrame, radius: int = 3, blocks: int | None = None, tree_size: int = TREE_SIZE) -> DataFrame:
    """Links (u, v) between distinct fingerprints that differ in at most radius bits, enough to span every linked group.

    prints: one column ``fp`` of distinct signed longs. Each fingerprint is put into the shards of shard_masks(); a shard's
    BK-tree is searched with the shard's own fingerprints. A shard beyond tree_size is dealt into segments by hash; each pair
    of segments is a block of its own, so a hot shard spreads over many tasks and a tree's size is bounded. Exact: no cap.
    blocks: more give more and smaller shards; the links are the same.
    """
    masks = shard_masks(radius, blocks or max(BLOCKS, radius + 1))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("band", "key"))
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    n_seg = F.ceil(F.col("n") / F.lit(tree_size)).cast("int")
    dealt = (
        keyed.join(sizes, ["band", "key"])
        .withColumn("seg", F.pmod(F.xxhash64("fp", "band"), n_seg).cast("int"))
        .withColumn("t", F.explode(F.sequence(F.lit(0), n_seg - 1)))
        .select("band", "key", F.least("seg", "t").alias("a"), F.greatest("seg", "t").alias("b"), "seg", "fp")
    )
    blocks_of = dealt.repartition("band", "key", "a", "b").sortWithinPartitions("band", "key", "a", "b", "fp")
    return blocks_of.mapInPandas(_search(radius), "u long, v long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3, tree_size: int = TREE_SIZE) -> DataFrame:
    """One row for each row of docs: doc_id, node (the text's name), fp (long), component_id (least id reachable over links, own id
    included), component (the group's least fingerprint).

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows stay repeated. A null id takes part but
    never names a component; a component without any id has a null component_id. Extra columns are not read. Empty: empty.
    Equal fingerprints are first merged into one, so a group of copies costs one value in the search.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), text_name(F.col(text)).alias("node"))
    fps = written(with_fingerprint(given, "text", "fp", width).select("doc_id", "node", "fp"), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = connected_components(fingerprint_links(distinct.select("fp"), radius, tree_size=tree_size))
    roots = distinct.join(found.select(F.col("vertex").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = roots.groupBy("component").agg(F.min("least").alias("component_id"))
    final = roots.join(names, "component").select("fp", "component_id", "component")
    return fps.join(final, "fp").select("doc_id", "node", "fp", "component_id", "component")


def text_name(text: Column) -> Column:
    """A text's name: 64 bits of hash over its bytes, crc32 and length; null as the empty text."""
    whole = F.coalesce(text, F.lit(""))
    return F.xxhash64(whole, F.crc32(whole.cast("binary")), F.length(whole))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each group of near_duplicates(), chosen as in one_of_each()."""
    return one_of_each(docs, near_duplicates(docs, doc_id, text, **options), doc_id, text)


def one_of_each(docs: DataFrame, classes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs with one row of each component of classes(doc_id, node, component): the one with the least id (null ids last), of rows
    with that id the one whose text's name is least, of rows alike in both one; columns stay and may have any names."""
    names = own_names(docs, "id", "node")
    best = classes.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("best"))
    rows = classes.groupBy("doc_id", "node").agg(F.count("*").alias("n"))
    picked = best.select(F.col("best.doc_id").alias(names["id"]), F.col("best.node").alias(names["node"]))
    picked = written(picked.join(rows, F.col(names["id"]).eqNullSafe(F.col("doc_id")) & (F.col(names["node"]) == F.col("node"))).select(*names.values(), "n"), "picked")
    own = [F.col(f"`{c}`") for c in docs.columns]
    here = (text_name(F.col(f"`{text}`")) == F.col(names["node"])) & F.col(f"`{doc_id}`").eqNullSafe(F.col(names["id"]))
    kept = docs.join(picked.where("n = 1").drop("n"), here).select(*own)
    repeated = picked.where("n > 1").drop("n")
    if repeated.isEmpty():
        return kept
    return kept.unionByName(docs.join(repeated, here).dropDuplicates([*names.values()]).select(*own))


# ---- near copies by shingle similarity

#: Bins of a text's sketch, one byte each; min-hashes of a shard key and shard keys of a text.
BINS, KEY_HASHES, KEYS = 256, 3, 12
#: Texts of similarity 0.8 differ in about 10 of 64 bits; a search reaches over four spreads beyond.
WIDE_RADIUS = 22
SIMILAR = 0.8
#: What the sketch's share of equal bins may fall below the similarity: four times its own spread (0.025 at 0.8). The sketch
#: only picks candidates; the shingle sets decide.
SLACK = 0.1
#: Bytes of shingle sets in one segment of a shard.
SEGMENT_BYTES = 16 << 20
#: Texts whose sets are needed that are broadcast at most (two numbers each).
BROADCAST_TEXTS = 1 << 20

_MULTIPLIERS = np.random.default_rng(64).integers(1 << 62, 1 << 63, KEY_HASHES * KEYS, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """Distinct XXH64 values of a text's word shingles (A-Z lowered); a shorter text is one shingle, one without words none."""
    words = as_bytes(text).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, width = b" ".join(words), min(width, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def sketch(hashes: np.ndarray) -> tuple[int, bytes, list[int]]:
    """SimHash of a shingle set, its one-permutation sketch (a byte of the least hash of each bin, 0: empty), and shard keys."""
    if not len(hashes):
        return 0, bytes(BINS), [0] * KEYS
    ones = np.zeros(64, np.int64)
    least = np.full((KEYS * KEY_HASHES,), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1 << 16):
        h = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        mixed = h ^ (h >> np.uint64(29))
        least = np.minimum(least, [(mixed * m).min() for m in _MULTIPLIERS])
    fp = int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")
    bins = np.zeros(BINS, np.uint8)
    at = (hashes >> np.uint64(56)).astype(np.intp)
    first = np.flatnonzero(np.diff(at, prepend=-1))  # hashes are sorted, so the first of a bin is its least
    bins[at[first]] = hashes[first] % np.uint64(255) + np.uint64(1)
    keys = [xxhash.xxh64_intdigest(least[i : i + KEY_HASHES].tobytes(), i) for i in range(0, len(least), KEY_HASHES)]
    return fp, bins.tobytes(), keys


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets from their sketches: equal bins among those that either set fills."""
    filled = np.count_nonzero(a | b)
    return np.count_nonzero((a == b) & (a > 0)) / filled if filled else 1.0


def exact_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two arrays of distinct shingle hashes; 1 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _equal_bins(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """similarity() of rows of two arrays of sketches."""
    filled = np.count_nonzero(a | b, axis=1)
    same = np.count_nonzero((a == b) & (a > 0), axis=1)
    return np.where(filled > 0, same / np.maximum(filled, 1), 1.0)


def _sketches(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, BINS)


def _search_similar(radius: int, least: float):
    """Links (u, v) of each block that join two of its groups: exact, enough to span what the block links.

    Candidates are BK-tree neighbours of two groups whose sizes allow the similarity and whose sketches come near it. Two texts
    that share several keys are a candidate in the shard of the first of these alone. Candidates are tested by their whole shingle
    sets, nearest sketches first; two texts that a link has brought together need no test.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(batches, ["key", "a", "b"]):
            node, key = block["node"].to_numpy(np.int64), block["key"].iloc[0]
            fp, bins = block["fp"].to_numpy(np.int64).view(np.uint64), _sketches(block["sketch"])
            keys = np.array(block["keys"].tolist(), np.int64).reshape(len(block), -1)
            sets = [np.frombuffer(v, np.uint64) for v in block["set"]]
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            label = np.unique(block["group"].to_numpy(np.int64), return_inverse=True)[1]
            x, y = _neighbours(fp, (block["seg"] == block["a"]).to_numpy(), block["a"].iloc[0] == block["b"].iloc[0], radius)
            pairs = [(np.zeros(0, np.intp), np.zeros(0, np.intp), np.zeros(0))]
            for i in range(0, len(x), 1 << 14):
                u, v = x[i : i + (1 << 14)], y[i : i + (1 << 14)]
                good = (label[u] != label[v]) & (np.minimum(size[u], size[v]) >= least * np.maximum(size[u], size[v]) - 1e-6)
                u, v = u[good], v[good]
                same = keys[u] == keys[v]
                good = keys[u, same.argmax(axis=1)] == key
                u, v = u[good], v[good]
                found = _equal_bins(bins[u], bins[v])
                good = found >= least - SLACK
                pairs.append((u[good], v[good], found[good]))
            x, y, found = (np.concatenate(c) for c in zip(*pairs, strict=True))
            order = np.argsort(-found, kind="stable")
            links = []
            for u, v in zip(x[order].tolist(), y[order].tolist(), strict=True):
                if label[u] != label[v] and exact_similarity(sets[u], sets[v]) >= least - 1e-9:
                    links.append((node[u], node[v]))
                    label[label == label[v]] = label[u]
            yield pd.DataFrame(np.array(links, np.int64).reshape(-1, 2), columns=["u", "v"])

    return run


def _neighbours(fp: np.ndarray, in_tree: np.ndarray, inside: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y) of a block's texts whose fingerprints lie within the radius, each pair once: of the tree's texts and the
    others, or if inside of the tree's own."""
    held = np.flatnonzero(in_tree)
    asked = held if inside else np.flatnonzero(~in_tree)
    # texts with one fingerprint are one value of the tree
    values, which = np.unique(fp[held], return_inverse=True)
    order = np.argsort(which, kind="stable")
    first = np.searchsorted(which[order], np.arange(len(values) + 1))
    tree = BKTree(np.random.default_rng(1).permutation(values).tolist())
    place = np.searchsorted(values, np.array(tree.values, np.uint64))
    q, t = tree.near_many(fp[asked], radius)
    size = (first[1:] - first[:-1])[place[t]]
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[place[t]], size)
    x, y = asked[np.repeat(q, size)], held[order[at]]
    return (x[x < y], y[x < y]) if inside else (x, y)


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, least: float = SIMILAR, radius: int = WIDE_RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """One row per row of docs: doc_id, node (the text's name), class_id (least doc_id of the row's class). Classes: texts whose sets
    of width-word shingles have a similarity of least or more, over links.

    Equal texts become one. Each text goes to the shards of KEYS keys, each of KEY_HASHES min-hashes: two texts of similarity 0.8
    share one with probability 1 - (1 - 0.8^3)^12 = 0.9998. First each text is compared with one centre of its shards, the
    one of nearest sketch, so that a large group of copies becomes one class in two joins. Then only shards that still hold two
    classes are searched: their BK-trees of SimHashes within a wide radius, all pairs of two classes; a shard beyond tree_size
    texts or SEGMENT_BYTES of shingle sets is dealt into segments, each pair of segments a block of its own. Sketches that agree
    within SLACK only make a candidate; the block, which holds the texts' whole shingle sets, decides by their exact overlap. No
    candidate of two classes goes untested; those within one class need no test, so a block of n texts makes fewer than n links.
    Texts without words are one class. Null ids: as in near_duplicates(). Empty: empty.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("struct<fp: long, sketch: binary, keys: array<long>, size: long>")
    def sketches(texts: pd.Series) -> pd.DataFrame:
        hashes = [shingle_hashes(t, width) for t in texts]
        found = [sketch(h) for h in hashes]
        fps, keys = np.array([f for f, _, _ in found], np.uint64).view(np.int64), [np.array(k, np.uint64).view(np.int64) for _, _, k in found]
        return pd.DataFrame({"fp": fps, "sketch": [s for _, s, _ in found], "keys": keys, "size": list(map(len, hashes))})

    @F.pandas_udf("double")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(_equal_bins(_sketches(left), _sketches(right)) if len(left) else np.zeros(0))

    @F.pandas_udf("binary")
    def shingle_sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t, width).tobytes() for t in texts], dtype=object)

    @F.pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([exact_similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least - 1e-9 for x, y in zip(left, right, strict=True)], dtype=bool)

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), text_name(F.col(text)).alias("node"))
    rows = written(given.select("doc_id", "node", sketches("text").alias("s")).select("doc_id", "node", "s.*"), "sketches")
    texts = written(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.any_value("fp").alias("fp"), F.any_value("sketch").alias("sketch"), F.any_value("keys").alias("keys"), F.any_value("size").alias("size")), "texts")

    def sets_of(nodes: DataFrame) -> DataFrame:
        """Shingle sets (node, set) of some texts; each is read from one row, so that a group of equal texts doesn't meet in one task."""
        needed = nodes.distinct().join(texts.select("node", "least"), "node").select(F.col("node").alias("of"), "least")
        needed = broadcast_if_small(written(needed, "needed"), BROADCAST_TEXTS)
        read = given.join(needed, (F.col("node") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("least"))).groupBy("node").agg(F.any_value("text").alias("text"))
        return written(read.select("node", shingle_sets("text").alias("set")), "sets")

    keyed = texts.select("node", F.explode("keys").alias("key"))
    centres = written(keyed.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1").select("key", "centre"), "centres")
    stars = keyed.join(centres, "key").where("node != centre").select("node", "centre").distinct()
    side = texts.select(F.col("node").alias("centre"), F.col("fp").alias("fp_c"), F.col("sketch").alias("sketch_c"))
    seen = stars.join(texts.select("node", "fp", "sketch"), "node").join(side, "centre").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_c"))) <= radius)
    seen = seen.select("node", "centre", alike("sketch", "sketch_c").alias("alike")).where(F.col("alike") >= least - SLACK)
    best = seen.groupBy("node").agg(F.max(F.struct("alike", "centre"))["centre"].alias("v")).select(F.col("node").alias("u"), "v")
    best = written(best, "stars")
    sets = sets_of(best.select(F.explode(F.array("u", "v")).alias("node")))
    side = lambda c, t: sets.select(F.col("node").alias(c), F.col("set").alias(t))
    links = written(best.join(side("u", "su"), "u").join(side("v", "sv"), "v").where(similar("su", "sv")).select("u", "v"), "links")

    ends = written(connected_components(links), "classes")
    grouped = texts.join(ends.select(F.col("vertex").alias("node"), "component"), "node", "left").select("node", F.coalesce("component", "node").alias("group"), "size", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = grouped.groupBy("key").agg(F.count("*").alias("n"), F.sum(8 * F.col("size") + 512).alias("bytes"), F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo != hi")
    sizes = sizes.select("key", F.ceil(F.greatest(F.col("n") / F.lit(tree_size), F.col("bytes") / F.lit(SEGMENT_BYTES))).cast("int").alias("n_seg"))
    members = written(grouped.join(written(sizes, "mixed"), "key").select("node", "group", "key", "n_seg"), "members")
    held = written(texts.select("node", "fp", "sketch", "keys").join(sets_of(members.select("node")), "node"), "held")
    dealt = (
        members.withColumn("seg", F.pmod(F.xxhash64("node", "key"), "n_seg").cast("int"))
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n_seg") - 1)))
        .select("node", "group", "key", F.least("seg", "t").alias("a"), F.greatest("seg", "t").alias("b"), "seg")
    )
    blocks = dealt.join(held, "node").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "node")
    new = written(blocks.mapInPandas(_search_similar(radius, least), "u long, v long").distinct(), "found")
    if not new.isEmpty():
        ends = written(connected_components(links.unionByName(new)), "classes")

    of = texts.select("node", "least").join(ends.select(F.col("vertex").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = of.groupBy("component").agg(F.min("least").alias("class_id"))
    return rows.select("doc_id", "node").join(of.join(names, "component").select("node", "class_id", "component"), "node").select("doc_id", "node", "class_id", "component")


def keep_one_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each class of similar_documents(), chosen as in one_of_each()."""
    return one_of_each(docs, similar_documents(docs, doc_id, text, **options), doc_id, text)
