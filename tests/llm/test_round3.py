"""Prefix trie, packing and centroids against brute force, and on nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import random
import zlib
from itertools import pairwise

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from tracksmith.llm import centroids, packing, prefix_trie
from tracksmith.llm.queries import BYTE_BPE, BYTE_BPE_JSON, queries

SF = "/root/testdata/sf0.001"
CONV = "conv_id long, turn long, role string, text string, depth string, p1 long, band int"


def brute_trie(rows, tie=lambda r: (r[2] or "", r[3] or "")):
    """Nodes by the contract: {(conv_id, depth): (parent, n_convs, n_children, n_leaves, saved, hash)}."""
    turns = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, tie(r))):
        turns.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    members, ends = {}, {}
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
        ends.setdefault(tuple(t), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)

    def sums(k):
        below = [sums(x) for x in kids.get(k, [])]
        own = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        return (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))

    return {
        (min(m), len(k)): (min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), *sums(k), hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest())
        for k, m in members.items()
    }


def trie_rows(df):
    return {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect()}


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], CONV).repartition(5)


@pytest.mark.parametrize("band", [2, 3, 16])
def test_trie_against_brute_force(spark, band):
    """Long conversations cross several bands; common first turns, copies, missing bases, null roles and texts, null ids."""
    rng = random.Random(band)
    rows = [(None, 1, "user", "of no conversation")]
    for c in [*range(0, 30), 37, 38, 40, 9000, 9001]:
        n = rng.choice([1, 2, 3, 5, 40 if c in (5, 10) else 4])
        for t in range(n):
            rows.append((c, None if t == 0 and c % 7 == 0 else t, rng.choice(["user", None]), "hello" if t == 0 else rng.choice([None, "", "a", "bß", "c" * 50])))
    rows += [(100 + i, t, "user", f"copy {t}") for i in range(12) for t in range(20)]
    rng.shuffle(rows)
    assert trie_rows(prefix_trie.prefix_trie(conversations(spark, rows), band)) == brute_trie(rows)


def test_trie_ties_repeats_and_many_ends(spark, monkeypatch):
    """Equal turns are ordered by their hash: any order is one of the two; ends of a node over several segments hash in order."""
    monkeypatch.setattr(prefix_trie, "SEGMENT", 4)
    rows = [(c, 0, "user", "same") for c in range(50, 90)] + [(c, 1, "user", x) for c in range(50, 90) for x in ("p", "p")]
    got = trie_rows(prefix_trie.prefix_trie(conversations(spark, rows)))
    assert got == brute_trie(rows)
    two = [(7, 1, "a", "p"), (7, 1, "a", "q")]
    got = trie_rows(prefix_trie.prefix_trie(conversations(spark, two)))
    assert got in [brute_trie(two, tie=lambda r, s=s: (s * ord(r[3]),)) for s in (1, -1)]


def test_trie_of_nothing_and_turnless(spark):
    assert prefix_trie.prefix_trie(conversations(spark, [(1, 0, "a", "b")]).where("false")).count() == 0
    alone = next(c for c in range(1, 200) if zlib.crc32(str(c).encode()) % 9 > 3 and c % 5)
    got = trie_rows(prefix_trie.prefix_trie(conversations(spark, [(alone, 0, "a", "b")])))
    assert got == {(alone, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())}


def test_trie_heavy_parents(spark, monkeypatch):
    """A parent with more children than the bound finds its id in the broadcast, with the same rows."""
    rows = [(c, 0, "u", "hi") for c in range(0, 10_000, 5)] + [(c, 1, "u", str(c)) for c in range(0, 10_000, 5)]
    assert trie_rows(prefix_trie.prefix_trie(conversations(spark, rows))) == brute_trie(rows)


# ---- packing


def check_places(rows, capacity):
    """Every sequence is gapless from 0 and within the capacity; documents are cut only where they must be."""
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for places in by_seq.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(places)) and sum(n for _, n in places) <= capacity
    return by_seq, by_doc


def test_packing_round_trip(spark):
    rng = random.Random(3)
    texts = [None, "", "<|endoftext|> and more", "É ß 漢字 ☃", "long " * 3000, *[" ".join(rng.choice(["red", "blau", "vert", "42"]) for _ in range(rng.randrange(1, 400))) for _ in range(200)]]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, at int, sequence_id int")
    out = packing.pack_documents(docs, BYTE_BPE_JSON, BYTE_BPE, 256).cache()
    rows = out.collect()
    _, by_doc = check_places(rows, 256)
    t = Tokenizer.from_file(BYTE_BPE_JSON)
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}
    for r in rows:
        part = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids"] == part and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for d, parts in by_doc.items():
        parts.sort()
        assert [p for p, _, _ in parts] == list(range(len(parts))) and sum(n for _, _, n in parts) == len(want[d])
        assert all(n == 256 for _, _, n in parts[1:]) and (len(parts) == 1 or len(want[d]) > 256)
    joined = packing.sequences(out).collect()
    assert sum(len(r["ids"]) for r in joined) == sum(map(len, want.values())) and max(len(r["ids"]) for r in joined) <= 256


def test_packing_repeats_nulls_and_nothing(spark):
    docs = spark.createDataFrame([(None, "a b c")] * 30 + [(1, "a b c")] * 30, "doc_id long, text string")
    rows = packing.pack_documents(docs, BYTE_BPE_JSON, BYTE_BPE, 16).collect()
    by_seq, _ = check_places(rows, 16)
    assert len(rows) == 60 and len(by_seq) == 15
    assert packing.pack_documents(docs.where("false"), BYTE_BPE_JSON, BYTE_BPE, 16).count() == 0


def fewest(sizes, capacity):
    """Exact least number of bins by depth-first search (small inputs)."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for b in sorted(set(bins)):
            if b + sizes[i] <= capacity:
                rest = list(bins)
                rest[rest.index(b)] += sizes[i]
                go(i + 1, rest)
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_search_against_exact_packing():
    """The bound never exceeds the least number of bins, the search never falls below it, and is at most one above here."""
    rng = np.random.default_rng(2)
    for _ in range(60):
        sizes = rng.integers(1, 40, rng.integers(1, 11))
        where = packing.pack(sizes, 48)
        assert np.bincount(where, sizes).max() <= 48
        assert packing.least_bins(sizes, 48) <= fewest(sizes.tolist(), 48) <= where.max() + 1 <= fewest(sizes.tolist(), 48) + 1


def test_swaps_save_bins_and_raise_squared_fill():
    """Thirds of a bin defeat best fit; exchanges regain bins, squared fill only rises, and given bins are never more afterwards."""
    sizes = np.random.default_rng(1).integers(300, 420, 1500)
    first = packing.best_fit(sizes, 1024)
    search = packing.Search(sizes, first, 1024)
    before = int((search.fill**2).sum())
    for a in np.argsort(search.fill)[:20].tolist():
        while 0 < search.fill[a] < 1024 and search.exchange(a):
            now = int((search.fill**2).sum())
            assert now > before and (np.bincount(search.where, sizes, len(search.fill)) == search.fill).all()
            before = now
    after = packing.pack(sizes, 1024)
    assert after.max() < first.max() * 0.98 and np.bincount(after, sizes).max() <= 1024
    assert packing.pack(sizes, 1024, first).max() <= first.max()


def test_groups_are_packed_apart_and_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 300)
    sizes = np.random.default_rng(4).integers(1, 1025, 2000).tolist()
    pieces = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "at long, length long")
    got = packing.pack_pieces(pieces).collect()
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], sizes[r["at"]]))
    assert len(got) == 2000
    for places in used.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(places)) and places[-1][0] + places[-1][1] <= 1024
    assert len(used) <= 1.03 * packing.least_bins(np.array(sizes), 1024)  # groups of 300 only


# ---- centroids


def brute_centroids(rows, k=8, rounds=10, dims=64):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for r in range(rounds + 1):
        near = [min((far(v, c), j) for j, c in enumerate(cents)) for _, v in kept]
        if r < rounds:
            for j in range(len(cents)):
                own = [v for (_, v), n in zip(kept, near, strict=True) if n[1] == j]
                if own:
                    cents[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    sums = [sum(d for d, j in near if j == c) for c in range(len(cents))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, sums[j], sum(sums), sha[j]) for (i, _), (d, j) in zip(kept, near, strict=True)), key=repr)


def centroid_rows(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect()), key=repr)


VEC = "vec_id long, embedding array<double>, label int, cluster string, x int"


def test_centroids_against_brute_force(spark):
    """Negative and equal components, wrong sizes, nulls, infinities, repeated rows, a null id, an emptied centroid."""
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=64) * rng.choice([0.001, 1, 300])).tolist()) for i in range(300)]
    rows += [(400, None), (401, []), (402, [1.0] * 63), (403, [1.0] * 65), (404, [None] + [1.0] * 63), (405, [float("inf")] * 64), (406, [float("nan")] + [0.0] * 63), (None, [0.5] * 64)]
    rows += [(500, [0.25] * 64)] * 40
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VEC).repartition(7)
    assert centroid_rows(centroids.cluster(df)) == brute_centroids(rows)


def test_centroids_of_few_equal_and_huge(spark):
    make = lambda rows: spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VEC)
    assert centroids.cluster(make([(1, [0.0] * 64)]).where("false")).count() == 0
    assert centroids.cluster(make([(1, [0.0])])).count() == 0
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert centroid_rows(centroids.cluster(make(few))) == brute_centroids(few)
    same = [(i, [0.125] * 64) for i in range(20)]  # all distances tie: cluster 0
    assert centroid_rows(centroids.cluster(make(same))) == brute_centroids(same)
    huge = centroids.cluster(make([(1, [1e300] * 64), (2, [-1e300] * 64)])).collect()
    assert [r["distance"] for r in huge] == [0, 0]


# ---- the registered queries


@pytest.mark.parametrize(
    ("name", "types"),
    [
        ("op11_prefix_trie", {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"}),
        ("op12_packing", {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}),
        ("op13_centroids", {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}),
    ],
)
def test_registered_columns(spark, name, types):
    out = queries()[name](spark, SF)
    assert dict(out.dtypes) == types and out.count() > 0


@pytest.mark.parametrize(("name", "table", "sql"), [("op11_prefix_trie", "conversations", prefix_trie.ORACLE_SQL), ("op13_centroids", "embeddings", centroids.oracle_sql())])
def test_registered_against_sql(spark, name, table, sql):
    db = duckdb.connect()
    db.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    cur = db.execute(sql)
    cols = [c[0] for c in cur.description]
    got = queries()[name](spark, SF)
    assert sorted(cols) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == sorted(cur.fetchall(), key=repr)


def test_op12_on_the_given_table(spark):
    rows = queries()["op12_packing"](spark, SF).collect()
    by_seq, _ = check_places(rows, 1024)
    assert len(by_seq) <= 1.02 * packing.least_bins(np.array([r["length"] for r in rows]), 1024) + 1
