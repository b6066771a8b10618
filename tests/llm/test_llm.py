"""Operators of the llm subpackage against brute force, and on nulls, empty and long texts, repeats and empty tables."""

import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tracksmith.llm import kdtree_shards, lengths, media, mixing, pieces, quality_knn, rans, robust, simhash, toxicity
from tracksmith.llm.queries import BYTE_BPE, PIECES, WORD_BPE

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, fp double, score int, shard string"
WORDS = "the of and to erst thon redble ingou hestly anter thandre ouble etion shan".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "er", "ly", "ness", "ion"]) for _ in range(n))


def make(spark, texts, sources=None, ids=None):
    """Documents with extra columns whose names clash with those that the operators make."""
    rows = [(ids[i] if ids else i, t, [None, "en", "de"][i % 3], sources[i] if sources else ["a", "b", None][i % 3], len(t or ""), "x", 1.0, 7, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, repeated rows, a very long text, non-ASCII, near copies."""
    rng = random.Random(5)
    base = [prose(rng, 60) for _ in range(12)]
    texts = [None, "", "  \n\t ", "one", "one two", base[0], base[0], base[1], base[1] + " added", "É ß 漢字 ☃ 𝄞\n" + base[2], prose(rng, 30000), "% # $\n" * 50, "same line\n" * 30, *base[3:]]
    df = make(spark, texts, ids=[None, None, *range(len(texts) - 2)])
    return df.unionByName(df.where("doc_id = 3")), [*texts, texts[5]]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                up[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            r = root(i)
            least[r] = min(least.get(r, d), d)
    return [least.get(root(i)) for i in range(len(fps))]


def test_simhash_against_brute_force(spark, odd, empty):
    df, _ = odd
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    want = sorted(zip([r[0] for r in rows], fps, brute_components([r[0] for r in rows], fps), strict=True), key=repr)
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).columns == empty.columns


@pytest.mark.parametrize(("size", "blocks"), [(1024, None), (7, None), (5, 6)])
def test_linked_fingerprints_with_hot_shards(spark, size, blocks):
    """A family of near values in one shard, chains and lone values; small trees deal a shard into segments."""
    rng = random.Random(1)
    base = rng.getrandbits(64)
    values = {base ^ (1 << rng.randrange(16)) ^ (1 << rng.randrange(16)) for _ in range(60)}
    for _ in range(80):
        x = rng.getrandbits(64)
        values.add(x)
        values.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 3, blocks, size).collect()
    up = {v: v for v in signed}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in links:
        assert ((r["u"] ^ r["v"]) % (1 << 64)).bit_count() <= 3
        up[root(r["u"])] = root(r["v"])
    want = brute_components(range(len(values)), values)
    assert all((root(signed[i]) == root(signed[j])) == (want[i] == want[j]) for i in range(len(values)) for j in range(i))


def test_keep_one_keeps_the_least_id_of_each_group(spark, odd):
    df, _ = odd
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    found = simhash.near_duplicates(df)
    assert kept.count() == found.groupBy(F.coalesce("component_id", F.lit(-1))).count().count()
    assert {r["doc_id"] for r in kept.collect()} - {None} == {r[0] for r in found.select("component_id").distinct().collect()} - {None}


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def test_similar_documents_against_brute_force(spark, odd, empty):
    """Families of edited texts: pairs well over 0.8 are one class, classes hold nothing under 0.7; hot shards in small segments."""
    rng = random.Random(11)
    texts = []
    for n in (30, 120, 400):
        for _ in range(6):
            base = [w + str(rng.randrange(50)) for w in prose(rng, n).split()]
            for edits in (0, 0, 1, 2, n // 40, n // 4):
                t = list(base)
                for _ in range(edits):
                    t[rng.randrange(n)] = "edit" + str(rng.randrange(10**6))
                texts.append(" ".join(t))
    sets = [shingles(t) for t in texts]
    for size in (1024, 4):
        got = {r["doc_id"]: r["class_id"] for r in simhash.similar_documents(make(spark, texts), tree_size=size).collect()}
        for i in range(len(texts)):
            mates = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in range(len(texts)) if j != i and got[i] == got[j]]
            assert not mates or max(mates) >= 0.7
            assert all(got[i] == got[j] for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.85)
    df, _ = odd
    found = simhash.similar_documents(df)
    assert found.count() == df.count()
    blank = [r["class_id"] for r in found.join(df.select("doc_id", "text").where("trim(translate(text, '\\n\\t', '')) = ''"), "doc_id").collect()]
    assert len(set(blank)) == 1
    kept = simhash.keep_one_similar(df)
    assert kept.columns == df.columns and kept.count() == found.select(F.coalesce("class_id", F.lit(-1))).distinct().count()
    assert simhash.similar_documents(empty).count() == 0 and simhash.keep_one_similar(empty).count() == 0


def test_similar_documents_at_the_threshold(spark):
    """Pairs of similarity 0.7 to 0.9: one class if and only if the shingle sets reach 0.8."""
    rng = random.Random(14)
    texts, want = [], []
    for i in range(150):
        n = rng.choice((60, 200, 1000))
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        other, sets = list(base), set(zip(*(base[k:] for k in range(5)), strict=False))
        goal = rng.uniform(0.72, 0.88)
        while len(sets & (now := set(zip(*(other[k:] for k in range(5)), strict=False)))) / len(sets | now) > goal:
            other[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
        texts += [" ".join(base), " ".join(other)]
        want.append(len(sets & now) / len(sets | now) >= 0.8)
    got = {r["doc_id"]: r["class_id"] for r in simhash.similar_documents(make(spark, texts)).collect()}
    assert 40 < sum(want) < 110
    assert [got[2 * i] == got[2 * i + 1] for i in range(150)] == want


def test_rejected_candidates_do_not_part_a_class(spark, monkeypatch):
    """Two families that are candidates of one another but not similar; each stays whole, and they stay apart."""
    rng = random.Random(15)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    other = [*base[:345], *(f"y{i}" for i in range(55))]
    texts = []
    for family in (base, other):
        for i in range(15):
            t = list(family)
            t[5 * i] = f"v{i}"
            texts.append(" ".join(t))
    sets = [shingles(t) for t in texts]
    across = [len(a & b) / len(a | b) for a in sets[:15] for b in sets[15:]]
    assert 0.7 < min(across) and max(across) < 0.8
    for size, most in ((1024, 1 << 24), (4, 1 << 24), (1024, 20_000)):  # one block, segments by texts, segments by bytes
        monkeypatch.setattr(simhash, "SEGMENT_BYTES", most)
        got = {r["doc_id"]: r["class_id"] for r in simhash.similar_documents(make(spark, texts), tree_size=size).collect()}
        assert [got[i] for i in range(30)] == [0] * 15 + [15] * 15


def test_a_block_yields_spanning_links_of_its_own_pairs():
    """One block of ten near copies of two groups: one link between the groups, and none for pairs that meet in an earlier shard."""
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join([*base[:290], f"v{i}"]) for i in range(10)]
    sets = [simhash.shingle_hashes(t) for t in texts]
    found = [simhash.sketch(h) for h in sets]
    for key, links in ((7, 1), (8, 0)):
        block = pd.DataFrame({
            "node": range(10), "group": [i % 2 for i in range(10)], "key": key, "a": 0, "b": 0, "seg": 0, "fp": np.array([f for f, _, _ in found], np.uint64).view(np.int64),
            "sketch": [s for _, s, _ in found], "keys": [np.array([7, 8], np.int64)] * 10, "set": [h.tobytes() for h in sets],
        })
        assert sum(map(len, simhash._search_similar(22, 0.8)(iter([block])))) == links


def test_sketch_similarity():
    rng = random.Random(12)
    for share in (0.5, 0.8, 0.95):
        est = []
        for _ in range(20):
            both = [rng.getrandbits(64) for _ in range(int(400 * share))]
            a, b = ([*both, *(rng.getrandbits(64) for _ in range((400 - len(both)) // 2))] for _ in (0, 1))
            x, y = (np.frombuffer(simhash.sketch(np.unique(np.array(v, np.uint64)))[1], np.uint8) for v in (a, b))
            est.append(simhash.similarity(x, y) - len(both) / len(set(a) | set(b)))
        assert abs(np.mean(est)) < 0.02 and np.std(est) < 0.04


def brute_counts(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= set(range(i, i + 8))
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit), len(lines)


def test_text_counts_against_brute_force():
    rng = random.Random(2)
    block = prose(rng, 12)
    texts = [None, "", " ", "a", "a b c d e f g h", "a b c d e f g h " * 2, block + " x " + block, "x\ny\nx\n\n \ny", "# é漢 <b>|", "w " * 40, prose(rng, 200) + block + prose(rng, 30) + block]
    for t in texts:
        assert robust.text_counts(t) == brute_counts(t), t


def test_quality_rules(spark, odd, empty):
    rng = random.Random(3)
    clean = [prose(rng, rng.randrange(25, 400)) for _ in range(300)]
    junk = ["".join(w + "%%% " for w in prose(rng, 80).split()) for _ in range(12)]
    df = make(spark, clean + junk, ["s"] * 312)
    r = robust.quality_rules(df).toPandas().set_index("doc_id")
    assert r.loc[range(300), "kept"].all() and not r.loc[range(300, 312), "kept"].any()
    assert not r["base_failed"].any()
    again = robust.quality_rules(df.repartition(5)).toPandas().set_index("doc_id").loc[r.index]
    assert (r["distance2"] == again["distance2"]).all()
    o = robust.quality_rules(odd[0])
    assert o.count() == odd[0].count() and o.where("kept is null or base_failed is null").count() == 0
    assert robust.quality_rules(empty).count() == 0 and robust.keep_good(empty).columns == empty.columns
    assert robust.keep_good(odd[0]).columns == odd[0].columns


def test_robust_estimate_against_numpy(spark):
    """A concentration step on the binned table against the same step on the rows, where bins don't cut."""
    rng = np.random.default_rng(0)
    x = np.rint(rng.normal(0, 300, (400, 4))).astype(int)
    df = spark.createDataFrame([("c", *map(int, v)) for v in x], "cell string, " + ", ".join(f"{f} long" for f in robust.FEATURES))
    est = robust._step(df, F.lit(0), 1.0).first()
    assert est["centre"] == pytest.approx(x.mean(0).tolist()) and est["cell_rows"] == 400
    cov = np.cov(x.T, bias=True) + np.diag((np.array(robust.FLOORS) * robust.UNIT) ** 2)
    assert est["inverse"] == pytest.approx([np.linalg.inv(cov)[i, j] for i, j in robust._PAIRS])
    assert robust.chi_square_quantile(0.95, 4) == pytest.approx(9.4877, abs=1e-3)


def test_mixing(spark, odd, empty):
    rng = random.Random(4)
    texts = [prose(rng, rng.randrange(1, 50)) for _ in range(400)]
    sources = ["big"] * 200 + ["mid"] * 150 + ["tiny"] * 40 + [None] * 10
    df = make(spark, texts, sources)
    r = mixing.mix(df, range_rows=32).toPandas()
    size = r.groupby(r["source"].fillna("~"))["size"].sum()
    taken = r.groupby(r["source"].fillna("~"))["taken"].sum()
    target = r.groupby(r["source"].fillna("~"))["target"].first()
    assert (taken == np.floor(target)).all() and (r["taken"] <= 3 * r["size"]).all()
    assert (target <= 3 * size).all() and target.sum() == pytest.approx(size.sum())
    one = mixing.mix(df, range_rows=10**9).toPandas()
    key = ["doc_id", "starts_at", "taken"]
    assert sorted(map(tuple, r[key].values)) == sorted(map(tuple, one[key].values))
    rows = mixing.mixed_documents(df)
    words = rows.select(F.coalesce("source", F.lit("~")).alias("s"), F.size(F.split(F.trim("text"), r"\s+")).alias("w")).groupBy("s").sum("w").collect()
    assert {s: w for s, w in words} == taken.to_dict() and rows.columns == df.columns
    o = mixing.mix(odd[0])
    assert o.count() == odd[0].count() and mixing.mixed_documents(odd[0]).count() > 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_targets_share_the_excess(spark):
    s = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 0)], "source string, source_size long")
    t = {r["source"]: r["target"] for r in mixing.source_targets(s).collect()}
    # weights 5, 2, 1, 5: a stops at 300, c at 30, null at 0, the rest of 1110 goes to b
    assert t == pytest.approx({"a": 300.0, "b": 780.0, "c": 30.0, None: 0.0})


def test_quality_scores(spark, odd, empty):
    rng = random.Random(6)
    good = [prose(rng, rng.randrange(20, 200)) for _ in range(150)]
    bad = [" ".join(f"{w}$$$" for w in prose(rng, 60).split()) for _ in range(75)] + [(prose(rng, 1) + " ") * 80 for _ in range(75)]
    df = make(spark, good + bad)
    lab = spark.createDataFrame([(i, int(i < 150)) for i in range(300) if i % 3] + [(5, None), (999999, 1), (1, 1)], "doc_id long, label int")
    model = quality_knn.fit(df.select("doc_id", "text"), lab)
    r = quality_knn.score(df.select("doc_id", "text"), model).toPandas().set_index("doc_id")["score"]
    held = [i for i in range(300) if i % 3 == 0]
    assert all((r[i] >= 0.3) == (i < 150) for i in held)
    o = quality_knn.score(odd[0].select("doc_id", "text"), model)
    assert o.where("score is null or score < 0 or score > 1").count() == 0
    none = quality_knn.fit(df.select("doc_id", "text"), lab.where("false"))
    assert quality_knn.score(odd[0].select("text"), none).where("score != 0.5").count() == 0
    assert quality_knn.score(empty.select("text"), model).count() == 0


def test_votes_are_exact():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    y = rng.integers(0, 2, 300).astype(float)
    m = quality_knn.KnnModel(np.ones(quality_knn.TERMS, np.float32), np.eye(quality_knn.TERMS, 8, dtype=np.float32), v, y, 0.5)
    terms = [{int(j): float(abs(rng.normal())) for j in rng.integers(0, 8, 3)} for _ in range(40)]
    for t, s in zip(terms, m.score(terms), strict=True):
        q = np.zeros(8)
        q[list(t)] = list(t.values())
        c = v @ (q / np.linalg.norm(q))
        top = np.argsort(-c)[: quality_knn.NEIGHBOURS]
        w = np.maximum(c[top], 0) ** quality_knn.SHARPNESS
        assert s == pytest.approx((w @ y[top] + 0.25) / (w.sum() + 0.5), rel=1e-4)


def test_toxicity(spark, odd, empty):
    rng = random.Random(7)
    texts, lab = [], []
    for i in range(400):
        words = prose(rng, rng.randrange(20, 120)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["zorgnak", "quilbin" + rng.choice(["a", "oru", "est"])]))
        texts.append(" ".join(words) + ".")
        lab.append((i, int(toxic)))
    df = make(spark, texts)
    model = toxicity.fit(df.select("doc_id", "text"), spark.createDataFrame([x for x in lab if x[0] % 3], "doc_id long, label int"))
    r = toxicity.score(df.select("doc_id", "text"), model).toPandas().set_index("doc_id")["score"]
    assert all((r[i] >= 0.3) == bool(y) for i, y in lab if i % 3 == 0)
    o = toxicity.score(odd[0].select("text"), model)
    assert o.where("score is null or score < 0 or score > 1").count() == 0
    clauses = toxicity.matched_clauses(df.where("doc_id in (0, 1)"), model).collect()
    assert {c["doc_id"] for c in clauses} == {0} and all(c["patterns"] for c in clauses)
    assert toxicity.score(empty.select("text"), model).count() == 0
    assert toxicity.score(df.limit(1).select("text"), toxicity.fit(df.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, label int"))).first()["score"] == 0.5


@pytest.mark.parametrize(
    ("clause", "want"),
    [("i o", {""}), ("n o i", {"n"}), ("n o o o i", {""}), ("y i", {"t"}), ("y o o o o i", {""}), ("s y i", {"rt"}), ("s o o o o o i", {"r"}), ("s o n y i", {"nrt"}), ("i y i", {"t"}), ("o o", set())],
)
def test_grammar(clause, want):
    kinds = {"i": toxicity.INSULT, "o": toxicity.OTHER, "n": toxicity.NOT, "y": toxicity.YOU, "s": toxicity.SAID}
    assert {m for _, m in toxicity.matches([kinds[c] for c in clause.split()])} == want


def brute_clause(symbols):
    """The grammar's rules by looking at neighbours, one rewriting of the clause after another."""
    t, one = toxicity, []
    for i, s in enumerate(symbols):
        beside = any(x in (t.INSULT, t.HINT) for x in symbols[max(0, i - 2) : i])
        one.append((t.INSULT, "") if s == t.INSULT or (s == t.HINT and beside) else (t.HINT, "") if s == t.HINT else s)
    two, will, verb = [], None, None
    for i, s in enumerate(one):
        if s == t.MODALS:
            will = i
        if s == t.VERB:
            if will is not None and i - will <= 3:
                two.append((t.THREATEN, ""))
                will = verb = None
                continue
            will, verb = None, i
        if s == t.YOU and verb is not None and i - verb <= 3:
            two.append((t.THREATEN, ""))
            verb = None
        two.append(s)
    out = set()
    for i, s in enumerate(two):
        if isinstance(s, tuple):
            n = "n" if t.NOT in two[max(0, i - 3) : i] else ""
            r = "r" if t.SAID in two[:i] else ""
            behind = two[i + 1 : i + 5]
            later = next((k for k, x in enumerate(behind) if isinstance(x, tuple)), 4)  # a hit waits no longer than for the next one
            out.add((s[0], n + r + ("t" if t.YOU in two[max(0, i - 4) : i] or t.YOU in behind[:later] else "")))
    return out


def test_grammar_against_a_brute_force_scorer():
    """Patterns and path weights of random clauses."""
    rng = random.Random(31)
    weights = np.array([rng.uniform(-2, 2) for _ in toxicity.PATTERNS])
    machine = toxicity.weighted(weights)
    for _ in range(4000):
        clause = rng.choices(toxicity.WORDS[:8], [6, 2, 2, 2, 1, 2, 1, 0.5], k=rng.randrange(1, 14))
        want = brute_clause(clause) if {toxicity.INSULT, toxicity.HINT, toxicity.VERB} & set(clause) else set()
        assert toxicity.matches(clause) == want, clause
        if want:
            assert machine.run([*clause, toxicity.END])[1] == pytest.approx(sum(weights[toxicity.PATTERNS.index(p)] for p in want))


@pytest.mark.parametrize("clause, want", [("i o y", {"t"}), ("i o o o o y", {""}), ("n i o y", {"nt"})])
def test_targets_behind_a_hit(clause, want):
    kinds = {"i": toxicity.INSULT, "o": toxicity.OTHER, "n": toxicity.NOT, "y": toxicity.YOU}
    assert {m for _, m in toxicity.matches([kinds[c] for c in clause.split()])} == want


def brute_pieces(p, text):
    table = {p.names[i]: (p.sp.get_score(i), i) for i in range(len(p.names)) if not (p.sp.is_unknown(i) or p.sp.is_control(i) or p.sp.is_byte(i) or p.sp.is_unused(i))}
    best, back = [0.0] + [None] * len(text), [None] * (len(text) + 1)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - 20), e):
            x = text[s:e]
            c = best[s] + table[x][0] if x in table else best[s] + p.unknown_score if s == e - 1 else None
            if c is not None and (best[e] is None or c > best[e]):
                best[e], back[e] = c, (s, table[x][1] if x in table else -1)
    ids, e = [], len(text)
    while e:
        s, i = back[e]
        ids += [i] if i >= 0 else [p.bytes[b] for b in reversed(text[s:e].encode())]
        e = s
    return ids[::-1]


def test_pieces_against_brute_force():
    p = pieces.Pieces(PIECES)
    rng = random.Random(8)
    for t in [prose(rng, 40), "a☃漢\n\n b  c", "   ", "é" * 5, "☃☃☃", "the  the   the", "x" * 90, "\tTab and　wide"]:
        assert p.encode(t) == brute_pieces(p, p.sp.normalize(t)), t
        assert p.decode(p.encode(t)) == t == p.sp.decode(p.encode(t))


def test_no_segmentation_of_the_library_scores_better():
    p, rng = pieces.Pieces(PIECES), random.Random(9)
    total = lambda ids: sum(map(p.sp.get_score, ids))
    for _ in range(30):  # without unknown characters, so that every id has a score
        t = prose(rng, 60).capitalize()
        own, merged = p.encode(t), p.sp.encode(t)
        assert total(own) >= total(merged) and p.sp.decode(own) == p.sp.decode(merged) == t


def test_encode_decode(spark, odd, empty):
    r = pieces.encode_decode(odd[0], PIECES)
    assert r.where("not exact").count() == 0 and r.where("n_pieces = 0").count() == r.where("text is null or text = ''").count()
    assert pieces.encode_decode(empty, PIECES).count() == 0


def brute_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_reused_ids_are_the_whole_texts():
    texts = ["It's <|endoftext|>now,O'Neil", "été ÉTÉ ς Σας İstanbul ǅ", "a b\x0bc\x1cd e", "foo's'll ''' 3.14 x2y2 ﬁ ①", "ÀÉ,,!! @@@ <|startoftext|> <|", "́x ý", "ß ẞ ÿ µ", "O'Neil's don't!'t 'LL ''s x's7's a_b \\ [x] `~{|}", "STRASSE straße ÇA ÿ÷×", "", None]
    e = rans.Encoder(WORD_BPE)
    assert [np.frombuffer(x, e.kind).tolist() for x in e(texts)] == brute_ids(texts)


def test_rans_round_trip(spark, odd, empty):
    df, _ = odd
    r = rans.round_trip(df, WORD_BPE).toPandas()
    rows = df.select("doc_id", "text", F.xxhash64("text").alias("h")).toPandas()
    rows["k"] = rows["doc_id"].isna()
    rows = rows.sort_values(["k", "doc_id", "h"], ascending=[False, True, True])
    want, start = [], 0
    for d, ids in zip(rows["doc_id"], brute_ids([t if isinstance(t, str) else None for t in rows["text"]]), strict=True):
        ids = [*ids, 2]
        want.append((None if np.isnan(d) else int(d), start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    r = r.sort_values("start")
    got = [(None if np.isnan(d) else int(d), s, n, c) for d, s, n, c in zip(r["doc_id"].astype(float), r["start"], r["n_tokens"], r["ids_crc32"], strict=True)]
    assert got == want
    assert rans.round_trip(empty, WORD_BPE).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 5000, 300_000, 1_300_000])
def test_blocks(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 1000).astype(np.uint16)
    tables = rans.Tables(np.bincount(ids, minlength=1000))
    raw = rans.encode_block(ids, tables, [1, None], [n, 0])
    b = rans.Block(raw)
    assert (b.ids(tables) == ids).all() and b.doc_ids == [1, None] and b.lengths.tolist() == [n, 0]
    if n > 1_000_000:
        parts = [b.section(i, tables) for i in reversed(range(len(b.marks)))][::-1]  # any order
        assert len(parts) > 1 and (np.concatenate(parts) == ids).all() and len(raw) < n * 1.3
    broken = bytearray(raw)
    broken[len(raw) // 2] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        rans.Block(bytes(broken))


def test_shards(spark, odd, empty):
    rng = random.Random(10)
    texts = [prose(rng, rng.randrange(1, 80)) for _ in range(600)] + ["copy of copies"] * 600
    df = make(spark, texts, [f"s{rng.randrange(6)}" for _ in texts])
    r = kdtree_shards.kdtree_shards(df).toPandas()
    by = r.groupby("shard")
    sizes = by["size"].sum()
    assert len(sizes) == 16 and sizes.max() / sizes.min() < 1.25 and sizes.max() - sizes.min() < 900
    assert all(sorted(g) == list(range(len(g))) for _, g in by["slot"])
    assert (r.sort_values("doc_id")["size"].to_numpy() == [len(t.encode()) + 1 for t in texts]).all()
    assert (r.sort_values("doc_id")["text_crc32"].to_numpy() == [zlib.crc32(t.encode()) for t in texts]).all()
    other = kdtree_shards.kdtree_shards(df.repartition(3)).toPandas()
    assert dict(zip(r["doc_id"], r["shard"], strict=True)) == dict(zip(other["doc_id"], other["shard"], strict=True))
    o = kdtree_shards.kdtree_shards(odd[0], 5)
    assert o.count() == odd[0].count() and {x[0] for x in o.select("shard").distinct().collect()} <= set(range(5))
    assert kdtree_shards.kdtree_shards(empty).count() == 0


def test_shards_split_at_the_weighted_median(spark):
    """Two shards along one dimension: the cut is where half of the bytes lie, as near as the groups of equal texts allow (720 bytes each)."""
    df = spark.createDataFrame([(i, "x" * (i % 50), "en", "s") for i in range(1000)], "doc_id long, text string, lang string, source string")
    r = kdtree_shards.kdtree_shards(df, 2).toPandas()
    a, b = (r[r["shard"] == s] for s in (0, 1))
    assert a["d_size"].max() <= b["d_size"].min() and abs(a["size"].sum() - b["size"].sum()) <= 360


def test_shards_against_a_brute_force_tree(spark, monkeypatch):
    """The same cuts on sorted points in plain Python, without the tolerance; equal texts stay together, a group beyond a shard is dealt."""
    monkeypatch.setattr(kdtree_shards, "TOLERANCE", 0.0)
    rng = random.Random(21)
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(300)]
    texts += texts[:60] * 2 + ["one large group"] * 1500
    df = make(spark, texts, [rng.choice(["a", "common_crawl", "common_voice", None]) for _ in texts])
    r = kdtree_shards.kdtree_shards(df, 7).toPandas()
    split = r.groupby(["text_crc32", "size"])["shard"].nunique()
    assert split[split > 1].index.tolist() == [(zlib.crc32(b"one large group"), 16)]
    small = make(spark, texts[:420], [rng.choice(["a", "common_crawl", "common_voice", None]) for _ in range(420)])
    r = kdtree_shards.kdtree_shards(small, 7).toPandas()
    ties = {x["doc_id"]: x["tie"] for x in small.select("doc_id", F.shiftright(F.xxhash64("text"), 2).alias("tie")).collect()}
    r["tie"] = r["doc_id"].map(ties)
    points = r.groupby("tie").agg(w=("size", "sum"), d_source=("d_source", "first"), d_lang=("d_lang", "first"), d_size=("d_size", "first"), shard=("shard", "first")).reset_index()
    dims = ["d_source", "d_lang", "d_size"]
    width = {d: max(1, points[d].max() - points[d].min()) for d in dims}

    def tree(part, k):
        if k == 1:
            return [sorted(part["tie"])]
        dim = max(dims, key=lambda d: ((part[d].max() - part[d].min()) / width[d], -dims.index(d)))
        part = part.sort_values([dim, "tie"])
        want, upto = part["w"].sum() * (k // 2) / k, part["w"].cumsum().to_numpy()
        i = int(np.searchsorted(upto, want))
        before = upto[i - 1] if i else 0
        i += upto[i] - want < want - before
        return tree(part.iloc[:i], k // 2) + tree(part.iloc[i:], k - k // 2)

    assert tree(points, 7) == [sorted(g["tie"]) for _, g in points.groupby("shard")]
    leaves = kdtree_shards.kdtree_shards(small, target_bytes=5000).select("shard").distinct().count()
    assert leaves == -(-int(r["size"].sum()) // 5000)


def test_rans_folder_is_complete(spark, tmp_path):
    """Another session reads documents and ranges of ids from the folder alone."""
    rng = random.Random(22)
    df = make(spark, [prose(rng, rng.randrange(0, 300)) for _ in range(200)] + [None])
    path = str(tmp_path / "ids")
    rans.write_blocks(df, WORD_BPE, path)
    other = spark.newSession()
    b = rans.read_blocks(other, path).toPandas().sort_values("start")
    ids = np.concatenate(b["ids"].tolist())
    want = [[*rans.Encoder(WORD_BPE, reuse=False).tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for _, t in sorted((r["doc_id"], r["text"]) for r in df.collect())]
    assert ids.tolist() == [i for w in want for i in w]
    part = rans.read_range(other, path, 1000, 1500).toPandas().sort_values("at")
    assert part["id"].tolist() == ids[1000:1500].tolist() and part["at"].tolist() == list(range(1000, 1500))
    n = 3 * rans.LANES * rans.CHECK_STEPS // 2
    many = np.random.default_rng(1).integers(0, 500, n)
    tables = rans.Tables(np.bincount(many, minlength=500))
    block = rans.Block(rans.encode_block(many, tables, [1], [n]))
    assert len(block.marks) == 2 and (block.some_ids(tables, n // 2, n - 7) == many[n // 2 : n - 7]).all()


def test_lengths(spark, odd, empty):
    df, _ = odd
    n = lengths.with_length(df.select("text"), BYTE_BPE).toPandas()
    enc = lengths.encoding(BYTE_BPE)
    assert [len(enc.encode_ordinary(t)) if isinstance(t, str) else 0 for t in n["text"]] == n["n_tokens"].tolist()
    all_n = np.array(n["n_tokens"])
    sums = lengths.suffix_sums(lengths.length_histogram(lengths.with_length(df.select("text"), BYTE_BPE)))
    for r in sums.collect():
        c = r["n_tokens"]
        assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"], r["truncated_total"]) == ((all_n == c).sum(), (all_n >= c).sum(), all_n[all_n >= c].sum(), np.minimum(all_n, c).sum())
    limits = [0, 1, 5, 100, 101, 5000, 10**7]
    got = {r["limit"]: (r["docs_cut"], r["truncated_total"]) for r in lengths.truncated_totals(sums, limits).collect()}
    assert got == {c: ((all_n > c).sum(), np.minimum(all_n, c).sum()) for c in limits}
    q = {r["share"]: r["n_tokens"] for r in lengths.quantiles(sums, [0.0, 0.25, 0.5, 1.0]).collect()}
    assert q == {s: int(np.quantile(all_n, s, method="inverted_cdf")) for s in (0.0, 0.25, 0.5, 1.0)}
    assert lengths.suffix_sums(lengths.length_histogram(spark.createDataFrame([], "n_tokens long"))).count() == 0
    grouped = lengths.suffix_sums(spark.createDataFrame([(None, 3, 2), ("a", 3, 1), ("a", 5000, 1)], "lang string, n_tokens long, n_docs long"), ["lang"])
    assert {(r["lang"], r["n_tokens"], r["docs_at_least"]) for r in grouped.collect()} == {(None, 3, 2), ("a", 3, 2), ("a", 5000, 1)}


def picture(seed, h=120, w=96):
    rng = np.random.default_rng(seed)
    img = np.kron(rng.integers(0, 255, (h // 4, w // 4)), np.ones((4, 4)))
    return np.clip(img, 0, 255).astype(np.uint8)


def test_image_copies(spark):
    a, b = picture(1), picture(2)
    edited = a.copy()
    edited[70:90, 20:50] = 128
    images = {1: a, 2: a.copy(), 3: a[16:, 8:], 4: edited, 5: b, 6: b[:96, :80], 7: picture(3), 8: np.full((40, 40), 9, np.uint8), 9: np.full((40, 40), 10, np.uint8)}
    rows = [(i, v.shape[1], v.shape[0], bytearray(v.tobytes())) for i, v in images.items()] + [(10, 5, 5, None), (11, 7, 9, bytearray(b"xy")), (None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, width int, height int, pixels binary")
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in media.image_copies(df).collect()}
    assert {i: c for i, (c, _) in got.items() if i and i < 10} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7, 8: 8, 9: 9}
    assert got[1][1] == got[2][1] >= 1 and got[7][1] == 0
    assert media.image_copies(df.where("id > 99")).count() == 0


def test_many_copies_meet_at_one(spark):
    """More images in an entry than are compared all with all."""
    base = picture(4)
    images = []
    for i in range(media.ALL_PAIRS * 2):
        v = base.copy()
        v[0, i] ^= 1
        images.append((i, v.shape[1], v.shape[0], bytearray(v.tobytes())))
    df = spark.createDataFrame(images, "id long, width int, height int, pixels binary")
    assert [r[0] for r in media.image_copies(df).select("class_id").distinct().collect()] == [0]


def brute_classes(images):
    """Least number of each image's class and its number of links, by the link rule over all pairs of different images."""
    points = {i: media.keypoints(v) for i, v in images.items()}
    name, links = {i: i for i in images}, dict.fromkeys(images, 0)
    for i in images:
        for j in (j for j in images if j < i and min(len(points[i]), len(points[j])) >= media.LEAST_PLACES):
            need = max(media.LEAST_PLACES, media.LEAST_SHARE * min(len(points[i]), len(points[j])))
            if media.agreeing(points[i], points[j], media.near_pairs(points[i], points[j])) >= need:
                links[i], links[j] = links[i] + 1, links[j] + 1
                low, high = sorted((name[i], name[j]))
                name = {k: low if n == high else n for k, n in name.items()}
    return {i: (name[i], links[i]) for i in images}


def test_copies_that_share_only_hot_entries(spark):
    """Three passages that many strangers hold, and near copies that share these passages alone; whole and in small segments."""
    parts = [picture(20 + i, 48) for i in range(3)]
    images = {i: np.vstack([parts[i % 3], picture(100 + i, 160)]) for i in range(75)}
    for i in (7, 23, 39):
        images[i] = np.vstack([*parts, picture(200 + i, 28)])
    df = spark.createDataFrame([(i, v.shape[1], v.shape[0], bytearray(v.tobytes())) for i, v in images.items()], "id long, width int, height int, pixels binary")
    want = brute_classes(images)
    assert [c for c, _ in want.values()] == [7 if i in (7, 23, 39) else i for i in images]
    for segment in (media.SEGMENT, 4):
        assert {r["id"]: (r["class_id"], r["n_links"]) for r in media.image_copies(df, segment).collect()} == want


def test_links_of_many_copies_are_counted(spark):
    """Equal keypoints under different pixels, and near copies: each is linked with all others."""
    base = picture(4)
    images = {i: base.copy() for i in range(30)}
    for i in images:
        images[i][0, i] ^= 1
    for i in range(30, 50):
        images[i] = base.copy()
        images[i][60:64, i : i + 4] = 3 * i
    df = spark.createDataFrame([(i, v.shape[1], v.shape[0], bytearray(v.tobytes())) for i, v in images.items()], "id long, width int, height int, pixels binary")
    assert {r["id"]: (r["class_id"], r["n_links"]) for r in media.image_copies(df).collect()} == brute_classes(images) == dict.fromkeys(images, (0, 49))


def test_turned_and_halved_keypoints_agree():
    img = np.kron(picture(5, 160, 160), np.ones((2, 2))).astype(np.uint8)
    k, t = media.keypoints(img), media.keypoints(np.ascontiguousarray(np.rot90(img)))
    near = [(i, j) for i in range(len(k)) for j in range(len(t)) if np.unpackbits(k["bits"][i] ^ t["bits"][j]).sum() <= media.NEAR_BITS]
    assert len(near) >= 5 and media.agreeing(k, t, np.array(near)) >= 5


def test_page_rasters():
    w, h, p = media.page_raster("<html><script>no()</script><p>Hello &amp; you</p><!-- x --><p>" + "a" * 200 + "</p></html>")
    assert (w, h, len(p)) == (media.PAGE_WIDTH, 1 + 3, media.PAGE_WIDTH * 4)
    assert media.page_raster(None) is None and media.page_raster("")[1] == 0


def test_recall_on_drawn_pages(spark):
    """Links among all pages against the link rule over all pairs: 0.9 of them at least, and none that the rule doesn't have."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = media.page_images(pages).collect()
    images = {r["id"]: np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"]) for r in rows}
    assert sum(len(media.keypoints(v)) < media.LEAST_PLACES for v in images.values()) <= 0.01 * len(images)
    want = sum(n for _, n in brute_classes(images).values())
    got = media.image_copies(media.page_images(pages)).agg(F.sum("n_links")).first()[0]
    assert 0.9 * want <= got <= want and want >= 20


def test_image_copies_of_odd_pages(spark):
    """Null, empty, very long and repetitive pages, and repeated ids; extra columns with clashing names."""
    long = "<p>" + "one line of words again and again " * 20000 + "</p>"
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, "<p>" + "x " * 90000 + "</p>"), (None, long + "<p>more</p>"), (5, "<b></b>")]
    df = spark.createDataFrame([(i, h, 1, "a") for i, h in rows], "page_id long, html string, pts int, points string")
    got = [(r["id"], r["class_id"]) for r in media.image_copies(media.page_images(df)).collect()]
    assert sorted((x for x in got if x[0]), key=repr) == [(1, 1), (2, 2), (3, 3), (3, 3), (4, 4), (5, 2)] and (None, 3) in got


def test_near_descriptors_are_all_found(spark):
    """Crowds of descriptors with up to 10 changed bits anywhere, whole and in small segments, against all pairs."""
    rng = np.random.default_rng(6)
    bits = np.repeat(rng.integers(0, 2, (12, media.BITS)), 40, axis=0)
    for row in bits:
        row[rng.choice(media.BITS, rng.integers(0, 11), replace=False)] ^= 1
    words = np.unique(np.packbits(bits, axis=1).view("<i8"), axis=0)
    asks = rng.integers(0, 2, len(words)).astype(bool)
    apart = np.bitwise_count(words.view("<u8")[:, None] ^ words.view("<u8")[None]).sum(2)
    want = sorted((*words[i].tolist(), *words[j].tolist()) for i, j in np.argwhere((apart > 0) & (apart <= media.NEAR_BITS)) if asks[i])
    df = spark.createDataFrame([(*w, bool(a)) for w, a in zip(words.tolist(), asks, strict=True)], "lo long, hi long, asks boolean")
    for segment in (media.SEGMENT, 8):
        assert sorted(tuple(r) for r in media.near_descriptors(df, segment).collect()) == want and len(want) > 1000


def test_copies_with_changed_bits_all_over(spark, monkeypatch):
    """Descriptors whose changed bits lie in both halves link as the rule says: none is left out."""
    rows = []
    for i in range(12):
        points = media.keypoints(picture(300 + i // 2)).copy()
        if i % 2:
            points["bits"][:, [0, 5, 8, 13]] ^= 4
        rows.append((i, 96, 120, bytearray(picture(320 + i).tobytes()), bytearray(points.tobytes()), len(points)))
    packed = spark.createDataFrame(rows, "id long, width int, height int, pixels binary, points binary, n int")
    monkeypatch.setattr(media, "with_keypoints", lambda images: packed)
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in media.image_copies(packed.select("id", "width", "height", "pixels")).collect()}
    assert got == {i: (i // 2 * 2, 1) for i in range(12)}
