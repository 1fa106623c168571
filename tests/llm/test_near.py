"""Operator 9 against all pairs, and its parts."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from umbel.llm import graph, simhash
from umbel.llm.store import settle

from .conftest import prose


def plain_fingerprint(text, width=3):
    w = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    grams = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_classes(fps, ids, radius=2):
    """{fingerprint: smallest id reachable}, by all pairs of different fingerprints."""
    u = sorted(set(fps))
    a = np.array(u, np.uint64)
    parent = list(range(len(u)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius):
            parent[root(i)] = root(i + 1 + int(j))
    least = {}
    for f, d in zip(fps, ids, strict=True):
        r = root(u.index(f)) if len(u) < 50 else root(int(np.searchsorted(a, np.uint64(f))))
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return {f: least.get(root(i)) for i, f in enumerate(u)}


def held(got, rows):
    want = [plain_fingerprint(t) for _, t in rows]
    classes = plain_classes(want, [d for d, _ in rows])
    expected = Counter((d, f"{f:016x}", classes[f]) for (d, _), f in zip(rows, want, strict=True))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == expected


def test_masks_cover_every_pair_within_the_radius():
    for radius in (1, 2):
        tables = [m % (1 << 64) for m in simhash.masks(radius)]
        assert len(tables) == 2 ** (radius + 1) - 1
        for i in range(64):
            for j in range(64):
                diff = 1 << i if radius == 1 else (1 << i) | (1 << j)
                assert any(diff & m == 0 for m in tables)


def test_whole_table(spark, real):
    from umbel.llm.queries import op9_simhash

    held(op9_simhash(spark, "/root/testdata/sf0.01").collect(), [(r[0], r[1]) for r in real])


def test_odd(odd, nothing, odd_rows):
    held(simhash.classes(odd).collect(), [(r[0], r[1]) for r in odd_rows])
    assert simhash.classes(nothing).count() == 0
    assert simhash.keep_one(nothing).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    fps = {plain_fingerprint(r[1]) for r in odd_rows}
    classes = plain_classes([plain_fingerprint(r[1]) for r in odd_rows], [r[0] for r in odd_rows])
    assert kept.count() == len(set(classes.values())) and len(fps) >= kept.count()


@pytest.mark.parametrize(("radius", "pair_rows"), [(2, 2), (2, 32), (1, 1)])
def test_links_by_pairs_and_by_points(spark, monkeypatch, radius, pair_rows):
    """Dense clusters, chains and noise: both ways of searching a bucket keep every connection and add none."""
    monkeypatch.setattr(simhash, "PAIR_ROWS", pair_rows)
    rng = random.Random(3)
    fps = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(60):  # a cluster around a centre, and a chain that leaves it
            fps.add(x ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.6) * (1 << rng.randrange(64)))
        for _ in range(25):
            x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(200)} | {0, (1 << 64) - 1, 1 << 63}
    order = sorted(fps)
    rng.shuffle(order)
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(order)]
    nodes = settle(spark.createDataFrame(signed, "node bigint, fp bigint"), "n")
    got = {r["node"]: r["label"] for r in graph.components(simhash.links(nodes, radius)).collect()}
    want = plain_classes(order, list(range(len(order))), radius)
    assert all(got.get(i, i) == want[f] for i, f in enumerate(order))


def test_components_of_paths_and_stars(spark):
    rng = random.Random(9)
    names = list(range(3000))
    rng.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(1500)] + [(names[1600], names[i]) for i in range(1601, 2600)] + [(names[i], names[i + 1]) for i in range(2700, 2990, 2)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert got == {x: root(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_long_text_in_blocks(monkeypatch):
    text = prose(random.Random(1), 5000)
    monkeypatch.setattr(simhash, "_CHUNK_SHINGLES", 700)
    assert simhash.text_fingerprints([text, None, "", "a b", "one two three"], 3).tolist() == [plain_fingerprint(t) for t in (text, None, "", "a b", "one two three")]


def test_five_word_shingles():
    text = "A b c d e f g"
    grams = ["a b c d e", "b c d e f", "c d e f g"]
    assert simhash.shingle_hashes(text, 5) == [xxhash.xxh64_intdigest(g, seed=42) for g in grams]


def test_spark_hash_is_the_same(spark):
    r = spark.range(1).select(F.xxhash64(F.lit("one two three")).alias("h")).first()
    assert r["h"] % (1 << 64) == simhash.shingle_hashes("one two three", 3)[0]




def plain_set(text, width=5):
    w = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def plain_pairs(texts, similarity=0.8):
    """Pairs of places whose sets are that similar, by counting what they share."""
    sets = [plain_set(t) for t in texts]
    held = Counter(x for s in sets for x in s)
    column = {x: i for i, x in enumerate(x for x, n in held.items() if n > 1)}
    m = np.zeros((len(sets), len(column)), np.float32)
    for i, s in enumerate(sets):
        m[i, [column[x] for x in s if x in column]] = 1
    common, n = m @ m.T, np.array([len(s) for s in sets])
    near = common / np.maximum(n[:, None] + n - common, 1) >= similarity - 1e-6
    return {(int(i), int(j)) for i, j in np.argwhere(np.triu(near, 1))}


def plain_kept(rows):
    """Smallest ids of the components of 3-word fingerprints within two bits and of similar sets."""
    fps = np.array([plain_fingerprint(t) for _, t in rows], np.uint64)
    close = {(i, i + 1 + int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 2)}
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in close | plain_pairs([t for _, t in rows]):
        parent[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted(least.values())


def test_stage_reaches_similar_texts_of_the_table(spark, real):
    import corpus_pipeline

    rows = [(r[0], r[1]) for r in real]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").select("doc_id").collect()) == plain_kept(rows)


@pytest.mark.parametrize(("pair_rows", "rounds"), [(32, 2), (3, 2), (1, 0)])
def test_stage_against_all_pairs(spark, monkeypatch, tmp_path, pair_rows, rounds):
    """Copies with words changed, chains that drift away, buckets searched in both ways."""
    from umbel.llm import near_dedup

    monkeypatch.setattr(near_dedup, "PAIR_ROWS", pair_rows)
    monkeypatch.setattr(near_dedup, "ROUNDS", rounds)
    rng = random.Random(13)
    texts = []
    for n in (60, 120, 400):
        base = prose(rng, n).split()
        for changes in [0, 1, 1, 2, 3, 5, 8] * 3:
            w = list(base)
            for _ in range(changes):
                w[rng.randrange(n)] = f"zz{rng.randrange(10**6)}"
            texts.append(" ".join(w))
        for _ in range(25):
            base[rng.randrange(n)] = f"yy{rng.randrange(10**6)}"
            texts.append(" ".join(base))
    texts += [texts[0].upper(), "one two", "One two", "three", *[prose(rng, 80) for _ in range(40)]]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    fps = [plain_fingerprint(t) for t in texts]
    assert sum((fps[i] ^ fps[j]).bit_count() > 2 for i, j in plain_pairs(texts)) > 100
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(docs).collect()) == plain_kept(rows)


def boilerplate(rng, n, share, words=200):
    """``n`` texts that have ``share`` of their words in common, each with its own words at its end."""
    site = prose(rng, int(words * share))
    return [f"{site} {' '.join(f'own{i}x{j}' for j in range(words - int(words * share)))}" for i in range(n)]


def test_middling_similarity_is_not_compared_in_pairs(spark, tmp_path):
    """Texts of one site, of similarity 0.6 to 0.7: prefixes form no pairs, and pairs checked grow with the texts."""
    from umbel.llm import near_dedup

    rng = random.Random(2)
    checked = []
    for n in (400, 800):
        texts = boilerplate(rng, n, 0.8)
        nodes = spark.createDataFrame([(i, i) for i in range(n)], "node bigint, label bigint")
        docs = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
        assert near_dedup._prefix_pairs(nodes, docs, 5, 0.8).count() == 0
        real, near_dedup._similar = near_dedup._similar, lambda pairs, *a: (checked.append(pairs.distinct().count()), real(pairs, *a))[1]
        try:
            path = str(tmp_path / str(n))
            docs.withColumnRenamed("node", "doc_id").repartition(4).write.parquet(path)
            checked.append(("texts", n))
            assert near_dedup.keep_one(spark.read.parquet(path)).count() == n
        finally:
            near_dedup._similar = real
    at = checked.index(("texts", 800))
    small, large = sum(checked[1:at]), sum(checked[at + 1 :])
    assert large <= 3 * max(small, 400)


def test_large_bucket_of_middling_texts_against_all_pairs(spark, tmp_path):
    """Two thousand texts of one site, some of them near copies of each other."""
    from umbel.llm import near_dedup

    rng = random.Random(8)
    texts = boilerplate(rng, 1200, 0.75) + boilerplate(rng, 500, 0.55)
    for i in range(0, 300, 3):
        w = texts[i].split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [f"{t} {i}" for i, t in enumerate([texts[7]] * 200)]
    rng.shuffle(texts)
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5).write.parquet(str(tmp_path / "t"))
    got = sorted(r["doc_id"] for r in near_dedup.keep_one(spark.read.parquet(str(tmp_path / "t"))).collect())
    assert got == plain_kept(list(enumerate(texts)))


def test_texts_of_shared_variants_meet_only_if_they_may_be_similar(spark):
    """Five places with three variants each: every shingle is common, but most pairs differ in too many."""
    from itertools import combinations, product

    from umbel.llm import near_dedup

    words = [f"w{i}" for i in range(90)]
    texts = []
    for choice in product("abc", repeat=5):
        for i, c in enumerate(choice):
            words[10 + 16 * i] = f"{c}{i}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    met = {(r["a"], r["b"]) for r in near_dedup._prefix_pairs(docs.select("node", F.col("node").alias("label")), docs, 5, 0.8).collect()}
    sets = [set(near_dedup.shingle_set(t, 5).tolist()) for t in texts]
    similar = {(a, b) for a, b in combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(similar) == 1215 and similar <= met and len(met) < 5 * len(similar)
