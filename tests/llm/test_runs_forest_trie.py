"""Operators 11 to 13 against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbel.llm import hash_forest, periodic_runs, prefix_trie

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

# ---- 11


def plain_runs(w, least=6, exponent=4):
    """(start, period, length) of all runs, period by period."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((a, q, b - a) for (a, b), q in found.items())


def plain_collapsed(w, runs):
    gone = {i for a, q, n in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def laid_in(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_z_function_against_its_definition():
    rng = random.Random(1)
    for _ in range(1500):
        n, k = rng.randint(0, 50), rng.choice([1, 2, 3])
        s = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.5:
            p = rng.randint(1, 6)
            s = [s[i % min(p, n)] if rng.random() > 0.03 else 1 for i in range(n)]
        want = [next((k for k in range(n - i) if s[k] != s[i + k]), n - i) for i in range(n)]
        assert periodic_runs.z_function(np.array(s, np.int64)).tolist() == want


@pytest.mark.parametrize("short", [8, 32, 512])
def test_runs_against_every_period(monkeypatch, short):
    """Short blocks, Z-functions, and both; words of few kinds, repeats within repeats, several texts on a line."""
    monkeypatch.setattr(periodic_runs, "SHORT", short)
    rng = random.Random(short)
    for _ in range(500):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.choice([0, 3, 7, 20, 60, 150]), rng.choice([1, 2, 3])
            w = [b"%d" % rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.7:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 3))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        assert [[tuple(x) for x in r.tolist()] for r in periodic_runs.runs_of(texts)] == [plain_runs(w) for w in texts]
    assert periodic_runs.runs_of([]) == []


def test_very_long_periodic_texts_are_linear():
    n = 200_000
    for w, want in (([b"a"] * n, [(0, 1, n)]), ([b"a", b"b"] * (n // 2), [(0, 2, n)]), ([b"x"] + [b"a", b"b", b"c"] * (n // 3), [(1, 3, n // 3 * 3)])):
        assert [tuple(x) for x in periodic_runs.runs_of([w])[0].tolist()] == want


def test_op11_on_whole_table(spark, real):
    from umbel.llm.queries import op11_periodic_runs

    got = op11_periodic_runs(spark, SF)
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    got = {r["doc_id"]: tuple(r)[1:] for r in got.collect()}
    assert len(got) == len(real)
    planted = 0
    for doc_id, text, *_ in real:
        w = laid_in(doc_id, text)
        runs = plain_runs(w)
        planted += bool(runs)
        best = max(runs, key=lambda r: (r[2] / r[1], -r[0], -r[1]), default=None)
        head = (len(runs), best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (0, None, None, None, None)
        lines = "".join(f"{a},{n},{q}\n" for a, q, n in runs)
        assert got[doc_id] == (*head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(plain_collapsed(w, runs).encode()).hexdigest())
    assert planted > 50


def test_runs_of_odd_rows(odd, nothing, odd_rows):
    found = periodic_runs.find_runs(odd)
    assert [c for c in odd.columns if c != "text"] == found.columns[:-3]
    got = Counter((r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed_text"]) for r in found.collect())
    want = []
    for doc_id, text, *_ in odd_rows:
        w = WORD.findall(text or "")
        runs = plain_runs(w) if len(w) < 10_000 else []
        want.append((doc_id, len(w), tuple(runs), plain_collapsed(w, runs)))
    assert got == Counter(want)
    assert periodic_runs.find_runs(nothing).count() == 0
    taken = periodic_runs.find_runs(odd.limit(3).withColumn("runs", F.lit(1)))
    assert taken.columns[-3:] == ["n_words", "runs_", "collapsed_text"] and taken.count() == 3


# ---- 12


def plain_nearest(rows, asked, k):
    """{query: [(id, score)]} over all other rows."""
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if asked(i):
            s = m @ np.array(v, float)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def recall(got, want):
    return np.mean([len({x for x, _ in got.get(q, [])} & {x for x, _ in w}) / max(1, len(w)) for q, w in want.items()])


def as_lists(found):
    out = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_op12_on_whole_table(spark, sf):
    from umbel.llm.queries import op12_hash_forest

    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    found = op12_hash_forest(spark, f"/root/testdata/{sf}")
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got, want = as_lists(found), plain_nearest(rows, lambda i: i % 20 == 0, 20)
    assert {q: [x for x, _ in v] for q, v in got.items()} == {q: [x for x, _ in v] for q, v in want.items()}  # so few are met in full
    assert all(abs(a - b) < 1e-12 for q in want for (_, a), (_, b) in zip(got[q], want[q], strict=True))


def test_forest_recall_where_it_descends(spark, monkeypatch):
    """With the root out of reach: vectors without clusters, of different lengths, and tight clusters beside them."""
    monkeypatch.setattr(hash_forest, "EXACT_ROWS", 64)
    rng = np.random.default_rng(4)
    free = rng.normal(size=(4000, 32)) / 6 * rng.uniform(0.3, 1.0, size=(4000, 1))
    near = np.repeat(rng.normal(size=(20, 32)), 60, axis=0) + rng.normal(size=(1200, 32)) * 0.1
    m = np.concatenate([free, near]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    want = plain_nearest(rows, lambda i: i % 20 == 0, 20)
    got = as_lists(hash_forest.nearest(df, F.col("id") % 20 == 0, 20, candidates=1500))
    assert recall(got, want) >= 0.9
    parts = {"PART_ROWS": 700, "QUERY_ROWS": 50}  # arrays met in a grid of parts, and of longer prefixes
    for name, value in parts.items():
        monkeypatch.setattr(hash_forest, name, value)
    assert as_lists(hash_forest.nearest(df, F.col("id") % 20 == 0, 20, candidates=1500)) == got


def test_letters_keep_near_vectors_together():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 17)).astype(np.float32)
    letters = hash_forest.Letters(16, 5, trees=30)
    a, b, c = letters.codes(x), letters.codes(x + 0.01 * rng.normal(size=x.shape).astype(np.float32)), letters.codes(rng.normal(size=x.shape).astype(np.float32))
    first = lambda u, v: ((u >> letters.shift(1)) == (v >> letters.shift(1))).mean()
    assert first(a, b) > 0.9 and first(a, c) < 0.1 and (a >= 0).all()


def test_forest_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 1.0]),
            (None, [1.0, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (40, [-1.0, 0.0]), (60, None), (10, [1e200, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({c: F.lit(7) for c in ("id", "score", "rank", "v", "query")})
    got = as_lists(hash_forest.nearest(df, F.col("id") % 20 == 0, 3))
    assert got == {
        0: [(10, 1e200), (20, 1.0), (1, 0.5)], 20: [(10, 1e200), (0, 1.0), (1, 0.5)], 40: [(1, -0.5), (2, -0.5), (0, -1.0)],
    }
    assert hash_forest.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert hash_forest.nearest(df.where("vec_id = 0"), F.col("id") % 20 == 0).count() == 0
    copies = spark.createDataFrame([(i, [1.0, 2.0] if i < 300 else [float(i), 1.0]) for i in range(330)], "vec_id bigint, embedding array<double>")
    some = plain_nearest([(r["vec_id"], r["embedding"]) for r in copies.collect()], lambda i: i % 20 == 0, 20)
    assert as_lists(hash_forest.nearest(copies, F.col("id") % 20 == 0, 20)) == some


# ---- 13


def plain_trie(rebuilt):
    """Rows of op13 from {conv_id: ((role, text), ...)}."""
    members, below = defaultdict(list), defaultdict(set)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                below[s[: d - 1]].add(s[:d])
    leaves, saved = Counter(), Counter()
    for s in sorted(members, key=len, reverse=True):
        leaves[s] += not below[s]
        saved[s] += (len(members[s]) - 1) * len(s[-1][1].encode()) if s else 0
        if s:
            leaves[s[:-1]] += leaves[s]
            saved[s[:-1]] += saved[s]
    out = []
    for s, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(rebuilt[c]) == len(s)))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(below[s]), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def plain_rebuilt(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: tuple(own.get(c - c % 5, [])[: heads[c]] + v[heads[c] :]) for c, v in own.items()}


@pytest.mark.parametrize(("range_bytes", "run_bytes"), [(4 << 20, 1 << 20), (4 << 20, 300), (3000, 500), (200, 100)])
def test_op13_on_whole_table(spark, monkeypatch, range_bytes, run_bytes):
    """One range and many, one run and many to a range."""
    from umbel.llm.queries import op13_prefix_trie

    monkeypatch.setattr(prefix_trie, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(prefix_trie, "RUN_BYTES", run_bytes)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op13_prefix_trie(spark, SF)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert Counter(tuple(r) for r in got.collect()) == plain_trie(plain_rebuilt(rows))


def test_merge_of_runs_by_a_loser_tree():
    rng = random.Random(6)
    unit = lambda x: bytes([x]) * prefix_trie.UNIT
    for k in (1, 2, 3, 5, 8):
        seqs = list({b"".join(unit(rng.randrange(3)) for _ in range(rng.randint(0, 7))) for _ in range(200)})
        deal = [[] for _ in range(k)]
        for i, s in enumerate(seqs):
            deal[rng.randrange(k)].append((s, 1, i, b"\0" * 32))
        got = list(prefix_trie.merged([prefix_trie.packed_run(d) for d in deal if d] or [b""]))
        assert [x[1] for x in got] == sorted(seqs)
        for a, b in zip(got[:-1], got[1:], strict=True):
            assert b[0] == prefix_trie.shared(a[1], b[1], 0)
    assert prefix_trie.shared(unit(1) * 900 + unit(2), unit(1) * 900 + unit(3), 5) == 900
    assert list(prefix_trie.merged([b""])) == []


def test_trie_of_odd_rows(spark, monkeypatch):
    """Nulls, equal turns, repeated rows, a hot opening, many copies, a deep conversation, and ends on inner nodes; over many ranges."""
    rng = random.Random(3)
    rows = [(1, None, None, None), (1, 0, "user", "hi"), (2, 0, "user", None), (2, 0, None, "x"), (2, 0, None, "x"), (3, 5, "a", "é\U0001f600"), (None, 0, "user", "nobody")]
    for c in range(10, 300):  # a third are copies, all open alike
        n = 4 if c % 3 == 0 else rng.randint(1, 6)
        rows += [(c, t, "user", "open" if t == 0 else "copy" if c % 3 == 0 else rng.choice("abc")) for t in range(n)]
    rows += [(400 + i, t, "user", "deep" if t < 600 - 7 * i else f"tail{i}") for i in range(5) for t in range(600)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit("clash") for c in ("seq", "unit", "key", "pid", "n", "known")})
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()[:32]
            convs[c].append((turn is not None, turn or 0, digest, role or "", text or ""))
    want = plain_trie({c: tuple(x[3:] for x in sorted(v)) for c, v in convs.items()})
    for size in (4 << 20, 5000, 400):
        monkeypatch.setattr(prefix_trie, "RANGE_BYTES", size)
        monkeypatch.setattr(prefix_trie, "RUN_BYTES", size // 3)
        assert Counter(tuple(r) for r in prefix_trie.trie(prefix_trie.sequences(df)).drop("node_id").collect()) == want
    assert prefix_trie.trie(prefix_trie.sequences(df.limit(0))).count() == 0
