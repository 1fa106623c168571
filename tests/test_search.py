"""Exact and hashed search, quantisation: against numpy and by their properties."""

import importlib
import re
import warnings

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from umbel.lopq import LOPQModel, build_index, evaluate, search
from umbel.lopq.model import allocate, rotation
from umbel.lopq.search import cell, cells_in_order, cells_to_quota, distances, read_index, reranked, search_reranked, write_index
from umbel.operators.retrieval import recall
from umbel.operators.search import knn, lsh_search, probe_hits, projection_tree, projections


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vector array<double>")


def plain_knn(q, x, k):
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
    return [sorted((d[i, j], j) for j in range(len(x)))[:k] for i in range(len(q))]


@pytest.mark.parametrize("block", [8192, 7])
def test_knn_with_ties_and_blocks(spark, block):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, (300, 6)).astype(float)  # many equal vectors
    q = x[:20]
    got = knn(frame(spark, q, 1000), frame(spark, x).repartition(5), 9, block=block).collect()
    want = plain_knn(q, x, 9)
    for i in range(20):
        mine = sorted((r["pos"], r["neighbour"], r["distance"]) for r in got if r["query"] == 1000 + i)
        assert [m[1] for m in mine] == [j for _, j in want[i]]
        assert np.allclose([m[2] for m in mine], [d for d, _ in want[i]])


def test_knn_odd(spark):
    x = frame(spark, np.eye(3))
    none = x.where("false")
    q = x.union(spark.createDataFrame([(77, None)], "id bigint, vector array<double>"))
    got = knn(q, none, 2).collect()
    assert {r["query"] for r in got} == {0, 1, 2, 77} and all(r["neighbour"] is None for r in got)
    assert knn(none, x, 2).count() == 0
    assert {r["query"]: r["neighbour"] for r in knn(x, x, 1, with_self=False).collect()} == {0: 1, 1: 0, 2: 0}
    assert [r["neighbour"] for r in knn(q, x, 1).orderBy("query").collect()] == [0, 1, 2, None]


def test_lsh_is_a_part_of_the_exact_search(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16))
    q = x[:30] + rng.normal(scale=0.01, size=(30, 16))
    near = lsh_search(frame(spark, q), frame(spark, x), 5, tables=6, bits=6, dimension=16).collect()
    exact = {(i, j): d for i, row in enumerate(plain_knn(q, x, 400)) for d, j in row}
    assert all(abs(exact[(r["query"], r["neighbour"])] - r["distance"]) < 1e-9 for r in near if r["neighbour"] is not None)
    assert {r["query"] for r in near} == set(range(30))
    assert sum(r["query"] == r["neighbour"] and r["pos"] == 1 for r in near) >= 28


@pytest.mark.parametrize("probes", [3, 50])
def test_lsh_sends_a_query_once_a_part(spark, monkeypatch, probes):
    """What bucket by bucket would find, with copies; a query is not shuffled once a probe."""
    from umbel.operators import search as s

    x = np.random.default_rng(7).normal(size=(300, 16))
    x = np.concatenate([x, x[:40], x[:40]])
    monkeypatch.setattr(s, "PART_ROWS", 150)
    monkeypatch.setattr(s, "LEAST_ROWS", 150)
    d, center = s.projections(16, 6), x.mean(axis=0)
    own = s._bits(x - center, d)
    far = np.abs((x[:20] - center) @ d.T) @ (np.arange(64)[:, None] >> np.arange(6) & 1).astype(float).T
    near = own[:20, None] ^ np.argsort(far, axis=1, kind="stable")[:, :probes]
    sent = []
    probed = s._probed
    monkeypatch.setattr(s, "_probed", lambda index, queries, *rest: sent.append(queries.count()) or probed(index, queries, *rest))
    got = lsh_search(frame(spark, x[:20]), frame(spark, x), 5, tables=1, bits=6, dimension=16, probes=probes).collect()
    assert sent == [20 * 3]
    for i in range(20):
        rows = [j for j in range(len(x)) if own[j] in near[i]]
        want = sorted((np.sqrt(((x[i] - x[j]) ** 2).sum()), j) for j in rows)[:5]
        mine = sorted((r["pos"], r["neighbour"], r["compared"]) for r in got if r["query"] == i)
        assert [m[1:] for m in mine] == [(j, len(rows)) for _, j in want]


@pytest.mark.parametrize(("tables", "parts"), [(1, 1), (1, 4), (2, 3)])
def test_one_search_tells_what_each_number_of_probes_finds(spark, monkeypatch, tables, parts):
    """As separate searches find it, with more copies than neighbours, tiles, waiting pairs, queries without a vector and tables smaller than k."""
    from umbel.operators import search as s

    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 16))
    x = np.concatenate([x, x[:30], np.repeat(x[30:32], 25, axis=0), np.zeros((3, 16))])[rng.permutation(483)]
    monkeypatch.setattr(s, "PART_ROWS", -(-len(x) // parts))
    monkeypatch.setattr(s, "LEAST_ROWS", len(x))
    monkeypatch.setattr(s, "QUERY_BLOCK", 40)
    k, probes, how = 9, (1, 5, 20, 64), {"tables": tables, "bits": 6, "dimension": 16}
    none = spark.createDataFrame([(10**6, None)], "id bigint, vector array<double>")
    index, q = frame(spark, x).union(none), frame(spark, x).where("id % 5 = 0").union(none)
    got = {r["query"]: r for r in probe_hits(q, index, k, probes, **how).collect()}
    assert len(got) == 98 and got.pop(10**6)["hits"] is None
    truth = {}
    for r in knn(q, index, k, with_self=False).where("neighbour IS NOT NULL").collect():
        truth.setdefault(r["query"], []).append(r["distance"])
    for i, p in enumerate(probes):
        found = {}
        for r in lsh_search(q, index, k + 1, probes=p, **how).where("query <> neighbour").collect():
            found.setdefault(r["query"], []).append((r["distance"], r["compared"]))
        for query, row in got.items():
            hits = [d for d, _ in found.get(query, []) if d <= max(truth[query]) + 1e-9]
            assert row["hits"][i] == min(len(hits), k) and row["first"][i] == any(d <= min(truth[query]) + 1e-9 for d in hits)
            assert query not in found or row["compared"][i] == found[query][0][1]
    assert all(r["hits"][-1] == k and r["first"][-1] for r in got.values())
    few = probe_hits(frame(spark, x[:4]), frame(spark, x[:4]), k, probes, **how).collect()
    assert all(r["hits"][-1] == 3 for r in few) and probe_hits(q, index.where("false"), k, probes, **how).where("hits IS NOT NULL").count() == 0
    with pytest.raises(ValueError, match="ascending"):
        probe_hits(q, index, k, (5, 1), **how)


def test_waiting_pairs_and_small_tiles_change_nothing(monkeypatch):
    from umbel.operators import search as s

    rng = np.random.default_rng(9)
    x = rng.integers(0, 3, (700, 5)).astype(float)  # many rows at equal distances
    q, k = x[:60], 7
    level, bucket = rng.integers(0, 3, (60, 4)), rng.integers(0, 4, 700)
    ids = pa.array([None, *range(1, 700)], pa.int64())
    want = []
    for i in range(60):
        d = np.sqrt(((x - q[i]) ** 2).sum(axis=1))
        other = [j for j in range(700) if not 0 < i == j]
        edge = sorted(d[other])[k - 1] + 1e-9
        for c in range(3):
            want += [(i, v, c) for v in sorted(d[j] for j in other if d[j] <= edge and level[i, bucket[j]] == c)[:k]]
    few = s._few_of_each(x, k + 1)
    assert len(few) < 700 and max(np.unique(x[few], axis=0, return_counts=True)[1]) == k + 1
    for tile, waiting, pairs in ((2048, 1 << 18, 1 << 12), (50, 1 << 18, 7), (50, 100, 1 << 12), (3, 10, 64)):
        for name, n in (("_TILE", tile), ("_WAITING", waiting), ("_PAIRS", pairs)):
            monkeypatch.setattr(s, name, n)
        for rows in (np.arange(700), few):
            found = s._nearest_by_level(q, ids[:60], [level], np.column_stack([x, (x * x).sum(axis=1)])[rows], ids.take(pa.array(rows)), [bucket[rows]], k, 2)
            if len(rows) == 700:
                assert sorted(zip(*(y.tolist() for y in found), strict=True)) == sorted(want)
            assert (np.diff(found[0]) >= 0).all() and all((np.diff(found[1][found[0] == i]) >= 0).all() for i in range(60))


def test_recall_curve_compares_the_tables_once(spark):
    """However many numbers of probes: each took another search before."""
    from umbel.plans.vectors import _curve

    rows = frame(spark, np.random.default_rng(10).normal(size=(200, 64))).withColumnsRenamed({"id": "vec_id", "vector": "embedding"})
    curves = [_curve(rows, p, "rows") for p in ((4,), (4, 32, 96, 256))]
    searches = [c._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") for c in curves]
    assert searches == [1, 1]
    first, (*_, last) = curves[0].collect(), curves[1].orderBy("probes").collect()
    assert curves[1].orderBy("probes").first() == first[0] and tuple(last) == ("rows", 256, 1.0, 1.0, 1.0)
    assert [tuple(r) for r in _curve(rows.where("false"), (4, 32), "none").orderBy("probes").collect()] == [("none", 4, None, None, None), ("none", 32, None, None, None)]


def test_document_vectors_are_shuffled_once(spark, tmp_path):
    """One row a text meets the others of its id; before, one a text and place, and again."""
    from umbel.plans.registry import Tables
    from umbel.plans.vectors import _document_vectors

    rng = np.random.default_rng(11)
    texts = [" ".join(f"W{w}" for w in rng.integers(0, 90, n)) for n in rng.integers(1, 60, 70)]
    rows = [*enumerate(texts), (3, "again\tand\n\nagain "), (None, "one"), (None, "two  two"), (90, None), (91, ""), (92, " \t\r"), (93, "\u00c9t\u00e9 \u00e9T\u00c9\u00a0x"), (94, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = _document_vectors(Tables(spark, str(tmp_path)))
    got = {r["vec_id"]: r["embedding"] for r in found.collect()}
    words = [(i, w) for i, text in rows for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    hashes = spark.createDataFrame(words, "i bigint, w string").select("i", F.xxhash64("w")).collect()
    want = {}
    for i, h in hashes:
        want.setdefault(i, np.zeros(64, int))[h % 64] += 1 if h >> 32 & 1 else -1
    assert got == {i: (n / np.sqrt(n @ n)).tolist() for i, n in want.items() if n.any()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("RepartitionByExpression") == 1 and "Aggregate" not in plan


def test_projection_tree(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 8))
    dirs = projections(8, 6, 3)
    got = {r["id"]: r["node"] for r in projection_tree(frame(spark, x), dirs, 40).collect()}
    bits = ["".join("1" if v > 0 else "0" for v in row) for row in x @ dirs.T]
    sizes = {}
    for b in bits:
        for i in range(7):
            sizes[b[:i]] = sizes.get(b[:i], 0) + 1
    for i, b in enumerate(bits):
        want = ""
        while len(want) < 6 and sizes[b[: len(want) + 1]] >= 40:
            want = b[: len(want) + 1]
        assert got[i] == want


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 4
    return np.concatenate([c + rng.normal(size=(80, 16)) * rng.uniform(0.2, 1.0, 16) for c in centres])


@pytest.fixture(scope="module")
def model(spark, clustered):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return LOPQModel(V=4, M=4, S=16).fit(frame(spark, clustered).repartition(4), coarse_rounds=8, local_rounds=8)


def test_reconstruction_is_better_than_the_cell_alone(clustered, model):
    coarse, fine = model.predict(clustered)
    back = model.reconstruct(coarse, fine)
    centre = np.concatenate([model.Cs[s][coarse[:, s]] for s in (0, 1)], axis=1)
    assert ((clustered - back) ** 2).sum() < 0.35 * ((clustered - centre) ** 2).sum()
    for r in model.Rs:
        assert np.allclose(r @ np.swapaxes(r, 1, 2), np.eye(8), atol=1e-8)


def test_code_distance_is_the_distance_to_the_reconstruction(spark, clustered, model):
    coarse, fine = model.predict(clustered[:50])
    back = model.reconstruct(coarse, fine)
    tables = model.subquantizer_distances(clustered[3], tuple(coarse[7]))
    assert abs(sum(t[f] for t, f in zip(tables, fine[7], strict=True)) - ((clustered[3] - back[7]) ** 2).sum()) < 1e-9
    assert len(model.subquantizer_distances(clustered[3], tuple(coarse[7]), 1)) == 2


def test_search_and_recall(spark, clustered, model):
    x = frame(spark, clustered)
    index = build_index(x, model)
    q = x.where("id % 50 = 0")
    found = search(q, index, model, quota=400, limit=50)
    truth = knn(q, x, 1)
    r = recall(found.withColumn("pos", F.col("pos") - 1), truth, [1, 10, 50]).first()
    assert r["recall_50"] >= 0.9 and r["recall_1"] <= r["recall_10"] <= r["recall_50"]
    rows = found.collect()
    by = {}
    for row in sorted(rows, key=lambda r: r["pos"]):
        by.setdefault(row["query"], []).append(row["distance"])
    assert all(d == sorted(d) and len(d) == 50 for d in by.values())
    everything = search(q, index, model, quota=10**6, limit=10**6)
    assert everything.groupBy("query").count().where(F.col("count") != len(clustered)).count() == 0
    assert search(q, index.where("false"), model).where("neighbour IS NOT NULL").count() == 0


def test_cells(spark, clustered, model):
    q = frame(spark, clustered[:5])
    cells = cells_in_order(q, model.Cs).collect()
    for i in range(5):
        mine = sorted((r["pos"], r["dist"], r["c0"], r["c1"]) for r in cells if r["query"] == i)
        d = [((clustered[i][s * 8 : s * 8 + 8] - model.Cs[s]) ** 2).sum(axis=1) for s in (0, 1)]
        assert [m[1] for m in mine] == sorted(m[1] for m in mine) and len(mine) == 16
        assert all(abs(m[1] - d[0][m[2]] - d[1][m[3]]) < 1e-9 for m in mine)
    index = build_index(frame(spark, clustered), model)
    kept = cells_to_quota(cells_in_order(q, model.Cs), index, 100).collect()
    for i in range(5):
        mine = sorted((r["pos"], r["count"]) for r in kept if r["query"] == i)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
        assert sum(c for _, c in mine) >= 100 > sum(c for _, c in mine[:-1])


@pytest.mark.parametrize("depth", [37, 10**6])
def test_search_by_vectors_without_a_row_for_each_pair(spark, clustered, model, monkeypatch, depth):
    """The rows of a whole search by code and a whole re-ranking, with copies, from parts that send some rows a query each."""
    lopq_search = importlib.import_module("umbel.lopq.search")
    for name, n in (("QUERY_BLOCK", 20), ("PART_ROWS", 200), ("LEAST_ROWS", 200), ("_PRODUCT", 500)):
        monkeypatch.setattr(lopq_search, name, n)
    x = frame(spark, np.concatenate([clustered, clustered[:200], clustered[:100]])).repartition(3)
    index, q = build_index(x, model), x.where("id % 40 = 0").unionByName(spark.createDataFrame([(-1, None)], x.schema))
    plain = lambda df: sorted(map(tuple, df.select("query", "pos", "neighbour", "distance").collect()), key=str)
    got = plain(search_reranked(q, index, model, x, 700, depth, 9))
    assert got == plain(reranked(search(q, index, model, 700, depth), q, x, 9)) and (-1, None, None, None) in got
    all_pairs = distances(q, index, model, 700)
    near = distances(q, index, model, 700, 9)
    assert all_pairs.groupBy("query").count().where("count < 700").count() == 0
    assert near.groupBy("query").count().agg(F.max("count")).first()[0] <= 9 * 2 * (16 + len(clustered) * 2 // 200)


def test_store_and_index_round_trip(spark, clustered, model, tmp_path):
    model.save(spark, str(tmp_path / "m"))
    again = LOPQModel.load(spark, str(tmp_path / "m"))
    assert all(np.array_equal(a, b) for k in ("Cs", "Rs", "mus", "subs") for a, b in zip(getattr(model, k), getattr(again, k), strict=True))
    x = frame(spark, clustered)
    write_index(build_index(x.where("id < 500"), model), str(tmp_path / "i"))
    write_index(build_index(x.where("id >= 500"), model), str(tmp_path / "i"))
    index = read_index(spark, str(tmp_path / "i"))
    assert index.count() == len(clustered)
    c = build_index(x, model).first()
    assert c["id"] in {r["id"] for r in cell(index, c["c0"], c["c1"]).collect()}
    assert "PartitionFilters: [isnotnull" in cell(spark.read.parquet(str(tmp_path / "i")), 1, 1)._jdf.queryExecution().toString()
    same = evaluate.code_stability(x, model).first()
    assert same["n"] == len(clustered) and same["same_coarse"] >= 0.9 * same["n"]
    d = evaluate.distortion(x, model)
    coarse, fine = model.predict(clustered)
    assert abs(d.sum() - ((clustered - model.reconstruct(coarse, fine)) ** 2).sum() / len(clustered)) < 1e-8
    assert model.coarse_of(model.cell_id((3, 2))) == (3, 2)


def test_given_parts_are_kept(spark, clustered, model):
    again = LOPQModel(4, 4, 16, Cs=model.Cs, Rs=model.Rs, mus=model.mus).fit(frame(spark, clustered), local_rounds=2, sample=0.5)
    assert again.Cs is model.Cs and again.Rs is model.Rs and again.subs[0].shape == (2, 16, 4)
    with pytest.raises(ValueError, match="together"):
        LOPQModel(4, 4, 16, Rs=model.Rs)
    with pytest.raises(ValueError, match="too few"):
        LOPQModel(4, 4, 16).fit(frame(spark, clustered[:9]))


def test_sums_of_many_tasks(spark, clustered, monkeypatch):
    """Added in groups or by the driver alone, the sums are the same."""
    from umbel.lopq import model as m

    x = frame(spark, clustered).repartition(9).select(F.col("vector").alias("v"))
    partial = lambda y: {"s": y.sum(axis=0), "o": y.T @ y}
    alone = m._summed(x, partial)
    monkeypatch.setattr(m, "SUM_TASKS", 2)
    grouped = m._summed(x, partial)
    assert np.allclose(alone["o"], clustered.T @ clustered) and all(np.allclose(alone[k], grouped[k]) for k in alone)


def test_allocation_balances():
    values = np.array([8.0, 4.0, 2.0, 1.0, 0.5, 0.25, 0.0, 16.0])
    order = allocate(values, 4)
    assert sorted(order) == list(range(8))
    logs = [sum(np.log2(max(values[i], 0.25) / 0.25) for i in order[b * 2 : b * 2 + 2]) for b in range(4)]
    assert max(logs) - min(logs) <= 3
    assert allocate(np.zeros(4), 2).tolist() == [0, 2, 1, 3] or sorted(allocate(np.zeros(4), 2)) == [0, 1, 2, 3]


def test_thin_cells():
    with pytest.warns(UserWarning, match="no rotation"):
        r, m = rotation(np.zeros((4, 4)), np.zeros(4), 0, 2)
    assert np.array_equal(np.sort(r, axis=0)[-1], np.ones(4)) and not m.any()
    with pytest.warns(UserWarning):
        rotation(np.ones((4, 4)), np.ones(4), 1, 2)
