"""What a task gets does not grow with the table, whatever the number of shuffle partitions."""

import tracemalloc

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from umbel.lopq import LOPQModel
from umbel.operators import frames, regions, search, statistics
from umbel.plans import fixtures, queries
from umbel.plans.registry import Tables

SF = "/root/testdata/sf0.001"


def rows_of_tasks(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_fine_matches_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(frames, "TASK_ROWS", 100)
    t = Tables(spark, SF)
    lines = t.lineitem.count()
    for df in (fixtures.fine(t), queries()["w8_rank_fusion"](spark, SF), queries()["a17_feature_means"](spark, SF)):
        assert max(rows_of_tasks(df)) < 300 < lines / 8


def test_equal_training_rows_are_fitted_once_with_their_weight(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (3000, 2)) / 3
    label = (x**2).sum(axis=1) < 0.5
    rows = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, label, strict=True))], "id int, a double, b double, label int")
    seen = []
    fit = statistics.KernelClassifier._mapped
    monkeypatch.setattr(statistics.KernelClassifier, "_mapped", lambda self, df, extra: seen.append(df) or fit(self, df, extra))
    monkeypatch.setattr(statistics, "FIT_ROWS", 10)
    model = statistics.KernelClassifier(["a", "b"], "label", "id", iterations=60).fit(rows)
    (fitted,) = seen
    assert fitted.count() == len(np.unique(x, axis=0)) == 49 and max(rows_of_tasks(fitted)) < 30
    assert fitted.agg(F.sum("__weight")).first()[0] == 3000
    found = model.margins(rows).collect()
    # the loss of the weighted rows is that of all rows, one by one: no worse than Spark's own solver on these
    y = np.where([r["label"] for r in found], 1.0, -1.0)
    loss = lambda w, m: 0.01 / 2 * float(w @ w) + np.maximum(0, 1 - y * m).mean()
    mapped = model.map((x - model.mean) / model.scale)
    every = spark.createDataFrame([(Vectors.dense(m), float(c)) for m, c in zip(mapped, label, strict=True)], ["features", "label"])
    plain = LinearSVC(regParam=0.01, maxIter=60, tol=1e-8, standardization=False).fit(every)
    w = plain.coefficients.toArray()
    assert loss(model.weights, np.array([r["margin"] for r in found])) <= loss(w, mapped @ w + plain.intercept) * 1.005


@pytest.mark.parametrize("crowd", [0, 256])
def test_boxes_meet_alike_as_lists_and_by_cells(spark, monkeypatch, crowd):
    monkeypatch.setattr(regions, "CROWD", crowd, raising=False)
    rng = np.random.default_rng(3)
    box = lambda i: (int(rng.integers(0, 3)), i, *(lambda x, y, w, h: (x, y, x + w, y + h))(*map(int, rng.integers(0, 200, 2)), *map(int, rng.integers(0, 150, 2))))
    a, b = [box(i) for i in range(40)] + [(None, 90, 0, 0, 500, 500), (1, None, 0, 0, 500, 500), (1, 91, 0, 0, None, 500)], [box(i) for i in range(30)] + [(None, 92, 0, 0, 500, 500)]
    schema = "image int, idx int, x1 int, y1 int, x2 int, y2 int"
    ref, ver = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    want = []
    for p in a:
        met = [] if None in p else sorted((q[1], (min(p[4], q[4]) - max(p[2], q[2])) * (min(p[5], q[5]) - max(p[3], q[3]))) for q in b if p[0] == q[0] and min(p[4], q[4]) > max(p[2], q[2]) and min(p[5], q[5]) > max(p[3], q[3]))
        want += [(p[0], p[1], n, *m) for n, m in enumerate(met, 1)] or [(p[0], p[1], 0, None, 0)]
    assert sorted(map(tuple, regions.overlap_join(ref, ver).collect()), key=repr) == sorted(want, key=repr)
    scores = regions.region_scores(ref, ver)
    assert sorted(((r["image"], r["ref"], r["match"], r["ver"]) for r in scores.collect()), key=repr) == sorted((w[:4] for w in want), key=repr)
    # coordinates go along with the pairs: only boxes of crowded images are joined, by cells and to their numbers
    assert scores._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 2


def test_neighbours_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(frames, "TASK_ROWS", 100)
    rng = np.random.default_rng(5)
    x = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))], "id int, vector array<double>")
    got = search.knn(x, x, 5)
    assert got.count() == 1500 and max(rows_of_tasks(got)) < 250


def test_rotations_are_gathered_for_some_rows_at_a_time():
    rng = np.random.default_rng(6)
    rs, cs, mus, subs = rng.normal(size=(2, 4, 32, 32)), rng.normal(size=(2, 4, 32)), rng.normal(size=(2, 4, 32)), rng.normal(size=(2, 4, 16, 8))
    model = LOPQModel(4, 8, 16, tuple(cs), tuple(rs), tuple(mus), tuple(subs))
    coarse, fine, x = rng.integers(0, 4, (10_000, 2)), rng.integers(0, 16, (10_000, 8)), rng.normal(size=(10_000, 64))
    for run, how in ((lambda: model.project(x, coarse), "ij,j->i"), (lambda: model.reconstruct(coarse, fine), None)):
        tracemalloc.start()
        got = run()
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        print(peak)
        assert peak < 40
        if how:
            a = coarse[7]
            want = [rs[s][a[s]] @ (x[7, s * 32 : s * 32 + 32] - cs[s][a[s]] - mus[s][a[s]]) for s in (0, 1)]
            assert np.allclose(got[7], np.concatenate(want))
