"""Ranking against pandas, on small frames with ties, gaps and missing values."""

import numpy as np
import pandas as pd
import pytest

from umbel.operators import ranking, retrieval


def golden(df: pd.DataFrame, top: int) -> dict:
    """Pivot, rank every column, sum ranks, list the best, vote: the steps as pandas does them."""
    out = {}
    for key, part in df.dropna(subset=["package", "distance"]).groupby(["sample", "algorithm"]):
        votes, seen = {}, {}
        pivots = {a: part.pivot_table(index="package", columns="descriptor", values="distance", aggfunc=a) for a in ("mean", "median", "sum", "min", "size")}
        for d in pivots["mean"].columns:
            total = sum(p[d].rank(method="max", ascending=a != "size", na_option="bottom") for a, p in pivots.items())
            for place, package in enumerate(total.nsmallest(top).index, 1):
                votes[package] = votes.get(package, 0) + 1
                seen.setdefault(package, (d, place))
        out[key] = sorted(votes, key=lambda p: (-votes[p], seen[p]))[:top]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_core_against_pandas(spark, seed):
    rng = np.random.default_rng(seed)
    n = 400
    df = pd.DataFrame(
        {
            "sample": rng.choice(["s1", "s2", "s3"], n), "algorithm": rng.choice(["A", "B"], n), "descriptor": rng.integers(0, 5, n),
            "package": rng.choice([f"p{i:02d}" for i in range(14)] + [None], n), "distance": rng.choice([0.25, 0.5, 0.75, 1.0, 1.5, np.nan], n),
        }
    )
    rows = [tuple(None if pd.isna(x) else x for x in r) for r in df.itertuples(index=False)]
    rows = [(a, b, int(c), d, None if e is None else float(e)) for a, b, c, d, e in rows]
    got = ranking.candidates(spark.createDataFrame(rows, "sample string, algorithm string, descriptor int, package string, distance double"), 6).collect()
    lists: dict = {}
    for r in sorted(got, key=lambda r: r["pos"]):
        lists.setdefault((r["sample"], r["algorithm"]), []).append(r["package"])
    assert lists == golden(df, 6)


@pytest.mark.parametrize("descending", [False, True])
def test_ranks_against_pandas(spark, descending):
    values = [3.0, 1.0, None, 3.0, 2.0, None, 1.0, 1.0]
    df = spark.createDataFrame([(i, "k", v) for i, v in enumerate(values)], "i int, k string, v double")
    got = df.select("i", ranking.max_rank("v", ["k"], descending).alias("m"), ranking.dense_rank("v", ["k"], descending).alias("d")).orderBy("i").collect()
    s = pd.Series(values, dtype=float)
    assert [r["m"] for r in got] == s.rank(method="max", ascending=not descending, na_option="bottom").astype(int).tolist()
    assert [r["d"] for r in got] == s.rank(method="dense", ascending=not descending, na_option="bottom").astype(int).tolist()


def test_wide_and_long_are_inverse(spark):
    rows = [("s", "A", "p1", 2, 1), ("s", "A", "p2", 1, 2), ("s", "B", "p9", 1, 1), ("t", "A", "p3", 3, 1)]
    df = spark.createDataFrame(rows, "sample string, algorithm string, package string, votes int, pos int")
    back = ranking.long(ranking.wide(df, 4), ["sample", "algorithm"], 4)
    assert sorted(map(tuple, back.collect())) == sorted((a, b, e, c) for a, b, c, _, e in rows)
    fused = ranking.interleave(df).where("sample = 's'").orderBy("fused").collect()
    assert [r["package"] for r in fused] == ["p1", "p9", "p2"]


def test_empty(spark):
    none = spark.createDataFrame([], "sample string, algorithm string, descriptor int, package string, distance double")
    assert ranking.candidates(none).count() == 0


def test_curves(spark):
    rng = np.random.default_rng(3)
    rows = [(float(rng.integers(0, 40)), int(rng.random() < 0.4)) for _ in range(500)]
    df = spark.createDataFrame(rows, "s double, y int")
    up = np.array([s for s, y in rows if y])
    down = np.array([s for s, y in rows if not y])
    want = ((up[:, None] > down[None]).mean() + (up[:, None] == down[None]).mean() / 2).item()
    assert abs(retrieval.auc(df, "s", "y").first()["auc"] - want) < 1e-12
    points = sorted((r["fpr"], r["tpr"]) for r in retrieval.roc(df, "s", "y").collect())
    x, y = np.array([(0.0, 0.0), *points]).T
    assert points[-1] == (1.0, 1.0) and abs(np.trapezoid(y, x) - want) < 1e-12


def test_mode_counts_null(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", 1), ("b", 2), ("b", 1)], "k string, v int")
    assert {r["k"]: r["v"] for r in retrieval.mode(df, ["k"], "v").collect()} == {"a": None, "b": 1}


def test_best_row_skips_null(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, 5.0), ("b", 4, None)], "k string, i int, v double")
    assert {r["k"]: r["i"] for r in retrieval.best_row(df, ["k"], "v", ["i"]).collect()} == {"a": 2, "b": 4}
