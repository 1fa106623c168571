"""Keypoint matching: two nearest neighbours, exact or by a kd-forest, ratio test, robust two-view geometry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbel.functions.vectors import squared_distance
from umbel.operators import robust
from umbel.operators.kdforest import CHECKS, TREES, KdForest
from umbel.operators.robust import TOLERANCE

RATIO = 0.7
#: Numbers of a temporary array of differences.
BLOCK = 1 << 22
RESULT = "pair string, kp_actual int, kp_candidate int, matches int, good int, ransac int, error string"


def two_nearest(verified: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kp, first, d1, d2): each verified keypoint's nearest reference keypoint and the two least distances.

    Both frames have keys, kp and vector (array<double>). Keypoints of one image pair number some
    hundreds, so a pair is the unit of work; keys spread pairs over tasks.
    """
    r = reference.select(*keys, F.col("kp").alias("kp2"), F.col("vector").alias("v2"))
    far = verified.join(r, keys).select(*keys, "kp", "kp2", F.sqrt(squared_distance(F.col("vector"), F.col("v2"))).alias("d"))
    ranked = far.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "kp").orderBy("d", "kp2"))).where("r <= 2")
    return ranked.groupBy(*keys, "kp").agg(F.max(F.when(F.col("r") == 1, F.col("kp2"))).alias("first"), F.max(F.when(F.col("r") == 1, F.col("d"))).alias("d1"), F.max(F.when(F.col("r") == 2, F.col("d"))).alias("d2"))


def good_matches(near: DataFrame, ratio: float = RATIO) -> DataFrame:
    """Matches whose nearest neighbour is clearly nearer than the next."""
    return near.where(F.col("d1") < ratio * F.col("d2"))


def match_counts(near: DataFrame, keys: list[str], ratio: float = RATIO) -> DataFrame:
    """(keys, matches, good)."""
    return near.groupBy(*keys).agg(F.count("*").alias("matches"), F.count_if(F.col("d1") < ratio * F.col("d2")).alias("good"))


def nearest_two(verified: np.ndarray, reference: np.ndarray, matcher: str = "brute", trees: int = TREES, checks: int | None = CHECKS, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each verified descriptor its nearest reference row and the two least distances, and how many rows were compared.

    ``brute`` compares all, in blocks of bounded size; ``flann`` asks a forest of kd-trees and compares ``checks`` rows
    a descriptor (None: as many as an exact answer takes).
    """
    n = len(verified)
    if matcher == "flann":
        forest = KdForest(reference, trees, seed)
        found = [forest.nearest(q, 2, checks) for q in verified]
        rows = np.array([[r for _, r in best] for best, _ in found], int).reshape(n, 2)
        d = np.sqrt(np.array([[x for x, _ in best] for best, _ in found]).reshape(n, 2))
        return rows[:, 0], d[:, 0], d[:, 1], sum(c for _, c in found)
    if matcher != "brute":
        raise ValueError(f"no such matcher: {matcher}")
    first, d = np.zeros(n, int), np.zeros((n, 2))
    step = max(1, BLOCK // max(1, reference.size))
    for s in range(0, n, step):
        far = ((verified[s : s + step, None] - reference[None]) ** 2).sum(axis=2)
        order = np.argsort(far, axis=1, kind="stable")[:, :2]
        first[s : s + step] = order[:, 0]
        d[s : s + step] = np.sqrt(np.take_along_axis(far, order, 1))
    return first, d[:, 0], d[:, 1], n * len(reference)


def match_pairs(pairs: DataFrame, ratio: float = RATIO, tolerance: float = TOLERANCE, matcher: str = "brute", trees: int = TREES, checks: int | None = CHECKS) -> DataFrame:
    """RESULT for every row of ``pairs``: pair, and for both sides points (array of [x, y]) and descriptors (array of vectors).

    ransac: the good matches that one fundamental matrix explains, by samples that a dominant plane can't mislead
    (``robust.robust_fundamental``); null for fewer than eight. Fewer than two reference descriptors, or none verified, give a row with ``error``; other failures do
    too, so that one bad pair never stops the rest.
    """

    def one(name, pv, dv, pr, dr) -> tuple:
        pv, dv, pr, dr = (np.array([list(x) for x in (y if y is not None else [])], float) for y in (pv, dv, pr, dr))
        if not len(dv) or len(dr) < 2:
            raise ValueError("too few descriptors")
        first, d1, d2, _ = nearest_two(dv, dr, matcher, trees, checks)
        good = d1 < ratio * d2
        return name, len(dv), len(dr), len(d1), int(good.sum()), robust.inliers(pv[good], pr[first[good]], tolerance), None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RESULT.split(", ")]
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                try:
                    rows.append(one(*r))
                except Exception as e:  # noqa: BLE001
                    rows.append((r[0], None, None, None, None, None, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({c: "Int32" for c in names[1:6]})

    cols = pairs.select("pair", "points_ver", "descriptors_ver", "points_ref", "descriptors_ref")
    return cols.mapInPandas(run, RESULT)


def _per_group(rows: DataFrame, key: str, columns: list[str], work: Callable, schema: str) -> DataFrame:
    """``work(key, one array a column)`` on the rows of every key, in order of ``columns``; it yields rows of ``schema``.

    The rows of a key are the points of one image pair, which fit a task; keys spread over tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.field(n, {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in schema.split(", "))]
        for b in batches:
            out = []
            for k, group in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                flat = group.values.flatten()
                out += work(k, *[np.asarray(x.to_pylist()) for x in flat])
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(kinds)], schema=pa.schema(kinds))

    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("points"))
    return grouped.mapInArrow(run, schema)


def scene_inliers(points: DataFrame, key: str = "scene", tolerance: float = TOLERANCE, planes: bool = True) -> DataFrame:
    """(scene, pairs, inliers) of point pairs (scene, id, x, y, u, v): how many agree with one two-view geometry."""

    def work(scene, ids, x, y, u, v):
        return [(scene, len(ids), robust.inliers(np.column_stack([x, y]), np.column_stack([u, v]), tolerance, planes=planes))]

    return _per_group(points, key, ["id", "x", "y", "u", "v"], work, f"{key} bigint, pairs int, inliers int")


def aligned(points: DataFrame, key: str = "scene", tolerance: float = TOLERANCE) -> DataFrame:
    """(scene, id, mx, my, inside) of point pairs (scene, id, x, y, u, v): where the homography that most pairs agree with takes (x, y).

    Scenes of fewer than four pairs, or without a homography, give null places.
    """

    def work(scene, ids, x, y, u, v):
        a, b = np.column_stack([x, y]), np.column_stack([u, v])
        h, inside = robust.robust_homography(a, b, tolerance)
        at = [(None, None)] * len(a) if h is None else robust.mapped(h, a).tolist()
        return [(scene, i, *p, bool(x)) for i, p, x in zip(ids.tolist(), at, inside, strict=True)]

    return _per_group(points, key, ["id", "x", "y", "u", "v"], work, f"{key} bigint, id bigint, mx double, my double, inside boolean")


def two_nearest_of_sets(verified: DataFrame, reference: DataFrame, key: str, matcher: str = "flann", trees: int = TREES, checks: int | None = CHECKS) -> DataFrame:
    """(key, kp, first, d1, d2, compared) of keypoints (key, kp, vector): the two nearest reference descriptors of every verified one.

    compared: rows held against each on average. Sets of fewer than two reference descriptors give no rows.
    """
    side = lambda d, s: d.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("kp", "vector"))).alias(s))
    sets = side(verified, "a").join(side(reference, "b"), key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [pd.DataFrame({key: [], "kp": [], "first": [], "d1": [], "d2": [], "compared": []}).astype({key: "int64", "kp": "int64", "first": "int64"})]
            for name, a, b in f.itertuples(index=False):
                if len(b) < 2:
                    continue
                (ka, va), (kb, vb) = (zip(*[(x["kp"], x["vector"]) for x in side], strict=True) for side in (a, b))
                first, d1, d2, compared = nearest_two(np.array(va, float), np.array(vb, float), matcher, trees, checks)
                out.append(pd.DataFrame({key: name, "kp": ka, "first": np.array(kb)[first], "d1": d1, "d2": d2, "compared": compared / len(ka)}))
            yield pd.concat(out)

    return sets.mapInPandas(run, f"{key} bigint, kp bigint, first bigint, d1 double, d2 double, compared double")


def match_features(result: DataFrame) -> DataFrame:
    """Rows without error or missing counts, with the four ratios and whether the candidate is the actual package."""
    kept = result.where("ransac_matches_amount IS NOT NULL")
    r = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return kept.withColumns(
        {
            "package_match": F.col("package_actual") == F.col("package_candidate"),
            "good_ratio": r("good_matches_amount", "matches_amount"), "ransac_ratio": r("ransac_matches_amount", "matches_amount"),
            "ransac_good_ratio": r("ransac_matches_amount", "good_matches_amount"), "keypoint_ratio": r("kp_amount_actual", "kp_amount_candidate"),
        }
    )


def candidate_pairs(candidates: DataFrame, phones: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Every candidate with every phone; null candidates are left out first."""
    return candidates.where("package_candidate IS NOT NULL").withColumn("phone", F.explode(F.array(*[F.lit(p) for p in phones])))
