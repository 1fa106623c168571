"""Hulls, smallest rectangles, outlines and their approximation, for points and pixels gathered by region.

Points of a region are thinned out natively to the outermost of every row before they meet in a task, so what a
task gets of a region is bounded by its height.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Points = list[tuple[float, float]]


def hull(points: Points) -> Points:
    """Corners of the convex hull by the monotone chain, counter-clockwise from the leftmost; no three on a line."""
    at = sorted(set(points))
    if len(at) < 3:
        return at

    def chain(order) -> Points:
        out: Points = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(at) + chain(reversed(at))


def smallest_rectangle(corners: Points) -> tuple[float, float, float, float, float]:
    """(cx, cy, width, height, angle) of the rectangle of least area around a convex polygon; of equal ones the first side's.

    One of its sides lies on a side of the polygon. The three other touching corners only move on as the side turns
    (rotating calipers), so a turn around the polygon costs a few passes. width lies along the side, angle is its direction.
    """
    n = len(corners)
    if n == 0:
        return (np.nan,) * 5
    if n == 1:
        return (*corners[0], 0.0, 0.0, 0.0)
    p = np.array(corners, float)
    best = None
    far = top = near = None
    for i in range(n if n > 2 else 1):
        d = p[(i + 1) % n] - p[i]
        length = np.hypot(*d)
        u = d / length
        v = np.array([-u[1], u[0]])
        if far is None:
            along = p @ u
            far, near, top = int(along.argmax()), int(along.argmin()), int((p @ v).argmax())
        for name, axis in (("far", u), ("top", v), ("near", -u)):
            j = {"far": far, "top": top, "near": near}[name]
            for _ in range(n):
                if p[(j + 1) % n] @ axis <= p[j] @ axis:
                    break
                j = (j + 1) % n
            far, top, near = (j if name == "far" else far), (j if name == "top" else top), (j if name == "near" else near)
        a, b, low, high = p[near] @ u, p[far] @ u, p[i] @ v, p[top] @ v
        area = (b - a) * (high - low)
        if best is None or area < best[0] * (1 - 1e-12):
            c = u * (a + b) / 2 + v * (low + high) / 2
            best = (area, float(c[0]), float(c[1]), float(b - a), float(high - low), float(np.degrees(np.arctan2(u[1], u[0]))))
    return best[1:]


def simplified(outline: Points, tolerance: float) -> Points:
    """A closed outline with fewer corners, none of whose points is further than ``tolerance`` away (Douglas and Peucker).

    It is first cut at its first point and the point furthest from it.
    """
    n = len(outline)
    if n < 3:
        return list(outline)
    p = np.array([*outline, outline[0]], float)
    split = int(((p[:n] - p[0]) ** 2).sum(axis=1).argmax())
    keep, parts = {0, split}, [(0, split), (split, n)]
    while parts:
        a, b = parts.pop()
        if b - a < 2:
            continue
        d = p[b] - p[a]
        length = np.hypot(*d)
        off = p[a + 1 : b] - p[a]
        far = np.abs(d[0] * off[:, 1] - d[1] * off[:, 0]) / length if length else np.hypot(off[:, 0], off[:, 1])
        i = int(far.argmax())
        if far[i] > tolerance:
            keep.add(a + 1 + i)
            parts += [(a, a + 1 + i), (a + 1 + i, b)]
    return [outline[i] for i in sorted(keep) if i < n]


def perimeter(outline: Points) -> float:
    return float(sum(np.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(outline, [*outline[1:], *outline[:1]], strict=True)))


def area(outline: Points) -> float:
    """Area within a closed outline."""
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(outline, [*outline[1:], *outline[:1]], strict=True))) / 2


#: The eight neighbours in turn (y grows downwards), from the right.
_AROUND = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def outer_border(pixels: set[tuple[int, int]]) -> Points:
    """Outline of a connected set of pixels by following its outer border once around, straight stretches as their ends.

    It begins at the topmost, leftmost pixel, from which the next border pixel is searched for in turn, from the one it was come from.
    """
    start = min(pixels, key=lambda p: (p[1], p[0]))

    def turn(at: tuple[int, int], since: int) -> tuple[int, tuple[int, int]] | None:
        for k in range(8):
            d = (since + k) % 8
            to = (at[0] + _AROUND[d][0], at[1] + _AROUND[d][1])
            if to in pixels:
                return d, to
        return None

    first = turn(start, 7)
    if first is None:
        return [start]
    path, (d, at) = [start], first
    steps = [d]
    while True:
        step = turn(at, (d + 7) % 8 if d % 2 == 0 else (d + 6) % 8)
        path.append(at)
        d, to = step
        if at == start and d == first[0]:
            path.pop()
            break
        steps.append(d)
        at = to
    return [path[i] for i in range(len(path)) if steps[i] != steps[i - 1] or len(path) < 3]


METHODS = ("contour", "brect", "rrect", "hull", "hull_approximated")


def polygon_of(contour: Points, method: str) -> Points:
    """An outline as it is, as its upright or smallest rectangle, as its hull, or as the hull with 2 % of its perimeter to spare."""
    if method == "contour":
        return contour
    if method == "hull":
        return hull(contour)
    if method == "hull_approximated":
        h = hull(contour)
        return simplified(h, 0.02 * perimeter(h))
    if method == "brect":
        (x1, y1), (x2, y2) = np.min(contour, axis=0), np.max(contour, axis=0)
        return [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]
    if method == "rrect":
        cx, cy, w, h, angle = smallest_rectangle(hull(contour))
        u = np.array([np.cos(np.radians(angle)), np.sin(np.radians(angle))])
        v = np.array([-u[1], u[0]])
        return [(float(cx + q[0]), float(cy + q[1])) for q in (-u * w / 2 - v * h / 2, u * w / 2 - v * h / 2, u * w / 2 + v * h / 2, -u * w / 2 + v * h / 2)]
    raise ValueError(f"no such method: {method}")


def _by_region(points: DataFrame, keys: list[str], work: Callable[[Points], tuple], schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """``work(points)`` for the points of every region, as columns of ``schema`` beside its keys."""
    grouped = points.groupBy(*keys).agg(F.collect_list(F.struct("x", "y")).alias("p"))
    names = [*keys, *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(keys)).to_pylist()
            out = [work([(q["x"], q["y"]) for q in p]) for p in lists]
            new = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *new], names)

    types = dict(points.dtypes)
    return grouped.mapInArrow(run, ", ".join([*(f"{k} {types[k]}" for k in keys), schema]))


def outermost(points: DataFrame, keys: list[str]) -> DataFrame:
    """Of the points (keys, x, y) the first and last of every row of a region, which hold its hull; null places are left out."""
    ends = points.where("x IS NOT NULL AND y IS NOT NULL").groupBy(*keys, "y").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    return ends.select(*keys, F.explode(F.array_distinct(F.array("a", "b"))).alias("x"), "y")


def rectangles(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, corners, hull_area, cx, cy, width, height, angle): hull and smallest rectangle of the points (keys, x, y) of every region."""

    def work(p: Points) -> tuple:
        h = hull(p)
        return (len(h), area(h) if len(h) > 2 else 0.0, *smallest_rectangle(h))

    return _by_region(outermost(points, keys), keys, work, "corners int, hull_area double, cx double, cy double, width double, height double, angle double", [pa.int32(), *[pa.float64()] * 6])


def outlines(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, method, polygon, area, perimeter) of the pixels (keys, x, y) of connected regions, a row for each of METHODS.

    The pixels of one region meet in a task. Areas are within the outline through the middles of its border pixels.
    """
    shape = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))

    def work(p: Points) -> tuple:
        contour = outer_border(set(p))
        out = [polygon_of(contour, m) for m in METHODS]
        return [[{"x": float(x), "y": float(y)} for x, y in q] for q in out], [area(q) if len(q) > 2 else 0.0 for q in out], [perimeter(q) for q in out]

    schema = "polygons array<array<struct<x:double,y:double>>>, areas array<double>, perimeters array<double>"
    found = _by_region(pixels.distinct(), keys, work, schema, [pa.list_(shape), pa.list_(pa.float64()), pa.list_(pa.float64())])
    each = F.explode(F.arrays_zip(F.array(*[F.lit(m) for m in METHODS]).alias("method"), F.col("polygons").alias("polygon"), F.col("areas").alias("area"), F.col("perimeters").alias("perimeter")))
    return found.select(*keys, each.alias("e")).select(*keys, "e.*")
