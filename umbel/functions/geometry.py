"""Rectangles, rotated or not, as struct columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def side_ratio(width: Column, height: Column) -> Column:
    """width / height in double, 0 for height 0."""
    return F.when(height == 0, F.lit(0.0)).otherwise(F.try_divide(width.cast("double"), height.cast("double")))


def rotated_corners(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> Column:
    """The four corners of a rectangle turned by ``angle`` about its centre, cut to whole pixels: array<struct<x,y>>."""
    corner = []
    for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1)):
        dx, dy = w * (sx / 2), h * (sy / 2)
        x, y = cx + dx * F.cos(angle) - dy * F.sin(angle), cy + dx * F.sin(angle) + dy * F.cos(angle)
        corner.append(F.struct(x.cast("int").alias("x"), y.cast("int").alias("y")))
    return F.array(*corner)


def quad_area(corners: Column) -> Column:
    """Area of a polygon of four corners."""
    at = [F.element_at(corners, i) for i in (1, 2, 3, 4, 1)]
    twice = reduce(lambda s, t: s + t, [a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(at, at[1:], strict=False)])
    return F.abs(twice) / F.lit(2.0)


def region_valid(area: Column, width: Column, height: Column, scale: float = 1.0) -> Column:
    """Large enough and not too long: area over (16 * scale)^2 and sides within 15 to 1; null sides or area fail."""
    sides = F.try_divide(F.greatest(width, height).cast("double"), F.least(width, height).cast("double"))
    return F.coalesce((area > (16 * scale) ** 2) & (sides < 15), F.lit(False))


def blob_valid(solidity: Column, area: Column, scale: float = 1.0) -> Column:
    """Solid and large enough for a letter."""
    return F.coalesce((solidity > 0.25) & (area > (15 * scale) ** 2), F.lit(False))


def plain_patch(aspect: Column, area: Column, stddev: Column, scale: float = 1.0) -> Column:
    """Nearly square, large and even: a patch that gets further morphology."""
    return F.coalesce((aspect < 1.5) & (area > (25 * scale) ** 2) & (stddev < 25), F.lit(False))


def scaled(value: Column, factor: float, down: bool = True) -> Column:
    """A length at the working scale (``down``) or back at the full one."""
    return value * factor if down else F.try_divide(value, F.lit(factor))


# Projective maps are arrays of nine doubles, row by row; points and corners are structs of x and y.


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def square_to_quad(corners: Column) -> Column:
    """The map that takes (0,0), (1,0), (1,1), (0,1) to the four ``corners``; null if three of them are on one line."""
    p = [F.get(corners, F.lit(i)) for i in range(4)]
    dx1, dx2, sx = p[1]["x"] - p[2]["x"], p[3]["x"] - p[2]["x"], p[0]["x"] - p[1]["x"] + p[2]["x"] - p[3]["x"]
    dy1, dy2, sy = p[1]["y"] - p[2]["y"], p[3]["y"] - p[2]["y"], p[0]["y"] - p[1]["y"] + p[2]["y"] - p[3]["y"]
    det = dx1 * dy2 - dx2 * dy1
    g, h = F.try_divide(sx * dy2 - dx2 * sy, det), F.try_divide(dx1 * sy - sx * dy1, det)
    rows = [(p[1][c] - p[0][c] + g * p[1][c], p[3][c] - p[0][c] + h * p[3][c], p[0][c]) for c in ("x", "y")]
    return F.when(g.isNotNull() & h.isNotNull(), F.array(*rows[0], *rows[1], g, h, F.lit(1.0)))


def projected(m: Column, p: Column) -> Column:
    """Where a map takes a point; null coordinates on its horizon."""
    at = lambda i: F.get(m, F.lit(i))
    w = at(6) * p["x"] + at(7) * p["y"] + at(8)
    return F.struct(F.try_divide(at(0) * p["x"] + at(1) * p["y"] + at(2), w).alias("x"), F.try_divide(at(3) * p["x"] + at(4) * p["y"] + at(5), w).alias("y"))


def inverse_map(m: Column) -> Column:
    """The map that undoes ``m`` (its adjugate, as scale does not matter)."""
    a, b, c, d, e, f, g, h, i = (F.get(m, F.lit(k)) for k in range(9))
    return F.array(e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d)


def composed(first: Column, then: Column) -> Column:
    """The map that does ``first`` and ``then`` after it."""
    at = lambda m, i: F.get(m, F.lit(i))
    return F.array(*[sum((at(then, 3 * r + k) * at(first, 3 * k + c) for k in range(1, 3)), at(then, 3 * r) * at(first, c)) for r in range(3) for c in range(3)])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clipped(polygon: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """A convex or simple polygon (array of points) cut to a frame, one side after the other; empty if nothing is inside."""
    kind = "array<struct<x:double,y:double>>"
    for axis, limit, sign in (("x", x0, 1), ("x", x1, -1), ("y", y0, 1), ("y", y1, -1)):
        polygon = bound(polygon.cast(kind), _cut(axis, limit, sign))
    return polygon


def _cut(axis: str, limit: float, sign: int) -> Callable[[Column], Column]:
    """What is left of a polygon on one side: edges are walked only if they may cross the line, as most polygons lie on one side of it."""

    def cut(polygon: Column) -> Column:
        inside, outside = (lambda p: sign * (p[axis] - limit) >= 0), (lambda p: sign * (p[axis] - limit) < 0)
        return F.when(F.forall(polygon, inside), polygon).when(F.forall(polygon, outside), F.slice(polygon, 1, 0)).otherwise(_side(axis, limit, sign)(polygon))

    return cut


def _side(axis: str, limit: float, sign: int) -> Callable[[Column], Column]:
    return lambda polygon: _one_side(polygon, axis, limit, sign)


def _one_side(polygon: Column, axis: str, limit: float, sign: int) -> Column:
    """The part of a polygon on one side of a line: every edge gives its crossing, then its end, if they are inside."""
    other = "y" if axis == "x" else "x"

    def edge(p: Column, i: Column) -> Column:
        last = F.when(i == 0, F.element_at(polygon, -1)).otherwise(F.get(polygon, i - 1))
        d, e = sign * (last[axis] - limit), sign * (p[axis] - limit)
        cut = last[other] + (p[other] - last[other]) * F.try_divide(d, d - e)
        along, across = F.lit(float(limit)).alias(axis), cut.alias(other)
        crossing = F.struct(along, across) if axis == "x" else F.struct(across, along)
        both = F.array(F.when((d < 0) != (e < 0), crossing), F.when(e >= 0, F.struct(p["x"].alias("x"), p["y"].alias("y"))))
        return F.filter(both, lambda q: q.isNotNull())

    return F.flatten(F.transform(polygon, edge))


def polygon_area(polygon: Column) -> Column:
    """Area within a simple polygon of any number of corners, 0 for fewer than three."""

    def area(q: Column) -> Column:
        after = lambda i: F.get(q, (i + 1) % F.size(q))
        twice = F.transform(q, lambda p, i: (after(i)["y"] + p["y"]) * (p["x"] - after(i)["x"]))
        return F.coalesce(F.abs(F.aggregate(twice, F.lit(0.0), lambda s, x: s + x)) / 2, F.lit(0.0))

    return bound(polygon, area)


def bounds(polygon: Column) -> Column:
    """The smallest upright rectangle around a polygon: struct x1, y1, x2, y2."""

    def box(q: Column) -> Column:
        side = lambda f, c: f(F.transform(q, lambda p: p[c]))
        return F.struct(side(F.array_min, "x").alias("x1"), side(F.array_min, "y").alias("y1"), side(F.array_max, "x").alias("x2"), side(F.array_max, "y").alias("y2"))

    return bound(polygon, box)
