"""Vector arithmetic on array columns, in the JVM and in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    """The vector as array<double>."""
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null if a vector is null or lengths differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared L2 distance; null if a vector is null or lengths differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def distance(a: Column, b: Column) -> Column:
    """L2 distance."""
    return F.sqrt(squared_distance(a, b))


def norm(a: Column) -> Column:
    """L2 norm."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a norm is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalised(a: Column) -> Column:
    """The vector divided by its norm; elements are null for a zero vector."""
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x, n))


def minus(a: Column, b: Column) -> Column:
    """Element-wise difference: the residual of a vector and its centroid."""
    return F.zip_with(a, b, lambda x, y: x - y)


def parts(a: Column, n: int, length: int) -> list[Column]:
    """``n`` contiguous sub-vectors of ``length // n`` elements; a remainder at the end is left out."""
    each = length // n
    return [F.slice(a, i * each + 1, each) for i in range(n)]


def literal(v: Sequence[float]) -> Column:
    """A vector literal."""
    return F.array(*[F.lit(float(x)) for x in v])


def nearest(a: Column, centroids: Column) -> Column:
    """Index from 0 of the nearest of an array of centroids; the first of equally near ones."""
    far = F.transform(centroids, lambda c, i: F.struct(squared_distance(a, c).alias("d"), i.alias("i")))
    return F.array_min(far)["i"]


def slice_of(a: Column, start: int, length: int) -> Column:
    """``length`` elements from place ``start``, counted from 0."""
    return F.slice(a, start + 1, length)
