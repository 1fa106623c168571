"""Pixel tables: runs, connected regions, clearing of borders; whole small images: line dilation and stable regions.

A pixel table has a row for each pixel that is set (keys of the image, y, x). Regions are labelled between tasks, so an
image may be of any size; the two image kernels take an image as one row of values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a strip by which runs of neighbouring rows find each other.
STRIP = 256
#: Directions of ``line_dilation``, in degrees.
ANGLES = tuple(range(-90, 90, 5))


def runs(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x0, x1, run): the stretches of neighbouring pixels of each row; run names one within its image."""
    one = pixels.select(*keys, F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x")).distinct()
    place = F.row_number().over(Window.partitionBy(*keys, "y").orderBy("x"))
    found = one.withColumn("shift", F.col("x") - place).groupBy(*keys, "y", "shift").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("shift")
    return found.withColumn("run", F.shiftleft("y", 32) + F.col("x0"))


def touching(found: DataFrame, keys: list[str], diagonal: bool = True) -> DataFrame:
    """(keys, run, near): both ways, runs of neighbouring rows that touch, at corners too if ``diagonal``."""
    reach = int(diagonal)
    strip = lambda a, b: F.explode(F.sequence(F.floor(a / STRIP), F.floor(b / STRIP)))
    low = found.select(*keys, "run", "x0", "x1", (F.col("y") + 1).alias("row"), strip(F.col("x0") - reach, F.col("x1") + reach).alias("strip"))
    high = found.select(*keys, F.col("run").alias("near"), F.col("x0").alias("a"), F.col("x1").alias("b"), F.col("y").alias("row"), strip(F.col("x0"), F.col("x1")).alias("strip"))
    met = low.join(high.hint("merge"), [*keys, "row", "strip"]).where((F.col("a") <= F.col("x1") + reach) & (F.col("b") >= F.col("x0") - reach)).select(*keys, "run", "near").distinct()
    return met.unionByName(met.select(*keys, F.col("near").alias("run"), F.col("run").alias("near")))


def labelled(pixels: DataFrame, keys: list[str], scratch: Callable[[str], str], diagonal: bool = True) -> DataFrame:
    """(keys, y, x0, x1, run, label): runs with the least run of their connected region.

    Every round a run takes the least label around it and then the label which that one has come to, so labels
    travel twice as far each time. ``scratch`` names folders for the rounds' tables. All sides grow with the pixels, so joins merge:
    a broadcast would pass them through the driver, in every round again.
    """
    spark = pixels.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch(name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    found = kept(runs(pixels, keys), "runs")
    links = kept(touching(found, keys, diagonal), "touching")
    labels = found.select(*keys, "run", F.col("run").alias("label"))
    while True:
        heard = links.join(labels.withColumnRenamed("run", "near").hint("merge"), [*keys, "near"]).groupBy(*keys, "run").agg(F.min("label").alias("heard"))
        lower = kept(labels.join(heard.hint("merge"), [*keys, "run"], "left").select(*keys, "run", F.col("label").alias("was"), F.least("label", "heard").alias("label")), "lower")
        further = lower.select(*keys, F.col("run").alias("label"), F.col("label").alias("further"))
        after = kept(lower.join(further.hint("merge"), [*keys, "label"]).select(*keys, "run", "was", F.col("further").alias("label")), "labels")
        labels = after.drop("was")
        if not after.where("was <> label").limit(1).count():
            return found.join(labels.hint("merge"), [*keys, "run"])


def as_pixels(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x) of runs with the same keys."""
    return found.select(*keys, "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def clear_borders(pixels: DataFrame, keys: list[str], margin: int, scratch: Callable[[str], str]) -> DataFrame:
    """(keys, y, x) without the connected regions that reach the left margin (x up to ``margin``) or the row ``margin``.

    A region goes whole, so what is left reaches neither and clearing again changes nothing.
    """
    found = labelled(pixels, keys, scratch)
    gone = found.where((F.col("x0") <= margin) | (F.col("y") == margin)).select(*keys, "label").distinct()
    return as_pixels(found.join(gone.hint("merge"), [*keys, "label"], "left_anti"), keys)


def line_offsets(length: int, angle: float) -> list[tuple[int, int]]:
    """(dx, dy) of the pixels of a line of ``length`` through the middle, ``angle`` degrees up from the right (y grows downwards)."""
    c, s = np.cos(np.radians(angle)), -np.sin(np.radians(angle))
    major = max(abs(c), abs(s))
    reach = int((length - 1) / 2 * major + 1e-9)
    half_away = lambda v: int(np.copysign(np.floor(abs(v) + 0.5 - 1e-9), v))
    return sorted({(half_away(k * c / major), half_away(k * s / major)) for k in range(-reach, reach + 1)})


def dilated(image: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    """Pixels from which the line, laid there, meets one that is set."""
    h, w = image.shape
    out = np.zeros_like(image)
    for dx, dy in offsets:
        if abs(dx) < w and abs(dy) < h:
            out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] |= image[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


def line_dilation(image: np.ndarray, length: int | None = None, key: str = "min", angles: tuple[int, ...] = ANGLES) -> tuple[int, list[int], np.ndarray]:
    """Angle of the dilation by a line that sets the fewest (or most) pixels, all counts, and the dilation by half the line at it.

    The length is a tenth of the longer side unless it is given; of equal counts the first angle is taken.
    """
    length = length or max(1, max(image.shape) // 10)
    counts = [int(dilated(image, line_offsets(length, a)).sum()) for a in angles]
    best = angles[int(np.argmin(counts) if key == "min" else np.argmax(counts))]
    return best, counts, dilated(image, line_offsets(max(1, length // 2), best))


def stable_regions(grey: np.ndarray, levels: int, delta: int = 1, least: int = 1, most: float = 1.0, variation: float = 1.0) -> list[tuple[int, int, int, float]]:
    """(level, seed, area, variation) of the maximally stable dark regions of an image of grey levels 0 to ``levels`` - 1.

    Pixels join in order of their level (then place) into a tree of connected regions by union and find, four neighbours each. A
    region at a level is named by its darkest, first pixel. Its variation is the growth of the region of that pixel from ``delta``
    levels below to ``delta`` above over its area; it is stable if that is no more than one level below and less than one above.
    """
    h, w = grey.shape
    flat = grey.ravel()
    order = np.lexsort((np.arange(h * w), flat))
    rank = np.empty(h * w, int)
    rank[order] = np.arange(h * w)
    parent, size, seed = list(range(h * w)), [1] * (h * w), list(range(h * w))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    areas: list[dict[int, int]] = []  # by level: of every seed so far the area of the region it is in now
    owners: list[dict[int, int]] = []  # and the seed that names that region
    done, joined = 0, np.zeros(h * w, bool)
    seeds: list[int] = []
    for level in range(levels):
        while done < h * w and flat[order[done]] <= level:
            i = int(order[done])
            joined[i] = True
            seeds.append(i)
            y, x = divmod(i, w)
            for j in ([i - 1] if x else []) + ([i + 1] if x < w - 1 else []) + ([i - w] if y else []) + ([i + w] if y < h - 1 else []):
                if joined[j] and (a := root(i)) != (b := root(j)):
                    if size[a] < size[b]:
                        a, b = b, a
                    parent[b] = a
                    size[a] += size[b]
                    seed[a] = min(seed[a], seed[b], key=lambda s: rank[s])
            done += 1
        areas.append({s: size[root(s)] for s in seeds})
        owners.append({s: seed[root(s)] for s in seeds})

    def growth(level: int, s: int) -> float:
        below = areas[level - delta].get(s, 0) if level >= delta else 0
        return (areas[min(level + delta, levels - 1)][s] - below) / areas[level][s]

    out = []
    for level in range(levels):
        for s, owner in owners[level].items():
            if s != owner or not least <= areas[level][s] <= most * h * w:
                continue
            q = growth(level, s)
            under = growth(level - 1, s) if level and s in areas[level - 1] else None
            over = growth(level + 1, s) if level + 1 < levels else None
            if q <= variation and (under is None or q <= under) and (over is None or q < over):
                out.append((level, s, areas[level][s], q))
    return out


def per_image(images: DataFrame, key: str, work: Callable[[np.ndarray], list[tuple]], schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """``work`` on the values (image key, height, array of values row by row) of every image: rows of ``schema`` beside the key."""
    names = [key, *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, h, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = work(np.array(v).reshape(h, -1)) if v else []
                ids += [i] * len(rows)
                out += rows
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)]], names)

    return images.select(F.col(key).cast("bigint").alias(key), "height", "values").mapInArrow(run, f"{key} bigint, {schema}")
