"""Regions and masks: statistics of boxes, overlap joins, voting, scores of regions and whole masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbel.functions import geometry, metrics

#: Annotation labels, with their colours, and their classes.
LABEL_COLOURS = {
    "Text": (255, 0, 255), "Number": (0, 255, 255), "Watermark": (0, 0, 255), "Image": (255, 0, 0), "Barcode": (255, 255, 0), "Unknown": (255, 255, 255),
}
TEXT_LABELS = ("Text", "Number")
GRAPHIC_LABELS = ("Watermark", "Image", "Barcode")

#: Boxes of both sides of an image up to which each meets the other side's as a list, without cells.
CROWD = 256


def label_colour(label: Column) -> Column:
    """array<int> of a label's colour; null for others."""
    return F.create_map(*[x for k, v in LABEL_COLOURS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[label]


def label_class(label: Column) -> Column:
    """``text``, ``graphic`` or null."""
    return F.when(label.isin(*TEXT_LABELS), "text").when(label.isin(*GRAPHIC_LABELS), "graphic")


def box_statistics(annotations: DataFrame) -> DataFrame:
    """One row per box of annotations (filename, objects: array of struct name, type, bndbox, robndbox): filename, kind, label, height, width, area, ratio.

    Boxes of other types than bndbox and robndbox are left out. A rotated box's area is that of its
    corners on whole pixels.
    """
    o = annotations.select("filename", F.explode("objects").alias("o")).where(F.col("o.type").isin("bndbox", "robndbox"))
    plain = F.col("o.type") == "bndbox"
    b, r = F.col("o.bndbox"), F.col("o.robndbox")
    height = F.when(plain, (b["ymax"] - b["ymin"]).cast("double")).otherwise(r["h"])
    width = F.when(plain, (b["xmax"] - b["xmin"]).cast("double")).otherwise(r["w"])
    turned = geometry.rotated_corners(r["cx"], r["cy"], r["w"], r["h"], r["angle"])
    sized = o.select("filename", F.when(plain, "regular").otherwise("rotated").alias("kind"), F.col("o.name").alias("label"), height.alias("height"), width.alias("width"), turned.alias("corners"))
    area = F.when(F.col("kind") == "regular", F.col("height") * F.col("width")).otherwise(geometry.quad_area(F.col("corners")))
    return sized.select("filename", "kind", "label", "height", "width", area.alias("area"), geometry.side_ratio(F.col("width"), F.col("height")).alias("ratio"))


def label_counts(boxes: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Count of each label per key, and of all under the label Total."""
    each = boxes.groupBy(*keys, F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return each.unionByName(each.groupBy(*keys).agg(F.sum("n").alias("n")).withColumn("label", F.lit("Total")))


def _numbered(reference: DataFrame, verified: DataFrame, image: str) -> DataFrame:
    """image, idx, x1, y1, x2, y2 of reference boxes, match, ver and v (the verified box: idx, x1, y1, x2, y2; null if none): the rows of ``overlap_join``.

    Both sides meet in one shuffle by image. In an image of CROWD boxes at most every reference box looks at all verified ones, as
    a list; in others boxes meet by the cells of a grid.
    """
    box = ("idx", "x1", "y1", "x2", "y2")
    sides = [df.select(image, F.lit(k).alias("side"), *box) for k, df in ((0, reference), (1, verified))]
    # small lists first: a count that a task makes of its own rows leaves nothing to join
    sized = sides[0].unionByName(sides[1]).withColumn("n", F.count("*").over(Window.partitionBy(image)))
    v = F.struct(*box)
    few = sized.where(F.col("n") <= CROWD).withColumn("vs", F.collect_list(F.when(F.col("side") == 1, v)).over(Window.partitionBy(image))).where("side = 0")
    # boxes without an area, or with a null in place of a side or a key, meet none
    known = F.expr("x2 > x1 AND y2 > y1") & F.col(image).isNotNull() & F.col("idx").isNotNull()
    meets = lambda o: known & (o["x2"] > o["x1"]) & (o["y2"] > o["y1"]) & (o["x2"] > F.col("x1")) & (o["x1"] < F.col("x2")) & (o["y2"] > F.col("y1")) & (o["y1"] < F.col("y2"))
    listed = few.select(image, *box, F.posexplode_outer(F.array_sort(F.filter("vs", meets))).alias("p", "v"))
    listed = listed.select(image, *box, F.coalesce(F.col("p") + 1, F.lit(0)).alias("match"), "v")
    many = sized.where(F.col("n") > CROWD)
    r, pairs = many.where("side = 0").select(image, *box), _by_cells(many.where("side = 0"), many.where("side = 1"), image)
    celled = r.join(pairs, [image, "idx"], "left").select(image, *box, F.coalesce("match", F.lit(0)).alias("match"), "v")
    return listed.unionByName(celled)


def _by_cells(reference: DataFrame, verified: DataFrame, image: str) -> DataFrame:
    """(image, idx, match, v): pairs of boxes that meet, by the cells of a grid that they cover, so that a crowded image is spread over its cells."""
    cell = 64

    def spread(df: DataFrame, p: str) -> DataFrame:
        xs = F.sequence(F.floor(F.col("x1") / cell), F.floor((F.col("x2") - 1) / cell))
        ys = F.sequence(F.floor(F.col("y1") / cell), F.floor((F.col("y2") - 1) / cell))
        named = df.where("x2 > x1 AND y2 > y1").withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys))
        return named.select(image, "cx", "cy", *[F.col(c).alias(f"{p}{c}") for c in ("idx", "x1", "y1", "x2", "y2")])

    met = spread(reference, "r").join(spread(verified, "v"), [image, "cx", "cy"])
    w = F.least("rx2", "vx2") - F.greatest("rx1", "vx1")
    h = F.least("ry2", "vy2") - F.greatest("ry1", "vy1")
    # a pair is reported by the cell that holds the corner of its intersection, so once
    corner = (F.floor(F.greatest("rx1", "vx1") / cell) == F.col("cx")) & (F.floor(F.greatest("ry1", "vy1") / cell) == F.col("cy"))
    v = F.struct(*[F.col(f"v{c}").alias(c) for c in ("idx", "x1", "y1", "x2", "y2")])
    pairs = met.where((w > 0) & (h > 0) & corner).select(image, F.col("ridx").alias("idx"), v.alias("v"))
    return pairs.withColumn("match", F.row_number().over(Window.partitionBy(image, "idx").orderBy("v.idx")))


def _intersection() -> Column:
    """Area in common of a box x1, y1, x2, y2 and a box v that it meets; 0 without v."""
    w = F.least("x2", F.col("v.x2")) - F.greatest("x1", F.col("v.x1"))
    h = F.least("y2", F.col("v.y2")) - F.greatest("y1", F.col("v.y1"))
    return F.when(F.col("v").isNull(), F.lit(0)).otherwise(w * h).cast("bigint")


def overlap_join(reference: DataFrame, verified: DataFrame, image: str = "image") -> DataFrame:
    """Left outer join of boxes (image, idx, x1, y1, x2, y2; half open) on a non-empty intersection.

    (image, ref, match, ver, intersection): matches of a reference box are numbered from 1 in the order of
    the verified ones; a box without any gives match 0. ``idx`` tells the boxes of a side and image apart.
    """
    out = _numbered(reference, verified, image)
    return out.select(image, F.col("idx").alias("ref"), "match", F.col("v.idx").alias("ver"), _intersection().alias("intersection"))


def region_scores(reference: DataFrame, verified: DataFrame, image: str = "image") -> DataFrame:
    """The rows of ``overlap_join`` with the metrics of each pair within the box that holds both."""
    j = _numbered(reference, verified, image)
    area = lambda p: (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))
    # not greatest and least, which skip nulls: without a verified box there is no joint one
    far = lambda c: F.when(F.col(f"v.{c}") > F.col(c), F.col(f"v.{c}")).otherwise(F.col(c))
    near = lambda c: F.when(F.col(f"v.{c}") < F.col(c), F.col(f"v.{c}")).otherwise(F.col(c))
    joint = (far("x2") - near("x1")) * (far("y2") - near("y1"))
    tp = _intersection()
    fp, fn = F.coalesce(area("v."), F.lit(0)) - tp, area("") - tp
    tn = joint - tp - fp - fn
    counted = j.select(image, F.col("idx").alias("ref"), "match", F.col("v.idx").alias("ver"), tp.alias("tp"), tn.alias("tn"), fp.alias("fp"), fn.alias("fn"))
    return metrics.add_scores(counted).drop("tp", "tn", "fp", "fn")


def mask_scores(pixels: DataFrame, keys: list[str], verified: str, reference: str) -> DataFrame:
    """Confusion counts and metrics of whole masks in long form, one row a pixel."""
    counts = pixels.groupBy(*keys).agg(*[c.alias(k) for k, c in metrics.confusion(F.col(verified), F.col(reference)).items()])
    return metrics.add_scores(counts)


def combine_masks(a: Column, b: Column) -> dict[str, Column]:
    """Intersection, union and difference of two boolean columns."""
    return {"both": a & b, "either": a | b, "one": a != b}


def rasterise(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The pixels (y, x) that axis-aligned half-open boxes cover, each once per key."""
    rows = boxes.where("x2 > x1 AND y2 > y1").select(*keys, "x1", "x2", F.explode(F.sequence(F.col("y1"), F.col("y2") - 1)).alias("y"))
    return rows.select(*keys, "y", F.explode(F.sequence(F.col("x1"), F.col("x2") - 1)).alias("x")).distinct()


def combinations3(names: DataFrame, name: str) -> DataFrame:
    """All sets of three of a small table of distinct names, as (a, b, c) in order."""
    n = names.select(F.col(name).alias("a"))
    return n.join(n.withColumnRenamed("a", "b"), F.col("a") < F.col("b")).join(n.withColumnRenamed("a", "c"), F.col("b") < F.col("c"))


def majority(masks: list[Column]) -> Column:
    """True if at least two of three masks are; for more masks, if any three of them agree so, which is any two."""
    if len(masks) < 3:
        raise ValueError("voting takes three masks at least")
    return reduce(lambda a, b: a + b, [F.coalesce(m, F.lit(False)).cast("int") for m in masks]) >= 2


def spacing(boxes: DataFrame, image: str, floor: int = 20) -> DataFrame:
    """(image, spacing): 1.5 times the mean, over boxes, of the least corner distance to a later box, cut, ``floor`` at least.

    ``boxes`` has image, idx and corners (array of struct x, y). Images with fewer than three boxes give none.
    """
    b = boxes.withColumn("n", F.count("*").over(Window.partitionBy(image))).where("n > 2")
    later = b.select(image, F.col("idx").alias("idx2"), F.col("corners").alias("corners2"))
    far = F.array_min(F.flatten(F.transform("corners", lambda p: F.transform("corners2", lambda q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))))))
    least = b.join(later, image).where(F.col("idx") < F.col("idx2")).select(image, "idx", far.alias("d")).groupBy(image, "idx").agg(F.min("d").alias("d"))
    return least.groupBy(image).agg(F.greatest((1.5 * F.avg("d")).cast("int"), F.lit(floor)).alias("spacing"))


def enclosed_contours(contours: DataFrame, least_area: float = 25.0) -> DataFrame:
    """Contours to delete: with more than five children that fill them, are long and leave room.

    ``contours``: image, idx, parent (null: none), area, length, pixels (set inside). Children of
    ``least_area`` or less don't count.
    """
    kids = contours.where(F.col("parent").isNotNull() & (F.col("area") > least_area)).groupBy("image", F.col("parent").alias("idx")).agg(
        F.count("*").alias("children"), F.sum("area").alias("child_area"), F.sum("length").alias("child_length")
    )
    j = contours.join(kids, ["image", "idx"])
    solidity = F.abs(1 - F.try_divide("pixels", "child_area"))
    bad = (F.col("children") > 5) & (solidity < 0.2) & (F.try_divide("length", "child_length") < 0.5) & (F.try_divide("area", "child_area") > 1.5)
    return j.where(bad).select("image", "idx", "children")


def profile_lines(pixels: DataFrame, keys: list[str], axis: str = "y", value: str = "v", threshold: float = 3.0) -> DataFrame:
    """(keys, n, upper, lower): where the mean along an axis rises above and falls to ``threshold``, paired in order."""
    means = pixels.groupBy(*keys, axis).agg(F.avg(value).alias("m"))
    w = Window.partitionBy(*keys).orderBy(axis)
    edges = means.select(*keys, F.col(axis).alias("at"), "m", F.lead("m").over(w).alias("next")).where("next IS NOT NULL")
    rise, fall = (F.col("m") <= threshold) & (F.col("next") > threshold), (F.col("m") > threshold) & (F.col("next") <= threshold)
    order = Window.partitionBy(*keys).orderBy("at")
    up = edges.where(rise).select(*keys, F.row_number().over(order).alias("n"), F.col("at").alias("upper"))
    down = edges.where(fall).select(*keys, F.row_number().over(order).alias("n"), F.col("at").alias("lower"))
    return up.join(down, [*keys, "n"])


def blur_score(histogram: DataFrame, key: str) -> DataFrame:
    """(key, score): place in a 256-bin gradient histogram (key, bin, n) where counts fall below 10, between two bins by line; 0 in the first two."""
    least = 10
    first = histogram.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("n") < least, F.col("bin"))), F.max("bin")).alias("it"))
    at = lambda by, name: histogram.select(key, (F.col("bin") + by).alias("it"), F.col("n").alias(name))
    j = first.join(at(1, "high"), [key, "it"], "left").join(at(0, "low"), [key, "it"], "left")
    high, low = F.col("high") - least, least - F.col("low")
    score = F.try_divide((F.col("it") - 1) * low + F.col("it") * high, low + high)
    return j.select(key, F.when(F.col("it") <= 1, F.lit(0.0)).otherwise(score).alias("score"))


def quality_flags(blur_ref: Column, blur_ver: Column, glare: Column) -> dict[str, Column]:
    """is_blurred: the reference is sharper by more than 2; is_glared: glare takes 0.4 or more."""
    return {"is_blurred": blur_ref - blur_ver > 2, "is_glared": glare >= 0.4}
