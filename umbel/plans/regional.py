"""Rectangles, overlaps, voting and quality columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbel.functions import geometry
from umbel.operators import regions
from umbel.operators.frames import tasks_for
from umbel.plans.evaluation import sql_scores
from umbel.plans.registry import Tables, query

#: Order lines as boxes on an image per order: reference boxes from quantity and tax, verified ones shifted by discount.
_SQL_BOXES = """line AS (
  SELECT l_orderkey AS image, (l_partkey * 10 + l_linenumber)::BIGINT AS idx, l_partkey, min(l_suppkey) AS supp, CAST(min(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY ALL),
ref AS (
  SELECT image, idx, (l_partkey % 300)::BIGINT AS x1, (supp % 200)::BIGINT AS y1, (l_partkey % 300 + 20 + q * 3)::BIGINT AS x2, (supp % 200 + 10 + q)::BIGINT AS y2 FROM line),
ver AS (SELECT image, idx, x1 + 15 AS x1, y1 + 5 AS y1, x2 + 9 AS x2, y2 + 2 AS y2 FROM ref WHERE idx % 10 <> 2)"""


def _boxes(t: Tables) -> tuple[DataFrame, DataFrame]:
    lines = t.lineitem.repartition(tasks_for(t.spark, t.lineitem.count()), "l_orderkey")
    line = lines.groupBy(F.col("l_orderkey").alias("image"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("idx"), "l_partkey").agg(F.min("l_suppkey").alias("supp"), F.min("l_quantity").cast("bigint").alias("q"))
    x, y, q = F.col("l_partkey") % 300, F.col("supp") % 200, F.col("q")
    ref = line.select("image", "idx", x.alias("x1"), y.alias("y1"), (x + 20 + q * 3).alias("x2"), (y + 10 + q).alias("y2"))
    ver = ref.where("idx % 10 <> 2").select("image", "idx", (F.col("x1") + 15).alias("x1"), (F.col("y1") + 5).alias("y1"), (F.col("x2") + 9).alias("x2"), (F.col("y2") + 2).alias("y2"))
    return ref, ver


_SQL_OVERLAP = (
    _SQL_BOXES
    + """,
p AS (
  SELECT r.image, r.idx AS ref, v.idx AS ver, ((least(r.x2, v.x2) - greatest(r.x1, v.x1)) * (least(r.y2, v.y2) - greatest(r.y1, v.y1)))::BIGINT AS intersection,
         row_number() OVER (PARTITION BY r.image, r.idx ORDER BY v.idx) AS match
  FROM ref r JOIN ver v ON r.image = v.image AND r.x1 < v.x2 AND v.x1 < r.x2 AND r.y1 < v.y2 AND v.y1 < r.y2),
o AS (SELECT r.image, r.idx AS ref, coalesce(p.match, 0)::INT AS match, p.ver, coalesce(p.intersection, 0)::BIGINT AS intersection FROM ref r LEFT JOIN p ON p.image = r.image AND p.ref = r.idx)"""
)


@query("j6_w9_overlap_join", f"WITH {_SQL_OVERLAP} SELECT * FROM o")
def j6(t: Tables) -> DataFrame:
    """Reference boxes with the verified boxes that they meet, numbered; those without keep one row."""
    return regions.overlap_join(*_boxes(t))


@query(
    "m5_m8_m9_region_scores",
    f"""WITH {_SQL_OVERLAP}, s AS (
      SELECT o.image, o.ref, o.match, o.ver, intersection AS tp, coalesce((v.x2 - v.x1) * (v.y2 - v.y1), 0) - intersection AS fp, (r.x2 - r.x1) * (r.y2 - r.y1) - intersection AS fn,
             coalesce((greatest(r.x2, v.x2) - least(r.x1, v.x1)) * (greatest(r.y2, v.y2) - least(r.y1, v.y1)), (r.x2 - r.x1) * (r.y2 - r.y1)) AS joint_
      FROM o JOIN ref r ON r.image = o.image AND r.idx = o.ref LEFT JOIN ver v ON v.image = o.image AND v.idx = o.ver),
    c AS (SELECT image, ref, match, ver, tp, fp, fn, joint_ - tp - fp - fn AS tn FROM s)
    SELECT image, ref, match, ver, {sql_scores()} FROM c""",
)
def m5(t: Tables) -> DataFrame:
    """Metrics of every pair of regions within the box that holds both."""
    return regions.region_scores(*_boxes(t))


@query(
    "c17_f12_f13_f15_box_predicates",
    """SELECT p_partkey, (p_size * 30 * 9)::BIGINT AS area, CASE WHEN p_size % 4 = 0 THEN 0.0::DOUBLE ELSE ((p_size * 30) / (p_size % 4))::DOUBLE END AS ratio,
    (p_size * 30 * 9 > 256 AND greatest(p_size * 30, 9) / least(p_size * 30, 9) < 15) AS region_ok, (p_retailprice / 2000 > 0.25 AND p_size * 30 * 9 > 225) AS blob_ok,
    (p_size / 10 < 1.5 AND p_size * 100 > 625 AND p_retailprice / 60 < 25) AS patch_ok FROM part""",
)
def c17(t: Tables) -> DataFrame:
    """Size, side ratio and the three validity rules."""
    w, h = F.col("p_size") * 30, F.lit(9)
    return t.part.select(
        "p_partkey", (w * h).cast("bigint").alias("area"), geometry.side_ratio(w, F.col("p_size") % 4).alias("ratio"), geometry.region_valid(w * h, w, h).alias("region_ok"),
        geometry.blob_valid(F.col("p_retailprice") / 2000, w * h).alias("blob_ok"), geometry.plain_patch(F.col("p_size") / 10, F.col("p_size") * 100, F.col("p_retailprice") / 60).alias("patch_ok"),
    )


def _sql_corner(sx: int, sy: int) -> tuple[str, str]:
    dx, dy, a = f"(w * {sx / 2})", f"(h * {sy / 2})", "a"
    return f"trunc(cx + {dx} * cos({a}) - {dy} * sin({a}))::INT", f"trunc(cy + {dx} * sin({a}) + {dy} * cos({a}))::INT"


_CORNERS = [_sql_corner(*s) for s in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


@query(
    "c18_c19_rotated_boxes",
    "WITH b AS (SELECT p_partkey, p_size * 7.5::DOUBLE AS cx, 100.0::DOUBLE AS cy, p_size * 3.3::DOUBLE AS w, 21.7::DOUBLE AS h, p_retailprice / 700 AS a FROM part), c AS (SELECT p_partkey, "
    + ", ".join(f"{x} AS x{i}, {y} AS y{i}" for i, (x, y) in enumerate(_CORNERS))
    + " FROM b) SELECT p_partkey, x0, y0, x2, y2, (abs("
    + " + ".join(f"x{i}::BIGINT * y{(i + 1) % 4} - x{(i + 1) % 4}::BIGINT * y{i}" for i in range(4))
    + ") / 2.0)::DOUBLE AS area FROM c",
)
def c18(t: Tables) -> DataFrame:
    """Corners of turned rectangles on whole pixels, and the area between them."""
    c = geometry.rotated_corners(F.col("p_size") * 7.5, F.lit(100.0), F.col("p_size") * 3.3, F.lit(21.7), F.col("p_retailprice") / 700)
    b = t.part.select("p_partkey", c.alias("c"))
    at = lambda i, k: F.get("c", i)[k].alias(f"{k}{i}")
    return b.select("p_partkey", at(0, "x"), at(0, "y"), at(2, "x"), at(2, "y"), geometry.quad_area(F.col("c")).alias("area"))


@query("j15_combinations", "SELECT a.n_name AS a, b.n_name AS b, c.n_name AS c FROM nation a JOIN nation b ON a.n_name < b.n_name JOIN nation c ON b.n_name < c.n_name")
def j15(t: Tables) -> DataFrame:
    """All sets of three of the 25 nations (algorithms in their place are five)."""
    return regions.combinations3(t.nation, "n_name")


@query("i19_majority_vote", "SELECT l_orderkey, l_linenumber, ((l_tax > 0.04)::INT + (l_discount > 0.05)::INT + (l_quantity > 25)::INT) >= 2 AS vote FROM lineitem")
def i19(t: Tables) -> DataFrame:
    """Two of three masks agree."""
    return t.lineitem.select("l_orderkey", "l_linenumber", regions.majority([F.col("l_tax") > 0.04, F.col("l_discount") > 0.05, F.col("l_quantity") > 25]).alias("vote"))


@query(
    "j16_least_corner_distances",
    f"""WITH {_SQL_BOXES}, c AS (SELECT image, idx, unnest([[x1, y1], [x2, y1], [x2, y2], [x1, y2]]) AS p, count(*) OVER (PARTITION BY image) AS n FROM ref),
    m AS (SELECT a.image, a.idx, min(sqrt(pow(a.p[1] - b.p[1], 2) + pow(a.p[2] - b.p[2], 2))) AS d FROM c a JOIN c b ON a.image = b.image AND a.idx < b.idx
          WHERE a.image IN (SELECT image FROM ref GROUP BY image HAVING count(*) > 2) GROUP BY ALL)
    SELECT image, greatest(trunc(1.5 * avg(d))::INT, 20) AS spacing FROM m GROUP BY image""",
)
def j16(t: Tables) -> DataFrame:
    """Spacing of an image's boxes: least corner distance to later boxes, averaged."""
    ref, _ = _boxes(t)
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return regions.spacing(ref.select("image", "idx", F.array(point("x1", "y1"), point("x2", "y1"), point("x2", "y2"), point("x1", "y2")).alias("corners")), "image")


@query(
    "f14_i7_enclosed_contours",
    """WITH c AS (SELECT l_orderkey % 500 AS image, (l_orderkey * 10 + l_linenumber)::BIGINT AS idx, CASE WHEN l_linenumber > 1 THEN (l_orderkey % 500) END AS parent_of, l_quantity * 3 AS area, l_quantity AS length FROM lineitem),
    k AS (SELECT image, count(*) AS children, sum(area) AS child_area, sum(length) AS child_length FROM c WHERE parent_of IS NOT NULL AND area > 25 GROUP BY image)
    SELECT image, (-1)::BIGINT AS idx, children FROM k WHERE children > 5 AND abs(1 - (child_area * 1.1) / child_area) < 0.2 AND (child_length * 0.4) / child_length < 0.5 AND (child_area * 1.6) / child_area > 1.5""",
)
def f14(t: Tables) -> DataFrame:
    """Contours with many children inside them."""
    kids = t.lineitem.select(
        (F.col("l_orderkey") % 500).alias("image"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), F.when(F.col("l_linenumber") > 1, F.lit(-1).cast("bigint")).alias("parent"),
        (F.col("l_quantity") * 3).alias("area"), F.col("l_quantity").alias("length"), F.lit(0.0).alias("pixels"),
    )
    inner = kids.where("parent IS NOT NULL AND area > 25").groupBy("image").agg(F.sum("area").alias("a"), F.sum("length").alias("l"))
    outer = inner.select("image", F.lit(-1).cast("bigint").alias("idx"), F.lit(None).cast("bigint").alias("parent"), (F.col("a") * 1.6).alias("area"), (F.col("l") * 0.4).alias("length"), (F.col("a") * 1.1).alias("pixels"))
    return regions.enclosed_contours(kids.unionByName(outer))


@query(
    "i12_profile_lines",
    """WITH m AS (SELECT l_suppkey AS k, l_linenumber AS y, avg(l_quantity) AS m FROM lineitem GROUP BY ALL), e AS (SELECT *, lead(m) OVER (PARTITION BY k ORDER BY y) AS nx FROM m),
    u AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY y) AS n, y AS upper FROM e WHERE nx IS NOT NULL AND m <= 25.5 AND nx > 25.5),
    l AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY y) AS n, y AS lower FROM e WHERE nx IS NOT NULL AND m > 25.5 AND nx <= 25.5)
    SELECT k, u.n::INT AS n, upper, lower FROM u JOIN l USING (k, n)""",
)
def i12(t: Tables) -> DataFrame:
    """Where a projection profile rises and falls."""
    p = t.lineitem.select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("y"), F.col("l_quantity").alias("v"))
    return regions.profile_lines(p, ["k"], "y", "v", 25.5)


@query(
    "i23_blur_score",
    """WITH h AS (SELECT l_suppkey AS k, (CAST(l_quantity AS BIGINT) // 2)::INT AS bin FROM lineitem),
    g AS (SELECT k, bin, (count(*) - bin)::BIGINT AS n FROM h GROUP BY k, bin),
    f AS (SELECT k, coalesce(min(CASE WHEN n < 10 THEN bin END), max(bin)) AS it FROM g GROUP BY k)
    SELECT f.k, round(CASE WHEN it <= 1 THEN 0.0::DOUBLE ELSE ((it - 1) * (10 - lo.n) + it * (hi.n - 10))::DOUBLE / nullif((10 - lo.n) + (hi.n - 10), 0) END, 9) AS score
    FROM f LEFT JOIN g hi ON hi.k = f.k AND hi.bin = it - 1 LEFT JOIN g lo ON lo.k = f.k AND lo.bin = it""",
)
def i23(t: Tables) -> DataFrame:
    """Blur score of a gradient histogram."""
    b = F.expr("CAST(l_quantity AS BIGINT) DIV 2")
    h = t.lineitem.select(F.col("l_suppkey").alias("k"), F.col("l_quantity").cast("bigint").alias("q"), b.cast("int").alias("bin"))
    g = h.groupBy("k", "bin").agg((F.count("*") - F.first("bin")).cast("bigint").alias("n"))
    return regions.blur_score(g, "k").withColumn("score", F.round("score", 9))


@query("f20_i25_m10_quality_flags", "SELECT l_orderkey, l_linenumber, l_quantity - l_linenumber > 2 AS is_blurred, l_discount * 5 >= 0.4 AS is_glared FROM lineitem")
def f20(t: Tables) -> DataFrame:
    flags = regions.quality_flags(F.col("l_quantity"), F.col("l_linenumber"), F.col("l_discount") * 5)
    return t.lineitem.select("l_orderkey", "l_linenumber", flags["is_blurred"].alias("is_blurred"), flags["is_glared"].alias("is_glared"))


@query("c27_label_lookups", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'text' WHEN l_linenumber = 2 THEN 'graphic' END AS class, CASE l_linenumber WHEN 1 THEN '255,0,255' WHEN 2 THEN '255,255,0' WHEN 3 THEN '255,255,255' END AS colour FROM lineitem")
def c27(t: Tables) -> DataFrame:
    label = F.when(F.col("l_linenumber") == 1, "Text").when(F.col("l_linenumber") == 2, "Barcode").when(F.col("l_linenumber") == 3, "Unknown")
    return t.lineitem.select("l_orderkey", "l_linenumber", regions.label_class(label).alias("class"), F.array_join(regions.label_colour(label), ",").alias("colour"))


@query("a41_label_summary", "SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS \"A\", count(*) FILTER (WHERE l_returnflag = 'N') AS \"N\", count(*) FILTER (WHERE l_returnflag = 'R') AS \"R\", count(*) AS \"Total\" FROM lineitem GROUP BY l_orderkey")
def a41(t: Tables) -> DataFrame:
    """Label counts and total of each annotation in one row."""
    long = regions.label_counts(t.lineitem, ["l_orderkey"], "l_returnflag")
    return long.groupBy("l_orderkey").pivot("label", ["A", "N", "R", "Total"]).agg(F.sum("n")).na.fill(0)


@query(
    "i29_rasterised_boxes",
    """SELECT p_size AS k, count(*) AS pixels FROM (SELECT DISTINCT p_size, y, x FROM part, unnest(range(p_partkey % 5, p_partkey % 5 + 4)) AS a(x), unnest(range(p_partkey % 7, p_partkey % 7 + 3)) AS b(y)) GROUP BY p_size""",
)
def i29(t: Tables) -> DataFrame:
    """Pixels that a group's boxes cover together."""
    x, y = F.col("p_partkey") % 5, F.col("p_partkey") % 7
    b = t.part.select(F.col("p_size").alias("k"), x.alias("x1"), (x + 4).alias("x2"), y.alias("y1"), (y + 3).alias("y2"))
    return regions.rasterise(b, ["k"]).groupBy("k").agg(F.count("*").alias("pixels"))


@query("i4_scaled_lengths", "SELECT p_partkey, p_size * 0.5 AS down, p_size / 0.5 AS up FROM part".replace("p_size * 0.5", "p_size * 0.5::DOUBLE").replace("p_size / 0.5", "p_size / 0.5::DOUBLE"))
def i4(t: Tables) -> DataFrame:
    s = F.col("p_size").cast("double")
    return t.part.select("p_partkey", geometry.scaled(s, 0.5).alias("down"), geometry.scaled(s, 0.5, down=False).alias("up"))
