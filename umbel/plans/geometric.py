"""Two views of planted scenes, projective maps, clipped and smallest rectangles, outlines of pixel regions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbel.functions import geometry
from umbel.operators import matching, pixels, polygons
from umbel.plans.registry import Tables, query

# ---- two views of the lines of a supplier as points in space; the texts are the same in both dialects

_SPACE = """SELECT l_suppkey AS scene, l_orderkey * 8 + l_linenumber AS id, CAST(l_partkey % 200 - 100 AS DOUBLE) AS x3, CAST(l_orderkey % 161 - 80 AS DOUBLE) AS y3,
  CASE WHEN l_linenumber = 1 THEN 300 + 4 * CAST(l_quantity AS DOUBLE) ELSE 400 + 0.3 * (l_partkey % 200 - 100) - 0.2 * (l_orderkey % 161 - 80) END AS z3,
  l_linenumber = 2 AND l_returnflag = 'R' AS wrong, l_partkey, l_suppkey FROM lineitem"""
#: The second camera is turned about the vertical axis and moved, mostly sideways; a wrong match lies far below its place.
_VIEWS = f"""SELECT scene, id, wrong, 500.0 * x3 / z3 + 320.0 AS x, 500.0 * y3 / z3 + 240.0 AS y,
  500.0 * (0.995 * x3 + 0.0998 * z3 - 60.0) / (0.995 * z3 - 0.0998 * x3 + 10.0) + 320.0 - CASE WHEN wrong THEN l_partkey % 50 ELSE 0 END AS u,
  500.0 * (y3 + 5.0) / (0.995 * z3 - 0.0998 * x3 + 10.0) + 240.0 + CASE WHEN wrong THEN 80 + l_partkey % 90 ELSE 0 END AS v FROM ({_SPACE})"""


def _sql(t: Tables, text: str) -> DataFrame:
    """The rows of a text that both dialects understand, over the given tables."""
    return t.spark.sql(text.replace("FROM lineitem", "FROM {lineitem}"), lineitem=t.lineitem)


@query("i27_robust_two_views", f"SELECT scene, count(*)::INT AS pairs, count(*) FILTER (WHERE NOT wrong)::INT AS inliers FROM ({_VIEWS}) GROUP BY scene")
def i27_scenes(t: Tables) -> DataFrame:
    """Pairs that one two-view geometry explains, in scenes most of whose points lie in one plane."""
    return matching.scene_inliers(_sql(t, _VIEWS).select("scene", "id", *[F.col(c).cast("double").alias(c) for c in "xyuv"]))


_PLANE = """SELECT l_suppkey AS scene, l_orderkey * 8 + l_linenumber AS id, CAST(l_partkey % 400 AS DOUBLE) AS x, CAST(l_orderkey % 301 AS DOUBLE) AS y, l_linenumber IN (2, 5) AS wrong FROM lineitem"""
#: The planted map of the plane.
_WARP = (1.1, 0.05, 10.0, -0.04, 0.95, 6.0, 0.0002, 0.0001, 1.0)
_MAPPED = f"SELECT *, (1.1 * x + 0.05 * y + 10.0) / (0.0002 * x + 0.0001 * y + 1.0) AS wx, (-0.04 * x + 0.95 * y + 6.0) / (0.0002 * x + 0.0001 * y + 1.0) AS wy FROM ({_PLANE})"


@query("i1_robust_homography", f"SELECT scene, id, round(wx + 0.0000137, 4) AS mx, round(wy + 0.0000137, 4) AS my, NOT wrong AS inside FROM ({_MAPPED})")
def i1(t: Tables) -> DataFrame:
    """Every point where the homography of its scene takes it; the matches of two lines of seven are wrong."""
    p = _sql(t, _MAPPED)
    far = F.when(F.col("wrong"), 60.0 + F.col("id") % 83).otherwise(0.0)
    found = matching.aligned(p.select("scene", "id", "x", "y", (F.col("wx") + far).alias("u"), (F.col("wy") - 1.5 * far).alias("v")))
    return found.withColumns({c: F.round(F.col(c) + 0.0000137, 4) for c in ("mx", "my")})  # no ties of exact fractions


_QUADS = """SELECT l_orderkey, l_linenumber, CAST(l_partkey % 40 AS DOUBLE) AS x0, CAST(l_suppkey % 30 AS DOUBLE) AS y0, 200.0 + l_partkey % 37 AS x1, 10.0 + l_orderkey % 41 AS y1,
  210.0 + l_suppkey % 23 AS x2, 150.0 + l_partkey % 61 AS y2, CAST(l_orderkey % 35 AS DOUBLE) AS x3, 160.0 + l_linenumber * 5 AS y3 FROM lineitem"""


@query(
    "i1_corner_maps",
    f"""WITH q AS (SELECT * FROM ({_QUADS})), d AS (SELECT *, (x2 - x0) * (y3 - y1) - (y2 - y0) * (x3 - x1) AS det, ((x1 - x0) * (y3 - y1) - (y1 - y0) * (x3 - x1)) AS top FROM q)
    SELECT l_orderkey, l_linenumber, round(x2, 6) AS far_x, round(y2, 6) AS far_y, round(x0 + top / det * (x2 - x0), 6) AS mid_x, round(y0 + top / det * (y2 - y0), 6) AS mid_y,
           100.0::DOUBLE AS back_x, 0.0::DOUBLE AS back_y FROM d""",
)
def i1_corners(t: Tables) -> DataFrame:
    """Corner mode: the map from a square of 100 to four corners takes its far corner and its middle (the diagonals' crossing) there, and back."""
    q = _sql(t, _QUADS)
    corners = F.array(*[geometry.point(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(4)])
    shrink = F.array(*[F.lit(x) for x in (0.01, 0.0, 0.0, 0.0, 0.01, 0.0, 0.0, 0.0, 1.0)])
    q = q.select("*", geometry.square_to_quad(corners).alias("s")).withColumn("m", geometry.composed(shrink, F.col("s")))
    far, mid = (geometry.projected(F.col("m"), geometry.point(F.lit(x), F.lit(x))) for x in (100.0, 50.0))
    back = geometry.projected(geometry.inverse_map(F.col("m")), geometry.point(F.col("x1"), F.col("y1")))
    out = q.select("l_orderkey", "l_linenumber", far.alias("far"), mid.alias("mid"), back.alias("back"))
    return out.select("l_orderkey", "l_linenumber", *[(F.round(F.col(f"{p}.{c}"), 6) + 0.0).alias(f"{p}_{c}") for p in ("far", "mid", "back") for c in "xy"])


_BOXES = """SELECT l_orderkey, l_linenumber, CAST(l_partkey % 400 - 40 AS DOUBLE) AS ox, CAST(l_suppkey * 7 % 300 - 30 AS DOUBLE) AS oy, 10.0 + CAST(l_quantity AS DOUBLE) AS bw, 10.0 + 8.0 * l_linenumber AS bh FROM lineitem"""
_FRAME = (0.0, 0.0, 320.0, 240.0)


def _sql_corner(dx: str, dy: str) -> str:
    m = _WARP
    x, y = f"(ox + {dx})", f"(oy + {dy})"
    w = f"({m[6]} * {x} + {m[7]} * {y} + {m[8]})"
    return f"[({m[0]} * {x} + {m[1]} * {y} + {m[2]}) / {w}, ({m[3]} * {x} + {m[4]} * {y} + {m[5]}) / {w}]::DOUBLE[]"


def _warped(t: Tables) -> DataFrame:
    b = _sql(t, _BOXES)
    m = F.array(*[F.lit(x) for x in _WARP])
    x, y = (F.col("ox"), F.col("ox") + F.col("bw")), (F.col("oy"), F.col("oy") + F.col("bh"))
    quad = F.array(*[geometry.projected(m, geometry.point(a, c)) for a, c in ((x[0], y[0]), (x[1], y[0]), (x[1], y[1]), (x[0], y[1]))])
    return b.withColumn("quad", quad)


@query(
    "i28_reference_regions",
    f"""WITH b AS (SELECT *, row_number() OVER () AS r FROM ({_BOXES})), q AS (SELECT r, l_orderkey, l_linenumber, [{_sql_corner('0', '0')}, {_sql_corner('bw', '0')}, {_sql_corner('bw', 'bh')}, {_sql_corner('0', 'bh')}] AS p FROM b),
    e AS (SELECT r, l_orderkey, l_linenumber, p, unnest([1, 2, 3, 4]) AS i FROM q),
    s AS (SELECT r, l_orderkey, l_linenumber, p[i] AS a, p[i % 4 + 1] AS c FROM e),
    inner_ AS (SELECT r, l_orderkey, l_linenumber, a[1] AS x, a[2] AS y FROM s WHERE a[1] BETWEEN 0 AND 320 AND a[2] BETWEEN 0 AND 240),
    xs AS (SELECT r, l_orderkey, l_linenumber, k AS x, a[2] + (c[2] - a[2]) * (k - a[1]) / (c[1] - a[1]) AS y FROM s, (VALUES (0.0::DOUBLE), (320.0::DOUBLE)) AS f(k) WHERE (a[1] < k) <> (c[1] < k)),
    ys AS (SELECT r, l_orderkey, l_linenumber, a[1] + (c[1] - a[1]) * (k - a[2]) / (c[2] - a[2]) AS x, k AS y FROM s, (VALUES (0.0::DOUBLE), (240.0::DOUBLE)) AS f(k) WHERE (a[2] < k) <> (c[2] < k)),
    corner AS (SELECT r, l_orderkey, l_linenumber, x, y FROM s, (VALUES (0.0::DOUBLE, 0.0::DOUBLE), (320.0::DOUBLE, 0.0::DOUBLE), (320.0::DOUBLE, 240.0::DOUBLE), (0.0::DOUBLE, 240.0::DOUBLE)) AS f(x, y)
      GROUP BY ALL HAVING bool_and((c[1] - a[1]) * (y - a[2]) - (c[2] - a[2]) * (x - a[1]) >= 0)),
    pts AS (SELECT * FROM inner_ UNION ALL SELECT * FROM xs WHERE y BETWEEN 0 AND 240 UNION ALL SELECT * FROM ys WHERE x BETWEEN 0 AND 320 UNION ALL SELECT * FROM corner),
    mid AS (SELECT *, atan2(y - avg(y) OVER w, x - avg(x) OVER w) AS t FROM pts WINDOW w AS (PARTITION BY r)),
    ring AS (SELECT r, l_orderkey, l_linenumber, list(x ORDER BY t) AS x, list(y ORDER BY t) AS y FROM mid GROUP BY ALL),
    cut AS (SELECT r, l_orderkey, l_linenumber, abs(list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] * y[i % len(x) + 1] - x[i % len(x) + 1] * y[i]))) / 2 AS area,
      list_min(x) AS x1, list_min(y) AS y1, list_max(x) AS x2, list_max(y) AS y2 FROM ring WHERE len(x) > 2)
    SELECT l_orderkey, l_linenumber, round(area, 4) AS area, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2 FROM cut WHERE area > 0.001""",
)
def i28(t: Tables) -> DataFrame:
    """Boxes of the reference in the verified image: their polygons cut at the frame, with area and bounds; what lies outside is left out."""
    cut = _warped(t).select("l_orderkey", "l_linenumber", geometry.clipped(F.col("quad"), *_FRAME).alias("p"))
    cut = cut.select("l_orderkey", "l_linenumber", geometry.polygon_area(F.col("p")).alias("area"), geometry.bounds(F.col("p")).alias("b")).where("area > 0.001")
    return cut.select("l_orderkey", "l_linenumber", F.round("area", 4).alias("area"), *[(F.round(F.col(f"b.{c}"), 4) + 0.0).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("i22_unaligned_regions", f"SELECT l_orderkey, l_linenumber, round(ox, 5) AS x1, round(oy, 5) AS y1, round(ox + bw, 5) AS x2, round(oy + bh, 5) AS y2, round(bw * bh, 4) AS area FROM ({_BOXES})")
def i22(t: Tables) -> DataFrame:
    """Aligned regions taken back by the inverse map: the boxes they were."""
    m = geometry.inverse_map(F.array(*[F.lit(x) for x in _WARP]))
    back = _warped(t).withColumn("p", F.transform("quad", lambda p: geometry.projected(m, p)))
    b = geometry.bounds(F.col("p"))
    out = back.select("l_orderkey", "l_linenumber", b.alias("b"), geometry.polygon_area(F.col("p")).alias("area"))
    return out.select("l_orderkey", "l_linenumber", *[(F.round(F.col(f"b.{c}"), 5) + 0.0).alias(c) for c in ("x1", "y1", "x2", "y2")], F.round("area", 4).alias("area"))


_CLOUD = "SELECT CAST(floor(l_orderkey / 8) AS BIGINT) AS region, l_partkey % 97 AS x, l_suppkey * 31 % 89 AS y FROM lineitem"


@query(
    "i3_smallest_rectangles",
    f"""WITH p AS (SELECT DISTINCT region, x::DOUBLE AS x, y::DOUBLE AS y FROM ({_CLOUD})),
    d AS (SELECT DISTINCT a.region, (b.x - a.x) AS dx, (b.y - a.y) AS dy FROM p a JOIN p b ON a.region = b.region AND (a.x < b.x OR (a.x = b.x AND a.y < b.y))),
    e AS (SELECT d.region, dx, dy, (max(x * dx + y * dy) - min(x * dx + y * dy)) * (max(y * dx - x * dy) - min(y * dx - x * dy)) / (dx * dx + dy * dy) AS area FROM d JOIN p ON p.region = d.region GROUP BY d.region, dx, dy)
    SELECT region, round(min(area), 4) AS area FROM e GROUP BY region UNION ALL SELECT region, 0.0::DOUBLE FROM p GROUP BY region HAVING count(*) = 1""",
)
def i3(t: Tables) -> DataFrame:
    """Area of the smallest rectangle around the points of some orders; in SQL the least over all directions between two points."""
    found = polygons.rectangles(_sql(t, _CLOUD), ["region"])
    return found.select("region", F.round(F.col("width") * F.col("height"), 4).alias("area"))


# ---- pixel tables: the 64 numbers of a vector are an image of 8 x 8

_SQL_PIXELS = "px AS (SELECT image, CAST(i // 8 AS BIGINT) AS y, CAST(i % 8 AS BIGINT) AS x FROM (SELECT vec_id AS image, unnest(range(0, 64)) AS i, embedding AS e FROM embeddings) WHERE e[i + 1] > 0.06)"


def _pixels(t: Tables) -> DataFrame:
    p = t.embeddings.select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("i", "v")).where("v > 0.06")
    return p.select("image", F.expr("CAST(i DIV 8 AS BIGINT)").alias("y"), (F.col("i") % 8).cast("bigint").alias("x"))


@query(
    "i13_cleared_borders",
    f"""WITH RECURSIVE {_SQL_PIXELS}, gone AS (SELECT image, y, x FROM px WHERE x = 0 OR y = 0
      UNION SELECT p.image, p.y, p.x FROM gone g JOIN px p ON p.image = g.image AND abs(p.y - g.y) <= 1 AND abs(p.x - g.x) <= 1)
    SELECT * FROM px EXCEPT SELECT * FROM gone""",
)
def i13(t: Tables) -> DataFrame:
    """Pixels of the regions that reach neither the left margin nor the top row."""
    return pixels.clear_borders(_pixels(t), ["image"], 0, t.scratch)


@query(
    "i20_region_outlines",
    f"""WITH RECURSIVE {_SQL_PIXELS}, reach AS (SELECT image, y AS sy, x AS sx, y, x FROM px
      UNION SELECT r.image, r.sy, r.sx, p.y, p.x FROM reach r JOIN px p ON p.image = r.image AND abs(p.y - r.y) <= 1 AND abs(p.x - r.x) <= 1),
    comp AS (SELECT image, y, x, min(sy * 8 + sx) AS c FROM reach GROUP BY ALL),
    grid AS (SELECT y, x FROM range(-1, 9) AS a(y), range(-1, 9) AS b(x)),
    ids AS (SELECT DISTINCT image, c FROM comp),
    free AS (SELECT i.image, i.c, g.y, g.x FROM ids i, grid g ANTI JOIN comp k ON k.image = i.image AND k.c = i.c AND k.y = g.y AND k.x = g.x),
    outside AS (SELECT image, c, -1::BIGINT AS y, -1::BIGINT AS x FROM ids
      UNION SELECT o.image, o.c, f.y, f.x FROM outside o JOIN free f ON f.image = o.image AND f.c = o.c AND abs(f.y - o.y) + abs(f.x - o.x) = 1),
    fill AS (SELECT image, c, y, x FROM ids, grid EXCEPT SELECT image, c, y, x FROM outside),
    block AS (SELECT image, c, y + dy AS y, x + dx AS x, count(*) AS n FROM fill, (VALUES (0, 0), (0, -1), (-1, 0), (-1, -1)) AS v(dy, dx) GROUP BY ALL),
    size AS (SELECT image, c, sum(CASE n WHEN 4 THEN 1.0::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS area FROM block GROUP BY ALL),
    box AS (SELECT image, c, count(*) AS pixels, (max(x) - min(x)) * (max(y) - min(y))::DOUBLE AS brect_area FROM comp GROUP BY ALL)
    SELECT image, c AS region, pixels, area AS contour_area, brect_area::DOUBLE AS brect_area FROM size JOIN box USING (image, c)""",
)
def i20(t: Tables) -> DataFrame:
    """Areas within the outline and the upright rectangle of every connected region; in SQL by filling it and counting blocks of four."""
    keys = ["image", "label"]
    found = pixels.as_pixels(pixels.labelled(_pixels(t), ["image"], t.scratch), keys)
    counts = found.groupBy(*keys).agg(F.count("*").alias("pixels"))
    areas = polygons.outlines(found, keys).groupBy(*keys).agg(*[F.max(F.when(F.col("method") == m, F.col("area"))).alias(f"{m}_area") for m in ("contour", "brect")])
    region = (F.shiftright("label", 32) * 8 + F.col("label").bitwiseAND(F.lit((1 << 32) - 1))).alias("region")
    return areas.join(counts.hint("merge"), keys).select("image", region, "pixels", "contour_area", "brect_area")


@query(
    "i10_line_dilation",
    f"""WITH {_SQL_PIXELS}, line AS (SELECT a, dx * k AS dx, dy * k AS dy FROM (VALUES (-90, 0, 1), (-45, 1, 1), (0, 1, 0), (45, 1, -1)) AS d(a, dx, dy), range(-2, 3) AS r(k) WHERE a IN (-90, 0) OR abs(k) <= 1),
    set_ AS (SELECT DISTINCT image, a, y + dy AS y, x + dx AS x FROM px, line WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7),
    n AS (SELECT image, a, count(*) AS n FROM set_ GROUP BY ALL),
    best AS (SELECT image, arg_min(a, n * 1000 + a) AS angle, min(n) AS fewest, max(n) AS most FROM n GROUP BY image)
    SELECT image, angle::INT AS angle, fewest::INT AS fewest, most::INT AS most FROM best""",
)
def i10(t: Tables) -> DataFrame:
    """The angle at which a line of five sets fewest pixels, of the four whose lines are exact."""
    images = t.embeddings.select("vec_id", F.lit(8).alias("height"), F.transform("embedding", lambda v: (v > 0.06).cast("int")).alias("values"))

    def work(image):
        if not image.any():
            return []
        angle, counts, _ = pixels.line_dilation(image.astype(bool), 5, angles=(-90, -45, 0, 45))
        return [(angle, min(counts), max(counts))]

    return pixels.per_image(images, "vec_id", work, "angle int, fewest int, most int", [pa.int32()] * 3).withColumnRenamed("vec_id", "image")


@query(
    "i17_stable_regions",
    """WITH RECURSIVE g AS (SELECT vec_id * 4 + tile AS image, y, x, least(greatest(floor((embedding[((tile // 2 * 4 + y) * 8 + tile % 2 * 4 + x + 1)::INT]::DOUBLE + 0.3) * 10), 0), 5)::INT AS g
      FROM embeddings, range(0, 4) AS a(tile), range(0, 4) AS b(y), range(0, 4) AS c(x)),
    lv AS (SELECT t, image, y, x, g, (g * 16 + y * 4 + x)::INT AS s FROM g, range(0, 6) AS l(t) WHERE g <= t),
    reach AS (SELECT t, image, s, y, x FROM lv UNION SELECT r.t, r.image, r.s, p.y, p.x FROM reach r JOIN lv p ON p.t = r.t AND p.image = r.image AND abs(p.y - r.y) + abs(p.x - r.x) = 1),
    area AS (SELECT r.t, r.image, r.s, count(*) AS n, min(p.s) AS owner FROM reach r JOIN lv p ON p.t = r.t AND p.image = r.image AND p.y = r.y AND p.x = r.x GROUP BY ALL),
    q AS (SELECT a.t, a.image, a.s, a.n, a.owner, (coalesce(h.n, a.n) - coalesce(l.n, 0))::DOUBLE / a.n AS q FROM area a
      LEFT JOIN area h ON h.image = a.image AND h.s = a.s AND h.t = least(a.t + 1, 5) LEFT JOIN area l ON l.image = a.image AND l.s = a.s AND l.t = a.t - 1)
    SELECT q.image, q.t::INT AS level, (q.s % 16)::INT AS seed, q.n::INT AS area, round(q.q, 6) AS variation FROM q
      LEFT JOIN q u ON u.image = q.image AND u.s = q.s AND u.t = q.t - 1 LEFT JOIN q o ON o.image = q.image AND o.s = q.s AND o.t = q.t + 1
    WHERE q.s = q.owner AND q.n BETWEEN 2 AND 12 AND q.q <= 0.7 AND (u.q IS NULL OR q.q <= u.q) AND (o.q IS NULL OR q.q < o.q)""",
)
def i17(t: Tables) -> DataFrame:
    """Maximally stable regions of tiles of 4 x 4 in six grey levels; in SQL by thresholds at every level."""
    v, tile = F.col("embedding"), F.col("tile")
    place = lambda i: ((F.floor(tile / 2) * 4 + F.floor(i / 4)) * 8 + tile % 2 * 4 + i % 4).cast("int")
    grey = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.least(F.greatest(F.floor((F.get(v, place(i)).cast("double") + 0.3) * 10), F.lit(0)), F.lit(5)).cast("int"))
    images = t.embeddings.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(3)))).select((F.col("vec_id") * 4 + tile).alias("image"), F.lit(4).alias("height"), grey.alias("values"))
    found = pixels.per_image(images, "image", lambda x: pixels.stable_regions(x, 6, 1, 2, 0.75, 0.7), "level int, seed int, area int, variation double", [pa.int32(), pa.int32(), pa.int32(), pa.float64()])
    return found.withColumn("variation", F.round("variation", 6))
