"""The driver's tables in the roles of descriptors, searches, fine matches and annotations; in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbel.functions import keys
from umbel.operators.frames import tasks_for
from umbel.operators.search import knn
from umbel.plans.registry import Tables

#: Neighbours of a search.
K = 20

SQL_DESCRIPTORS = """d0 AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS vector, 1 + (vec_id // 40) % 3 AS phone,
         CASE WHEN vec_id % 5 = 0 THEN 360 ELSE ((vec_id // 40) % 36) * 10 END AS angle
  FROM embeddings),
d AS (
  SELECT *, printf('%04d_D%02d_S%03d', label, 1 + label % 3, 1 + label % 5) AS package,
         printf('Ph%d_P%04d_D%02d_S%03d_C2_az%03d', phone, label, 1 + label % 3, 1 + label % 5, angle) AS sample,
         'PFP_' || printf('Ph%d_P%04d_D%02d_S%03d_C2_az%03d', phone, label, 1 + label % 3, 1 + label % 5, angle) || '_side1' AS filename
  FROM d0)"""

SQL_MATCHES = (
    SQL_DESCRIPTORS
    + f""",
arms AS (SELECT *, 'MSER' AS algorithm, vector AS x FROM d UNION ALL SELECT *, 'MI1' AS algorithm, vector[1:32] AS x FROM d),
near AS (
  SELECT q.algorithm, q.sample, q.phone, q.package AS package_actual, q.vec_id AS query, i.vec_id AS neighbour, i.package,
         list_distance(q.x, i.x) AS dist
  FROM arms q JOIN arms i ON q.algorithm = i.algorithm WHERE q.angle <> 360 AND i.angle = 360),
placed AS (SELECT *, row_number() OVER (PARTITION BY algorithm, query ORDER BY dist, neighbour) AS pos FROM near),
matches AS (
  SELECT sample, phone, package_actual, algorithm, query AS descriptor, neighbour, package, round(dist, 6) AS distance, pos::INT AS pos,
         package = package_actual AS match
  FROM placed WHERE pos <= {K})"""
)


def descriptors(t: Tables) -> DataFrame:
    """vec_id, label, vector, phone, angle, package, sample, filename: names are composed from ids as a capture session would."""
    n = F.col("vec_id")
    block = F.expr("vec_id DIV 40")
    d = t.embeddings.select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"), (1 + block % 3).alias("phone"),
        F.when(n % 5 == 0, F.lit(360)).otherwise((block % 36) * 10).alias("angle"),
    )
    package = keys.package_id(F.col("label"), 1 + F.col("label") % 3, 1 + F.col("label") % 5)
    d = d.withColumn("package", package)
    sample = F.concat(F.lit("Ph"), F.col("phone").cast("string"), F.lit("_P"), F.col("package"), F.lit("_C2_az"), keys.zfill(F.col("angle"), 3))
    return d.withColumn("sample", sample).withColumn("filename", F.concat(F.lit("PFP_"), F.col("sample"), F.lit("_side1")))


def arm(d: DataFrame, algorithm: str) -> DataFrame:
    """The descriptors of one algorithm: MSER has the whole vector, MI1 its first half."""
    return d if algorithm == "MSER" else d.withColumn("vector", F.slice("vector", 1, 32))


def matches(t: Tables, k: int = K) -> DataFrame:
    """Neighbours in the index (angle 360) of every query, by both algorithms, with packages and match flags."""
    d = descriptors(t)
    out = None
    for algorithm in ("MSER", "MI1"):
        a = arm(d, algorithm)
        near = knn(a.where("angle <> 360"), a.where("angle = 360"), k, "vec_id").withColumn("algorithm", F.lit(algorithm))
        out = near if out is None else out.unionByName(near)
    q = d.select(F.col("vec_id").alias("query"), "sample", "phone", F.col("package").alias("package_actual"))
    i = d.select(F.col("vec_id").alias("neighbour"), "package")
    # a query has k rows of each algorithm, so tasks get equal shares; a neighbour may have any number, so its join is left to be split
    n = tasks_for(t.spark, 2 * k * t.embeddings.count())
    found = out.where("neighbour IS NOT NULL").repartition(n, "query").join(q.repartition(n, "query"), "query").join(i, "neighbour")
    return found.select(
        "sample", "phone", "package_actual", "algorithm", F.col("query").alias("descriptor"), "neighbour", "package",
        F.round("distance", 6).alias("distance"), "pos", (F.col("package") == F.col("package_actual")).alias("match"),
    )


SQL_FINE = """fine AS (
  SELECT o_orderkey AS sample, CASE WHEN l_linenumber % 2 = 0 THEN 'MSER' ELSE 'MI1' END AS algorithm, 1 + l_suppkey % 3 AS phone,
         o_custkey % 7 AS package_actual, l_partkey % 7 AS candidate, l_linenumber AS line,
         CAST(l_quantity AS BIGINT) * 10 AS matches, CAST(floor(l_quantity * l_discount * 50) AS BIGINT) AS good,
         CASE WHEN l_returnflag = 'R' AND l_tax = 0 THEN NULL ELSE CAST(floor(l_quantity * l_discount * 20) AS BIGINT) END AS ransac
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
fine_match AS (SELECT *, package_actual = candidate AS match FROM fine)"""


def fine(t: Tables) -> DataFrame:
    """Order lines as fine-matching results: a sample per order, candidates with match counts, some missing.

    Orders are dealt among as many tasks as the lines ask for; what is grouped or ranked by sample stays in its task.
    """
    n = tasks_for(t.spark, t.lineitem.count())
    j = t.lineitem.repartition(n, "l_orderkey").join(t.orders.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    q, disc = F.col("l_quantity"), F.col("l_discount")
    out = j.select(
        F.col("o_orderkey").alias("sample"), F.when(F.col("l_linenumber") % 2 == 0, "MSER").otherwise("MI1").alias("algorithm"),
        (1 + F.col("l_suppkey") % 3).alias("phone"), (F.col("o_custkey") % 7).alias("package_actual"), (F.col("l_partkey") % 7).alias("candidate"),
        F.col("l_linenumber").alias("line"), (q.cast("bigint") * 10).alias("matches"), F.floor(q * disc * 50).cast("bigint").alias("good"),
        F.when(~((F.col("l_returnflag") == "R") & (F.col("l_tax") == 0)), F.floor(q * disc * 20).cast("bigint")).alias("ransac"),
    )
    return out.withColumn("match", F.col("package_actual") == F.col("candidate"))
