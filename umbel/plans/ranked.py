"""The ranking core and what is built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbel.operators import ranking, retrieval
from umbel.plans.fixtures import SQL_FINE, SQL_MATCHES, fine, matches
from umbel.plans.registry import Tables, query


def _sql_core(dense: bool = False, extended: bool = False, top: int = 10) -> str:
    stats = {"mean": "ASC", "median": "ASC", "sum": "ASC", "min": "ASC", "size": "DESC"} | ({"std": "ASC", "var": "ASC"} if extended else {})
    if dense:
        stats.pop("min")
    part = "PARTITION BY sample, algorithm, descriptor ORDER BY"
    if dense:
        ranks = " + ".join(f'dense_rank() OVER ({part} "{s}" {d} NULLS LAST)' for s, d in stats.items())
    else:
        ranks = " + ".join(f'count(*) OVER ({part} "{s}" {d} NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)' for s, d in stats.items())
    return f"""WITH {SQL_MATCHES},
cells AS (
  SELECT sample, algorithm, descriptor, package, avg(distance) AS mean, median(distance) AS median, sum(distance) AS sum, min(distance) AS min,
         count(*) AS size, stddev_samp(distance) AS std, var_samp(distance) AS var
  FROM matches GROUP BY ALL),
packs AS (SELECT DISTINCT sample, algorithm, package FROM cells), descs AS (SELECT DISTINCT sample, algorithm, descriptor FROM cells),
dense AS (
  SELECT * FROM packs JOIN descs USING (sample, algorithm) LEFT JOIN cells USING (sample, algorithm, descriptor, package)),
ranks AS (SELECT sample, algorithm, descriptor, package, ({ranks})::BIGINT AS rank_sum FROM dense),
guess AS (SELECT *, row_number() OVER (PARTITION BY sample, algorithm, descriptor ORDER BY rank_sum, package) AS guess_rank FROM ranks),
listed AS (SELECT * FROM guess WHERE guess_rank <= {top}),
votes AS (SELECT sample, algorithm, package, count(*) AS votes, min((descriptor, guess_rank)) AS seen FROM listed GROUP BY ALL),
core AS (
  SELECT sample, algorithm, package, votes, pos::INT AS pos FROM (
    SELECT *, row_number() OVER (PARTITION BY sample, algorithm ORDER BY votes DESC, seen) AS pos FROM votes) WHERE pos <= {top})
"""


@query("ranking_core", _sql_core() + "SELECT * FROM core")
def ranking_core(t: Tables) -> DataFrame:
    """Flagship (A9, W2, W1, W6, W5, A31, W7): top ten candidates of every sample and algorithm."""
    return ranking.candidates(matches(t))


@query("a42_dense_extended_vote", _sql_core(dense=True, extended=True, top=5) + "SELECT * FROM core")
def a42(t: Tables) -> DataFrame:
    """Notebook variant: dense ranks, with spread, without the minimum, top five."""
    return ranking.candidates(matches(t), top=5, extended=True, dense=True)


@query(
    "a9_a10_cell_statistics",
    f"""WITH {SQL_MATCHES} SELECT sample, algorithm, descriptor, package, round(avg(distance), 9) AS mean, round(median(distance), 9) AS median,
    round(sum(distance), 9) AS sum, min(distance) AS min, count(*) AS size, round(stddev_samp(distance), 9) AS std, round(var_samp(distance), 9) AS var
    FROM matches GROUP BY ALL""",
)
def a9(t: Tables) -> DataFrame:
    """Multi-aggregate pivot, kept long."""
    c = ranking.cell_statistics(matches(t), extended=True)
    return c.withColumns({x: F.round(x, 9) for x in ("mean", "median", "sum", "std", "var")})


@query(
    "w1_w2_max_rank_densified",
    _sql_core().rsplit("guess AS", 1)[0].rstrip().rstrip(",") + " SELECT * FROM ranks",
)
def w1(t: Tables) -> DataFrame:
    """Rank sums over all packages of a sample, absent cells last."""
    return ranking.rank_sums(ranking.cell_statistics(matches(t))).select("sample", "algorithm", "descriptor", "package", "rank_sum")


@query(
    "w3_dense_rank",
    "SELECT p_partkey, p_brand, p_retailprice, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size NULLS LAST)::INT AS size_rank FROM part",
)
def w3(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_brand", "p_retailprice", ranking.dense_rank("p_size", ["p_brand"]).alias("size_rank"))


@query(
    "w1_rank_both_directions",
    """SELECT s_suppkey, count(*) OVER (PARTITION BY s_nationkey ORDER BY v ASC NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up,
    count(*) OVER (PARTITION BY s_nationkey ORDER BY v DESC NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS down
    FROM (SELECT *, CASE WHEN s_acctbal > 0 THEN floor(s_acctbal / 1000) END AS v FROM supplier)""",
)
def w1_both(t: Tables) -> DataFrame:
    s = t.supplier.withColumn("v", F.when(F.col("s_acctbal") > 0, F.floor(F.col("s_acctbal") / 1000)))
    return s.select("s_suppkey", ranking.max_rank("v", ["s_nationkey"]).alias("up"), ranking.max_rank("v", ["s_nationkey"], True).alias("down"))


@query("w11_fused_list", _sql_core() + "SELECT *, row_number() OVER (PARTITION BY sample ORDER BY pos, algorithm)::INT AS fused FROM core")
def w11(t: Tables) -> DataFrame:
    """Both algorithms' candidates in turn."""
    return ranking.interleave(ranking.candidates(matches(t)))


@query(
    "p12_p13_wide_candidates",
    _sql_core() + "SELECT sample, algorithm, " + ", ".join(f"max(CASE WHEN pos = {i} THEN package END) AS package_candidate_{i}" for i in range(1, 11)) + " FROM core GROUP BY ALL",
)
def p13(t: Tables) -> DataFrame:
    """One row per sample and algorithm with ten candidate columns."""
    return ranking.wide(ranking.candidates(matches(t)))


@query("p12_p15_wide_to_long", _sql_core() + "SELECT sample, algorithm, pos, package FROM core")
def p12(t: Tables) -> DataFrame:
    """Back to one row a candidate, numbered from 1."""
    return ranking.long(ranking.wide(ranking.candidates(matches(t))), ["sample", "algorithm"])


_SQL_HITS = """, actual AS (SELECT DISTINCT sample, package_actual FROM matches),
hits AS (SELECT core.*, package = package_actual AS match FROM core JOIN actual USING (sample))"""


def _hits(t: Tables) -> DataFrame:
    m = matches(t)
    return ranking.candidates(m).join(m.select("sample", "package_actual").distinct(), "sample").withColumn("match", F.col("package") == F.col("package_actual"))


def _sql_curve(source: str, keys: str, pos: str, n: int) -> str:
    return f"""SELECT n::INT AS n, hits, total, 1 - hits / total AS miss, hits / total AS hit FROM (
      SELECT n, count(*) FILTER (WHERE first <= n) AS hits, count(*) AS total
      FROM (SELECT {keys}, min(CASE WHEN match THEN {pos} END) AS first FROM {source} GROUP BY ALL), range(1, {n + 1}) AS r(n) GROUP BY n)"""


@query("a23_hit_curve", _sql_core() + _SQL_HITS + _sql_curve("hits", "sample, algorithm", "pos", 10))
def a23(t: Tables) -> DataFrame:
    """Share of samples whose package is among the first N candidates of an algorithm."""
    return retrieval.hit_curve(_hits(t), ["sample", "algorithm"], "pos", "match", 10)


@query(
    "a23_fused_hit_curve",
    _sql_core() + _SQL_HITS + ", fused AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY pos, algorithm) AS f FROM hits) " + _sql_curve("fused", "sample", "f", 20),
)
def a23_fused(t: Tables) -> DataFrame:
    """The same over the fused list of both algorithms."""
    return retrieval.hit_curve(ranking.interleave(_hits(t)), ["sample"], "fused", "match", 20)


@query(
    "f22_actual_among_guesses",
    _sql_core() + _SQL_HITS + "SELECT sample, algorithm, list_contains(list(package), any_value(package_actual)) AS found FROM core JOIN actual USING (sample) GROUP BY sample, algorithm",
)
def f22(t: Tables) -> DataFrame:
    """Is the actual package among the guesses?"""
    lists = _hits(t).groupBy("sample", "algorithm").agg(F.collect_list("package").alias("guesses"), F.first("package_actual").alias("actual"))
    return lists.select("sample", "algorithm", F.array_contains("guesses", F.col("actual")).alias("found"))


@query(
    "w8_rank_fusion",
    f"""WITH {SQL_FINE}, c AS (
      SELECT sample, candidate, sum(matches)::DOUBLE AS m, sum(good)::DOUBLE AS g, sum(ransac)::DOUBLE AS r FROM fine_match GROUP BY ALL),
    ranks AS (SELECT *, """
    + " + ".join(f"count(*) OVER (PARTITION BY sample ORDER BY {x} DESC NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" for x in "mgr")
    + """ AS rank_sum FROM c)
    SELECT sample, candidate, rank_sum::BIGINT AS rank_sum FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY rank_sum, candidate) AS n FROM ranks) WHERE n = 1""",
)
def w8(t: Tables) -> DataFrame:
    """Best candidate by the sum of its ranks over explicit features."""
    c = fine(t).groupBy("sample", "candidate").agg(*[F.sum(x).cast("double").alias(x[0]) for x in ("matches", "good", "ransac")])
    return ranking.fuse_by_ranks(c, ["sample"], ["m", "g", "r"]).select("sample", "candidate", "rank_sum")


@query(
    "a17_feature_means",
    f"""WITH {SQL_FINE} SELECT sample, candidate, algorithm, round(avg(matches), 6) AS matches, round(avg(good), 6) AS good, round(avg(ransac), 6) AS ransac
    FROM fine_match GROUP BY ALL""",
)
def a17(t: Tables) -> DataFrame:
    """Mean of explicit features per candidate; the match flag is no feature."""
    return fine(t).groupBy("sample", "candidate", "algorithm").agg(*[F.round(F.avg(x), 6).alias(x) for x in ("matches", "good", "ransac")])
