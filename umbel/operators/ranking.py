"""From neighbour lists to ranked candidates: grouped statistics, tie-aware ranks, votes, fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["sample", "algorithm"]
#: Statistics of a candidate's distances and whether the largest ranks first.
STATISTICS = {"mean": False, "median": False, "sum": False, "min": False, "size": True}
EXTENDED = STATISTICS | {"std": False, "var": False}


def max_rank(value: str, by: list[str], descending: bool = False) -> Column:
    """Rank whose ties all get the highest of their places; nulls share the last place."""
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    whole = Window.partitionBy(*by).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return F.count(F.lit(1)).over(whole)


def dense_rank(value: str, by: list[str], descending: bool = False) -> Column:
    """Rank without gaps; nulls share the last."""
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    return F.dense_rank().over(Window.partitionBy(*by).orderBy(order))


def cell_statistics(matches: DataFrame, extended: bool = False) -> DataFrame:
    """mean, median, sum, min (std, var) and size of distance per (sample, algorithm, descriptor, package); null keys and values are left out."""
    rows = matches.where(F.col("package").isNotNull() & F.col("distance").isNotNull())
    aggregates = [F.avg("distance").alias("mean"), F.median("distance").alias("median"), F.sum("distance").alias("sum"), F.min("distance").alias("min"), F.count("*").alias("size")]
    if extended:
        aggregates += [F.stddev_samp("distance").alias("std"), F.var_samp("distance").alias("var")]
    return rows.groupBy(*KEYS, "descriptor", "package").agg(*aggregates)


def densify(cells: DataFrame) -> DataFrame:
    """All packages by all descriptors of each (sample, algorithm), absent cells null."""
    packages = cells.select(*KEYS, "package").distinct()
    descriptors = cells.select(*KEYS, "descriptor").distinct()
    return packages.join(descriptors, KEYS).join(cells, [*KEYS, "descriptor", "package"], "left")


def rank_sums(cells: DataFrame, extended: bool = False, dense: bool = False) -> DataFrame:
    """Adds rank_sum over the statistics' ranks within a descriptor, over all packages of the sample."""
    rank = dense_rank if dense else max_rank
    by = [*KEYS, "descriptor"]
    total = None
    for name, descending in (EXTENDED if extended else STATISTICS).items():
        if dense and name == "min":
            continue
        r = rank(name, by, descending)
        total = r if total is None else total + r
    return densify(cells).withColumn("rank_sum", total.cast("bigint"))


def guesses(ranked: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` packages of each descriptor by (rank_sum, package), with guess_rank."""
    order = Window.partitionBy(*KEYS, "descriptor").orderBy("rank_sum", "package")
    return ranked.withColumn("guess_rank", F.row_number().over(order)).where(F.col("guess_rank") <= top)


def votes(guessed: DataFrame, top: int = 10) -> DataFrame:
    """(sample, algorithm, package, votes, pos): packages by number of descriptors that listed them, then first seen."""
    counted = guessed.groupBy(*KEYS, "package").agg(F.count("*").alias("votes"), F.min(F.struct("descriptor", "guess_rank")).alias("seen"))
    order = Window.partitionBy(*KEYS).orderBy(F.desc("votes"), "seen")
    return counted.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= top).drop("seen")


def candidates(matches: DataFrame, top: int = 10, extended: bool = False, dense: bool = False) -> DataFrame:
    """The ranking core: (sample, algorithm, package, votes, pos) from (sample, algorithm, descriptor, package, distance)."""
    return votes(guesses(rank_sums(cell_statistics(matches, extended), extended, dense), top), top)


def interleave(ranked: DataFrame) -> DataFrame:
    """Adds fused: place in the list of both algorithms' candidates, taken in turn by pos, then algorithm."""
    return ranked.withColumn("fused", F.row_number().over(Window.partitionBy("sample").orderBy("pos", "algorithm")))


def wide(ranked: DataFrame, top: int = 10) -> DataFrame:
    """One row per (sample, algorithm) with package_candidate_1 to _top."""
    named = [F.max(F.when(F.col("pos") == i, F.col("package"))).alias(f"package_candidate_{i}") for i in range(1, top + 1)]
    return ranked.groupBy(*KEYS).agg(*named)


def long(table: DataFrame, keys: list[str], top: int = 10) -> DataFrame:
    """The inverse of ``wide``; absent candidates give no row."""
    cells = F.array(*[F.col(f"package_candidate_{i}") for i in range(1, top + 1)])
    return table.select(*keys, F.posexplode(cells).alias("i", "package")).where("package IS NOT NULL").select(*keys, (F.col("i") + 1).alias("pos"), "package")


def fuse_by_ranks(scores: DataFrame, keys: list[str], features: list[str], descending: bool = True) -> DataFrame:
    """The best candidate of each key: least sum of max ranks of the features; ties go to the first candidate."""
    total = None
    for f in features:
        r = max_rank(f, keys, descending)
        total = r if total is None else total + r
    summed = scores.withColumn("rank_sum", total.cast("bigint"))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy("rank_sum", "candidate"))
    return summed.withColumn("__r", best).where("__r = 1").drop("__r")
