"""Evaluation of retrieval: accuracy, misses, hit curves, sweeps, recall, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbel.operators.prefix import running


def best_row(df: DataFrame, keys: list[str], value: str, ties: list[str], largest: bool = True) -> DataFrame:
    """One row per key: that of the largest (smallest) value, nulls last, then first by ``ties``."""
    order = F.col(value).desc_nulls_last() if largest else F.col(value).asc_nulls_last()
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order, *ties))).where("__r = 1").drop("__r")


def head(df: DataFrame, keys: list[str], n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def accuracy(df: DataFrame, keys: list[str], sample: str, value: str, ties: list[str]) -> DataFrame:
    """Share of samples whose best row is a match, per key."""
    best = best_row(df, [*keys, sample], value, ties)
    return best.groupBy(*keys).agg(F.count_if("match").alias("hits"), F.count(sample).alias("samples")).withColumn("accuracy", F.try_divide("hits", "samples"))


def miss_probability(match: Column, sample: Column) -> Column:
    """Aggregate: 1 - share of samples with a matching row."""
    return 1 - F.try_divide(F.count_distinct(F.when(match, sample)), F.count_distinct(sample))


def miss_percentage(df: DataFrame, keys: list[str], match: str) -> DataFrame:
    """One row: groups by composite keys, those with a match, and the percentage without."""
    groups = df.groupBy(*keys).agg(F.bool_or(match).alias("hit"))
    out = groups.agg(F.count("*").alias("groups"), F.count_if("hit").alias("hits"))
    return out.withColumn("miss_percent", 100 - F.try_divide(F.col("hits"), F.col("groups")) * 100)


def hit_curve(ranked: DataFrame, keys: list[str], pos: str, match: str, n: int) -> DataFrame:
    """(n, hits, total, miss, hit): for N = 1..n, keys with a match within the first N places; miss and hit are shares."""
    first = ranked.groupBy(*keys).agg(F.min(F.when(F.col(match), F.col(pos))).alias("first"))
    total = first.agg(F.count("*").alias("total"), *[F.count_if(F.col("first") <= i).alias(f"h{i}") for i in range(1, n + 1)])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("n"), F.col(f"h{i}").alias("hits")) for i in range(1, n + 1)]))
    out = total.select("total", rows.alias("x")).select("x.n", "x.hits", "total")
    hit = F.try_divide("hits", "total")
    return out.withColumns({"miss": 1 - hit, "hit": hit})


def neighbour_sweep(near: DataFrame, counts: list[int]) -> DataFrame:
    """For each n and algorithm, and for both together: mean number of packages listed per sample and miss probability.

    ``near`` has sample, algorithm, query, package, pos and match. The list of both algorithms holds up
    to n rows of each. Miss is over all samples of the table, whichever algorithm saw them.
    """
    total = near.agg(F.count_distinct("sample").alias("total"))
    kept = near.select("sample", "algorithm", "package", "pos", "match", F.explode(F.array(*[F.lit(n) for n in counts])).alias("n")).where("pos <= n")
    # two grains at once: each algorithm, and both as one list; distinct packages are counted first, so rows shrink before the second step
    graded = kept.select("n", "sample", "package", "match", F.explode(F.array("algorithm", F.lit("Both"))).alias("arm"))
    per_sample = graded.groupBy("n", "arm", "sample").agg(F.count_distinct("package").alias("packages"), F.bool_or("match").alias("hit"))
    out = per_sample.groupBy("n", "arm").agg(F.avg("packages").alias("mean_packages"), F.count_if("hit").alias("hits"))
    # one row joins: the number of samples
    return out.crossJoin(F.broadcast(total)).select(
        "n", "arm", F.col("mean_packages").cast("int").alias("list_size"), (1 - F.try_divide("hits", "total")).alias("miss")
    )


def majority_share(df: DataFrame, sample: str, match: str) -> DataFrame:
    """One row: samples with more matching than other rows, all samples, and the share."""
    per = df.groupBy(sample).agg(F.count_if(match).alias("yes"), F.count_if(~F.col(match)).alias("no"))
    out = per.agg(F.count_if(F.col("yes") > F.col("no")).alias("majority"), F.count("*").alias("samples"))
    return out.withColumn("share", F.try_divide("majority", "samples"))


def recall(found: DataFrame, truth: DataFrame, thresholds: list[int]) -> DataFrame:
    """One row: for each threshold t, the share of queries whose true nearest neighbour stands before place t (from 0).

    ``found`` (query, neighbour, pos from 0), ``truth`` (query, neighbour): one row a query.
    """
    hits = truth.select("query", "neighbour").join(found.select("query", "neighbour", "pos"), ["query", "neighbour"], "left")
    return hits.agg(*[F.try_divide(F.count_if(F.col("pos") < t), F.count("*")).alias(f"recall_{t}") for t in thresholds])


def roc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, fpr, tpr): points of the curve, one per different score, from the highest.

    Scores are counted before the cumulative sum, so that it runs over different scores only.
    """
    counts = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    sums = running(counts, score, {"fp": "n", "tp": "p"}, descending=True)
    totals = counts.agg(F.sum("p").alias("ps"), F.sum("n").alias("ns"))  # one row
    return sums.crossJoin(F.broadcast(totals)).select(F.col(score).alias("threshold"), F.try_divide("fp", "ns").alias("fpr"), F.try_divide("tp", "ps").alias("tpr"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row, auc: area under the curve by trapezia, ties counted half."""
    counts = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    area = running(counts, score, {"upto": "n"}).select("p", "n", (F.col("upto") - F.col("n")).alias("below"))
    return area.agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auc"))


def histogram(df: DataFrame, value: str, start: float, width: float, bins: int) -> DataFrame:
    """(bin, low, high, n) of the bins that have values; a value at the last edge belongs to the last bin, others outside to none."""
    v = F.col(value)
    b = F.least(F.floor((v - start) / width), F.lit(bins - 1)).cast("int")
    inside = df.where((v >= start) & (v <= start + width * bins)).select(b.alias("bin"))
    return inside.groupBy("bin").agg(F.count("*").alias("n")).select("bin", (start + F.col("bin") * width).alias("low"), (start + (F.col("bin") + 1) * width).alias("high"), "n")


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key, null counted as a value; the least of equally frequent ones, null last."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return head(counts.withColumn("__n", -F.col("n")).withColumn("__null", F.col(value).isNull()), keys, 1, ["__n", "__null", value]).drop("__n", "__null")
