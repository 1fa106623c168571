"""Running sums and row numbers over a whole table, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def blocks(df: DataFrame, by: str, name: str = "block") -> DataFrame:
    """Adds ``name``: number of the range of ``by`` that a row falls in, rising with the value; equal values share one.

    The bounds are the least values of Spark's sampled range partitions, one a shuffle partition. They
    are taken once, so a row's block follows from its value, wherever a rerun puts it. Null values come first.
    """
    ranged = df.select(by).where(F.col(by).isNotNull()).repartitionByRange(F.col(by)).groupBy(F.spark_partition_id()).agg(F.min(by).alias("low"))
    lows = sorted(r["low"] for r in ranged.collect())
    if not lows:
        return df.withColumn(name, F.lit(0))
    # two short walks, over every step-th bound and then over the bounds between two of those
    step, upto = max(1, round(len(lows) ** 0.5)), lambda xs: F.size(F.filter(xs, lambda x: x <= F.col(by)))
    runs = [lows[i : i + step] for i in range(0, len(lows), step)]
    outer = upto(F.array(*[F.lit(r[0]) for r in runs])) - 1
    inner = upto(F.get(F.array(*[F.array(*map(F.lit, r)) for r in runs]), outer))
    block = F.when(outer < 0, F.lit(0)).otherwise(outer * step + inner)
    return df.withColumn(name, F.when(F.col(by).isNull(), F.lit(0)).otherwise(block).cast("int"))


def running(df: DataFrame, by: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Adds for each ``new: column`` the sum of ``column`` over all rows up to and with the row's value of ``by``."""
    placed = blocks(df, by, "__block")
    totals = placed.groupBy("__block").agg(*[F.sum(c).alias(f"__t{i}") for i, c in enumerate(sums.values())])
    outer = Window.orderBy(F.desc("__block") if descending else F.asc("__block"))
    # one row a block, so its window is as small as the number of shuffle partitions
    before = totals.select("__block", *[(F.sum(f"__t{i}").over(outer) - F.col(f"__t{i}")).alias(f"__b{i}") for i in range(len(sums))])
    inner = Window.partitionBy("__block").orderBy(F.desc_nulls_last(by) if descending else F.asc_nulls_first(by))
    out = placed.join(F.broadcast(before), "__block")
    out = out.withColumns({new: F.col(f"__b{i}") + F.sum(c).over(inner) for i, (new, c) in enumerate(sums.items())})
    return out.drop("__block", *[f"__b{i}" for i in range(len(sums))])


def row_numbers(df: DataFrame, by: str, name: str = "row_number") -> DataFrame:
    """Adds the row number from 1 in the order of ``by``, whose values should be unique."""
    placed = blocks(df, by, "__block")
    counts = placed.groupBy("__block").agg(F.count("*").alias("__n"))
    before = counts.select("__block", (F.sum("__n").over(Window.orderBy("__block")) - F.col("__n")).alias("__b"))
    inner = Window.partitionBy("__block").orderBy(F.asc_nulls_first(by))
    return placed.join(F.broadcast(before), "__block").withColumn(name, F.col("__b") + F.row_number().over(inner)).drop("__block", "__b")
