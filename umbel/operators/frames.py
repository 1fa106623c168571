"""Operators on whole frames: renaming, pruning, imputing, flattening, catalogues, sampling, sets."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbel.operators.prefix import row_numbers

#: Rows of a task where tables are dealt among a number of tasks that follows from their rows.
TASK_ROWS = 200_000


def tasks_for(spark: SparkSession, rows: int, each: int | None = None) -> int:
    """Tasks that share ``rows`` so that none gets much more than ``each`` (TASK_ROWS); as many as there are cores, if rows are few.

    Spark merges neighbouring partitions by their bytes, but none of a number that was asked for.
    """
    return max(spark.sparkContext.defaultParallelism, -(-rows // (each or TASK_ROWS)))


def swap(df: DataFrame, a: str, b: str) -> DataFrame:
    """The frame with the contents of two columns exchanged, column order kept."""
    return df.select(*[F.col({a: b, b: a}.get(c, c)).alias(c) for c in df.columns])


def clean_nans(df: DataFrame) -> DataFrame:
    """NaN becomes null in all floating-point columns."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold no value; one pass counts all of them."""
    counts = df.agg(*[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[c for i, c in enumerate(df.columns) if counts[i]])


def with_prefix(df: DataFrame, prefixes: Iterable[str], keep: bool = True) -> DataFrame:
    """Only (or all but) the columns whose names start with one of ``prefixes``."""
    p = tuple(prefixes)
    return df.select(*[c for c in df.columns if c.startswith(p) == keep])


def add_differences(df: DataFrame, total: str = "ALL", part: str = "TXT", without: str | None = None) -> DataFrame:
    """For each column whose name has ``total``, a column named DIFF of it less its ``part`` namesake."""
    new = {}
    for c in df.columns:
        other = c.replace(total, part)
        if total in c and other in df.columns and other != c and not (without and without in c):
            new[c.replace(total, "DIFF")] = F.col(c) - F.col(other)
    return df.withColumns(new) if new else df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def impute_means(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Nulls of numeric columns replaced by the column's mean; columns become double. One row of means is joined by value."""
    columns = columns or numeric_columns(df)
    if not columns:
        return df
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(means[c])) for c in columns})


def flatten(df: DataFrame, separator: str = "_") -> DataFrame:
    """Struct columns spread into section_key columns, at any depth."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        out: list[Column] = []
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StructType):
                out += [F.col(f"`{f.name}`.`{k}`").alias(f"{f.name}{separator}{k}") for k in f.dataType.names]
            else:
                out.append(F.col(f"`{f.name}`"))
        df = df.select(*out)
    return df


def drop_rows_with_null(df: DataFrame) -> DataFrame:
    """Rows in which no column is null."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in df.columns], F.lit(True)))


def nulls_per_row(df: DataFrame) -> Column:
    """Number of null columns of a row."""
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in df.columns], F.lit(0))


def catalogue_filter(df: DataFrame, values: dict[str, list], mode: str = "inclusive") -> DataFrame:
    """Rows whose every key is among its values (``inclusive``), or none is (``exclusive``); keys without values don't count."""
    if mode not in ("inclusive", "exclusive"):
        raise ValueError(f"mode {mode!r}")
    for k, v in values.items():
        if v:
            member = F.coalesce(F.col(k).isin(v), F.lit(False))
            df = df.where(member if mode == "inclusive" else ~member)
    return df


def catalogue_order(keys: list[str], last: list[Column] | None = None) -> list[Column]:
    """Order of a stable sort by each key in turn: the last key is the primary one."""
    return [F.col(k).asc_nulls_last() for k in reversed(keys)] + (last or [])


def seeded(seed: int, *columns: str | Column) -> Column:
    """A number of 60 random-looking bits (bigint) from a seed and values, the same in every engine that knows MD5; null values are left out."""
    digits = F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]))
    return F.conv(F.substring(digits, 1, 15), 16, 10).cast("bigint")


def shuffle_order(column: Column, seed: int = 666) -> Column:
    """A seeded order that depends on values alone."""
    return seeded(seed, column)


def head_fraction(df: DataFrame, fraction: float, order: str) -> DataFrame:
    """The first int(rows * |fraction|) rows in the order of a unique column."""
    return row_numbers(df, order, "__n").where(F.col("__n") <= int(df.count() * abs(fraction))).drop("__n")


def hash_split(column: Column, shares: list[float], seed: int = 42) -> Column:
    """Part number from 0 for each row, by a seeded hash of ``column``: rows keep their part on any rerun."""
    unit = F.pmod(seeded(seed, column), F.lit(1_000_000)) / 1_000_000
    out, at = F.lit(len(shares) - 1), sum(shares)
    for i in range(len(shares) - 1, 0, -1):
        at -= shares[i]
        out = F.when(unit < at / sum(shares), F.lit(i - 1)).otherwise(out)  # the least bound is tested first
    return out


def group_members(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    """The members of each key tuple, sorted, and their number."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(member)).alias("members"), F.count(member).alias("size"))


def chunks(df: DataFrame, order: str, size: int = 5000) -> DataFrame:
    """Adds chunk: number from 0 of the run of ``size`` rows in the order of a unique column."""
    return row_numbers(df, order, "__n").withColumn("chunk", F.floor((F.col("__n") - 1) / size)).drop("__n")


def union_all(frames: list[DataFrame], allow_missing: bool = False) -> DataFrame:
    """All rows of all frames by column name; missing columns are null if allowed."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def first_write_wins(stored: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows of ``new`` to append: one per key, the first in ``order``, of keys that are not stored."""
    unseen = new.join(stored.select(*keys), keys, "left_anti")
    return unseen.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def last_file_wins(df: DataFrame, keys: list[str], file: str) -> DataFrame:
    """One row per key: that of the file last in order of names."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(file).desc()))).where("__r = 1").drop("__r")


def analysis_frame(df: DataFrame, status: str, fraction: float, renames: dict[str, str], prefixes: list[str], by: str) -> DataFrame:
    """Successful rows without empty columns, a seeded share of them, renamed, cut to prefixes, means imputed."""
    ok = drop_empty_columns(df.where(F.col(status) == "success"))
    part = ok.where(hash_split(F.col(by), [fraction, 1 - fraction]) == 0) if fraction < 1 else ok
    return impute_means(with_prefix(part.withColumnsRenamed(renames), prefixes))
