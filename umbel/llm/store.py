"""Shared scratch tables and size-checked joins used by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows below which a side that was counted may be broadcast (ids and a few numbers each).
BROADCAST_ROWS = 200_000

#: Rows of one group from which it is joined by broadcast, and how many such groups there can be; see ``by_group``.
HOT_ROWS = 256
HOT_GROUPS = 100_000

#: Words are runs of anything but the six ASCII blanks.
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"
BLANK_CHARS = " \t\n\u000b\f\r"

#: Rows are numbered within stretches of 2 to this power of their numbers first; see ``repeat_numbers``.
_STRETCH = 20

_local_base: dict[str, str] = {}
#: By application: the scratch paths that were given out and not freed.
_made: dict[str, list[str]] = {}


def scratch_base(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only for local masters."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_base:
        _local_base[app] = tempfile.mkdtemp(prefix="umbel-")
    return _local_base[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends, or by ``free``."""
    app = spark.sparkContext.applicationId
    path = f"{scratch_base(spark)}/umbel-{app}/{label}-{uuid.uuid4().hex}"
    where, fs = _hadoop(spark, path)
    fs.deleteOnExit(where)
    _made.setdefault(app, []).append(path)
    return path


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def made(spark: SparkSession) -> int:
    """How many scratch paths there are; a mark for ``free``."""
    return len(_made.get(spark.sparkContext.applicationId, []))


def free(spark: SparkSession, since: int) -> None:
    """Remove the scratch tables made after the mark ``since`` but for the last, whose reader is all that may still be used."""
    paths = _made.get(spark.sparkContext.applicationId, [])
    while len(paths) > since + 1:
        where, fs = _hadoop(spark, paths.pop(since))
        fs.delete(where, True)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage without a checkpoint in executor storage: the files outlive any executor,
    and readers get real sizes, so the optimiser plans on facts.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` to ``groups``, one settled row per ``key`` with its number of rows in ``size``, of ``total`` in all.

    A key with a large share of the rows would fill one task of a shuffled join. Groups above the bound
    number HOT_GROUPS at most, whatever the input, so these go by broadcast and the rest by merge.
    """
    bound = max(HOT_ROWS, total // HOT_GROUPS)
    hot = F.broadcast(groups.where(F.col(size) > bound))
    cold = groups.where(F.col(size) <= bound)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold.hint("merge"), key))


def repeat_numbers(hashed: DataFrame) -> DataFrame | None:
    """(row_id, number): numbers from 1 up for the second and further rows of each hash; None if no hash repeats.

    ``hashed`` is settled, with row_id and h.
    A hash may have a third of all rows, so rows are numbered within stretches of the input first, and the
    stretches of a hash are summed up after. The numbers of a hash have no gaps, however the table is stored.
    """
    repeated = settle(hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    if not repeated.limit(1).count():
        return None
    rows = by_group(hashed, repeated, "h", "n", hashed.count()).select("h", "row_id", F.shiftright("row_id", _STRETCH).alias("stretch"))
    rows = settle(rows, "repeated-rows")
    counts = rows.groupBy("h", "stretch").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("h").orderBy("stretch")) - F.col("rows")
    counts = settle(counts.select("h", "stretch", before.alias("before")), "stretches")
    inside = rows.withColumn("number", F.row_number().over(Window.partitionBy("h", "stretch").orderBy("row_id")) - 1)
    numbered_rows = inside.join(counts, ["h", "stretch"]).select("row_id", (F.col("before") + F.col("number")).alias("number"))
    return settle(numbered_rows.where("number > 0"), "numbers")


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` (best a settled table) has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def drop_ids(df: DataFrame, ids: DataFrame, key: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in ``ids``: broadcast behind a count, else a shuffled anti-join."""
    ids = settle(ids.select(key), "ids")
    return df.join(F.broadcast(ids) if is_small(ids, rows) else ids.hint("merge"), key, "left_anti")


def keyed_lookup(df: DataFrame, table: DataFrame, keys: list[str], salt_by: str, rows: int = BROADCAST_ROWS, salts: int = 64) -> DataFrame:
    """Left join of ``df`` to ``table`` (one settled row per key; nulls match nulls).

    A counted small table is broadcast. A larger one is repeated over ``salts`` and joined on key and
    salt, so that a key with a third of all rows is spread over as many tasks.
    """
    t = table.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in table.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    if is_small(table, rows):
        out = df.join(F.broadcast(t), on, "left")
    else:
        t = t.withColumn("__s2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        d = df.withColumn("__s1", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
        out = d.join(t.hint("merge"), [*on, F.col("__s1") == F.col("__s2")], "left").drop("__s1", "__s2")
    return out.drop(*[f"__{k}" for k in keys])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores appended until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a number for every row that is the same in all scans, and the number's column.

    monotonically_increasing_id differs between two scans when files are split otherwise the second time
    (as the number of live cores changes). So rows of files are numbered by file and place in the file;
    what is no plain scan of files with row indexes is written once with its numbers.
    """
    rid = fresh(df, "row_id")
    plan = df._jdf.queryExecution().analyzed()
    if plan.nodeName() == "LogicalRelation" and _row_indexes(df):
        meta, path = df.metadataColumn("_metadata"), fresh(df, "file_path")
        names = sorted(r[0] for r in df.select(meta.getField("file_path").alias(path)).distinct().collect())
        files = df.sparkSession.createDataFrame(list(zip(names, range(len(names)), strict=True)), "__path string, __file bigint")
        rows = df.withColumns({path: meta.getField("file_path"), rid: meta.getField("row_index")})
        rows = rows.join(F.broadcast(files) if len(names) <= BROADCAST_ROWS else files, F.col(path) == F.col("__path"))
        return rows.select(*df.columns, F.shiftleft("__file", 40).bitwiseOR(F.col(rid)).alias(rid)), rid
    return settle(df.withColumn(rid, F.monotonically_increasing_id()), "numbered"), rid


def _row_indexes(df: DataFrame) -> bool:
    """Can the files of this scan tell the place of a row?"""
    try:
        return "row_index" in df.select(df.metadataColumn("_metadata").alias("m")).schema["m"].dataType.names
    except AnalysisException:
        return False


def row_number(row_id: str | None) -> "F.Column":
    """The column ``row_id`` of a numbered table, or new numbers where there is none."""
    return F.col(row_id) if row_id else F.monotonically_increasing_id()


def words_column(text) -> "F.Column":
    """Array of the words of a text column; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{BLANKS}]+"))


def word_count(text) -> "F.Column":
    """Number of words of a text column (null: 0), without building them when blanks are simple."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
