"""Exact dedup with a persistent digest index, bucketed and sorted by hash (operator 3, native)."""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbel.llm.store import by_group, drop_ids, numbered, row_number, scratch_path, settle

BUCKETS = 64
RECORDS = "text_sha256 STRING, keep_id BIGINT, n_rows BIGINT, batch STRING, owner BOOLEAN"


class DigestIndex:
    """A persistent table of RECORDS, bucketed and sorted by ``text_sha256``.

    A batch records each of its digests once, with its number of rows. The batch that brought a digest
    first owns it, and its record has the id that stays; the records of later batches only count. So a
    batch that runs again under its name finds its own records and decides as before.

    The records are an external table below ``path``, in a folder named after its generation and number
    of buckets. Opening the same ``path`` again, in any session, finds the last complete generation, and
    its number of buckets holds. Table names are long digests of the folder; a table of that name that
    stands elsewhere is refused.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self._open(*self._last(buckets))

    def _folder(self, generation: int, buckets: int) -> str:
        return f"{self.path}/generation-{generation}-{buckets}"

    def _hadoop(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _last(self, buckets: int) -> tuple[int, int]:
        """(generation, buckets) of the last generation; those after the first count once they are wholly written."""
        where, fs = self._hadoop(self.path)
        found = [(0, buckets)]
        for status in fs.listStatus(where) if fs.exists(where) else []:
            kind, _, numbers = status.getPath().getName().partition("-")
            if kind == "generation":
                generation, n = map(int, numbers.split("-"))
                if generation == 0:
                    found[0] = (0, n)
                elif fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                    found.append((generation, n))
        return max(found)

    def _open(self, generation: int, buckets: int) -> None:
        self.generation, self.buckets, self.location = generation, buckets, self._folder(generation, buckets)
        self.table = f"umbel_digests_{hashlib.sha256(self.location.encode()).hexdigest()}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({RECORDS}) USING parquet "
            f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{self.location}'"
        )
        facts = {r["col_name"]: r["data_type"] for r in self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.table}").collect()}
        where, fs = self._hadoop(self.location)
        there, _ = self._hadoop(facts["Location"])
        if not fs.makeQualified(where).equals(fs.makeQualified(there)) or int(facts["Num Buckets"]) != buckets:
            raise ValueError(f"{self.table} stands at {facts['Location']} with {facts['Num Buckets']} buckets")

    def records(self) -> DataFrame:
        return self.spark.table(self.table)

    def read(self) -> DataFrame:
        """(text_sha256, keep_id, n_rows): every digest with its id and all rows recorded; buckets hold whole digests, so nothing is shuffled."""
        return self.records().groupBy("text_sha256").agg(F.max(F.when(F.col("owner"), F.col("keep_id"))).alias("keep_id"), F.sum("n_rows").alias("n_rows"))

    def append(self, groups: DataFrame, batch: str, again: bool = True) -> DataFrame:
        """Record the settled ``groups`` (text_sha256, keep_id, n_rows, ...) of ``batch``; returns those that it owns.

        The index side of the anti-joins is read by bucket and sorted within files, so only the groups are
        shuffled. ``again``: may the index hold records of this batch?
        """
        other = F.col("batch") != batch
        owned = self.records().where(F.col("owner") & other).select("text_sha256")
        new = settle(groups.hint("merge").join(owned, "text_sha256", "left_anti"), "new-digests")
        known = groups.hint("merge").join(new.select("text_sha256"), "text_sha256", "left_anti")
        record = lambda x, owner: x.select("text_sha256", "keep_id", "n_rows", F.lit(batch).alias("batch"), F.lit(owner).alias("owner"))
        rows = record(new, True).unionByName(record(known, False))
        if again:
            mine = self.records().where(~other).select("text_sha256")
            rows = settle(rows.hint("merge").join(mine, "text_sha256", "left_anti"), "new-records")
        self._write(rows)
        return new

    def _write(self, rows: DataFrame) -> None:
        # a task for each bucket, by the hash that buckets go by: one sorted file in each
        bucket = F.pmod(F.hash("text_sha256"), F.lit(self.buckets))
        rows.repartitionById(self.buckets, bucket).write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def compact(self, buckets: int | None = None) -> None:
        """Write all records anew, one sorted file a bucket, in ``buckets`` buckets (default: as many as now).

        Every append adds a file to each bucket, which a merge then has to sort; an index that takes many
        batches or outgrows its buckets is compacted now and then. The old generation goes when the new
        one is complete, so a run that dies on the way loses nothing.
        """
        old, rows = (self.location, self.table), self.records()
        where, fs = self._hadoop(self._folder(self.generation + 1, buckets or self.buckets))
        fs.delete(where, True)  # what a run that died has left
        self._open(self.generation + 1, buckets or self.buckets)
        self._write(rows)
        self.spark.sql(f"DROP TABLE {old[1]}")
        where, fs = self._hadoop(old[0])
        fs.delete(where, True)

    def close(self) -> None:
        """Forget the table's name in this session; its files stay where they are."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def digest(text) -> "F.Column":
    """Lowercase hex SHA-256 of a text's UTF-8 bytes; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def decide(
    docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", row_id: str | None = None, batch: str | None = None, parts: int = 1
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, row_id; ``index`` learns the texts.

    Texts are equal when identical. The index decides: a row stays if its digest is one that the index
    lacked and its id is the largest of those that bring it. The rows go through the index in ``parts``
    batches, larger ids first, so the largest id of all stays. keep_id is the id that the index holds,
    group_size the number of rows that it has recorded, those of earlier batches included.

    ``batch`` names the rows: the same rows under the same name are decided as before, whatever a run
    that died has recorded of them; without a name they count as new ones. Null texts count as empty
    ones, null ids rank below all others; of wholly equal rows one stays. Ids are whole numbers. An empty
    table gives no rows. Other columns are ignored. ``docs`` is read once; ``row_id`` names a column of
    numbers to use instead of new ones.
    """
    again, batch = batch is not None, batch or uuid.uuid4().hex
    keyed = settle(
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), digest(F.col(text_col)).alias("text_sha256"), row_number(row_id).alias("row_id")),
        "digests",
    )
    total = keyed.count()
    cuts = keyed.agg(F.percentile_approx("doc_id", [i / parts for i in range(parts - 1, 0, -1)])).first()[0] if parts > 1 else []
    part = reduce(lambda rest, cut: F.when(F.col("doc_id") > cut[1], cut[0]).otherwise(rest), reversed(list(enumerate(cuts or []))), F.lit(len(cuts or [])))
    all_groups, new = [], []
    for i in range(len(cuts or []) + 1):
        groups = settle(
            keyed.where(part == i).groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row_id")).alias("top"), F.count("*").alias("n_rows"))
            .select("text_sha256", F.col("top.doc_id").alias("keep_id"), F.col("top.row_id").alias("keep_row"), "n_rows"),
            "groups",
        )
        all_groups.append(groups.select("text_sha256", F.col("n_rows").alias("rows_here"), F.lit(None).cast("bigint").alias("keep_row")))
        new.append(index.append(groups, f"{batch}/{i}", again).select("text_sha256", F.lit(0).cast("bigint").alias("rows_here"), "keep_row"))
    told = reduce(DataFrame.unionByName, [*all_groups, *new])
    told = told.groupBy("text_sha256").agg(F.sum("rows_here").alias("rows_here"), F.max("keep_row").alias("keep_row"))
    verdicts = settle(told.hint("merge").join(index.read(), "text_sha256"), "verdicts")
    return by_group(keyed, verdicts, "text_sha256", "rows_here", total).select(
        "doc_id", "keep_id", F.col("n_rows").alias("group_size"), F.coalesce(F.col("row_id") == F.col("keep_row"), F.lit(False)).alias("kept"), "text_sha256", "row_id"
    )


def dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None, parts: int = 1) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; ``index`` learns their digests. See ``decide``."""
    docs, rid = numbered(docs)
    gone = decide(docs, index, id_col, text_col, rid, batch, parts).where(~F.col("kept")).select("row_id")
    return drop_ids(docs, gone.withColumnRenamed("row_id", rid), rid).drop(rid)


def new_index(spark: SparkSession, buckets: int = BUCKETS) -> DigestIndex:
    """An empty index in the shared scratch folder, for runs that keep none."""
    return DigestIndex(spark, scratch_path(spark, "index"), buckets)
