"""Global shuffle into shards by a two-pass external shuffle (operator 6, native).

Pass one scatters rows into buckets that fit in memory, by a seeded hash; pass two shuffles each bucket
by Fisher-Yates. Every order of all rows is then as likely as any other, up to the hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbel.llm.store import is_small, keyed_lookup, numbered, repeat_numbers, settle
from umbel.operators import prefix

SEED = 20240229
#: A bucket holds about so many bytes of the carried columns; each row counts ROW_BYTES more for what holds it in memory.
BUCKET_BYTES = 64 << 20
ROW_BYTES = 128
#: There are as many buckets at least, while each gets BUCKET_ROWS rows, so that tables of few bytes use all cores.
LEAST_BUCKETS = 256
BUCKET_ROWS = 8192


def text_bytes(text) -> "F.Column":
    """UTF-8 bytes of a text plus 1; null: 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def text_crc(text) -> "F.Column":
    """Unsigned CRC-32 of a text's UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def _row_bytes(docs: DataFrame, columns: list[str]) -> "F.Column":
    """About the bytes of the columns of a row."""
    size = F.lit(ROW_BYTES)
    for c in columns:
        kind = docs.schema[c].dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind in ("array", "struct", "variant"):
            size = size + F.coalesce(F.octet_length(F.to_json(c)), F.lit(0))
        else:
            size = size + 16
    return size.cast("bigint")


def shuffled(
    docs: DataFrame,
    shards: int = 8,
    columns: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
    bucket_rows: int = BUCKET_ROWS,
    bucket_bytes: int = BUCKET_BYTES,
    row_id: str | None = None,
) -> DataFrame:
    """``columns`` (default: all) of the rows of ``docs`` in a seeded random order, cut into shards: adds shard int and slot bigint.

    Law ``rows``: shard sizes are at most one apart; a shard holds a run of the global order, and slot
    counts within it from 0 without gaps. Rows are scattered by a hash of seed, id and text, and rows that
    repeat both by their number among these, so a source, a group of equal texts or a repeated row with a
    large share of the rows is spread evenly over buckets and shards. Null ids and texts hash like values;
    repeated rows get places of their own; an empty table gives no rows. Added columns that clash with one
    of ``columns`` replace it. The order depends on rows and seed alone, not on how the table is stored
    (but for rows of equal id and text that differ otherwise, whose order among themselves follows it). Columns have to be orderable (no maps); ids may have any type that can be hashed.
    """
    columns = [c for c in columns or docs.columns if c.lower() not in ("shard", "slot") and c != row_id]
    names = [f"c{i}" for i in range(len(columns))]
    docs, rid = (docs, row_id) if row_id else numbered(docs)
    carried = F.struct(*[F.col(c).alias(a) for a, c in zip(names, columns, strict=True)])
    tagged = docs.select(F.col(rid).alias("row_id"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"), _row_bytes(docs, columns).alias("size"), carried.alias("x"))
    if text_col in columns:  # keep the texts out of what is counted
        hashed = settle(tagged.drop("x"), "hashed")
    else:  # narrow rows: read the texts once
        tagged = hashed = settle(tagged, "tagged")
    rows, size = hashed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    rows = max(rows, 1)
    buckets = max(-(-size // bucket_bytes), min(-(-rows // bucket_rows), LEAST_BUCKETS), 1)
    bucket = F.pmod("h", F.lit(buckets)).cast("int").alias("bucket")
    numbers = repeat_numbers(hashed)
    again = F.xxhash64("h", "number")
    if numbers is not None:
        numbers = F.broadcast(numbers) if is_small(numbers) else numbers.hint("merge")
        spread = lambda d: d.join(numbers, "row_id", "left").withColumn("h", F.when(F.col("number") > 0, again).otherwise(F.col("h")))
        hashed, tagged = spread(hashed), spread(tagged)
    # first places: one row a bucket
    sizes = settle(hashed.groupBy(bucket).agg(F.count("*").alias("n")), "bucket-sizes")
    firsts = settle(prefix.running(sizes, "bucket", {"end": "n"}).select("bucket", (F.col("end") - F.col("n")).alias("first")), "bucket-firsts")
    # pass one: partition number = bucket number
    scattered = tagged.select(bucket, F.struct("h", "x").alias("r")).repartitionById(buckets, F.col("bucket"))
    # pass two: a fixed order, then Fisher-Yates; its generator starts from seed + partition number, so each bucket has its own
    listed = scattered.groupBy("bucket").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    drawn = listed.select("bucket", F.posexplode(F.shuffle("rs", F.lit(seed))).alias("place", "r"))
    placed = keyed_lookup(drawn, firsts, ["bucket"], "place").withColumn("at", F.col("first") + F.col("place"))
    # shard s begins at place ceil(s * rows / shards)
    placed = placed.withColumn("shard", F.expr(f"CAST((at * {shards}L) DIV {rows}L AS INT)"))
    slot = F.col("at") - F.expr(f"(CAST(shard AS BIGINT) * {rows}L + {shards - 1}L) DIV {shards}L")
    return placed.select(*[F.col(f"r.x.{a}").alias(c) for a, c in zip(names, columns, strict=True)], "shard", slot.alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, **options) -> None:
    """Write the shuffled rows below ``path``, one folder a shard, rows in slot order within each file."""
    out = shuffled(docs, shards, **options)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
