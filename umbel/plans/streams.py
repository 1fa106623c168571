"""Incremental forms: each gives what the batch form gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbel.lopq import LOPQModel
from umbel.plans.registry import Tables, query
from umbel.streaming import ingest


def _folder(t: Tables, df: DataFrame, label: str, files: int) -> str:
    path = t.scratch(label)
    df.repartition(files).write.parquet(path)
    return path


@query("t1_t2_chunked_session", "SELECT event_type AS session_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def t2(t: Tables) -> DataFrame:
    """Events in files, a few a batch, flattened and appended."""
    src = _folder(t, t.events.select(F.struct(F.col("event_type").alias("type")).alias("session"), "value"), "in", 4)
    out = t.scratch("out")
    ingest.run(ingest.table_stream(t.spark, src, t.spark.read.parquet(src).schema, 2), ingest.append_results(out), t.scratch("state"))
    return t.spark.read.parquet(out).groupBy("session_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("t3_incremental_index")
def t3(t: Tables) -> DataFrame:
    """Vectors that arrive in files are encoded and added to a stored index."""
    model = LOPQModel(V=4, M=8, S=16).fit(t.embeddings, "embedding", coarse_rounds=3, local_rounds=3)
    src = _folder(t, t.embeddings.select("vec_id", "embedding"), "vectors", 3)
    out = t.scratch("index")
    ingest.run(ingest.table_stream(t.spark, src, t.spark.read.parquet(src).schema), ingest.insert_vectors(model, out, "vec_id", "embedding"), t.scratch("state"))
    return t.spark.read.parquet(out).select("id", F.col("c0").cast("int").alias("c0"), "c1", "fine")


@query("t4_progress", "SELECT count(*) AS rows FROM orders")
def t4(t: Tables) -> DataFrame:
    """Rows that the progress reports of all batches count."""
    src = _folder(t, t.orders.select("o_orderkey"), "orders", 3)
    q = ingest.run(ingest.table_stream(t.spark, src, "o_orderkey bigint"), lambda batch, n: batch.write.mode("overwrite").parquet(t.scratch("sink")), t.scratch("state"))
    return t.spark.createDataFrame([(sum(p["rows"] for p in ingest.progress(q)),)], "rows bigint")


@query("t5_first_write_wins", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def t5(t: Tables) -> DataFrame:
    """Of the rows of a key the first stays, whichever batch brings more; files hold runs of ids."""
    src, out, state = t.scratch("events"), t.scratch("store"), t.scratch("state")
    half = t.events.agg(F.expr("(min(event_id) + max(event_id)) DIV 2")).first()[0]
    rows = t.events.select("user_id", "event_id")
    for side in (F.col("event_id") <= half, F.col("event_id") > half):  # what arrives between two runs is one batch
        rows.where(side).write.mode("append").parquet(src)
        ingest.run(ingest.table_stream(t.spark, src, rows.schema, 1_000_000), ingest.insert_once(out, ["user_id"], ["event_id"]), state)
    return t.spark.read.parquet(out).select("user_id", "event_id")
