"""Micro-batch forms of the batch stages: file catalogues, session sinks, index inserts, first-write-wins stores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from umbel.lopq.model import LOPQModel
from umbel.lopq.search import write_index
from umbel.operators.frames import first_write_wins, flatten

CHUNK_FILES = 5000


def image_stream(spark: SparkSession, folder: str, pattern: str = "*.png", chunk: int = CHUNK_FILES) -> DataFrame:
    """(path) of a folder's files, ``chunk`` of them a batch; contents are not carried on."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", chunk).load(folder).select("path")


def table_stream(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """Rows of the Parquet files that arrive in a folder, ``files`` of them a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every batch of what is there to ``each``, and end. A batch that was committed is not seen again."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def append_results(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends flattened results, one folder a batch: a batch that runs again replaces its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        flatten(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return each


def insert_vectors(model: LOPQModel, path: str, id_col: str = "id", vector_col: str = "vector") -> Callable[[DataFrame, int], None]:
    """A sink that encodes a batch and adds it to an index, one folder a batch below it."""

    def each(batch: DataFrame, number: int) -> None:
        write_index(model.encode(batch, id_col, vector_col), f"{path}/batch={number}", "overwrite")

    return each


def insert_once(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink in which a key's first row stays: a batch adds the keys that earlier batches lack."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number:
            stored = spark.read.parquet(path).where(F.col("batch") < number).select(*batch.columns)
        else:
            stored = batch.where("false")
        first_write_wins(stored, batch, keys, [F.col(c) for c in order]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return each


def distinct_keys(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key, kept in state instead of a store."""
    return stream.dropDuplicates(keys)


def progress(query: StreamingQuery) -> list[dict]:
    """Batch number and rows of every batch so far."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"]} for p in query.recentProgress]
