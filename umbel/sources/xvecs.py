"""Vector files: each vector as its dimension (32-bit, little-endian) and that many floats, integers or bytes."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"f": "<f4", "i": "<u4", "b": "u1"}


def decode(data: bytes, kind: str = "f") -> np.ndarray:
    """The vectors of one file, n x dimension, in double; a broken file raises ValueError."""
    if not data:
        return np.zeros((0, 0))
    item = np.dtype(KINDS[kind])
    d = int(np.frombuffer(data, "<u4", 1)[0])
    row = 4 + d * item.itemsize
    if len(data) % row:
        raise ValueError(f"{len(data)} bytes are no whole number of vectors of dimension {d}")
    body = np.frombuffer(data, np.uint8).reshape(-1, row)
    if (body[:, :4].copy().view("<u4") != d).any():
        raise ValueError("vectors of several dimensions")
    return body[:, 4:].copy().view(item).astype(np.float64)


def encode(x: np.ndarray, kind: str = "f") -> bytes:
    """The inverse of ``decode``."""
    body = np.ascontiguousarray(x, KINDS[kind])
    head = np.full((len(body), 1), body.shape[1], "<u4").view(np.uint8)
    return np.concatenate([head, body.view(np.uint8).reshape(len(body), -1)], axis=1).tobytes()


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path that all machines reach, and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    return (pyarrow.fs.LocalFileSystem(), path) if path.startswith("/") else pyarrow.fs.FileSystem.from_uri(path)


def read(spark: SparkSession, path: str, kind: str = "f", whole_bytes: int = 256 << 20) -> DataFrame:
    """(path, n, vector array<double>): all vectors of all files, n from 0 within a file.

    A file of up to ``whole_bytes`` bytes is read by one task; a larger one by runs of vectors of about
    that size, each in a task of its own.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, data in zip(f["path"], f["content"], strict=True):
                yield from _frames(p, decode(bytes(data), kind), 0)

    def _frames(p: str, x: np.ndarray, first: int) -> Iterator[pd.DataFrame]:
        for i in range(0, len(x), 4096):
            part = x[i : i + 4096]
            yield pd.DataFrame({"path": p, "n": np.arange(first + i, first + i + len(part)), "vector": list(part)})

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, length in zip(f["path"], f["length"], strict=True):
                fs, at = _store(p)
                with fs.open_input_file(at) as file:
                    row = 4 + int(np.frombuffer(file.read(4), "<u4")[0]) * np.dtype(KINDS[kind]).itemsize
                step = max(1, whole_bytes // row)
                starts = np.arange(0, -(-length // row), step)
                yield pd.DataFrame({"path": p, "first": starts, "row": row, "bytes": np.minimum(length - starts * row, step * row)})

    def ranged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, first, row, n in f.itertuples(index=False):
                fs, at = _store(p)
                with fs.open_input_file(at) as file:
                    file.seek(first * row)
                    yield from _frames(p, decode(file.read(n), kind), first)

    schema = "path string, n bigint, vector array<double>"
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= whole_bytes).select("path", "content").mapInPandas(run, schema)
    large = files.where(F.col("length") > whole_bytes).select("path", "length")
    if not large.limit(1).count():
        return small
    parts = large.mapInPandas(runs, "path string, first bigint, row bigint, bytes bigint")
    return small.union(parts.repartition("path", "first").mapInPandas(ranged, schema))


def write(df: DataFrame, folder: str, order: str, vector_col: str = "vector", kind: str = "f") -> None:
    """One file per partition, part-00000 and on, in the order of a column; partitions are ranges of it.

    Every task writes its own file in ``folder``, which all machines reach: first under a name of its own
    attempt, then renamed, so a task that runs again replaces its file by an equal one.
    """
    from pyspark import TaskContext

    fs, root = _store(folder)
    fs.create_dir(root)
    ranged = df.select(F.col(order).alias("o"), F.col(vector_col).cast("array<double>").alias("v")).repartitionByRange("o").sortWithinPartitions("o")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _store(folder)
        out, rows = None, 0
        name = f"{root}/part-{TaskContext.get().partitionId():05d}.{kind}vecs"
        attempt = f"{root}/.{uuid.uuid4().hex}"
        for f in frames:
            if len(f):
                out = out or fs.open_output_stream(attempt)
                out.write(encode(np.array(f["v"].tolist()), kind))
                rows += len(f)
        if out:
            out.close()
            fs.move(attempt, name)
        yield pd.DataFrame({"rows": [rows]})

    ranged.mapInPandas(run, "rows bigint").agg(F.sum("rows")).collect()
