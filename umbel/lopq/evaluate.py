"""How well codes and searches keep neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbel.lopq.model import LOPQModel, _summed
from umbel.operators.search import matrix


def shared_codes(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """One row, share: how many (query, neighbour) pairs have both coarse ids in common, by the codes of their ids."""
    c = codes.select("id", "c0", "c1")
    a = c.select(F.col("id").alias("query"), F.col("c0").alias("q0"), F.col("c1").alias("q1"))
    b = c.select(F.col("id").alias("neighbour"), F.col("c0").alias("n0"), F.col("c1").alias("n1"))
    same = (F.col("q0") == F.col("n0")) & (F.col("q1") == F.col("n1"))
    return pairs.join(a, "query").join(b, "neighbour").agg(F.try_divide(F.count_if(same), F.count("*")).alias("share"))


def cell_histogram(codes: DataFrame) -> DataFrame:
    """(c0, c1, n): rows of every occupied cell."""
    return codes.groupBy("c0", "c1").agg(F.count("*").alias("n"))


def code_stability(df: DataFrame, model: LOPQModel, vector_col: str = "vector") -> DataFrame:
    """One row: n, same_coarse, same_fine: rows whose reconstruction has the codes that it was made from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                coarse, fine = model.predict(matrix(b.column(0)))
                again = model.predict(model.reconstruct(coarse, fine))
                yield pa.RecordBatch.from_arrays([pa.array((coarse == again[0]).all(axis=1)), pa.array((fine == again[1]).all(axis=1))], ["coarse", "fine"])

    body = df.where(F.col(vector_col).isNotNull()).select(F.col(vector_col).cast("array<double>").alias("v"))
    same = body.mapInArrow(run, "coarse boolean, fine boolean")
    return same.agg(F.count("*").alias("n"), F.count_if("coarse").alias("same_coarse"), F.count_if("fine").alias("same_fine"))


def distortion(df: DataFrame, model: LOPQModel, vector_col: str = "vector") -> np.ndarray:
    """Mean squared distance of each subvector to its centroid."""
    body = df.where(F.col(vector_col).isNotNull()).select(F.col(vector_col).cast("array<double>").alias("v"))

    def partial(x: np.ndarray) -> dict[str, np.ndarray]:
        coarse, fine = model.predict(x)
        y = model.project(x, coarse)
        each = y.shape[1] // model.M
        d = [((y[:, i * each : (i + 1) * each] - c[fine[:, i]]) ** 2).sum() for i, c in enumerate(model._centroids())]
        return {"d": np.array(d), "n": np.array([float(len(x))])}

    sums = _summed(body, partial)
    return sums["d"] / sums["n"][0] if sums else np.zeros(model.M)
