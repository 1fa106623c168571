"""Descriptor stores: a keyed table with the old key-value semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbel.functions import keys
from umbel.operators.frames import first_write_wins

SCHEMA = "model string, length int, algorithm string, filename string, region int, vector array<float>"
KEY = ["model", "length", "algorithm", "filename", "region"]


class DescriptorStore:
    """Vectors by (model, length, algorithm, filename, region), in one folder per model, length and algorithm."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def insert(self, new: DataFrame) -> None:
        """Append the keys that the store lacks; a key's first vector stays. Empty vectors are left out."""
        rows = new.where(F.size("vector") > 0)
        found = first_write_wins(self.read(), rows, KEY, [F.col("vector")])
        found.select(*[f.split()[0] for f in SCHEMA.split(", ")]).write.mode("append").partitionBy("model", "length", "algorithm").parquet(self.path)

    def flush(self, sure: bool = False) -> None:
        """Delete everything, if ``sure``."""
        if not sure:
            raise ValueError("flush deletes the whole store; pass sure=True")
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def scan(self, model: str, length: int, algorithm: str) -> DataFrame:
        """Rows under one prefix: only that folder is read."""
        return self.read().where((F.col("model") == model) & (F.col("length") == length) & (F.col("algorithm") == algorithm))

    def like(self, pattern: str) -> DataFrame:
        """Rows whose key matches a LIKE pattern; none if nothing does."""
        return self.with_keys(self.read()).where(F.col("key").like(pattern))

    def get(self, filename: str, region: int) -> DataFrame:
        """Rows of one region."""
        return self.read().where((F.col("filename") == filename) & (F.col("region") == region))

    @staticmethod
    def with_keys(df: DataFrame) -> DataFrame:
        """Adds the composed key and whether it belongs to the index."""
        k = keys.key(*[F.col(c) for c in KEY])
        return df.withColumn("key", k).withColumn("is_index", keys.is_index(F.col("key")))
