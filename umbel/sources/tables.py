"""Result tables with declared schemas (NaN becomes null), and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbel.operators.frames import clean_nans, flatten

#: Schemas of the tables that stages hand to each other.
SCHEMAS = {
    "search": "uuid_actual string, uuid_predicted string, distance double",
    "combined": (
        "distance double, uuid_actual string, uuid_predicted string, sample_actual string, package_actual string, descriptor_actual int, "
        "package_predicted string, algorithm string, match boolean"
    ),
    "candidates": "sample string, package_actual string, algorithm string, pos int, package string, error string",
    "finematching": (
        "sample_actual string, segmentation_algorithm string, package_actual string, phone int, package_candidate string, descriptor string, "
        "kp_amount_actual int, kp_amount_candidate int, matches_amount int, good_matches_amount int, ransac_matches_amount int"
    ),
}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header; columns go by the declared schema, NaN and empty fields are null."""
    return clean_nans(spark.read.schema(schema).option("header", True).option("nanValue", "NaN").option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A CSV table with a header, without an index column."""
    df.write.mode(mode).option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def write_entity(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write by the extension of ``path``: csv, json or parquet. Images have no writer."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        write_csv(df, path, mode)
    elif kind in ("json", "parquet"):
        df.write.mode(mode).format(kind).save(path)
    else:
        raise ValueError(f"no writer for .{kind}")


def literal_catalogue(spark: SparkSession, names: list[str]) -> DataFrame:
    """A catalogue of given file names instead of a scan."""
    return spark.createDataFrame([(f"{n}.png",) for n in names], "path string")


def prepare_output(spark: SparkSession, path: str, clear: bool = False) -> None:
    """Make the folder; ``clear`` empties it first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if clear:
        fs.delete(p, True)
    fs.mkdirs(p)


class Session:
    """An accumulating table of per-item results: nested records are flattened to section_key and appended as files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, results: DataFrame) -> None:
        """Append; nothing that is stored is read or rewritten."""
        flatten(results).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        """All results; columns that only some appends had are null elsewhere."""
        return self.spark.read.option("mergeSchema", True).parquet(self.path)

    def failed(self, path_column: str) -> DataFrame:
        """Paths of the items that did not succeed."""
        return self.read().where(F.col("session_status") == "fail").select(path_column)
