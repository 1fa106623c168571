"""Image catalogues: which files there are, what their names say, and what belongs to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from umbel.functions import keys
from umbel.operators.frames import catalogue_filter, catalogue_order, group_members, head_fraction, shuffle_order
from umbel.sources.tables import literal_catalogue

DEBUG_FILES = ("PFP_Ph1_P0608_D01_S001_C2_az180_side1",)


def scan(spark: SparkSession, folder: str, pattern: str = "*.png", recursive: bool = False) -> DataFrame:
    """(path) of the folder's files; contents are never read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder).select("path")


def table_names(spark: SparkSession, folder: str) -> DataFrame:
    """(name) of the folder's Parquet tables, each a file or a folder of part files, partitioned or not; contents are never read."""
    table = F.regexp_extract("path", r"([^/]+)\.parquet(?:/[^/]+=[^/]*)*(?:/[^/]+)?$", 1)
    return scan(spark, folder, "*.parquet", True).select(table.alias("name")).distinct()


def folder_classes(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """(path, label): the class of a file is the name of its folder."""
    return scan(spark, folder, pattern, True).withColumn("label", F.element_at(F.split("path", "/"), -2))


def decode(spark: SparkSession, folder: str) -> DataFrame:
    """(path, height, width, channels, data) of the folder's images, pixels as BGR bytes; what can't be decoded is left out."""
    img = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")
    return img.select(F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("channels"), "data")


def parse(files: DataFrame, database: str = "enrollment") -> DataFrame:
    """Adds filename and the attributes of its kind of name."""
    named = files.withColumn("filename", keys.stem(F.col("path")))
    return named.withColumns(keys.attributes(F.col("filename"), database))


def load(
    spark: SparkSession, folder: str, database: str = "enrollment", filter_by: dict | None = None, filter_mode: str = "inclusive", fraction: float = 1.0,
    sort_by: list[str] | None = None, shuffle: bool = False, seed: int = 666, debug: bool = False,
) -> DataFrame:
    """The catalogue to process. ``debug`` takes the built-in list instead of the folder.

    Sorting goes by each key in turn, so the last one is primary. Shuffling replaces sorting, and only
    where sort keys are given. The fraction is taken in order of names.
    """
    if debug:
        return parse(literal_catalogue(spark, list(DEBUG_FILES)), database)
    files = parse(scan(spark, folder), database)
    if filter_by:
        files = catalogue_filter(files, filter_by, filter_mode)
    if fraction < 1:
        files = head_fraction(files, fraction, "filename")
    if sort_by and shuffle:
        return files.orderBy(shuffle_order(F.col("filename"), seed))
    return files.orderBy(*catalogue_order(sort_by, [F.col("filename")])) if sort_by else files


def groups(files: DataFrame, group_by: list[str]) -> DataFrame:
    """Members of each group of a catalogue."""
    return group_members(files, group_by, "filename")


def first_match(files: DataFrame, other: DataFrame, keys_: list[str], name: str) -> DataFrame:
    """Left join of ``files`` to the first (by name) of ``other`` with the same attributes."""
    first = other.groupBy(*keys_).agg(F.min(name).alias(name))
    return files.join(first, keys_, "left")


def result_sets(files: DataFrame, algorithms: list[str]) -> DataFrame:
    """(id, reference, algorithm, mask): stored results by id; the reference is the file with REF in its name."""
    alg = F.lit(None).cast("string")
    for a in sorted(algorithms, key=len):
        alg = F.when(F.contains("filename", F.lit(a)), F.lit(a)).otherwise(alg)
    named = files.withColumn("algorithm", alg)
    ref = named.where(F.contains("filename", F.lit("REF"))).groupBy("id").agg(F.min("path").alias("reference"))
    masks = named.where(~F.contains("filename", F.lit("REF")) & F.col("algorithm").isNotNull())
    first = masks.withColumn("r", F.row_number().over(Window.partitionBy("id", "algorithm").orderBy("path"))).where("r = 1")
    return first.join(ref, "id", "left").select("id", "reference", "algorithm", F.col("path").alias("mask"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(filename, width, height, depth, objects) of annotation XML, one document or a list in one root a file; boxes of unknown types are left out."""
    box = "struct<xmin:int,ymin:int,xmax:int,ymax:int>"
    turned = "struct<cx:double,cy:double,w:double,h:double,angle:double>"
    schema = f"filename string, size struct<width:int,height:int,depth:int>, object array<struct<name:string,type:string,bndbox:{box},robndbox:{turned}>>"
    raw = spark.read.schema(schema).option("rowTag", "annotation").option("recursiveFileLookup", True).xml(path)
    known = F.filter("object", lambda o: o["type"].isin("bndbox", "robndbox"))
    return raw.select("filename", "size.width", "size.height", "size.depth", F.coalesce(known, F.array()).alias("objects"))
