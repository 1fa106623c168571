"""Documents to packed sequences: quality rules, exact dedup, near-dedup, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbel.llm import exact_dedup, mixing, near_dedup, packing, quality_rules
from umbel.llm.store import free, made, settle
from umbel.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules."""
    ship(spark)
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    ship(spark)
    index = exact_dedup.new_index(spark)
    kept = exact_dedup.dedup(docs, index)
    index.close()  # decisions are settled; this run keeps no index
    return kept


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near copies the document with the smallest id."""
    ship(spark)
    return near_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ship(spark)
    return mixing.take(docs, F.col("source"), mixing.cycling)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences."""
    ship(spark)
    packed = packing.pack_documents(docs)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality rules", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("source mix", mix), ("best-fit packing", pack)]

#: SimHash's XXH64, the seeded selection and the tokenizer can't be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = made(spark)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        free(spark, since)  # what the stage has put aside, and the documents before it
    return STAGES[-1][1](spark, docs, sf_dir)
