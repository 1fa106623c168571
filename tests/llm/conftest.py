import random

import pytest

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names the operators use inside.
CLASHES = ["row_id", "size", "h", "x", "bucket", "fp", "kept", "part", "copies", "label", "node", "pattern", "bytes", "g0", "k0", "c0", "__w", "shard", "slot", "Row_Id_2"]


def prose(rng, n):
    syllables = ["an", "er", "th", "on", "re", "ti", "es", "or", "in", "ed", "nd", "ha"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, a very long text, ties, wholly repeated rows."""
    rng = random.Random(5)
    plain = prose(rng, 120)
    rows = [
        (1, plain, "en", "a", 10), (2, plain, "en", "a", 10), (2, plain, "en", "a", 10), (3, plain + " more", None, "b", None), (4, "", "de", None, 0),
        (5, None, None, None, None), (None, "no id here at all", "en", "b", 3), (None, None, None, None, None), (6, " \t\n ", "en", "a", 4),
        (7, prose(rng, 60_000), "en", "hot", 1), (8, "1234 5678 !!! ###", "en", "hot", 1), (9, "é" * 3000 + " \U0001f600", "fr", "", 1),
        (10, "x" * 400_000, "en", "hot", 2), (11, "a\nb\na\n\nb\na", "en", "hot", 2), (12, "   \x1c\x85word", "en", "hot", 2),
    ]
    rows += [(100 + i, prose(rng, rng.randint(50, 200)), rng.choice(["en", "de"]), rng.choice(["a", "b", "hot"]), i) for i in range(60)]
    rows += [(200 + i, "the same text for all of these rows " * 9, "en", "hot", 1) for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows, tmp_path_factory):
    """The odd rows as a table on disk, with columns whose names clash with inner ones."""
    from pyspark.sql import functions as F

    path = str(tmp_path_factory.mktemp("odd") / "t")
    spark.createDataFrame(odd_rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "t")
    odd.where("false").write.parquet(path)
    return spark.read.schema(odd.schema).parquet(path)


@pytest.fixture(scope="session")
def real(spark):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
