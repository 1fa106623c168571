"""File names and descriptor keys: parsing, formatting, patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The pattern of each attribute in an image's file name.
PATTERNS = {
    "packageclass": "P[0-9][0-9][0-9][0-9]",
    "phone": "Ph[1-3]",
    "distinct": "D[0-9][0-9]",
    "sample": "S[0-9][0-9][0-9]",
    "size": "C[0-9]",
    "angle": "az[0-3][0-9]0",
    "side": "side[0-9]",
    "RS": "S[0-9]",
}
COMMON = ("packageclass", "phone", "distinct", "sample", "size")
#: Attributes by kind of image database.
BY_DATABASE = {"enrollment": (*COMMON, "angle", "side"), "recognition": (*COMMON, "RS")}

#: Packages left out of the evaluations.
EXCLUDED_PACKAGES = (
    "0235_D01_S001", "0200_D01_S001", "0049_D01_S001", "0842_D01_S001", "0337_D01_S001", "0263_D01_S001", "0735_D01_S001",
    "0541_D01_S001", "0311_D01_S001",
)


def stem(path: Column) -> Column:
    """File name without folders and without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def attribute(name: Column, key: str) -> Column:
    """The number in the first match of an attribute's pattern; null where there is none."""
    found = F.regexp_extract(name, PATTERNS[key], 0)
    return F.when(found != "", F.regexp_replace(found, "[^0-9]", "").cast("int"))


def attributes(name: Column, database: str = "enrollment") -> dict[str, Column]:
    """All attributes of a kind of file name, by key."""
    return {k: attribute(name, k) for k in BY_DATABASE[database]}


def zfill(n: Column, width: int = 4) -> Column:
    """A number with leading zeros; longer numbers stay whole."""
    s = n.cast("string")
    return F.lpad(s, F.greatest(F.length(s), F.lit(width)), F.lit("0"))


def package_id(packageclass: Column, distinct: Column, sample: Column) -> Column:
    """The id by which packages are compared, as 0003_D01_S001."""
    return F.concat(zfill(packageclass), F.lit("_D"), zfill(distinct, 2), F.lit("_S"), zfill(sample, 3))


def identifier(packageclass: Column, distinct: Column, sample: Column) -> Column:
    """The short unique identifier, as 0003_01_01."""
    return F.concat_ws("_", zfill(packageclass), zfill(distinct, 2), zfill(sample, 2))


def annotation_key(packageclass: Column, distinct: Column) -> Column:
    """What an annotation's file name has in common with its images' names."""
    return F.concat(zfill(packageclass), F.lit("_D"), zfill(distinct, 2))


def key(model: Column, length: Column, algorithm: Column, filename: Column, region: Column) -> Column:
    """Descriptor key model+length+algorithm+filename:region; null if a part is null."""
    return F.concat(model, F.lit("+"), length.cast("string"), F.lit("+"), algorithm, F.lit("+"), filename, F.lit(":"), region.cast("string"))


def key_parts(k: Column) -> dict[str, Column]:
    """model, length, algorithm, filename and region of a descriptor key."""
    head = F.split(k, r"\+", 4)
    tail = F.split(F.get(head, 3), ":", 2)
    return {
        "model": F.get(head, 0), "length": F.get(head, 1).try_cast("int"), "algorithm": F.get(head, 2),
        "filename": F.get(tail, 0), "region": F.get(tail, 1).try_cast("int"),
    }


def is_index(k: Column) -> Column:
    """Keys of views at angle 360 belong to the index, others to the queries."""
    return F.contains(k, F.lit("az360"))


def route(k: Column, packages: list[str]) -> Column:
    """``base`` for the first phone's listed packages at angles from 0, ``query`` at angles from 300, else null."""
    listed = F.lit(False)
    for p in packages:
        listed = listed | k.contains(p)
    return F.when(k.contains("Ph1") & listed, F.when(k.contains("az0"), "base").when(k.contains("az3"), "query"))
