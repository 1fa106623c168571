"""SimHash near-dedup by covering locality-sensitive hashing (operator 9).

For radius r every bit i of a fingerprint gets a non-zero vector m(i) of r+1 bits; table v (one for each
of the 2^(r+1)-1 non-zero v) keeps the bits with odd <m(i), v>. The vectors of r differing bits span at
most r dimensions, so some v is orthogonal to all of them and that table sees equal keys: every pair
within the radius collides in some table, with certainty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbel.llm.graph import components
from umbel.llm.store import by_group, drop_ids, numbered, row_number, settle

BITS = 64
SEED = 42
#: A table's bucket with more distinct fingerprints than this is searched by flipped bits, not by pairs.
PAIR_ROWS = 32
_CHUNK_SHINGLES = 1 << 15
#: Texts of an Arrow batch that are Python objects at once.
_SLICE_ROWS = 128


def masks(radius: int) -> list[int]:
    """The bit masks of the tables, as signed 64-bit integers."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(BITS)]
    out = []
    for v in range(1, 2 ** (radius + 1)):
        mask = sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
        out.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return out


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of the shingles of ``width`` words, repeats included, of one text, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [h(line, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[: len(words) - width]).tolist()]
    return [h(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of ``counts`` hashes (no count is 0): bits set in over half of a run."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def _fingerprint(hashes: list[int]) -> int:
    """Fingerprint of one text of any length, in blocks of bounded size."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _CHUNK_SHINGLES):
        block = np.array(hashes[i : i + _CHUNK_SHINGLES], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def text_fingerprints(texts: list[str | None], width: int) -> np.ndarray:
    """Fingerprints (uint64) of ``texts``; a text without words has fingerprint 0."""
    out = np.zeros(len(texts), "<u8")
    pending: list[int] = []
    rows: list[int] = []
    counts: list[int] = []

    def flush():
        if rows:
            out[rows] = majority(np.array(pending, "<u8"), np.array(counts))
            pending.clear(), rows.clear(), counts.clear()

    for i, text in enumerate(texts):
        hashes = shingle_hashes(text, width)
        if len(hashes) > _CHUNK_SHINGLES:
            out[i] = _fingerprint(hashes)
        elif hashes:
            pending += hashes
            rows.append(i)
            counts.append(len(hashes))
            if len(pending) > _CHUNK_SHINGLES:
                flush()
    flush()
    return out


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", row_id: str | None = None) -> DataFrame:
    """(doc_id bigint, row_id bigint, fp bigint): the signed form of each row's fingerprint; ``row_id`` names a column of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slices = (b.column(2).slice(i, _SLICE_ROWS) for i in range(0, b.num_rows, _SLICE_ROWS))
            fp = np.concatenate([np.zeros(0, "<u8"), *(text_fingerprints(x.to_pylist(), width) for x in slices)]).view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], ["doc_id", "row_id", "fp"])

    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row_number(row_id).alias("row_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, row_id bigint, fp bigint")


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b), a < b, that connect what fingerprints of ``radius`` 1 or 2 or fewer differing bits connect.

    ``nodes``: settled (node, fp) with distinct fp. Within a table's bucket, small ones are compared pair
    by pair. In a larger one all members agree on the mask, so two of them are within 2 bits exactly if
    they meet after flipping none or one of the free bits each; every member is sent to these meeting
    points, and a point links all who meet there to the smallest, as any two of them are within 2 bits
    of each other. So a large group costs a multiple of its size, never its square, and loses no link.
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    tables = masks(radius)
    entries = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(tables)])
    placed = nodes.select("node", "fp", F.explode(entries).alias("e")).select("node", "fp", "e.*")
    # mostly buckets of one: counted with map-side sums, and only the others move on
    sizes = settle(placed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    members = settle(placed.join(sizes, ["t", "key"]), "buckets")
    small = members.where(F.col("n") <= PAIR_ROWS)
    b = small.select("t", "key", F.col("node").alias("node2"), F.col("fp").alias("fp2"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius
    pairs = small.join(b, ["t", "key"]).where((F.col("node") < F.col("node2")) & near).select(F.col("node").alias("a"), F.col("node2").alias("b"))
    flips = F.array(
        *[F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(BITS) if not (m >> i) & 1]) for m in tables]
    )
    # a node in large buckets of several tables goes once to each point, and to BITS + 1 of them at most
    large = members.where(F.col("n") > PAIR_ROWS).groupBy("node").agg(F.first("fp").alias("fp"), F.collect_set("t").alias("ts"))
    free = F.array_distinct(F.flatten(F.transform("ts", lambda t: F.get(flips, t))))
    met = settle(large.select("node", F.explode(free).alias("flip"), "fp").select("node", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), "flip"), "points")
    if radius == 1:  # here a point must be a member itself
        first = met.where("flip = 0").select("point", F.col("node").alias("a"))
    else:
        first = met.groupBy("point").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = met.join(first, "point").where("a <> node").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
    return pairs.unionByName(stars).distinct()


def classes(docs: DataFrame, radius: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text", row_id: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, row_id.

    component_id is the smallest id reachable over fingerprints of ``radius`` or fewer differing bits.
    Null and blank texts have fingerprint zero and are linked like any other. Rows with a null id belong
    to the class that their fingerprint reaches; if no row of a class has an id, component_id is null.
    Repeated rows are equal members. Ids are whole numbers. An empty table gives no rows; other columns
    are ignored.
    """
    fps = settle(fingerprints(docs, width, id_col, text_col, row_id), "fingerprints")
    nodes = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min("row_id").alias("node"), F.count("*").alias("n")), "nodes")
    labels = components(links(nodes, radius))
    found = settle(nodes.join(labels, "node", "left").select("fp", "doc_id", "n", F.coalesce("label", "node").alias("label")), "labelled")
    least = found.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_fp = settle(found.join(least, "label").select("fp", "component_id", "label", "n"), "by-fingerprint")
    # fingerprint zero, or that of a large group of copies, may have a third of all rows
    return by_group(fps, by_fp, "fp", "n", fps.count()).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "row_id", F.col("label").alias("class_row")
    )


def keep_one(docs: DataFrame, radius: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, the one with the smallest id (null ids last), with all columns of ``docs``."""
    docs, rid = numbered(docs)
    found = settle(classes(docs, radius, width, id_col, text_col, rid), "classes")
    # min of a struct combines on the map side, so the size of a class does not matter
    first = found.groupBy("class_row").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_id")).alias("m"))
    stay = first.select(F.col("m.row_id").alias("row_id"))
    gone = found.select("row_id").join(stay.hint("merge"), "row_id", "left_anti")
    return drop_ids(docs, gone.withColumnRenamed("row_id", rid), rid).drop(rid)
