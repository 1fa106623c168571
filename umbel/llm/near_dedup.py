"""The pipeline's near-dedup: SimHash classes joined with all pairs of texts of Jaccard 0.8 or more.

Candidates are texts that share a band of MinHash values and whose sketches, a bit of each of SKETCH values,
allow the similarity; each is then checked by its whole sets of shingles. A pair of similarity 0.8 shares no
band with probability 6e-5 and differs in more than FAR sketch bits with 4e-6. What large buckets leave apart is
joined by exact prefix filtering.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbel.llm import simhash
from umbel.llm.graph import components
from umbel.llm.store import by_group, drop_ids, numbered, settle

BANDS, BAND_ROWS = 32, 6
#: Bits of a sketch, and by how many two sketches of similar sets may differ (0.1 of them at similarity 0.8, with a deviation of 3.4).
SKETCH, FAR = 128, 28
SEED = 42
#: A bucket of more texts than this is first linked by rounds in which every member meets one other; only members that these leave
#: apart are compared by pairs.
PAIR_ROWS = 32
ROUNDS = 2
#: Numbers in the table of counts that tells rare shingles from common ones (1 MB as it is sent to tasks).
COUNTS = 1 << 18
_COUNT_SLICE = 512
#: Bits of a parity map, in which two sets differ in no more places than they differ in shingles.
PARITY = 256
_SLICE_ROWS = 128
_draw = np.random.default_rng(SEED)
_FACTORS = _draw.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64) | np.uint64(1)
_SHIFTS = _draw.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted different hashes of the shingles of one text."""
    return np.unique(np.array(simhash.shingle_hashes(text, width), "<u8"))


def band_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each non-empty set a row of BANDS keys (uint64), each of which holds its band's number, and its sketch (SKETCH / 64 x uint64)."""
    h = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out, bits = np.empty((len(sets), BANDS), np.uint64), np.zeros((len(sets), SKETCH), np.uint8)
    for band in range(BANDS):
        key = np.full(len(sets), band, np.uint64)
        for i in range(band * BAND_ROWS, (band + 1) * BAND_ROWS):
            least = np.minimum.reduceat(h * _FACTORS[i] + _SHIFTS[i], starts)
            if i < SKETCH:  # a mixed bit, as minima are small
                bits[:, i] = (least * _MIX) >> np.uint64(63)
            key = (key ^ least) * _MIX
            key ^= key >> np.uint64(29)
        out[:, band] = key
    return out, np.packbits(bits, axis=1).view("<u8")


def parity_map(shingles: np.ndarray) -> np.ndarray:
    """PARITY / 64 numbers (int64): a bit is set if an odd number of the set's shingles falls on it."""
    odd = np.bincount((shingles >> 40) & (PARITY - 1), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def signatures(docs: DataFrame, row_id: str, width: int, text_col: str) -> DataFrame:
    """(row_id, set_key, size, s1, s2, keys) of the rows whose text has a word; equal sets have equal set_key."""
    schema = "row_id bigint, set_key string, size int, s1 bigint, s2 bigint, keys array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, _SLICE_ROWS):
                part = b.slice(s, _SLICE_ROWS)
                found = [(i, x) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if len(x := shingle_set(t, width))]
                if found:
                    sets = [x for _, x in found]
                    bands, sketch = band_keys(sets)
                    keys, sketch = pa.array(bands.view("<i8").ravel(), pa.int64()), sketch.view("<i8")
                    columns = [
                        pa.array([i for i, _ in found], pa.int64()), pa.array([xxhash.xxh3_128_hexdigest(x.tobytes()) for x in sets]),
                        pa.array([len(x) for x in sets], pa.int32()), pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS), pa.int32()), keys),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["row_id", "set_key", "size", "s1", "s2", "keys"])

    return docs.select(F.col(row_id).alias("row_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, _SLICE_ROWS):
                part = b.slice(s, _SLICE_ROWS)
                sets = [pa.array(shingle_set(t, width).view("<i8"), pa.int64()) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.mapInArrow(run, "node bigint, shingles array<bigint>")


def _similar(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets have a Jaccard similarity of ``similarity`` or more."""
    pairs = settle(pairs.distinct(), "candidates")
    ends = pairs.select("a").distinct().union(pairs.select("b").distinct())
    ids = settle(ends.toDF("node").distinct(), "candidate-rows")
    sets = settle(_sets(texts.join(ids, "node").select("node", "text"), width), "candidate-sets")
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    near = common / (F.size("sa") + F.size("sb") - common) >= similarity
    return settle(both.where(near).select("a", "b"), "similar")


def links(docs: DataFrame, row_id: str, similarity: float = 0.8, width: int = 5, text_col: str = "text") -> DataFrame:
    """Links (a, b) between row ids that connect what pairs of ``similarity`` or more connect.

    ``docs``: settled, with its row ids. Rows of equal sets are linked to the smallest of them, and only
    that one is searched. Small buckets are compared by pairs. In large ones every text meets one text of
    its buckets a round, the first of a seeded order, if links don't connect the two yet; so a large group
    of copies is linked by some pairs a member. Then the members of buckets that are still apart are joined by
    prefixes of their sets, so no pair is left out and the work grows with the texts, not with their pairs.
    """
    sigs = settle(signatures(docs, row_id, width, text_col), "signatures")
    nodes = settle(sigs.groupBy("set_key").agg(F.min("row_id").alias("node"), F.count("*").alias("n")), "sets")
    equal = by_group(sigs.select("set_key", F.col("row_id").alias("b")), nodes.where("n > 1"), "set_key", "n", sigs.count())
    equal = settle(equal.where("b <> node").select(F.col("node").alias("a"), "b"), "equal-sets")
    facts = ["node", "size", "s1", "s2"]
    entries = sigs.join(nodes.select(F.col("node").alias("row_id")), "row_id").select(F.col("row_id").alias("node"), "size", "s1", "s2", F.explode("keys").alias("key"))
    sizes = settle(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    total = BANDS * nodes.count()
    members = settle(by_group(entries, sizes, "key", "n", total), "buckets")
    texts = docs.select(F.col(row_id).alias("node"), F.col(text_col).alias("text"))
    other = lambda df, *more: df.select("key", *more, *[F.col(c).alias(f"{c}2") for c in facts])
    # sizes of sets bound their similarity, and sketches tell it roughly
    fits = F.least("size", "size2") / F.greatest("size", "size2") >= similarity
    near = F.bit_count(F.col("s1").bitwiseXOR(F.col("s12"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("s22"))) <= FAR
    pair = [F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")]
    small, large = members.where(F.col("n") <= PAIR_ROWS), members.where(F.col("n") > PAIR_ROWS)
    pairs = small.join(other(small), "key").where((F.col("node") < F.col("node2")) & fits & near).select(pair)
    found = _similar(pairs, texts, width, similarity).union(equal)
    if not large.limit(1).count():
        return found
    for turn in range(ROUNDS):
        labelled = _labelled(large, found)
        if not labelled.limit(1).count():
            return found
        order = F.xxhash64(F.lit(turn), "node")
        first = labelled.groupBy("key").agg(F.min(F.struct(order.alias("o"), "node", "size", "s1", "s2", "label")).alias("m"), F.count("*").alias("n"))
        first = settle(first.select("key", "n", *[F.col(f"m.{c}").alias(f"{c}2") for c in (*facts, "label")]), "first-of-buckets")
        met = by_group(labelled.drop("n"), first, "key", "n", total).where((F.col("label") != F.col("label2")) & fits & near)
        one = met.groupBy("node").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "node2").alias("o"), "node2")).alias("m")).select("node", F.col("m.node2").alias("node2"))
        found = found.union(_similar(one.select(pair), texts, width, similarity))
    apart = _labelled(large, found).select("node", "label").distinct()
    return found.union(_similar(_prefix_pairs(apart, texts, width, similarity), texts, width, similarity))


def _prefix_pairs(nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, label) with different labels, among them all of ``similarity`` or more.

    With shingles in order of rarity, two similar sets share one among the first 0.11 n of the smaller and the first
    0.2 n of the larger (for 0.8). What is common to a group of texts comes last in this order, so texts that share
    much, but not enough, don't meet. Any order does that is the same for all; rarity is told by a table of counts
    of fixed size. Of those who meet at a shingle, the label that most of them have is not compared with itself.
    Parity maps then tell most of those apart who share common shingles, and only those who can't be similar: each place in
    which two maps differ takes another shingle that one set has alone.
    """
    spark = nodes.sparkSession
    sets = settle(_sets(texts.join(settle(nodes, "apart"), "node").select("node", "text"), width).join(nodes, "node"), "apart-sets")
    counts = spark.sparkContext.broadcast(_counts(sets))
    maps = [f"p{i}" for i in range(PARITY // 64)]
    schema = "node bigint, label bigint, size int, token bigint, place int, " + ", ".join(f"{c} bigint" for c in maps)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, label, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                x = x.values.to_numpy()
                n = len(x) - math.ceil(similarity * len(x) - 1e-9) + 1
                first = x[np.lexsort((x, counts.value[x & (len(counts.value) - 1)]))[:n]]
                same = [pa.array(np.full(len(first), v, t)) for v, t in ((node, np.int64), (label, np.int64), (len(x), np.int32))]
                parity = [pa.array(np.full(len(first), v, np.int64)) for v in parity_map(x)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(first), pa.array(np.arange(len(first), dtype=np.int32)), *parity], ["node", "label", "size", "token", "place", *maps])

    entries = settle(sets.select("node", "label", "shingles").mapInArrow(prefixes, schema), "prefixes")
    at_least = lambda x: F.ceil(x - 1e-9)
    labels = entries.groupBy("token", "label").agg(F.count("*").alias("m")).groupBy("token").agg(F.max(F.struct("m", "label")).alias("most"), F.count("*").alias("labels"))
    placed = entries.join(labels.where("labels > 1").select("token", F.col("most.label").alias("main")), "token")
    placed = settle(placed, "open-prefixes")
    other = placed.select("token", *[F.col(c).alias(f"{c}2") for c in ("node", "label", "size", "place", *maps)])
    x, y = F.struct("size", "node"), F.struct("size2", "node2")
    index = lambda size: size - at_least(2 * similarity / (1 + similarity) * size)
    rest = F.least(F.col("size") - F.col("place"), F.col("size2") - F.col("place2"))
    enough = rest >= at_least(similarity / (1 + similarity) * (F.col("size") + F.col("size2")))
    sizes = F.least("size", "size2") >= similarity * F.greatest("size", "size2") - 1e-9
    first = F.when(x < y, F.col("place") <= index(F.col("size"))).otherwise(F.col("place2") <= index(F.col("size2")))
    differ = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}2"))) for c in maps)
    alike = differ <= (1 - similarity) / (1 + similarity) * (F.col("size") + F.col("size2")) + 1e-9
    # a pair of two of the others is met from both sides
    met = placed.where("label <> main").join(other, "token").where((F.col("label") != F.col("label2")) & sizes & enough & first & alike)
    return met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))


def _counts(sets: DataFrame) -> np.ndarray:
    """How often shingles with the same last bits occur in ``sets``: a table of COUNTS numbers, summed by slices over tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTS, np.int64)
        for b in batches:
            n += np.bincount(b.column(0).flatten().to_numpy() & (COUNTS - 1), minlength=COUNTS)
        yield pa.RecordBatch.from_arrays([pa.array(range(COUNTS // _COUNT_SLICE)), pa.array([x.tobytes() for x in n.reshape(-1, _COUNT_SLICE)])], ["slice", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(x, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()])], ["slice", "n"])

    parts = sets.select("shingles").mapInArrow(count, "slice bigint, n binary").repartition("slice").mapInArrow(add, "slice bigint, n binary")
    out = np.zeros((COUNTS // _COUNT_SLICE, _COUNT_SLICE), np.int64)
    for r in parts.collect():
        out[r["slice"]] = np.frombuffer(r["n"], np.int64)
    return np.minimum(out.ravel(), np.iinfo(np.int32).max).astype(np.int32)


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets that links don't connect as a whole yet, each with the label of what it is linked to."""
    labelled = members.join(components(found), "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = settle(labelled, "large-buckets")
    open_ = labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("key")
    return settle(labelled.join(settle(open_, "open-buckets"), "key", "left_semi"), "open-members")


def keep_one(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, the one with the smallest id (null ids last), with all columns of ``docs``.

    Classes are connected by fingerprints within two bits (as in operator 9) and by sets of ``width``-word
    shingles, A-Z lower-cased, whose Jaccard similarity is ``similarity`` or more.
    """
    docs, rid = numbered(docs)
    found = settle(simhash.classes(docs, id_col=id_col, text_col=text_col, row_id=rid).select("doc_id", "row_id", "class_row"), "classes")
    # pairs of rows as pairs of fingerprint classes
    at = found.select("row_id", "class_row")
    pairs = links(docs, rid, similarity, width, text_col).join(at.toDF("a", "ca"), "a").join(at.toDF("b", "cb"), "b")
    pairs = settle(pairs.where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "class-links")
    labels = components(pairs).select(F.col("node").alias("class_row"), "label")
    first = (
        found.groupBy("class_row").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_id")).alias("m"))
        .join(labels, "class_row", "left").groupBy(F.coalesce("label", "class_row").alias("label")).agg(F.min("m").alias("m"))
    )
    gone = found.select("row_id").join(first.select(F.col("m.row_id").alias("row_id")).hint("merge"), "row_id", "left_anti")
    return drop_ids(docs, gone.withColumnRenamed("row_id", rid), rid).drop(rid)
