"""Approximate nearest neighbours by a forest of hash prefixes (operator 12).

Every tree gives a vector a string of letters: the first tells which of the signed axes of a random rotation of
up to 64 directions is nearest, each further one does the same in 4 fresh directions. A tree is the sorted array
of its strings. A query descends every tree to its longest matching prefix and then ascends in all trees at
once, one letter a step, until the entries below the common prefix length are enough; whole prefixes are taken,
never a part of one. Their vectors are scored in the arrays, the best are scored again in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbel.llm.store import is_small, keyed_lookup, settle

TREES = 48
#: Entries (rows of all trees, repeats included) at which a query stops ascending.
CANDIDATES = 16384
#: Up to so many different vectors every query meets all of them: it ascends to the root of one tree.
EXACT_ROWS = 4096
SEED = 42
#: Directions of the first letter and of each further one.
FIRST, NEXT = 64, 4
#: Rows of an array that one task holds at once, and queries that one task takes to it.
PART_ROWS = 65_536
QUERY_ROWS = 65_536
#: Neighbours beyond the asked ones that are scored again, so that single-precision scores decide nothing.
SLACK = 8
_SLICE = 4096


class Letters:
    """The hash functions of all trees for vectors of ``dim`` components, with strings of ``length`` letters."""

    def __init__(self, dim: int, length: int, trees: int = TREES, seed: int = SEED):
        self.dim, self.trees = dim, trees
        self.first = min(FIRST, dim + 1)
        self.bits = [math.ceil(math.log2(2 * self.first)), *[math.ceil(math.log2(2 * min(NEXT, dim + 1)))] * (length - 1)]
        self.seed, self.length = seed, length

    def shift(self, level: int) -> int:
        """By how many bits a code is shifted to leave its first ``level`` letters."""
        return sum(self.bits[level:])

    @cached_property
    def turns(self) -> list[list[np.ndarray]]:
        """By tree and letter: the orthonormal directions; drawn where they are used, as tasks get only the seed."""
        out = []
        for t in range(self.trees):
            draw = np.random.default_rng((self.seed, t))
            sizes = [self.first, *[min(NEXT, self.dim + 1)] * (self.length - 1)]
            out.append([np.linalg.qr(draw.normal(size=(self.dim + 1, n)))[0].astype(np.float32) for n in sizes])
        return out

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Codes (rows x trees, int64) of rows of dim + 1 components."""
        out = np.zeros((len(x), self.trees), np.int64)
        for t, turns in enumerate(self.turns):
            for turn, bits in zip(turns, self.bits, strict=True):
                p = x @ turn
                at = np.abs(p).argmax(axis=1)
                letter = 2 * at + (p[np.arange(len(p)), at] > 0)
                out[:, t] = (out[:, t] << bits) | letter
        return out


def sound(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id bigint, v array<double>), one row an id: rows with an id and a finite vector that is not zero.

    Of rows that share an id the one with the least vector stays. Only vectors of the most frequent length
    (of equally frequent ones the greatest) take part.
    """
    v = F.col("v")
    fine = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists(v, lambda x: x != 0)
    narrow = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    one = settle(narrow.where(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False))).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    length = one.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return one.where(F.size("v") == length[0]["d"]) if length else one


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _strings(rows: DataFrame, letters: Letters, scale: float | None) -> DataFrame:
    """(id, vec, codes) of (id, v): vec is what is scored (float32), divided by ``scale`` or, for queries, by its own length.

    Indexed vectors get one more component that brings all to the same length, so that the largest inner product
    is the smallest angle; a query's is zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, _SLICE):
                part = b.slice(s, _SLICE)
                x = _matrix(part.column(1))
                if scale is None:
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    last = np.zeros(len(x))
                else:
                    x = x / scale
                    last = np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1)))
                vec = np.ascontiguousarray(x, "<f4")
                codes = letters.codes(np.column_stack([vec, last.astype(np.float32)]))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, letters.trees), pa.int32()), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in vec], pa.binary()), lists], ["id", "vec", "codes"])

    return rows.select("id", "v").mapInArrow(run, "id bigint, vec binary, codes array<bigint>")


_CELL = ["tree", "prefix", "part", "qpart"]


def _dealt(rows: DataFrame, groups: DataFrame, own: str, other: str) -> DataFrame:
    """``rows`` with the part of their group that each belongs to, once for each part of the other side."""
    wide = groups.where((F.col("parts") > 1) | (F.col("qparts") > 1))
    if is_small(wide, 0):
        return rows.withColumns({"part": F.lit(0), "qpart": F.lit(0)})
    size = {"part": F.coalesce("parts", F.lit(1)), "qpart": F.coalesce("qparts", F.lit(1))}
    found = keyed_lookup(rows, wide, ["tree", "prefix"], "id")
    found = found.withColumn(own, F.pmod(F.xxhash64("id"), size[own]).cast("int"))
    return found.withColumn(other, F.explode(F.sequence(F.lit(0), (size[other] - 1).cast("int")))).drop("parts", "qparts")


def _meet(index: DataFrame, queries: DataFrame, base: int, letters: Letters, visit: Callable, schema: str) -> DataFrame:
    """What ``visit(codes, ids, vectors, batch of queries)`` yields where queries meet the sorted arrays of their prefixes of ``base`` letters.

    index, queries: (tree, code, id, level, vec). An array of more than PART_ROWS rows, or one asked by more
    than QUERY_ROWS queries, is met in a grid of parts of both, so no task holds a hot prefix.
    """
    shift = letters.shift(base) if base else 63
    index, queries = (x.withColumn("prefix", F.shiftright("code", shift)) for x in (index, queries))
    rows = index.groupBy("tree", "prefix").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    asked = queries.groupBy("tree", "prefix").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("qparts"))
    groups = settle(rows.join(asked, ["tree", "prefix"]), "prefixes")
    columns = [*_CELL, "kind", "code", "id", "level", "vec"]
    both = _dealt(index.withColumn("kind", F.lit(0)), groups, "part", "qpart").select(columns).unionByName(_dealt(queries.withColumn("kind", F.lit(1)), groups, "qpart", "part").select(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, array = None, [], None
        for b in batches:
            keys = np.column_stack([b.column(i).to_numpy() for i in range(5)])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                here, part = tuple(keys[s][:4]), b.slice(s, e - s)
                if here != cell:
                    cell, held, array = here, [], None
                if keys[s][4] == 0:
                    held.append(part)
                elif held or array is not None:
                    if array is None:
                        array, held = _array(held), []
                    for i in range(0, part.num_rows, _SLICE):
                        yield from visit(*array, part.slice(i, _SLICE))

    return both.repartition(*_CELL).sortWithinPartitions(*_CELL, "kind", "code", "id").mapInArrow(run, schema)


def _array(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Codes, ids and vectors of a sorted array."""
    codes, ids = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (5, 6))
    vec = [x for b in held for x in b.column(8).to_pylist()]
    return codes, ids, None if vec[0] is None else np.frombuffer(b"".join(vec), "<f4").reshape(len(vec), -1)


def _range(codes: np.ndarray, code: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the entries that share the letters left by ``shift`` with each code begin and end."""
    low = (code >> shift) << shift
    return np.searchsorted(codes, low), np.searchsorted(codes, low + ((1 << shift) - 1), "right")


def _counts(index: DataFrame, queries: DataFrame, base: int, letters: Letters) -> DataFrame:
    """(id, n): for each query the entries of all trees that share 0, 1, ... letters with it or more (none are counted above ``base``)."""

    def visit(codes, ids, vec, asked):
        code = asked.column(5).to_numpy()
        n = np.zeros((len(code), letters.length + 1), np.int64)
        for level in range(base, letters.length + 1):
            a, b = _range(codes, code, letters.shift(level)) if level else (0, len(codes))
            n[:, level] = b - a
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n.size + 1, n.shape[1]), pa.int32()), pa.array(n.ravel()))
        yield pa.RecordBatch.from_arrays([asked.column(6), lists], ["id", "n"])

    none = F.lit(None).cast("binary").alias("vec")
    found = _meet(index.withColumn("vec", none), queries.withColumn("vec", none), base, letters, visit, "id bigint, n array<bigint>")
    return found.groupBy("id").agg(F.array(*[F.sum(F.get("n", F.lit(i))) for i in range(letters.length + 1)]).alias("n"))


def _scored(index: DataFrame, queries: DataFrame, base: int, letters: Letters, keep: int) -> DataFrame:
    """(query, id, score): of each array the ``keep`` best rows that share ``level`` letters with the query."""

    def visit(codes, ids, vec, asked):
        code, level = asked.column(5).to_numpy(), asked.column(7).to_numpy()
        q = np.frombuffer(b"".join(asked.column(8).to_pylist()), "<f4").reshape(asked.num_rows, -1)
        a, b = np.zeros(len(code), np.int64), np.full(len(code), len(codes))
        for x in np.unique(level[level > 0]):
            at = level == x
            a[at], b[at] = _range(codes, code[at], letters.shift(int(x)))
        out = []
        for i in np.flatnonzero(b > a):
            s, names = vec[a[i] : b[i]] @ q[i], ids[a[i] : b[i]]
            if len(s) > keep:
                best = np.flatnonzero(s >= np.partition(s, len(s) - keep)[len(s) - keep])
                best = best[np.lexsort((names[best], -s[best]))[:keep]]
                s, names = s[best], names[best]
            out.append((np.full(len(s), asked.column(6)[int(i)].as_py()), names, s))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in range(3)], ["query", "id", "score"])

    return _meet(index, queries, base, letters, visit, "query bigint, id bigint, score float")


def nearest(
    vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, candidates: int = CANDIDATES, seed: int = SEED
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product found for each row for which ``queries`` holds, its own left out.

    ``queries`` is a condition on ``id``. Scores are inner products in double precision of the vectors as they stand,
    ties go to the smaller id, ranks begin at 1. Rows with a null id, and vectors that are null, empty, zero, or hold a
    null, NaN or infinity take no part; nor do vectors of another length than most. A repeated row counts once. Equal
    vectors are one entry of the trees with its k + 1 smallest ids, which is all that can be asked of it. Fewer
    candidates than k give fewer rows; an empty table gives none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = sound(vectors, id_col, vec_col)
    order = Window.partitionBy("v").orderBy("id")
    members = settle(rows.withColumn("copy", F.row_number().over(order)).where(F.col("copy") <= k + 1), "members")
    single = members.where("copy = 1").select("id", "v")
    largest = F.array_max(F.transform("v", F.abs))
    length = largest * F.sqrt(F.aggregate(F.transform("v", lambda x: x / largest), F.lit(0.0), lambda s, x: s + x * x))
    facts = single.agg(F.count("*"), F.max(length), F.max(F.size("v"))).first()
    total, longest, dim = facts
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    letters = Letters(dim, 1 + min(18, math.ceil(math.log(total, 2 * NEXT))), 1 if total <= EXACT_ROWS else trees, seed)
    # arrays of whole trees while they are short, else of as many first letters as leave some PART_ROWS / 2 rows each
    base = max((x for x in range(letters.length) if total >> sum(letters.bits[:x]) >= PART_ROWS // 2), default=0)
    unfold = ["id", "vec", F.posexplode("codes").alias("tree", "code")]
    index = settle(_strings(single, letters, longest), "strings").select(*unfold, F.lit(0).alias("level"))
    asking = settle(rows.where(queries), "queries")
    strings = settle(_strings(asking, letters, None), "query-strings")
    keep = k + 1 + SLACK
    if total <= EXACT_ROWS:
        found = _scored(index, strings.select(*unfold, F.lit(0).alias("level")), 0, letters, keep)
    else:
        floor = max(1, base)
        enough = [F.when(F.get("n", F.lit(x)) >= candidates, x) for x in range(letters.length, floor, -1)]
        # who has next to nothing below the shortest prefix is outside all groups and meets every row
        level = F.coalesce(*enough, F.when(F.get("n", F.lit(floor)) >= min(candidates, EXACT_ROWS) // 8, floor), F.lit(0))
        counted = _counts(index, strings.select(*unfold, F.lit(0).alias("level")), base, letters)
        levels = settle(counted.select("id", level.alias("level")), "levels")
        strings = strings.join(levels, "id", "left").withColumn("level", F.coalesce("level", F.lit(0)))
        queries_at = settle(strings, "placed-queries")
        found = _scored(index, queries_at.where("level > 0").select(*unfold, "level"), base, letters, keep)
        alone = queries_at.where("level = 0")
        if not is_small(alone, 0):
            found = found.unionByName(_scored(index.where("tree = 0"), alone.select(*unfold, "level").where("tree = 0"), 0, letters, keep))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = found.groupBy("query", "id").agg(F.max("score").alias("score")).withColumn("at", F.row_number().over(by_score)).where(F.col("at") <= keep)
    best = settle(best.select("query", "id"), "best")
    exact = F.aggregate(F.zip_with("v", "q", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias("score")
    scored = best.join(single, "id").join(asking.select(F.col("id").alias("query"), F.col("v").alias("q")), "query").select("query", "id", exact)
    copies = members.where("copy > 1")
    if is_small(copies, 0):
        every = scored
    else:
        named = copies.join(single.withColumnRenamed("id", "class"), "v").select("class", "id").unionByName(single.select(F.col("id").alias("class"), "id"))
        every = scored.withColumnRenamed("id", "class").join(named, "class").select("query", "id", "score")
    ranked = every.where("id <> query").withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
