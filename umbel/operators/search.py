"""Exact nearest neighbours, and random-projection hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbel.operators.frames import tasks_for

#: Queries of a block, and index rows of a part; each block meets each part in a task.
QUERY_BLOCK = 65_536
PART_ROWS = 65_536
#: Index rows from which it is worth another task, and numbers of a matrix product at once.
LEAST_ROWS = 512
_PRODUCT = 1 << 21
_ROWS = 4096
#: Bits of a hash table whose buckets are probed in order of distance.
PROBED_BITS = 12
#: Queries and index rows of a product of which few pairs are kept, pairs whose differences are taken at once, and pairs that wait for it.
_ASKED, _TILE = 512, 2048
_PAIRS, _WAITING = 1 << 12, 1 << 18
#: Rows that are no further than this beyond a neighbour are as near as it.
_AS_NEAR = 1e-9


def matrix(column: pa.Array) -> np.ndarray:
    """A list array as a matrix of double; every list has the length of the first."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _best(q: np.ndarray, x: np.ndarray, k: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) that hold each query's k nearest rows (of those ``among``) with all their ties.

    The product form picks what may be among the k nearest; distances are then taken from differences,
    so that equal vectors have equal distances.
    """
    rough = (q * q).sum(1)[:, None] - 2 * q @ x.T + (x * x).sum(1)[None]
    if among is not None:
        rough[~among] = np.inf
    if len(x) > k:
        edge = np.partition(rough, k - 1, axis=1)[:, k - 1]
        slack = 1e-9 * (1 + np.abs(edge) + (q * q).sum(1))
        a, b = np.nonzero(rough <= (edge + slack)[:, None])
    else:
        a, b = np.nonzero(np.ones(rough.shape, bool))
    if among is not None:
        a, b = a[among[a, b]], b[among[a, b]]
    return a, b, np.sqrt(((q[a] - x[b]) ** 2).sum(axis=1))


def in_cells(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[list[pa.RecordBatch], pa.RecordBatch]]:
    """(index rows of a cell, a slice of its queries), slice by slice, from rows sorted by ``n`` key columns and a side: index rows (0) before
    queries (1). The list of a cell is the same object for all its slices; cells without index rows give nothing."""
    cell, held = None, []
    for b in batches:
        at = np.column_stack([b.column(i).to_numpy() for i in range(n + 1)])
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if start == end:
                continue
            if (here := tuple(at[start][:n])) != cell:
                cell, held = here, []
            if at[start][n] == 0:
                held.append(b.slice(start, end - start))
            elif held:
                yield held, b.slice(start, end - start)


def places(ids: pa.Array) -> np.ndarray:
    """The place of every id in their order, nulls first."""
    order, out = pc.sort_indices(ids, null_placement="at_start").to_numpy(), np.empty(len(ids), np.int64)
    out[order] = np.arange(len(ids))
    return out


def first_of_each(a: np.ndarray, k: int) -> np.ndarray:
    """Of sorted numbers, the places of the first ``k`` of each."""
    return np.flatnonzero(np.arange(len(a)) - np.searchsorted(a, a) < k)


def _cells(index: DataFrame, queries: DataFrame, keys: list[str], k: int, with_self: bool, tasks: int | None = None) -> DataFrame:
    """(query, neighbour, distance, compared) of the rows of both sides (id, v, keys) with equal keys, ``k`` for each query and cell.

    The rows of a cell meet in one task: its index rows first, as a matrix, then its queries in batches, so a task holds the
    index rows of one cell. ``compared``: index rows of the cell, on the first row of a query's.
    """
    kind = dict(index.dtypes)["id"]
    columns = [*keys, "side", "id", "v"]
    both = index.withColumn("side", F.lit(0)).select(columns).unionByName(queries.withColumn("side", F.lit(1)).select(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cell, held, names, x = len(keys), None, [], [], None
        for b in batches:
            at = np.column_stack([b.column(i).to_numpy() for i in range(n + 1)])
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start == end:
                    continue
                part = b.slice(start, end - start)
                if (here := tuple(at[start][:n])) != cell:
                    cell, held, x = here, [], None
                if at[start][n] == 0:
                    held.append(part)
                    continue
                if x is None and held:
                    names, x, held = [i for h in held for i in h.column(n + 1).to_pylist()], np.concatenate([matrix(h.column(n + 2)) for h in held]), []
                if x is None:
                    continue
                step = max(1, _PRODUCT // len(x))
                for s in range(0, part.num_rows, step):
                    asked = part.slice(s, step)
                    own, best = asked.column(n + 1).to_pylist(), [[] for _ in range(asked.num_rows)]
                    for q, r, d in zip(*(y.tolist() for y in _best(matrix(asked.column(n + 2)), x, k + (not with_self))), strict=True):
                        if with_self or names[r] != own[q]:
                            best[q].append((d, names[r]))
                    rows = [(own[q], i, d, len(x) if not j else 0) for q, found in enumerate(best) for j, (d, i) in enumerate(sorted(found)[:k])]
                    if rows:
                        types = (kind_of, kind_of, pa.float64(), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["query", "neighbour", "distance", "compared"])

    kind_of = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    dealt = both.repartition(*keys) if tasks is None else both.repartition(tasks, *keys)
    return dealt.sortWithinPartitions(*keys, "side").mapInArrow(run, f"query {kind}, neighbour {kind}, distance double, compared bigint")


def _probed(index: DataFrame, queries: DataFrame, k: int, tasks: int) -> DataFrame:
    """(query, neighbour, distance, compared) of the rows of both sides (id, v, table, part, block, buckets) that have the three keys and a bucket in common, ``k`` for each query and part."""
    kind, keys = (dict(queries.dtypes)["id"], dict(index.dtypes)["id"]), ["table", "part", "block"]
    columns = [*keys, "side", "id", "v", "buckets"]
    both = index.withColumn("side", F.lit(0)).select(columns).unionByName(queries.withColumn("side", F.lit(1)).select(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = None
        for held, part in in_cells(batches, len(keys)):
            if held is not of:
                of, ids = held, pa.concat_arrays([h.column("id") for h in held])
                bucket = np.concatenate([h.column("buckets").flatten().to_numpy() for h in held])
                order = np.argsort(bucket, kind="stable")
                ids, x = ids.take(pa.array(order)), np.concatenate([matrix(h.column("v")) for h in held])[order]
                known, first, counts = np.unique(bucket[order], return_index=True, return_counts=True)
                place = places(ids)
            probes = part.column("buckets").flatten().to_numpy().reshape(part.num_rows, -1)
            at = np.minimum(np.searchsorted(known, probes), len(known) - 1)
            meets = np.zeros((part.num_rows, len(known)), bool)
            i, j = np.nonzero(known[at] == probes)
            meets[i, at[i, j]] = True
            compared = meets @ counts
            # a query that meets much of the part is compared with all of it at once, others bucket by bucket
            whole = compared.mean() > len(x) / 4
            step = max(1, _PRODUCT // (len(x) if whole else int(counts.max())))
            for s in range(0, part.num_rows, step):
                q, m = matrix(part.column("v").slice(s, step)), meets[s : s + step]
                if whole:
                    a, b, d = _best(q, x, k, np.repeat(m, counts, axis=1))
                else:
                    found = [(np.flatnonzero(m[:, u]), first[u], _best(q[m[:, u]], x[first[u] : first[u] + counts[u]], k)) for u in np.flatnonzero(m.any(axis=0))]
                    a, b, d = (np.concatenate(y) for y in zip(*[(own[y[0]], y[1] + start, y[2]) for own, start, y in found], strict=True)) if found else (np.zeros(0, int),) * 3
                order = np.lexsort((place[b], d, a))
                order = order[first_of_each(a[order], k)]
                a, b, d = a[order], b[order], d[order]
                seen = np.where(np.diff(a, prepend=-1) != 0, compared[s + a], 0)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(s + a)), ids.take(pa.array(b)), pa.array(d, pa.float64()), pa.array(seen, pa.int64())], ["query", "neighbour", "distance", "compared"])

    return both.repartition(tasks, *keys).sortWithinPartitions(*keys, "side").mapInArrow(run, f"query {kind[0]}, neighbour {kind[1]}, distance double, compared bigint")


def knn(queries: DataFrame, index: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector", with_self: bool = True, block: int = QUERY_BLOCK) -> DataFrame:
    """(query, neighbour, distance, pos): the ``k`` nearest index rows of every query, ties by id, pos from 1.

    Queries without neighbours give one row of nulls. Vectors are arrays of one length, ids bigint, int or
    string. The index is dealt into parts of PART_ROWS, the queries into blocks of ``block``; every block meets
    every part in a task, which compares them by matrix products and keeps k rows a query. Nothing passes through the driver.
    """
    index = index.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    q = queries.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows, asked = index.count(), q.count()
    # small tables in as many parts as there are cores, as long as a part is worth a task
    parts = max(-(-rows // PART_ROWS), min(index.sparkSession.sparkContext.defaultParallelism, -(-rows // LEAST_ROWS)), 1)
    blocks = max(1, -(-asked // block))
    of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    met = _cells(
        index.withColumn("part", of(parts)).withColumn("block", every(blocks)), q.where("v IS NOT NULL").withColumn("block", of(blocks)).withColumn("part", every(parts)),
        ["part", "block"], k, with_self, parts * blocks,
    )
    order = Window.partitionBy("query").orderBy("distance", "neighbour")
    # by the number of rows that the parts give, as many partitions of both sides: a task's share doesn't grow with the table
    n = tasks_for(q.sparkSession, asked * min(k * parts, rows))
    best = met.drop("compared").repartition(n, "query").withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)
    return q.select(F.col("id").alias("query")).repartition(n, "query").join(best, "query", "left")


def projections(dimension: int, bits: int, seed: int = 0) -> np.ndarray:
    """``bits`` random directions."""
    return np.random.default_rng(seed).normal(size=(bits, dimension))


def _bits(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return ((x @ directions.T > 0).astype(np.int64) << np.arange(len(directions), dtype=np.int64)).sum(axis=1)


def _nearest_buckets(x: np.ndarray, directions: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the ``n`` buckets that lie nearest to each row, its own first."""
    masks = np.arange(1 << len(directions), dtype=np.int64)
    flips = (masks[:, None] >> np.arange(len(directions)) & 1).astype(float)
    far = np.abs(x @ directions.T) @ flips.T
    return _bits(x, directions)[:, None] ^ np.argsort(far, axis=1, kind="stable")[:, :n]


def sign_buckets(df: DataFrame, tables: list[np.ndarray], vector_col: str = "vector", center: np.ndarray | None = None, probes: int = 1) -> DataFrame:
    """Adds buckets array<bigint>, ``probes`` numbers per table, table by table: bit i is set if the vector lies on the positive side of
    direction i (63 bits at most), seen from ``center``. Further probes are the buckets that lie nearest: those whose differing bits
    have the least sum of distances to their planes."""
    if any(len(d) > 63 for d in tables):
        raise ValueError("63 bits at most")
    if probes > 1 and any(len(d) > PROBED_BITS or probes > 1 << len(d) for d in tables):
        raise ValueError(f"probing takes tables of {PROBED_BITS} bits at most, and as many probes as they have buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS if probes == 1 else 256):
                b = whole.slice(start, _ROWS if probes == 1 else 256)
                x = matrix(b.column(b.num_columns - 1))
                x = x if center is None else x - center
                found = []
                for d in tables:
                    found.append(_nearest_buckets(x, d, probes) if probes > 1 else _bits(x, d)[:, None])
                each = np.concatenate(found, axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, each.size + 1, each.shape[1]), pa.int32()), pa.array(each.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], [f.name for f in out])

    body = df.where(F.col(vector_col).isNotNull())
    out = body.withColumn("buckets", F.array().cast("array<bigint>")).schema
    return body.withColumn("__v", F.col(vector_col).cast("array<double>")).mapInArrow(run, out)


def sign_bits(df: DataFrame, directions: np.ndarray, vector_col: str = "vector") -> DataFrame:
    """Adds bucket bigint, the number of a row in one table of directions."""
    return sign_buckets(df, [directions], vector_col).withColumn("bucket", F.get("buckets", 0)).drop("buckets")


def mean_vector(df: DataFrame, dimension: int, vector_col: str = "vector") -> np.ndarray:
    """The mean of all vectors, one row of sums."""
    v = F.col(vector_col)
    row = df.agg(*[F.avg(F.get(v, i).cast("double")).alias(str(i)) for i in range(dimension)]).first()
    return np.array([x or 0.0 for x in row])


def lsh_search(
    queries: DataFrame, index: DataFrame, k: int, tables: int = 1, bits: int = 8, dimension: int = 64, seed: int = 0, id_col: str = "id", vector_col: str = "vector", probes: int = 64
) -> DataFrame:
    """(query, neighbour, distance, pos, compared): nearest index rows among those in the ``probes`` nearest buckets of each of ``tables``.

    Planes go through the mean of the index, so buckets are about equally full. An index row stands once a
    table, queries once a table and part of PART_ROWS index rows, with the list of their probes. The rows of a part and a block of
    queries meet in a task, which compares each query with the rows of its buckets by matrix products and keeps k rows a query.
    ``compared`` is the number of rows that a query met, over all tables. Queries without a candidate give one row of
    nulls. Recall depends on the data: choose ``probes`` by measuring against ``knn``.
    """
    directions = [projections(dimension, bits, seed + t) for t in range(tables)]
    center = mean_vector(index, dimension, vector_col)

    def hashed(df: DataFrame, n: int) -> DataFrame:
        d = sign_buckets(df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")), directions, "v", center, n)
        each = F.array(*[F.struct(F.lit(t).alias("table"), F.slice("buckets", t * n + 1, n).cast("array<bigint>" if bits > 31 else "array<int>").alias("buckets")) for t in range(tables)])
        return d.select("id", "v", F.explode(each).alias("x")).select("id", "v", "x.table", "x.buckets")

    rows, asked, cores = index.count(), queries.count(), index.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-rows // PART_ROWS), min(cores, -(-rows // LEAST_ROWS)), 1)
    blocks = max(1, -(-asked // QUERY_BLOCK))
    of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = hashed(index, 1).withColumn("part", of(parts)).withColumn("block", every(blocks))
    met = _probed(x, hashed(queries, probes).withColumn("block", of(blocks)).withColumn("part", every(parts)), k, max(cores, 2 * parts * blocks * tables))
    near = met.groupBy("query", "neighbour").agg(F.min("distance").alias("distance"), F.sum("compared").alias("compared"))
    order = Window.partitionBy("query").orderBy("distance", "neighbour")
    best = near.withColumn("pos", F.row_number().over(order)).withColumn("compared", F.sum("compared").over(Window.partitionBy("query"))).where(F.col("pos") <= k)
    return queries.select(F.col(id_col).alias("query")).join(best, "query", "left")


def _few_of_each(x: np.ndarray, n: int) -> np.ndarray:
    """The places of ``n`` at most of the rows that are equal, in order."""
    _, of = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)
    order = np.argsort(of, kind="stable")
    return np.sort(order[first_of_each(of[order], n)])


def _nearest_by_level(q: np.ndarray, own: pa.Array, level: list[np.ndarray], x: np.ndarray, ids: pa.Array, buckets: list[np.ndarray], k: int, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, distance, level), by query and distance, of the rows as near as each query's ``k``-th of another id, ``k`` of a level at most.

    ``level`` has a query's level for each bucket, table by table, ``buckets`` those of the rows; a row's is its least. ``x`` has the square of
    the length as its last column. Tile by tile products pick the rows below the distance that ``k`` of those seen so far have;
    distances are then taken from differences, as ``_best`` does.
    """
    asked, square = np.column_stack([-2 * q, np.ones(len(q))]), (q * q).sum(axis=1)
    bound, settled = np.full(len(q), np.inf), 0
    held: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    space, picked = np.empty(len(q) * _TILE), np.empty(len(q) * _TILE, bool)
    for start in range(0, len(x), _TILE):
        tile = x[start : start + _TILE]
        shape, size = (len(q), len(tile)), len(q) * len(tile)
        rough = np.matmul(asked, tile.T, out=space[:size].reshape(shape))
        if not start and rough.shape[1] > k:
            bound = square + np.partition(rough, k, axis=1)[:, k]
            bound[np.isnan(bound)] = np.inf
        np.less_equal(rough, (bound - square + 2 * _AS_NEAR * (1 + np.abs(bound) + square))[:, None], out=picked[:size].reshape(shape))
        a, b = np.divmod(np.flatnonzero(picked[:size]), len(tile))
        waiting.append((a, b + start))
        seen = min(start + _TILE, len(x))
        if seen < len(x) and seen < 2 * settled and sum(len(w[0]) for w in waiting) < _WAITING:
            continue
        settled = seen
        a, b = (np.concatenate(w) for w in zip(*waiting, strict=True))
        waiting = []
        other = pc.fill_null(pc.not_equal(own.take(pa.array(a)), ids.take(pa.array(b))), True).to_numpy(zero_copy_only=False)
        a, b = a[other], b[other]
        d = np.concatenate([np.zeros(0), *[np.sqrt(((q[a[s : s + _PAIRS]] - x[b[s : s + _PAIRS], :-1]) ** 2).sum(axis=1)) for s in range(0, len(a), _PAIRS)]])
        c = np.min([f[a, u[b]] for f, u in zip(level, buckets, strict=True)], axis=0)
        a, d, c = (np.concatenate(y) for y in zip(held, (a, d, c), strict=True))
        order = np.lexsort((d, a))
        a, d, c = a[order], d[order], c[order]
        first, kth = np.searchsorted(a, np.arange(len(q) + 1)), np.full(len(q), np.inf)
        full = np.diff(first) >= k
        kth[full] = d[first[:-1][full] + k - 1]
        near = np.flatnonzero(d <= kth[a] + _AS_NEAR)
        group = a[near] * (levels + 1) + c[near]
        order = np.argsort(group, kind="stable")
        near = near[np.sort(order[first_of_each(group[order], k)])]
        held, bound = (a[near], d[near], c[near]), np.minimum(bound, kth**2)
    return held


def probe_hits(
    queries: DataFrame, index: DataFrame, k: int, probes: tuple[int, ...], tables: int = 1, bits: int = 8, dimension: int = 64, seed: int = 0, id_col: str = "id", vector_col: str = "vector"
) -> DataFrame:
    """(query, hits array<int>, first array<boolean>, compared array<bigint>): what ``lsh_search`` finds of every query's ``k`` nearest rows of
    other ids, for each number of ``probes``, in ascending order.

    A search finds a row if its bucket is among those that are probed, so one exact search, in which the rows' buckets are told, answers for
    all numbers of probes. ``hits``: rows found that are as near as the k-th (copies are as near as each other), k at most. ``first``: is one as
    near as the first among them? ``compared``: rows in the probed buckets. Ids are unique; queries that meet no row give nulls.
    The index is dealt into parts, as for ``knn``, the queries into blocks, each pair of both to a task of its own, which gives one row a query.
    """
    if list(probes) != sorted(set(probes)) or bits > PROBED_BITS or not 1 <= probes[0] <= probes[-1] <= 1 << bits:
        raise ValueError(f"ascending numbers of probes, of tables of {PROBED_BITS} bits at most, none larger than the number of buckets")
    directions = [projections(dimension, bits, seed + t) for t in range(tables)]
    center, spark = mean_vector(index, dimension, vector_col), index.sparkSession
    index = index.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    q = queries.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows, asked, kind = index.count(), q.count(), dict(q.dtypes)["id"]
    parts = max(-(-rows // PART_ROWS), min(spark.sparkContext.defaultParallelism, -(-rows // LEAST_ROWS)), 1)
    blocks = max(1, -(-asked // QUERY_BLOCK))
    of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["part", "block", "side", "id", "v"]
    both = index.withColumns({"part": of(parts), "side": F.lit(0)}).withColumn("block", every(blocks)).select(columns)
    both = both.unionByName(q.where("v IS NOT NULL").withColumns({"block": of(blocks), "side": F.lit(1)}).withColumn("part", every(parts)).select(columns))
    level_of_place = np.searchsorted(probes, np.arange(1 << bits), side="right")  # beyond all probes: the last level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = None
        for held, part in in_cells(batches, 2):
            if held is not met:
                met, x = held, np.concatenate([matrix(h.column("v")) for h in held])
                own = [np.concatenate([_bits(x[s : s + _ROWS] - center, d) for s in range(0, len(x), _ROWS)]) for d in directions]
                counts = [np.bincount(b, minlength=1 << bits) for b in own]
                few = _few_of_each(x, k + 1)  # of equal rows no query needs more
                ids, own, x = pa.concat_arrays([h.column("id") for h in held]).take(pa.array(few)), [b[few] for b in own], x[few]
                x = np.column_stack([x, (x * x).sum(axis=1)])
            for s in range(0, part.num_rows, _ASKED):
                b = part.slice(s, _ASKED)
                v = matrix(b.column("v"))
                level = [np.empty((len(v), 1 << bits), np.int64) for _ in directions]
                for f, d in zip(level, directions, strict=True):
                    np.put_along_axis(f, _nearest_buckets(v - center, d, 1 << bits), np.broadcast_to(level_of_place, f.shape), axis=1)
                a, d, c = _nearest_by_level(v, b.column("id"), level, x, ids, own, k, len(probes))
                near = pa.StructArray.from_arrays([pa.array(d, pa.float64()), pa.array(c, pa.int32())], ["distance", "level"])
                seen = np.column_stack([sum((f <= i) @ n for f, n in zip(level, counts, strict=True)) for i in range(len(probes))])
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), y) for at, y in ((np.searchsorted(a, np.arange(len(v) + 1)), near), (np.arange(0, seen.size + 1, len(probes)), pa.array(seen.ravel(), pa.int64())))]
                yield pa.RecordBatch.from_arrays([b.column("id"), *lists], ["query", "near", "seen"])

    # one pair of a part and a block a task: by a hash of their numbers some tasks would get several, others none
    dealt = both.repartitionById(parts * blocks, F.col("part") * blocks + F.col("block")).sortWithinPartitions("part", "block", "side")
    met = dealt.mapInArrow(run, f"query {kind}, near array<struct<distance:double,level:int>>, seen array<bigint>")
    n = tasks_for(spark, asked * min(k * parts, rows))
    each = met.repartition(n, "query").groupBy("query").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"), *[F.sum(F.get("seen", i)).alias(f"seen{i}") for i in range(len(probes))])
    at = lambda i: F.get("near", i)["distance"] + _AS_NEAR
    each = each.withColumns({"d1": at(F.lit(0)), "dk": at(F.least(F.size("near"), F.lit(k)) - 1)})
    up_to = lambda i, d: F.filter("near", lambda y: (y["level"] <= i) & (y["distance"] <= F.col(d)))
    each = each.select(
        "query", F.array(*[F.least(F.size(up_to(i, "dk")), F.lit(k)) for i in range(len(probes))]).alias("hits"), F.array(*[F.size(up_to(i, "d1")) > 0 for i in range(len(probes))]).alias("first"),
        F.array(*[f"seen{i}" for i in range(len(probes))]).alias("compared"),
    )
    return q.select(F.col("id").alias("query")).repartition(n, "query").join(each, "query", "left")


def projection_tree(df: DataFrame, directions: np.ndarray, minimum: int, vector_col: str = "vector") -> DataFrame:
    """Adds node string: the shortest prefix of a row's sign bits whose bucket is the last with at least ``minimum`` rows.

    A bucket is split while both it and the child that a row falls in have ``minimum`` rows, down to the
    number of directions; the root takes what no bucket holds.
    """
    hashed = sign_bits(df, directions, vector_col)
    depth = len(directions)
    for i in range(depth):
        hashed = hashed.withColumn(f"__{i + 1}", F.col("bucket").bitwiseAND(F.lit((1 << (i + 1)) - 1)))
    levels = F.array(*[F.struct(F.lit(i + 1).alias("level"), F.col(f"__{i + 1}").alias("code")) for i in range(depth)])
    sizes = hashed.select(F.explode(levels).alias("x")).groupBy("x.level", "x.code").agg(F.count("*").alias("n")).where(F.col("n") >= minimum)
    # fewer than rows / minimum buckets a level are large enough; each level is joined by its code
    node = F.lit("")
    for i in range(depth):
        level = sizes.where(F.col("level") == i + 1).select(F.col("code").alias(f"__{i + 1}"), F.lit(True).alias(f"__ok{i + 1}"))
        hashed = hashed.join(level, f"__{i + 1}", "left")
    alive = F.lit(True)
    for i in range(depth):
        alive = alive & F.coalesce(F.col(f"__ok{i + 1}"), F.lit(False))
        bit = F.when(F.col("bucket").bitwiseAND(F.lit(1 << i)) != 0, "1").otherwise("0")
        node = F.when(alive, F.concat(node, bit)).otherwise(node)
    return hashed.withColumn("node", node).select(*df.columns, "node")
