"""Search by the inverted multi-index: cells in order of distance, whole cells up to a quota, distances from codes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from umbel.functions.vectors import literal, slice_of, squared_distance
from umbel.lopq.model import LOPQModel
from umbel.operators.search import first_of_each, in_cells, matrix, places

#: Queries of a block, and most and least index rows of a part of a cell; each block meets each part in a task.
QUERY_BLOCK, PART_ROWS, LEAST_ROWS = 8192, 65_536, 4096
#: Distances at once, rows of a batch, and bits of a double below those that tell its bin.
_PRODUCT, _ROWS, _BITS = 1 << 21, 1 << 17, 44


def build_index(df: DataFrame, model: LOPQModel, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, c0, c1, fine): the index rows of a table."""
    return model.encode(df, id_col, vector_col)


def write_index(codes: DataFrame, path: str, mode: str = "append") -> None:
    """Store index rows in one folder per first coarse id, so that a search reads the cells it needs; ``overwrite`` empties it first."""
    codes.repartition("c0", "c1").sortWithinPartitions("c0", "c1").write.mode(mode).partitionBy("c0").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("c0", F.col("c0").cast("int"))


def cell(index: DataFrame, c0: int, c1: int) -> DataFrame:
    """(id, fine) of one cell; none for an empty one."""
    return index.where((F.col("c0") == c0) & (F.col("c1") == c1)).select("id", "fine")


def cells_in_order(queries: DataFrame, cs: tuple, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query, c0, c1, dist, pos): every cell of the grid for each query, from the nearest, pos from 1.

    A cell's distance is the sum of its halves' squared distances to the query; equally near cells come
    in the order of the halves' places. The grid has V * V cells, a constant, so a query's rows are bounded.
    """
    half = len(cs[0][0])
    q = queries.select(F.col(id_col).alias("query"), F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    sides = []
    for s in (0, 1):
        part = slice_of(F.col("v"), s * half, half)
        far = F.array(*[F.struct(squared_distance(part, literal(c)).alias("d"), F.lit(i).alias("c")) for i, c in enumerate(cs[s])])
        sides.append(F.sort_array(far).alias(f"s{s}"))
    placed = q.select("query", *sides)
    one = placed.select("query", "s1", F.posexplode("s0").alias("p0", "x0"))
    both = one.select("query", "p0", "x0", F.posexplode("s1").alias("p1", "x1"))
    near = both.select("query", F.col("x0.c").alias("c0"), F.col("x1.c").alias("c1"), (F.col("x0.d") + F.col("x1.d")).alias("dist"), "p0", "p1")
    return near.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy("dist", "p0", "p1"))).drop("p0", "p1")


def cells_to_quota(cells: DataFrame, index: DataFrame, quota: int) -> DataFrame:
    """The cells that are visited: whole ones in order until they hold ``quota`` rows; the first one always. Adds count and visited."""
    sizes = index.groupBy("c0", "c1").agg(F.count("*").alias("count"))
    counted = cells.join(F.broadcast(sizes), ["c0", "c1"], "left").na.fill(0, ["count"])  # V * V rows at most
    before = F.sum("count").over(Window.partitionBy("query").orderBy("pos")) - F.col("count")
    kept = counted.withColumn("before", before).where((F.col("before") < quota) | (F.col("pos") == 1)).drop("before")
    return kept.withColumn("visited", F.count("*").over(Window.partitionBy("query")))


def share_quota(index: DataFrame, share: float) -> int:
    """The quota that visits a share of the index rows, whatever their number."""
    return max(1, math.ceil(share * index.count()))


def reranked(found: DataFrame, queries: DataFrame, vectors: DataFrame, limit: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query, neighbour, distance, pos): the ``limit`` nearest of what ``search`` found, by true squared distances to the rows' vectors.

    What was found is a bounded number of rows a query, so the vectors of these rows alone are joined.
    """
    q = queries.select(F.col(id_col).alias("query"), F.col(vector_col).cast("array<double>").alias("qv"))
    x = vectors.select(F.col(id_col).alias("neighbour"), F.col(vector_col).cast("array<double>").alias("xv"))
    pairs = found.where("neighbour IS NOT NULL").select("query", "neighbour").join(x, "neighbour").join(q, "query")
    near = pairs.select("query", "neighbour", squared_distance(F.col("qv"), F.col("xv")).alias("distance"))
    order = Window.partitionBy("query").orderBy("distance", "neighbour")
    best = near.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)
    return q.select("query").join(best, "query", "left")


def _met(asked: DataFrame, index: DataFrame, model: LOPQModel, work: Callable, out: str) -> DataFrame:
    """What ``work`` makes of the queries (query, c0, c1, qv and more) and the index rows (id, c0, c1, fine and, if wanted, xv) of each cell.

    Large cells are dealt into parts, the queries into blocks; each block meets each part of its cells in a task of its own, which holds
    the rows of one part. ``work`` gets a slice of queries, their code distances to the part's rows, and the rows as ``_Rows``.
    """
    sizes = index.groupBy("c0", "c1").agg(F.count("*").alias("n")).collect()  # V * V rows at most
    cores = index.sparkSession.sparkContext.defaultParallelism
    rows = min(PART_ROWS, max(LEAST_ROWS, -(-sum(r["n"] for r in sizes) // (2 * cores))))
    parts = [(r["c0"], r["c1"], -(-r["n"] // rows)) for r in sizes]
    blocks = max(1, -(-asked.select("query").distinct().count() // QUERY_BLOCK))
    known = F.broadcast(index.sparkSession.createDataFrame(parts, "c0 int, c1 int, parts int"))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    x = index.join(known, ["c0", "c1"]).withColumn("part", dealt("id", F.col("parts"))).withColumn("block", every(F.lit(blocks))).withColumn("side", F.lit(0))
    q = asked.join(known, ["c0", "c1"]).withColumn("block", dealt("query", F.lit(blocks))).withColumn("part", every(F.col("parts"))).withColumn("side", F.lit(1))
    keys = ["c0", "c1", "part", "block"]
    both = x.drop("parts").unionByName(q.drop("parts"), allowMissingColumns=True)
    both = both.select(*keys, "side", *[c for c in both.columns if c not in (*keys, "side")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, part = None, None
        for held, queries in in_cells(batches, len(keys)):
            if held is not of:
                of, part = held, _Rows(held)
            step = max(1, _PRODUCT // len(part.ids))
            for start in range(0, queries.num_rows, step):
                some = queries.slice(start, step)
                cells = np.stack([some.column("c0").to_numpy(), some.column("c1").to_numpy()], axis=1)
                y = model.project(matrix(some.column("qv")), cells)
                each = y.shape[1] // model.M
                d = 0
                for i, c in enumerate(model._centroids()):
                    table = ((y[:, None, i * each : (i + 1) * each] - c[None]) ** 2).sum(axis=2)
                    d = d + table[:, part.fine[:, i]]
                for b in work(some, d, part):
                    for s in range(0, b.num_rows, _ROWS):
                        yield b.slice(s, _ROWS)

    number = max(cores, 2 * blocks * sum(n for *_, n in parts))
    return both.repartition(number, *keys).sortWithinPartitions(*keys, "side").mapInArrow(run, out)


class _Rows:
    """The index rows of a part: ids, their places in order, fine codes, vectors."""

    def __init__(self, held: list[pa.RecordBatch]):
        self.ids = pa.concat_arrays([h.column("id") for h in held])
        self.place = places(self.ids)
        self.fine = np.concatenate([matrix(h.column("fine")) for h in held]).astype(int)
        self.x = np.concatenate([matrix(h.column("xv")) for h in held]) if "xv" in held[0].schema.names else None


def _visits(queries: DataFrame, index: DataFrame, model: LOPQModel, quota: int, id_col: str, vector_col: str) -> DataFrame:
    """(query, qv, c0, c1, visited): the cells that each query visits."""
    kept = cells_to_quota(cells_in_order(queries, model.Cs, id_col, vector_col), index, quota).select("query", "c0", "c1", "visited")
    return kept.join(queries.select(F.col(id_col).alias("query"), F.col(vector_col).cast("array<double>").alias("qv")), "query")


def _least(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` least of each row, with all ties."""
    return np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k]) if d.shape[1] > k else np.nonzero(np.ones(d.shape, bool))


def distances(queries: DataFrame, index: DataFrame, model: LOPQModel, quota: int, limit: int | None = None, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query, neighbour, visited, distance): distances by code to the rows of all visited cells; with a limit, to so many nearest of each part of a cell."""
    names = ["query", "neighbour", "visited", "distance"]

    def work(some: pa.RecordBatch, d: np.ndarray, part: _Rows) -> Iterator[pa.RecordBatch]:
        if limit is None:
            a, b = np.divmod(np.arange(d.size), d.shape[1])
        else:
            a, b = _least(d, limit)
            order = np.lexsort((part.place[b], d[a, b], a))
            order = order[first_of_each(a[order], limit)]
            a, b = a[order], b[order]
        yield pa.RecordBatch.from_arrays([some.column("query").take(pa.array(a)), part.ids.take(pa.array(b)), some.column("visited").take(pa.array(a)), pa.array(d[a, b])], names)

    visits = _visits(queries, index, model, quota, id_col, vector_col)
    kind = dict(visits.dtypes)["query"], dict(index.dtypes)["id"]
    return _met(visits, index.select("id", "c0", "c1", "fine"), model, work, f"query {kind[0]}, neighbour {kind[1]}, visited bigint, distance double")


def search(queries: DataFrame, index: DataFrame, model: LOPQModel, quota: int = 20, limit: int | None = None, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query, neighbour, distance, pos, visited): the ``limit`` (default: quota) nearest rows by code, pos from 1.

    Distances are squared and estimated: the query in the cell's frame against the centroids of the
    codes. Queries that meet no row give one row of nulls.
    """
    limit = quota if limit is None else limit
    near = distances(queries, index, model, quota, limit, id_col, vector_col)
    order = Window.partitionBy("query").orderBy("distance", "neighbour")
    best = near.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)
    return queries.select(F.col(id_col).alias("query")).join(best, "query", "left").select("query", "neighbour", "distance", "pos", "visited")


def _bins(d: np.ndarray) -> np.ndarray:
    """Numbers of bins of relative width 1/256 that rise with the distance: the leading bits of doubles that are not negative."""
    return np.ascontiguousarray(d).view(np.int64) >> _BITS


def search_reranked(
    queries: DataFrame, index: DataFrame, model: LOPQModel, vectors: DataFrame, quota: int, depth: int, limit: int, id_col: str = "id", vector_col: str = "vector"
) -> DataFrame:
    """(query, neighbour, distance, pos): the rows of ``reranked(search(quota, depth), limit)``, where ``depth`` may be a share of the table.

    Pairs don't become rows. A first pass counts each query's code distances in bins; the bin that holds the ``depth``-th splits the rows into
    those before it, of which each part of a cell keeps the ``limit`` nearest by their vectors, and those in it, which are ordered by
    code. A second pass finds both.
    """
    visits = _visits(queries, index, model, quota, id_col, vector_col)
    kind = dict(visits.dtypes)["query"], dict(index.dtypes)["id"]
    codes = index.select("id", "c0", "c1", "fine")

    def count(some: pa.RecordBatch, d: np.ndarray, part: _Rows) -> Iterator[pa.RecordBatch]:
        found = [np.unique(b, return_counts=True) for b in _bins(d)] if d.shape[1] < 256 else []
        for b in _bins(d) if not found else ():
            n = np.bincount(b - b.min())
            found.append((np.flatnonzero(n) + b.min(), n[n > 0]))
        at = np.repeat(np.arange(len(found)), [len(b) for b, _ in found])
        yield pa.RecordBatch.from_arrays([some.column("query").take(pa.array(at)), pa.array(np.concatenate([b for b, _ in found])), pa.array(np.concatenate([n for _, n in found]))], ["query", "bin", "n"])

    bins = _met(visits, codes, model, count, f"query {kind[0]}, bin bigint, n bigint").groupBy("query", "bin").agg(F.sum("n").alias("n"))
    upto = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("query").orderBy("bin")))
    edge = upto.where((F.col("upto") >= depth) & (F.col("upto") - F.col("n") < depth)).select("query", F.col("bin").alias("edge"), (depth - F.col("upto") + F.col("n")).alias("room"))

    def find(some: pa.RecordBatch, d: np.ndarray, part: _Rows) -> Iterator[pa.RecordBatch]:
        q, e, b = matrix(some.column("qv")), some.column("edge").to_numpy()[:, None], _bins(d)
        rough = (q * q).sum(1)[:, None] - 2 * q @ part.x.T + (part.x * part.x).sum(1)[None]
        rough[b >= e] = np.inf
        slack = 1e-9 * (1 + np.abs(rough, where=rough < np.inf, out=np.zeros_like(rough)).max(axis=1, keepdims=True) + (q * q).sum(1)[:, None])
        top = np.partition(rough, limit - 1, axis=1)[:, limit - 1 : limit] if rough.shape[1] > limit else np.full((len(q), 1), np.inf)
        for sure, (i, j) in ((True, np.nonzero((rough <= top + slack) & (rough < np.inf))), (False, np.nonzero(b == e))):
            exact = np.zeros(len(i))
            for c in range(q.shape[1]):  # in the order of components, as sums of columns are made elsewhere
                exact += (q[i, c] - part.x[j, c]) ** 2
            if sure:
                order = np.lexsort((part.place[j], exact, i))
                order = order[first_of_each(i[order], limit)]
                i, j, exact = i[order], j[order], exact[order]
            columns = [some.column("query").take(pa.array(i)), part.ids.take(pa.array(j)), pa.array(d[i, j]), pa.array(exact), pa.array(np.full(len(i), sure)), some.column("room").take(pa.array(i))]
            yield pa.RecordBatch.from_arrays(columns, ["query", "neighbour", "code", "distance", "sure", "room"])

    marked = visits.join(edge, "query", "left").na.fill({"edge": 1 << 62, "room": 0})
    x = codes.join(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("xv")), "id")
    met = _met(marked, x, model, find, f"query {kind[0]}, neighbour {kind[1]}, code double, distance double, sure boolean, room bigint")
    by_code = Window.partitionBy("query").orderBy("code", "neighbour")
    last = met.where("NOT sure").withColumn("place", F.row_number().over(by_code)).where("place <= room")
    pairs = met.where("sure").select("query", "neighbour", "distance").unionByName(last.select("query", "neighbour", "distance"))
    best = pairs.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))).where(F.col("pos") <= limit)
    return queries.select(F.col(id_col).alias("query")).join(best, "query", "left")
