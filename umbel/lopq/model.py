"""The LOPQ model: coarse centroids of both vector halves, local rotations, subquantizers.

Published as "Locally Optimized Product Quantization for Approximate Nearest Neighbor Search" (Kalantidis
and Avrithis, 2014), with the eigenvalue allocation of "Optimized Product Quantization" (Ge et al., 2013).

Training runs as a few passes of partial sums over the table: a task sends the sums of its rows, whose
size depends on the parameters alone, and the driver adds them and solves the small problems.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbel.operators.search import matrix

#: Vectors that seed the centroids, at most.
SEED_ROWS = 20_000
#: Groups of tasks whose sums are added first.
SUM_TASKS = 64
#: Rows whose rotations are gathered at once.
TURNED_ROWS = 512
SUMS = "task int, name string, shape array<int>, values binary"
STORE = "kind string, split int, idx int, shape array<int>, values array<double>"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Nearest centroid of each row, the first of equally near ones."""
    return squared(x, c).argmin(axis=1)


def turned(how: str, rotations: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Each row by the rotation of its cell, some rows at a time, as a rotation is as large as many rows."""
    out = np.empty(x.shape)
    for i in range(0, len(x), TURNED_ROWS):
        at = slice(i, i + TURNED_ROWS)
        out[at] = np.einsum(how, rotations[a[at]], x[at])
    return out


def plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ seeds; rows repeat only where all rows coincide with a seed."""
    c = [x[rng.integers(len(x))]]
    d = ((x - c[0]) ** 2).sum(axis=1)
    for _ in range(1, k):
        total = d.sum()
        c.append(x[rng.choice(len(x), p=d / total) if total > 0 else rng.integers(len(x))])
        d = np.minimum(d, ((x - c[-1]) ** 2).sum(axis=1))
    return np.array(c)


def allocate(eigenvalues: np.ndarray, buckets: int) -> np.ndarray:
    """Order of the eigenvectors that balances the product of eigenvalues over buckets of equal size.

    Values are scaled by the least non-zero magnitude, so that no logarithm is negative; the largest come
    first, each into the bucket with room whose product is least.
    """
    n, size = len(eigenvalues), len(eigenvalues) // buckets
    magnitude = np.abs(eigenvalues)
    nonzero = magnitude[magnitude > 0]
    scale = nonzero.min() if len(nonzero) else 1.0
    weight = np.log2(np.where(magnitude > 0, magnitude / scale, 1.0))
    members: list[list[int]] = [[] for _ in range(buckets)]
    product = np.zeros(buckets)
    for i in np.argsort(-eigenvalues, kind="stable")[: size * buckets]:
        b = min((b for b in range(buckets) if len(members[b]) < size), key=lambda b: (product[b], b))
        members[b].append(int(i))
        product[b] += weight[i]
    return np.array([i for m in members for i in m][:n])


def rotation(outer: np.ndarray, total: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(rotation with eigenvectors as rows, mean residual) of one cell from the sums over its residuals.

    A cell with fewer points than dimensions keeps its axes; an empty one has mean zero.
    """
    d = len(total)
    mean = total / n if n else np.zeros(d)
    if n < max(d, 2):
        warnings.warn(f"{n} points for {d} dimensions: no rotation", stacklevel=2)
        values, vectors = np.ones(d), np.eye(d)
    else:
        values, vectors = np.linalg.eigh((outer + outer.T) / (2 * (n - 1)) - np.outer(mean, mean))
    return vectors[:, allocate(values, buckets)].T, mean


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per (task, name) of rows that come sorted by both."""
    at, shape, total = None, None, None
    for b in batches:
        for r in b.to_pylist():
            v = np.frombuffer(r["values"])
            if (r["task"], r["name"]) == at:
                total = total + v
            else:
                if at:
                    yield _sums_batch([(*at, shape, total.tobytes())])
                at, shape, total = (r["task"], r["name"]), r["shape"], v
    if at:
        yield _sums_batch([(*at, shape, total.tobytes())])


def _sums_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.list_(pa.int32()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["task", "name", "shape", "values"])


def _summed(vectors: DataFrame, partial: Callable[[np.ndarray], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Sums over all rows of what ``partial`` makes of a block; each task sends one row of bytes per name.

    The sums of tasks are added in groups and then by name on executors, so that the driver gets one row
    per name, whatever the table. Sums are added in the order of tasks, so reruns agree to the last digit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                for k, v in partial(matrix(b.column(0))).items():
                    held[k] = held[k] + v if k in held else v.astype(np.float64)
        if held:
            task = TaskContext.get().partitionId()
            for k, v in held.items():
                yield _sums_batch([(task, k, list(v.shape), v.tobytes())])

    sums = vectors.mapInArrow(run, SUMS)
    for groups in (SUM_TASKS, 1):
        grouped = sums.withColumn("part", F.col("task")).withColumn("task", F.col("task") % groups).repartition("task", "name")
        sums = grouped.sortWithinPartitions("task", "name", "part").drop("part").mapInArrow(_add, SUMS)
    return {r["name"]: np.frombuffer(r["values"]).reshape(r["shape"]) for r in sums.collect()}


def _lloyd(vectors: DataFrame, split: Callable[[np.ndarray], list[np.ndarray]], seeds: list[np.ndarray], rounds: int) -> tuple[list[np.ndarray], float]:
    """k-means of all parts of the vectors at once, a pass over the table each round; also the last total cost."""
    centroids, cost = [c.copy() for c in seeds], np.inf
    for _ in range(rounds):
        held = [c.copy() for c in centroids]

        def partial(x: np.ndarray, held=held) -> dict[str, np.ndarray]:
            out = {}
            for i, (p, c) in enumerate(zip(split(x), held, strict=True)):
                d = squared(p, c)
                a = d.argmin(axis=1)
                s = np.zeros_like(c)
                np.add.at(s, a, p)
                out |= {f"s{i}": s, f"n{i}": np.bincount(a, minlength=len(c)).astype(float), f"c{i}": d.min(axis=1).sum().reshape(1)}
            return out

        sums = _summed(vectors, partial)
        if not sums:
            break
        for i, c in enumerate(centroids):
            n = sums[f"n{i}"]
            centroids[i] = np.where(n[:, None] > 0, sums[f"s{i}"] / np.maximum(n, 1)[:, None], c)
        now = sum(float(sums[f"c{i}"][0]) for i in range(len(centroids)))
        if now >= cost * (1 - 1e-6):
            break
        cost = now
    return centroids, cost


def coarse_rounds(df: DataFrame, seeds: list[np.ndarray], rounds: int, vector_col: str = "vector") -> list[np.ndarray]:
    """k-means of consecutive parts of equal length of all vectors, from given seeds of each part (k x part length); a cluster without rows stays."""
    n = len(seeds)
    rows = df.where(F.col(vector_col).isNotNull()).select(F.col(vector_col).cast("array<double>").alias("v"))
    return _lloyd(rows, lambda x: np.split(x, n, axis=1), seeds, rounds)[0]


def cell_moments(rows: DataFrame, cs: tuple) -> dict[str, np.ndarray]:
    """Of the residuals of each half (0, 1) and cell: o0, o1 sums of outer products, t0, t1 sums, n0, n1 counts. ``rows``: one column of vectors."""

    def partial(x: np.ndarray) -> dict[str, np.ndarray]:
        out, half = {}, x.shape[1] // 2
        for s, c in enumerate(cs):
            p = x[:, s * half : (s + 1) * half]
            a = assign(p, c)
            r = p - c[a]
            outer, total = np.zeros((len(c), half, half)), np.zeros_like(c)
            for v in np.unique(a):
                outer[v], total[v] = r[a == v].T @ r[a == v], r[a == v].sum(axis=0)
            out |= {f"o{s}": outer, f"t{s}": total, f"n{s}": np.bincount(a, minlength=len(c)).astype(float)}
        return out

    return _summed(rows, partial)


@dataclass
class LOPQModel:
    """V coarse clusters of each half, M subvectors, S clusters of each; parts that are given are not trained."""

    V: int = 16
    M: int = 16
    S: int = 512
    Cs: tuple | None = None
    Rs: tuple | None = None
    mus: tuple | None = None
    subs: tuple | None = None

    def __post_init__(self):
        if (self.Rs is None) != (self.mus is None):
            raise ValueError("rotations and means come together")
        if self.M % 2:
            raise ValueError("M has to be even: each half has M/2 subvectors")

    # training

    def fit(self, df: DataFrame, vector_col: str = "vector", coarse_rounds: int = 10, n_init: int = 1, local_rounds: int = 20, sample: float = 1.0, seed: int = 0) -> LOPQModel:
        """Train what is missing. Needs as many vectors as V and S; null vectors are left out.

        ``sample`` is the share of rows that train the subquantizers; seeds come from SEED_ROWS rows at most.
        """
        rows = df.where(F.col(vector_col).isNotNull()).select(F.col(vector_col).cast("array<double>").alias("v"))
        # a share of the hashes that holds somewhat more than SEED_ROWS, so that no task sorts or sends more than its part of them
        h = F.xxhash64(F.lit(seed), "v")
        share = min(1.0, 1.2 * SEED_ROWS / max(1, rows.count()))
        few = rows.where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(h).limit(SEED_ROWS)
        few = matrix(few.toArrow().column("v").combine_chunks())
        if len(few) < max(self.V, self.S):
            raise ValueError(f"{len(few)} vectors are too few for V={self.V}, S={self.S}")
        if few.shape[1] % self.M:
            raise ValueError(f"{few.shape[1]} dimensions don't divide into {self.M} subvectors")
        half, rng = few.shape[1] // 2, np.random.default_rng(seed)
        if self.Cs is None:
            tries = [_lloyd(rows, lambda x: [x[:, :half], x[:, half:]], [plus_plus(few[:, :half], self.V, rng), plus_plus(few[:, half:], self.V, rng)], coarse_rounds) for _ in range(n_init)]
            self.Cs = tuple(min(tries, key=lambda t: t[1])[0])
        if self.Rs is None:
            sums = cell_moments(rows, self.Cs)
            made = [[rotation(sums[f"o{s}"][v], sums[f"t{s}"][v], int(sums[f"n{s}"][v]), self.M // 2) for v in range(self.V)] for s in (0, 1)]
            self.Rs = tuple(np.array([r for r, _ in m]) for m in made)
            self.mus = tuple(np.array([u for _, u in m]) for m in made)
        if self.subs is None:
            part = rows if sample >= 1 else rows.where(F.pmod(F.xxhash64(F.lit(seed + 1), "v"), F.lit(1 << 20)) < int(sample * (1 << 20)))
            local = self.project(few)
            each = local.shape[1] // self.M
            split = lambda y: [y[:, i * each : (i + 1) * each] for i in range(self.M)]
            cut = LOPQModel(self.V, self.M, self.S, self.Cs, self.Rs, self.mus)
            found, _ = _lloyd(part, lambda x: split(cut.project(x)), [plus_plus(p, self.S, rng) for p in split(local)], local_rounds)
            self.subs = (np.array(found[: self.M // 2]), np.array(found[self.M // 2 :]))
        return self

    # encoding

    def _halves(self, x: np.ndarray) -> list[np.ndarray]:
        h = x.shape[1] // 2
        return [x[:, :h], x[:, h:]]

    def predict_coarse(self, x: np.ndarray) -> np.ndarray:
        """Coarse ids of both halves, n x 2."""
        return np.stack([assign(p, c) for p, c in zip(self._halves(x), self.Cs, strict=True)], axis=1)

    def project(self, x: np.ndarray, coarse: np.ndarray | None = None) -> np.ndarray:
        """Vectors in the local frames of their cells (or of given ones)."""
        coarse = self.predict_coarse(x) if coarse is None else coarse
        out = []
        for s, p in enumerate(self._halves(x)):
            a = coarse[:, s]
            out.append(turned("nij,nj->ni", self.Rs[s], a, p - self.Cs[s][a] - self.mus[s][a]))
        return np.concatenate(out, axis=1)

    def _centroids(self) -> list[np.ndarray]:
        return [c for half in self.subs for c in half]

    def predict_fine(self, x: np.ndarray, coarse: np.ndarray | None = None) -> np.ndarray:
        """Fine ids, n x M."""
        y = self.project(x, coarse)
        each = y.shape[1] // self.M
        return np.stack([assign(y[:, i * each : (i + 1) * each], c) for i, c in enumerate(self._centroids())], axis=1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(coarse, fine) ids."""
        coarse = self.predict_coarse(x)
        return coarse, self.predict_fine(x, coarse)

    def reconstruct(self, coarse: np.ndarray, fine: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        local = np.concatenate([c[fine[:, i]] for i, c in enumerate(self._centroids())], axis=1)
        out = []
        for s, p in enumerate(self._halves(local)):
            a = coarse[:, s]
            out.append(turned("nji,nj->ni", self.Rs[s], a, p) + self.mus[s][a] + self.Cs[s][a])
        return np.concatenate(out, axis=1)

    def subquantizer_distances(self, x: np.ndarray, coarse: tuple[int, int], split: int | None = None) -> list[np.ndarray]:
        """For one vector seen from cell ``coarse``: squared distances to the S centroids of each subvector (of one half, if given)."""
        y = self.project(x[None], np.array([coarse]))[0]
        each = len(y) // self.M
        every = range(self.M) if split is None else range(split * self.M // 2, (split + 1) * self.M // 2)
        return [((y[i * each : (i + 1) * each] - self._centroids()[i]) ** 2).sum(axis=1) for i in every]

    def cell_id(self, coarse: tuple[int, int]) -> int:
        """One number for a pair of coarse ids."""
        return int(coarse[1]) + int(coarse[0]) * self.V

    def coarse_of(self, cell: int) -> tuple[int, int]:
        """The pair of coarse ids of a cell."""
        return divmod(int(cell), self.V)

    # tables

    def encode(self, df: DataFrame, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
        """(id, c0 int, c1 int, fine array<smallint>) of all rows with a vector."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    coarse, fine = self.predict(matrix(b.column(1)))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0), pa.array(coarse[:, 0], pa.int32()), pa.array(coarse[:, 1], pa.int32()), pa.array(fine.tolist(), pa.list_(pa.int16()))], ["id", "c0", "c1", "fine"]
                    )

        body = df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        return body.mapInArrow(run, f"id {dict(body.dtypes)['id']}, c0 int, c1 int, fine array<smallint>")

    def decode(self, codes: DataFrame) -> DataFrame:
        """(id, vector array<double>): reconstructions of a code table."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    coarse = np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()], axis=1)
                    x = self.reconstruct(coarse, matrix(b.column(3)).astype(int))
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], ["id", "vector"])

        body = codes.select("id", "c0", "c1", "fine")
        return body.mapInArrow(run, f"id {dict(body.dtypes)['id']}, vector array<double>")

    # the model as a table

    def rows(self) -> list[tuple]:
        out = []
        for kind in ("Cs", "Rs", "mus", "subs"):
            for split, part in enumerate(getattr(self, kind) or ()):
                out += [(kind, split, i, list(np.shape(m)), np.ravel(m).tolist()) for i, m in enumerate(part)]
        return [("size", 0, 0, [self.V, self.M, self.S], [])] + out

    def save(self, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
        spark.createDataFrame(self.rows(), STORE).coalesce(1).write.mode(mode).parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LOPQModel:
        found: dict = {}
        for r in spark.read.schema(STORE).parquet(path).collect():  # a model, whose size its parameters bound
            found[(r["kind"], r["split"], r["idx"])] = np.array(r["values"]).reshape(r["shape"]) if r["kind"] != "size" else r["shape"]
        v, m, s = found.pop(("size", 0, 0))
        parts = {}
        for kind in ("Cs", "Rs", "mus", "subs"):
            splits = [[found[k] for k in sorted(k for k in found if k[:2] == (kind, sp))] for sp in (0, 1)]
            parts[kind] = tuple(np.array(x) for x in splits) if splits[0] else None
        return cls(v, m, s, **parts)
