"""Bounded-space online best-fit packing of token sequences (operator 10).

Pieces come in a seeded random order, each is placed as it comes, and a fixed number of bins is open: when
none of them takes a piece, the fullest closes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbel.llm.store import numbered, row_number, settle
from umbel.llm.tokens import default_path, encoder

CAPACITY = 2048
#: Bins open at once in one packing task. What online packing loses hardly depends on it: 0.8 % more sequences than the least
#: possible number with 256 to 16,384 open bins on 66,228 pieces; packing the longest first would lose 0.003 %, but needs them all.
OPEN_BINS = 256
SEED = 20240302
#: Pieces packed by one task; a task's last bins are its only loss against one packing of all.
TASK_PIECES = 250_000
SEPARATOR = 0

PIECES = "doc_id bigint, row_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` >= 1 tokens: full ones, but for the first, which takes the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", row_id: str | None = None) -> DataFrame:
    """The token pieces of every row (null text: the separator alone), with the CRC-32 of their ids; ``row_id`` names a column of row numbers."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            rows: list[tuple] = []
            for doc_id, row_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids = np.append(enc.ids(text.as_py()), np.uint32(SEPARATOR)).astype("<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc_id, row_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row_number(row_id).alias("row_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, PIECES)


class BestFit:
    """Online best-fit: an item goes to the fullest open bin that takes it; bit f of ``free`` says that some bin has f left.

    With all ``bins`` open and none that fits, the fullest closes to make room for a new one.
    """

    def __init__(self, capacity: int = CAPACITY, bins: int = OPEN_BINS):
        self.capacity, self.bins, self.open, self.free, self.used, self.closed = capacity, bins, 0, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, f: int) -> int:
        stack = self.by_free[f]
        number = stack.pop()
        if not stack:
            self.free ^= 1 << f
        self.open -= 1
        return number

    def put(self, length: int) -> tuple[int, int]:
        """(bin number, offset in it) for an item of 1 to capacity."""
        fits = self.free >> length
        if fits:
            f = length + (fits & -fits).bit_length() - 1
            number = self._take(f)
        else:
            if self.open == self.bins:
                self._take((self.free & -self.free).bit_length() - 1)
                self.closed += 1
            f, number = self.capacity, self.used
            self.used += 1
        if left := f - length:
            if not self.by_free[left]:
                self.free |= 1 << left
            self.by_free[left].append(number)
            self.open += 1
        return number, self.capacity - f


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, bins: int = OPEN_BINS, task_pieces: int = TASK_PIECES) -> DataFrame:
    """The columns of PIECES, sequence_id bigint and offset bigint for every piece of a settled table.

    Pieces are dealt by a hash of their row to tasks of about ``task_pieces``, so no key decides how much
    a task gets; each task streams its pieces, in the order of another hash, through one BestFit, and
    holds the open bins only. A task's pieces and their order depend on the rows' numbers alone, so reruns agree.
    """
    parts = max(1, -(-cut_pieces.count() // task_pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, fit = None, None
        for b in batches:
            numbers, offsets = [], []
            for p, n in zip(b.column(0).to_pylist(), b.column(5).to_pylist(), strict=True):
                if p != part:
                    part, fit = p, BestFit(capacity, bins)
                number, offset = fit.put(n)
                numbers.append((p << 40) + number)
                offsets.append(offset)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())], [f.name for f in out])

    dealt = cut_pieces.select(F.pmod(F.xxhash64("row_id", "piece"), F.lit(parts)).cast("bigint").alias("part"), *cut_pieces.columns)
    out = dealt.drop("part").withColumn("sequence_id", F.lit(0).cast("bigint")).withColumn("offset", F.lit(0).cast("bigint")).schema
    order = dealt.repartition(parts, "part").sortWithinPartitions("part", F.xxhash64(F.lit(SEED), "row_id", "piece"), "row_id", "piece")
    return order.mapInArrow(run, out)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", row_id: str | None = None) -> DataFrame:
    """Cut and pack all rows of ``docs``; see ``pieces`` and ``pack``.

    Null and empty texts give one piece, the separator. Documents longer than ``capacity`` tokens are
    cut, others never. Null ids and repeated rows are packed like any other row; ids are whole numbers. An
    empty table gives no rows; other columns are ignored. ``row_id`` names a column of row numbers, which
    are the same in every scan (see ``numbered``); without it the rows are numbered here.
    """
    if not row_id:
        docs, row_id = numbered(docs)
    return pack(settle(pieces(docs, capacity, path, id_col, text_col, row_id), "pieces"), capacity)


def sequences(packed: DataFrame, docs: DataFrame, row_id: str, path: str | None = None, text_col: str = "text") -> DataFrame:
    """(sequence_id, ids array<int>): the packed sequences themselves, from the ``docs`` that were packed with the numbers of ``row_id``.

    Texts are encoded again rather than kept as ids between; a sequence has at most the capacity, so
    gathering one is bounded.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            seq, off, ids = [], [], []
            for text, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens = np.append(enc.ids(text), np.uint32(SEPARATOR))
                for p in places:
                    seq.append(p["sequence_id"])
                    off.append(p["offset"])
                    ids.append(tokens[p["start"] : p["start"] + p["length"]].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(off, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["sequence_id", "offset", "ids"])

    placed = packed.groupBy("row_id").agg(F.collect_list(F.struct("sequence_id", "offset", "start", "length")).alias("places"))
    texts = docs.select(F.col(row_id).alias("row_id"), F.col(text_col).alias("text"))
    parts = texts.join(placed, "row_id").select("text", "places").mapInArrow(run, "sequence_id bigint, offset bigint, ids array<int>")
    whole = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return whole.select("sequence_id", F.flatten(F.transform("x", lambda x: x["ids"])).alias("ids"))
