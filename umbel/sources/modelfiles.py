"""Quantiser models as files that other programs read: level-5 MAT containers, and protobuf messages.

Files are read by Spark's ``binaryFile`` and written through Hadoop, so they may stand in any store that Spark reaches.
A model is bounded by its parameters and is one file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession

from umbel.lopq.model import LOPQModel

# Fixed values of the MAT container: element types with their NumPy forms, the two kinds that hold others, array classes.
MAT_TYPES = {1: "<i1", 2: "<u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 9: "<f8", 12: "<i8", 13: "<u8"}
MAT_MATRIX, MAT_COMPRESSED = 14, 15
MAT_DOUBLE_CLASS = 6

# Fixed values of the message: field numbers of the model, of a matrix and of a vector.
FIELDS = {"D": 1, "V": 2, "M": 3, "num_subquantizers": 4, "Cs": 5, "Rs": 6, "mus": 7, "subs": 8}
VALUES, SHAPE = 1, 2


def _element(kind: int, data: bytes) -> bytes:
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def mat_bytes(arrays: dict[str, np.ndarray], compress: bool = False) -> bytes:
    """Named arrays of doubles as a level-5 MAT file; numbers are 1 x 1."""
    out = [b"MATLAB 5.0 MAT-file".ljust(116) + b"\0" * 8 + struct.pack("<H", 0x0100) + b"IM"]
    for name, a in arrays.items():
        a = np.atleast_2d(np.asarray(a, "<f8"))
        body = _element(6, struct.pack("<II", MAT_DOUBLE_CLASS, 0)) + _element(5, np.array(a.shape, "<i4").tobytes()) + _element(1, name.encode()) + _element(9, a.tobytes(order="F"))
        matrix = struct.pack("<II", MAT_MATRIX, len(body)) + body
        if compress:
            packed = zlib.compress(matrix)
            matrix = struct.pack("<II", MAT_COMPRESSED, len(packed)) + packed
        out.append(matrix)
    return b"".join(out)


def _elements(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(type, content) one after the other; up to four bytes may stand inside the tag."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<II", data, at)
        if kind >> 16:
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
        else:
            yield kind, data[at + 8 : at + 8 + size]
            at += 8 + size + (0 if kind == MAT_COMPRESSED else -size % 8)


def read_mat(data: bytes) -> dict[str, np.ndarray]:
    """The real numeric arrays of a level-5 MAT file by name, in double; others are left out."""
    if len(data) < 128 or data[126:128] != b"IM":
        raise ValueError("no little-endian level-5 MAT file")
    out = {}
    for kind, body in _elements(data[128:]):
        if kind == MAT_COMPRESSED:
            kind, body = next(_elements(zlib.decompress(body)))
        if kind != MAT_MATRIX:
            continue
        parts = list(_elements(body))
        if len(parts) < 4 or parts[3][0] not in MAT_TYPES:
            continue
        shape = np.frombuffer(parts[1][1], "<i4")
        out[parts[2][1].decode()] = np.frombuffer(parts[3][1], MAT_TYPES[parts[3][0]]).astype(float).reshape(shape, order="F")
    return out


def to_mat(model: LOPQModel, compress: bool = False) -> bytes:
    """Both halves of every parameter in one array: Cs 2 x V x D/2, Rs 2 x V x D/2 x D/2, mus 2 x V x D/2, subs 2 x M/2 x S x D/M."""
    parts = {k: np.array(getattr(model, k)) for k in ("Cs", "Rs", "mus", "subs") if getattr(model, k) is not None}
    return mat_bytes({**parts, "V": model.V, "M": model.M}, compress)


def from_mat(data: bytes) -> LOPQModel:
    d = read_mat(data)
    parts = {k: (tuple(d[k]) if k in d else None) for k in ("Cs", "Rs", "mus", "subs")}
    s = d["subs"].shape[2] if "subs" in d else 0
    return LOPQModel(int(d["V"].item()), int(d["M"].item()), int(s), **parts)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _sized(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, number or content) of one message, in order."""

    def varint(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (data[at] & 0x7F) << shift
            shift += 7
            at += 1
            if data[at - 1] < 0x80:
                return n, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        wire = tag & 7
        if wire == 0:
            value, at = varint(at)
        elif wire == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire} is not read")
        yield tag >> 3, value


def to_proto(model: LOPQModel) -> bytes:
    """The model as one message; values are single precision. Parameters go half by half, matrices with their shapes."""

    def matrix(a: np.ndarray) -> bytes:
        shape = b"".join(_varint(SHAPE << 3) + _varint(n) for n in a.shape)
        return _sized(VALUES, np.ascontiguousarray(a, "<f4").tobytes()) + shape

    out = [_varint(FIELDS[k] << 3) + _varint(v) for k, v in (("D", 2 * np.shape(model.Cs[0])[1] if model.Cs else 0), ("V", model.V), ("M", model.M), ("num_subquantizers", model.S))]
    out += [_sized(FIELDS["Cs"], matrix(np.asarray(c))) for c in model.Cs or ()]
    for k in ("Rs", "subs"):
        out += [_sized(FIELDS[k], matrix(np.asarray(m))) for half in getattr(model, k) or () for m in half]
    out += [_sized(FIELDS["mus"], _sized(VALUES, np.ascontiguousarray(m, "<f4").tobytes())) for half in model.mus or () for m in half]
    return b"".join(out)


def from_proto(data: bytes) -> LOPQModel:
    """A model from one message; values may be packed or stand one by one."""
    names = {v: k for k, v in FIELDS.items()}
    found: dict = {k: [] for k in FIELDS}
    for field, value in _fields(data):
        name = names.get(field)
        if name in ("D", "V", "M", "num_subquantizers"):
            found[name] = value
        elif name:
            values, shape = [], []
            for inner, x in _fields(value):
                if inner == VALUES:
                    values.append(np.frombuffer(x, "<f4"))
                elif isinstance(x, int):
                    shape.append(x)
                else:
                    shape += [n for n in _packed(x)]
            a = np.concatenate(values).astype(float) if values else np.zeros(0)
            found[name].append(a.reshape(shape) if shape else a)
    halves = {}
    for k in ("Cs", "Rs", "mus", "subs"):
        parts, n = found[k], len(found[k]) // 2
        halves[k] = (tuple(parts) if k == "Cs" else (np.array(parts[:n]), np.array(parts[n:]))) if parts else None
    return LOPQModel(found["V"], found["M"], found["num_subquantizers"], **halves)


def _packed(data: bytes) -> Iterator[int]:
    n = shift = 0
    for b in data:
        n |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            yield n
            n = shift = 0


FORMS = {"mat": (to_mat, from_mat), "proto": (to_proto, from_proto)}


def export(model: LOPQModel, spark: SparkSession, path: str, form: str) -> None:
    """Write ``model`` as one file in the form ``mat`` or ``proto``; a file that is there is replaced."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(FORMS[form][0](model)))
    finally:
        out.close()


def load(spark: SparkSession, path: str, form: str) -> LOPQModel:
    """The model in a file of the form ``mat`` or ``proto``."""
    rows = spark.read.format("binaryFile").load(path).select("content").limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is not one file")
    return FORMS[form][1](bytes(rows[0]["content"]))
