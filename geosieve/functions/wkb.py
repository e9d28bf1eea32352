"""Well-known binary, both ways, in Arrow batches: how databases and GeoParquet files store geometry.

Little and big endian, ISO and extended type codes; Z, M and the reference system's number are dropped. A collection
becomes the multi-geometry of its members of the highest dimension: its polygons, else its lines, else its points.
Bytes that cannot be read are NULL, as a NULL is; an empty geometry has no parts.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geosieve.layer import SHAPE_DDL

# The codes of the types.
KINDS = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON",
         7: "GEOMETRYCOLLECTION"}
_CODES = {kind: code for code, kind in KINDS.items()}
_VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_SHAPE = T.StructType([T.StructField("type", T.StringType()), T.StructField("parts", T.ArrayType(T.ArrayType(T.ArrayType(_VERTEX))))])

Parts = list[list[np.ndarray]]  # part, ring, (n, 2)


def _read(data: bytes, at: int) -> tuple[str, Parts, int]:
    order = "<" if data[at] == 1 else ">"
    if data[at] > 1:
        raise ValueError("no byte order")
    code, = struct.unpack_from(order + "I", data, at + 1)
    at += 5
    z, m = bool(code & 0x80000000), bool(code & 0x40000000)
    at += 4 * bool(code & 0x20000000)
    code &= 0x0FFFFFFF
    z, m, code = z or code // 1000 in (1, 3), m or code // 1000 in (2, 3), code % 1000
    width, kind = 2 + z + m, KINDS[code]

    def count() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", data, at - 4)[0]

    def points(n: int) -> np.ndarray:
        nonlocal at  # frombuffer refuses a count that the bytes do not hold
        found = np.frombuffer(data, order + "f8", n * width, at).reshape(n, width)[:, :2]
        at += 8 * n * width
        return found

    if kind == "POINT":
        p = points(1)
        return kind, [[p]] if np.isfinite(p).all() else [], at
    if kind == "LINESTRING":
        p = points(count())
        return kind, [[p]] if len(p) else [], at
    if kind == "POLYGON":
        rings = [points(count()) for _ in range(count())]
        return kind, [rings] if rings else [], at
    members = []
    for _ in range(count()):
        member, parts, at = _read(data, at)
        members.append((member.removeprefix("MULTI"), parts))
    if kind == "GEOMETRYCOLLECTION":
        top = next((k for k in ("POLYGON", "LINESTRING", "POINT") if any(m == k and p for m, p in members)), None)
        members = [x for x in members if x[0] == top]
        # a collection within a collection has been made one kind already
        kind = f"MULTI{top or 'POINT'}"
    return kind, [part for _, parts in members for part in parts], at


def read_wkb(data: bytes | None) -> tuple[str, Parts] | None:
    """Type and parts of one geometry, None where it cannot be read."""
    try:
        kind, parts, end = _read(data, 0)
        return (kind, parts) if end == len(data) else None
    except (TypeError, KeyError, IndexError, ValueError, struct.error):
        return None


def _lists(sizes: Iterable[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)


@F.arrow_udf(_SHAPE)
def _from_udf(column: pa.Array) -> pa.Array:
    rows = [read_wkb(x) for x in column.to_pylist()]
    parts = [r[1] if r else [] for r in rows]
    rings = [p for own in parts for p in own]
    lines = [line for p in rings for line in p]
    xy = np.concatenate([*lines, np.empty((0, 2))]).astype(float)
    vertices = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=["x", "y"])
    nested = _lists(map(len, parts), _lists(map(len, rings), _lists(map(len, lines), vertices)))
    return pa.StructArray.from_arrays([pa.array([r and r[0] for r in rows], pa.string()), nested], names=["type", "parts"],
                                      mask=pa.array([r is None for r in rows]))


def write_wkb(kind: str, parts: list[list[list[dict]]]) -> bytes:
    head = struct.pack("<BI", 1, _CODES[kind])

    def points(line) -> bytes:
        return np.array([(p["x"], p["y"]) for p in line], "<f8").tobytes()

    def counted(line) -> bytes:
        return struct.pack("<I", len(line)) + points(line)

    if kind == "POINT":
        return head + (points(parts[0][0][:1]) if parts else struct.pack("<dd", float("nan"), float("nan")))
    if kind == "LINESTRING":
        return head + (counted(parts[0][0]) if parts else counted([]))
    if kind == "POLYGON":
        rings = parts[0] if parts else []
        return head + struct.pack("<I", len(rings)) + b"".join(map(counted, rings))
    return head + struct.pack("<I", len(parts)) + b"".join(write_wkb(kind.removeprefix("MULTI"), [p]) for p in parts)


@F.arrow_udf(T.BinaryType())
def _to_udf(column: pa.Array) -> pa.Array:
    return pa.array([g and write_wkb(g["type"], g["parts"]) for g in column.to_pylist()], pa.binary())


def from_wkb(column: Column) -> Column:
    return _from_udf(column).cast(SHAPE_DDL)


def to_wkb(geom: Column) -> Column:
    return _to_udf(geom)
