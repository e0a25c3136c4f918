"""Well-known binary as columns, in Arrow batches: coordinates are read and written as numpy arrays, never point by point."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
TYPES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
_CODES = {v: k for k, v in TYPES.items()}
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
PARTS = "array<struct<part:int,ring:int,points:array<struct<x:double,y:double>>>>"


def parse(data: bytes, at: int = 0, part: int = 0) -> tuple[str, list[tuple[int, int, np.ndarray]], int]:
    """Type of a geometry, its stretches of points (part, ring, n x 2) and where it ends. Both byte orders, heights and measures (left out) and identifiers of reference systems (left out) are known; a broken one is a ValueError."""
    try:
        end = "<" if data[at] == 1 else ">"
        (code,) = struct.unpack_from(end + "I", data, at + 1)
    except (IndexError, struct.error):
        raise ValueError("cut off") from None
    at += 5
    dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    at += 4 if code & 0x20000000 else 0
    code &= 0x0FFFFFFF
    dims += {0: 0, 1: 1, 2: 1, 3: 2}.get(code // 1000, 0)
    kind = TYPES.get(code % 1000)
    if kind is None or code // 1000 > 3:
        raise ValueError("unknown type")

    def count() -> int:
        nonlocal at
        if at + 4 > len(data):
            raise ValueError("cut off")
        (n,) = struct.unpack_from(end + "I", data, at)
        at += 4
        return n

    def line(n: int) -> np.ndarray:
        nonlocal at
        if n * dims * 8 > len(data) - at:
            raise ValueError("cut off")
        xy = np.frombuffer(data, end + "f8", n * dims, at).reshape(n, dims)[:, :2]
        at += n * dims * 8
        return xy

    if kind == "Point":
        xy = line(1)
        return kind, ([] if np.isnan(xy).all() else [(part, 0, xy)]), at
    if kind == "LineString":
        xy = line(count())
        return kind, ([(part, 0, xy)] if len(xy) else []), at
    if kind == "Polygon":
        return kind, [(part, r, line(count())) for r in range(count())], at
    found = []
    for k in range(count()):
        _, inner, at = parse(data, at, k)
        found += inner
    return kind, ([] if kind == "GeometryCollection" else found), at


def _decoded(values: list[bytes | None]) -> list[pa.Array]:
    kinds, errors, stretches, edge = [], [], [], [0]
    for v in values:
        kind = error = None
        if v is not None:
            try:
                kind, own, end = parse(v)
                if end != len(v):
                    raise ValueError("more than one geometry")
                stretches += own
            except ValueError as e:
                kind, error = None, str(e)
        kinds.append(kind)
        errors.append(error)
        edge.append(len(stretches))
    xy = np.concatenate([s[2] for s in stretches]) if stretches else np.zeros((0, 2))
    points = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(s[2]) for s in stretches]), pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, k], "f8")) for k in (0, 1)], fields=list(_POINT)))
    inner = pa.StructArray.from_arrays([pa.array([s[0] for s in stretches], pa.int32()), pa.array([s[1] for s in stretches], pa.int32()), points], names=["part", "ring", "points"])
    none = pa.array([k is None for k in kinds])
    return [pa.array(kinds, pa.string()), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), inner, mask=none), pa.array(errors, pa.string())]


def decode(d: DataFrame, column: str) -> DataFrame:
    """``d`` with ``gtype``, ``parts`` and ``wkb_error`` in the place of the binary ``column``. A part is a point, a line or a polygon; ``ring`` 0 of a polygon is its shell. Null gives nulls; a broken value gives an error and no geometry."""
    kept = [c for c in d.columns if c != column]
    own = d.select(*kept, F.col(column).alias(column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            more = _decoded(b.column(len(kept)).to_pylist())
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(len(kept))], *more], names=[*kept, "gtype", "parts", "wkb_error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*kept).schema) if kept else ""
    return own.mapInArrow(run, f"{schema}{', ' if schema else ''}gtype string, parts {PARTS}, wkb_error string")


def build(kind: str, parts: list[dict]) -> bytes:
    """The bytes, little-endian, of a geometry given as in :func:`decode`."""
    head = lambda k: struct.pack("<BI", 1, _CODES[k])
    flat = lambda p: np.array([(q["x"], q["y"]) for q in p["points"]], "<f8").tobytes()
    line = lambda p: struct.pack("<I", len(p["points"])) + flat(p)
    if kind == "Point":
        return head(kind) + (flat(parts[0]) if parts else np.array([np.nan, np.nan], "<f8").tobytes())
    if kind == "LineString":
        return head(kind) + (line(parts[0]) if parts else struct.pack("<I", 0))
    if kind == "Polygon":
        return head(kind) + struct.pack("<I", len(parts)) + b"".join(map(line, parts))
    groups: dict[int, list[dict]] = {}
    for p in parts:
        groups.setdefault(p["part"], []).append(p)
    return head(kind) + struct.pack("<I", len(groups)) + b"".join(build(kind.removeprefix("Multi"), g) for g in groups.values())


def encoded(kind, parts):
    """A binary column of ``kind`` (text) and ``parts``."""

    @F.udf("binary", useArrow=True)
    def write(k, p):
        return None if k is None or p is None else build(k, [r if isinstance(r, dict) else r.asDict() for r in p])

    return write(kind, parts)
