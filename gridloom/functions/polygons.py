"""Polygon work that Columns cannot state: clipping to a convex area, simplification, points on surfaces. Arrow batches, numpy per part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def _xy(ring) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring], float) if ring is not None and len(ring) else np.zeros((0, 2))


def _rows(points: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in points]


def _spread(rings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A batch of rings as the points of all of them, one after another, and the number of points of each (null: 0)."""
    flat = rings.flatten()
    size = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.column_stack([flat.field(k).to_numpy(zero_copy_only=False).astype(float) for k in ("x", "y")]), size


def _starts(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else np.zeros(0, np.int64)


def _following(size: np.ndarray) -> np.ndarray:
    """For each point the place of the next one of its ring; after the last comes the first."""
    nxt = np.arange(1, size.sum() + 1)
    full = size > 0
    nxt[(np.cumsum(size) - 1)[full]] = _starts(size)[full]
    return nxt


def _sums(flags: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many points of each ring have the flag."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[_starts(size) + size] - total[_starts(size)]


def _open(points: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rings without a last point that repeats the first."""
    drop = np.zeros(len(points), bool)
    many = size > 1
    first, last = _starts(size)[many], (np.cumsum(size) - 1)[many]
    drop[last] = (points[first] == points[last]).all(axis=1)
    return points[~drop], size - _sums(drop, size)


def clip_rings(points: np.ndarray, size: np.ndarray, area: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of many polygons inside a convex, counter-clockwise ``area``, closed: one edge of the area after another cuts what is left of all of them. Fewer than three points are nothing."""
    out, size = _open(points, size)
    for a, b in zip(area, np.roll(area, -1, axis=0)):
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        nxt = _following(size)
        t, keep = side[nxt], side >= 0
        cross = (side < 0) != (t < 0)
        at = np.cumsum(keep.astype(np.int64) + cross) - cross  # behind a point that stays comes the crossing of its side
        done = np.empty((int(keep.sum() + cross.sum()), 2))
        done[at[keep] - 1] = out[keep]
        p, q, s = out[cross], out[nxt[cross]], side[cross]
        done[at[cross]] = p + (q - p) * (s / (s - t[cross]))[:, None]
        out, size = done, _sums(keep, size) + _sums(cross, size)
    good = size >= 3
    out, size = out[np.repeat(good, size)], np.where(good, size, 0)
    ends = (np.cumsum(size))[good]
    return np.insert(out, ends, out[_starts(size)[good]], axis=0), size + good


def clip_convex(ring: np.ndarray, area: np.ndarray) -> np.ndarray:
    """:func:`clip_rings` of one polygon."""
    return clip_rings(ring, np.array([len(ring)]), area)[0]


def clip_to_convex(area: list[tuple[float, float]]):
    """A function of a ring column; null where nothing is left."""
    fixed = np.array(area, float)

    @F.arrow_udf(RING)
    def clip(rings: pa.Array) -> pa.Array:
        points, size = clip_rings(*_spread(rings), fixed)
        flat = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], ["x", "y"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), flat, mask=pa.array(size == 0))

    return clip.asNondeterministic()  # so that a filter on what is left does not cut again


def kept_by_simplifying(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices stay: ends, and of each stretch the farthest one if it is farther off than ``tolerance``. A stack, not recursion, so length does not matter."""
    keep = np.zeros(len(points), bool)
    if len(points):
        keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        a, d, m = points[i], points[j] - points[i], points[i + 1 : j]
        length = float(d @ d)
        t = np.clip(((m - a) @ d) / length, 0, 1)[:, None] if length else np.zeros((len(m), 1))
        far = np.hypot(*(a + t * d - m).T)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return keep


def simplify_line(points: np.ndarray, tolerance: float) -> np.ndarray:
    """The vertices that :func:`kept_by_simplifying` keeps."""
    return points[kept_by_simplifying(points, tolerance)]


def simplify_for_zoom(zoom: int):
    """A function of a line column; nothing changes from zoom 12 on."""
    tolerance = 360 / 2**zoom / 2048

    @F.pandas_udf(RING)
    def simplify(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in lines:
            yield pd.Series([None if r is None else _rows(_xy(r) if zoom >= 12 else simplify_line(_xy(r), tolerance)) for r in s])

    return simplify


def surface_points(points: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each closed ring the middle of the widest stretch inside at half its height (moved off vertices); not a number for rings of fewer than four points or without a height."""
    n = len(size)
    found = np.full((n, 2), np.nan)
    ring = np.repeat(np.arange(n), size)
    x, y = points[:, 0], points[:, 1]
    low, high = np.full(n, np.inf), np.full(n, -np.inf)
    np.minimum.at(low, ring, y)
    np.maximum.at(high, ring, y)
    with np.errstate(invalid="ignore"):  # rings without points
        mid = (low + high) / 2
    # the heights of vertices on both sides of the middle
    above, below = np.full(n, np.inf), low.copy()
    up = (y >= mid[ring]) & (y > low[ring])
    np.minimum.at(above, ring[up], y[up])
    np.maximum.at(below, ring[~up], y[~up])
    good = (size >= 4) & (low < high)
    level = (below + above) / 2
    side = np.arange(len(points))[(np.arange(len(points)) - _starts(size)[ring] < size[ring] - 1) & good[ring]]
    r = ring[side]
    cross = (y[side] > level[r]) != (y[side + 1] > level[r])
    side, r = side[cross], r[cross]
    at = x[side] + (level[r] - y[side]) / (y[side + 1] - y[side]) * (x[side + 1] - x[side])
    order = np.lexsort((at, r))
    at, r = at[order], r[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    left = np.flatnonzero(place % 2 == 0)
    left = left[left + 1 < len(r)]
    left = left[r[left] == r[left + 1]]
    width, owner = at[left + 1] - at[left], r[left]
    widest = np.lexsort((left, -width, owner))  # the first of the widest
    owners, first = np.unique(owner[widest], return_index=True)
    k = left[widest[first]]
    found[owners] = np.column_stack([(at[k] + at[k + 1]) / 2, level[owners]])
    return found


def surface_point(ring: np.ndarray) -> tuple[float, float] | None:
    """:func:`surface_points` of one ring."""
    x, y = surface_points(ring, np.array([len(ring)]))[0]
    return None if np.isnan(x) else (float(x), float(y))


def polygon_representative():
    """A function of a ring column: a point on its surface."""

    @F.arrow_udf("struct<x:double,y:double>")
    def point(rings: pa.Array) -> pa.Array:
        found = surface_points(*_spread(rings))
        none = np.isnan(found[:, 0])
        return pa.StructArray.from_arrays([pa.array(found[:, k], mask=none) for k in (0, 1)], ["x", "y"])

    return point.asNondeterministic()
