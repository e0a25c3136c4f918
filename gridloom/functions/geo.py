"""Geometry as Columns: projection, distances, clipping of segments, rings, tiles.

Points are pairs of columns. The metric plane is EPSG:2180: a transverse Mercator series (Krueger) on GRS80.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the projection.
_A, _INV_F, _LON0, _K0, _FE, _FN = 6378137.0, 298.257222101, 19.0, 0.9993, 500000.0, -5300000.0
_FL = 1 / _INV_F
_N = _FL / (2 - _FL)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = math.sqrt(_FL * (2 - _FL))
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
EARTH_RADIUS = 6371008.8
MAX_LATITUDE = 85.05112878


def to_metric(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(x east, y north) in metres of a longitude and latitude in degrees."""
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    d = F.radians(lon - _LON0)
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _FE + _K0 * _RECT * x, _FN + _K0 * _RECT * y


def with_metric(df: DataFrame, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y") -> DataFrame:
    """``df`` with the metric ``x`` and ``y`` of a longitude and latitude. Each step of the series goes through an exploded array of one element, which the optimizer does not
    merge with what reads it, so a filter or an aggregate on the result does not work the series out again and again."""
    s = F.sin(F.radians(F.col(lat)))
    d = df.withColumn("_p", F.explode(F.array(F.struct(F.sinh(F.atanh(s) - _E * F.atanh(_E * s)).alias("t"), F.radians(F.col(lon) - _LON0).alias("d")))))
    t, e = F.col("_p.t"), F.col("_p.d")
    d = d.withColumn("_q", F.explode(F.array(F.struct(F.atan2(t, F.cos(e)).alias("xi"), F.atanh(F.sin(e) / F.sqrt(1 + t * t)).alias("eta")))))
    xi, eta = F.col("_q.xi"), F.col("_q.eta")
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    d = d.withColumn("_r", F.explode(F.array(F.struct((_FE + _K0 * _RECT * east).alias("x"), (_FN + _K0 * _RECT * north).alias("y")))))
    return d.select(*df.columns, F.col("_r.x").alias(x), F.col("_r.y").alias(y))


def circle_box(lon: float, lat: float, r: float) -> tuple[float, float, float, float]:
    """A box in degrees (west, south, east, north) around a circle, a little too large: what a scan can be asked for."""
    dy = 1.01 * r / 111_000
    dx = 1.01 * r / (111_000 * math.cos(math.radians(abs(lat) + dy)))
    return lon - dx, lat - dy, lon + dx, lat + dy


def to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """The inverse of :func:`to_metric`."""
    xi, eta = (y - _FN) / (_K0 * _RECT), (x - _FE) / (_K0 * _RECT)
    u, v = xi, eta
    for j, b in enumerate(_BETA, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return _LON0 + F.degrees(F.atan2(F.sinh(v), F.cos(u))), F.degrees(lat)


def metric_point(lon: float, lat: float) -> tuple[float, float]:
    """:func:`to_metric` of two numbers, for constants of a plan."""
    s = math.sin(math.radians(lat))
    t = math.sinh(math.atanh(s) - _E * math.atanh(_E * s))
    d = math.radians(lon - _LON0)
    xi, eta = math.atan2(t, math.cos(d)), math.atanh(math.sin(d) / math.sqrt(1 + t * t))
    x = eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    y = xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    return _FE + _K0 * _RECT * x, _FN + _K0 * _RECT * y


def segment_distance(px, py, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / length))).otherwise(0.0)
    return F.hypot(x1 + t * dx - px, y1 + t * dy - py)


def clip_to_circle(cx, cy, r, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """The part of a segment inside a circle as parameters (t_in, t_out); t_in > t_out where nothing is inside."""
    dx, dy, fx, fy = x2 - x1, y2 - y1, x1 - cx, y1 - cy
    a, b, c = dx * dx + dy * dy, fx * dx + fy * dy, fx * fx + fy * fy - r * r
    disc = b * b - a * c
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    inside = F.when(c <= 0, 1.0).otherwise(-1.0)
    t_in = F.when(a == 0, 0.0).when(disc < 0, 1.0).otherwise(F.greatest(F.lit(0.0), (-b - root) / a))
    t_out = F.when(a == 0, inside).when(disc < 0, 0.0).otherwise(F.least(F.lit(1.0), (-b + root) / a))
    return t_in, t_out


def circle_parts(sides: Column, r: Column) -> Column:
    """For each side (struct px, py, qx, qy) of an array the signed area between the centre of a circle of radius ``r`` at 0, 0 and the side, as far as it lies in the circle. Over
    the sides of a polygon they add up to its area in the circle."""

    def cut(s):
        t_in, t_out = clip_to_circle(F.lit(0.0), F.lit(0.0), r, s["px"], s["py"], s["qx"], s["qy"])
        return F.struct(s.alias("s"), t_in.alias("a"), t_out.alias("b"))

    def ends(c):
        s = c["s"]
        dx, dy = s["qx"] - s["px"], s["qy"] - s["py"]
        return F.struct(s.alias("s"), (c["a"] < c["b"]).alias("meets"), (s["px"] + c["a"] * dx).alias("ux"), (s["py"] + c["a"] * dy).alias("uy"), (s["px"] + c["b"] * dx).alias("vx"), (s["py"] + c["b"] * dy).alias("vy"))

    def area(c):
        s = c["s"]
        sector = lambda ax, ay, bx, by: r * r / 2 * F.atan2(ax * by - ay * bx, ax * bx + ay * by)
        inner = sector(s["px"], s["py"], c["ux"], c["uy"]) + (c["ux"] * c["vy"] - c["uy"] * c["vx"]) / 2 + sector(c["vx"], c["vy"], s["qx"], s["qy"])
        return F.when(c["meets"], inner).otherwise(sector(s["px"], s["py"], s["qx"], s["qy"]))

    return F.transform(F.transform(F.transform(sides, cut), ends), area)


def clip_to_box(xmin, ymin, xmax, ymax, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Like :func:`clip_to_circle` for a box: each side narrows the parameter range. No side's part holds that of another, so the expression grows with their number only."""
    sides = [(p, q, q / F.when(p != 0, p)) for p, q in ((x1 - x2, x1 - xmin), (x2 - x1, xmax - x1), (y1 - y2, y1 - ymin), (y2 - y1, ymax - y1))]
    t_in = F.greatest(F.lit(0.0), *[F.when(p < 0, t).when((p == 0) & (q < 0), 2.0) for p, q, t in sides])
    return t_in, F.least(F.lit(1.0), *[F.when(p > 0, t) for p, _, t in sides])


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point against an array of points (struct x, y), closed or not; a point on an edge is inside."""
    n = F.size(ring)

    def step(acc, i):
        a, b = F.element_at(ring, i), F.element_at(ring, i % n + 1)
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        within = x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        odd = ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"])
        return F.struct((acc["edge"] | ((cross == 0) & within)).alias("edge"), (acc["odd"] != F.coalesce(odd, F.lit(False))).alias("odd"))

    start = F.struct(F.lit(False).alias("edge"), F.lit(False).alias("odd"))
    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda a: a["edge"] | a["odd"])


def once(d: DataFrame, name: str, **values: Column) -> DataFrame:
    """``d`` with a struct of ``values`` that are worked out once for each row, however often and wherever they are read: an exploded array of one element is not merged with its readers."""
    return d.withColumn(name, F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once. In a function of array elements a Column is worked out again wherever it is named, for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ring_area(ring: Column) -> Column:
    """Area inside an array of points (struct x, y)."""
    return let(ring, _ring_area)


def _ring_area(ring: Column) -> Column:
    n = F.size(ring)
    twice = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, i: s + F.element_at(ring, i)["x"] * F.element_at(ring, i % n + 1)["y"] - F.element_at(ring, i % n + 1)["x"] * F.element_at(ring, i)["y"])
    return F.abs(twice) / 2


def circle_ring(cx: Column, cy: Column, r: Column, segments: int = 32) -> Column:
    """A closed ring of equal angles around a metric centre, as degrees rounded to 7 decimals."""

    def point(i):
        angle = i.cast("double") * (2 * math.pi / segments)
        lon, lat = to_degrees(cx + r * F.cos(angle), cy + r * F.sin(angle))
        return F.struct(F.round(lon, 7).alias("x"), F.round(lat, 7).alias("y"))

    return F.transform(F.concat(F.sequence(F.lit(0), F.lit(segments - 1)), F.array(F.lit(0))), point)


def great_circle_points(areas: DataFrame, segments: int = 64) -> DataFrame:
    """``areas`` (lon, lat and r in metres) once for each point of the closed ring at distance ``r`` over the sphere: ``pos, ring_lon, ring_lat``. Rows rather than arrays, so that it runs in generated code."""
    d = areas.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(segments))))
    b, phi, lam, far = (F.col("pos") % segments).cast("double") * (2 * math.pi / segments), F.radians("lat"), F.radians("lon"), F.col("r") / EARTH_RADIUS
    p = F.sin(phi) * F.cos(far) + F.cos(phi) * F.sin(far) * F.cos(b)
    d = d.withColumn("_p", F.explode(F.array(F.asin(p))))  # worked out once
    q = lam + F.atan2(F.sin(b) * F.sin(far) * F.cos(phi), F.cos(far) - F.sin(phi) * F.sin("_p"))
    return d.withColumns({"ring_lon": F.degrees(q), "ring_lat": F.degrees("_p")}).drop("_p")


def canonical_ring(ring: Column) -> Column:
    """The ring as text: coordinates rounded to 7 decimals, starting at its least point, closed."""
    opened = lambda r: F.when(F.element_at(r, 1) == F.element_at(r, -1), F.slice(r, 1, F.size(r) - 1)).otherwise(r)
    start = lambda o: F.struct(o.alias("o"), F.array_position(o, F.array_min(o)).cast("int").alias("at"))
    turned = lambda s: F.concat(F.slice(s["o"], s["at"], F.size(s["o"]) - s["at"] + 1), F.slice(s["o"], 1, s["at"] - 1))
    text = lambda p: F.concat_ws(" ", F.format_string("%.7f", p["x"]), F.format_string("%.7f", p["y"]))
    rounded = F.transform(ring, lambda p: F.struct(F.round(p["x"], 7).alias("x"), F.round(p["y"], 7).alias("y")))
    closed = lambda t: F.concat(t, F.slice(t, 1, 1))
    return F.array_join(F.transform(let(let(let(let(rounded, opened), start), turned), closed), text), ",")


# ---- tiles


def tile_x(lon: Column, z: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    return F.greatest(F.lit(0), F.least(n - 1, F.floor((lon + 180) / 360 * n))).cast("int")


def tile_y(lat: Column, z: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    phi = F.radians(F.greatest(F.lit(-MAX_LATITUDE), F.least(F.lit(MAX_LATITUDE), lat)))
    return F.greatest(F.lit(0), F.least(n - 1, F.floor((1 - F.asinh(F.tan(phi)) / math.pi) / 2 * n))).cast("int")


def tile_west(x: Column, z: Column) -> Column:
    return x / F.pow(F.lit(2.0), z) * 360 - 180


def tile_north(y: Column, z: Column) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / F.pow(F.lit(2.0), z)))))


def hilbert(x: Column, y: Column, bits: int) -> Column:
    """Place of a cell along a Hilbert curve of 2**bits by 2**bits cells."""

    def step(acc, i):
        s = F.pow(F.lit(2.0), F.lit(bits) - i).cast("long")
        px, py = acc["x"], acc["y"]
        rx, ry = (F.floor(px / s) % 2).cast("long"), (F.floor(py / s) % 2).cast("long")
        d = acc["d"] + s * s * ((3 * rx).bitwiseXOR(ry))
        fx, fy = F.when((ry == 0) & (rx == 1), s - 1 - px % s).otherwise(px % s), F.when((ry == 0) & (rx == 1), s - 1 - py % s).otherwise(py % s)
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(bits)), start, step, lambda a: a["d"])
