"""General areas: points, lines, unions, simplified borders and tiles against plain Python."""

import math
import random
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from gridloom.operators import arcs, areas, tiles

RINGS = "area int, ring int, k int, x double, y double"
U = [(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6)]  # open at the top
#: Areas by number: rings, the first a shell.
SHAPES = {
    1: [U],
    2: [[(0, 0), (8, 0), (8, 8), (0, 8)], [(2, 2), (2, 6), (6, 6), (6, 2)]],  # with a hole
    3: [[(0, 0), (8, 0), (8, 8), (0, 8)], [(2, 2), (2, 6), (6, 6), (6, 2)], [(3, 3), (5, 3), (5, 5), (3, 5)]],  # an island in the hole
    4: [[(10, 0), (12, 0), (12, 2), (10, 2)], [(14, 0), (16, 0), (15, 3)]],  # two parts
    5: [[(20, 0), (20, 0)]],  # nothing
    6: [[(-3, -3), (9, -3), (9, 9), (-3, 9), (-3, -3)]],  # closed
}


def tangle(seed, n, cx, cy, r):
    """A ring whose sides cross."""
    rng = random.Random(seed)
    return [(cx + r * rng.uniform(0.2, 1) * math.cos(2 * math.pi * k / n), cy + r * rng.uniform(0.2, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def star(seed, n, cx, cy, r):
    """A ring whose sides do not."""
    rng = random.Random(seed)
    return [(cx + d * math.cos(2 * math.pi * k / n), cy + d * math.sin(2 * math.pi * k / n)) for k in range(n) for d in (r * rng.uniform(0.2, 1),)]


SHAPES |= {7: [tangle(1, 200, 3, 3, 8)], 8: [star(2, 31, 10, 1, 4)]}


def vertices(spark, shapes):
    return spark.createDataFrame([(a, r, k, float(x), float(y)) for a, rings in shapes.items() for r, ring in enumerate(rings) for k, (x, y) in enumerate(ring)], RINGS)


def sides(rings):
    return [(p, q) for ring in rings for p, q in zip(ring, ring[1:] + ring[:1]) if p != q]


def covers(rings, x, y):
    inside = False
    for (ax, ay), (bx, by) in sides(rings):
        if (bx - ax) * (y - ay) - (by - ay) * (x - ax) == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return inside


def store(spark):
    def write(d, name):
        path = f"{tempfile.gettempdir()}/gridloom-test-{uuid.uuid4().hex}"
        d.write.parquet(path)
        return spark.read.schema(d.schema).parquet(path)

    return write


@pytest.mark.parametrize("cells", [2, 32])
def test_points_in_areas(spark, cells):
    """Random points, all vertices, middles of sides and whole numbers (many lie on borders), and no place."""
    rng = random.Random(5)
    pts = [(rng.uniform(-6, 18), rng.uniform(-6, 12)) for _ in range(400)] + [(float(x), float(y)) for x in range(-4, 18) for y in range(-4, 10)]
    pts += [p for rings in SHAPES.values() for p, _ in sides(rings)] + [((p[0] + q[0]) / 2, (p[1] + q[1]) / 2) for k in (1, 2, 3, 4) for p, q in sides(SHAPES[k])]
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(pts)]
    d = spark.createDataFrame([*rows, (-1, None, 1.0)], "id int, x double, y double")
    got = sorted((r.id, r.area) for r in areas.points_in_areas(d, areas.ring_edges(vertices(spark, SHAPES)), ["id"], cells).collect())
    assert got == sorted((i, a) for i, x, y in rows for a, rings in SHAPES.items() if covers(rings, x, y))


def plain_stretches(rings, x1, y1, x2, y2):
    ts = {0.0, 1.0}
    rx, ry = x2 - x1, y2 - y1
    for (ax, ay), (bx, by) in sides(rings):
        d = rx * (by - ay) - ry * (bx - ax)
        if d:
            t, u = ((ax - x1) * (by - ay) - (ay - y1) * (bx - ax)) / d, ((ax - x1) * ry - (ay - y1) * rx) / d
            ts |= {t} if -1e-9 <= u <= 1 + 1e-9 and 0 < t < 1 else set()
        elif (ax - x1) * ry == (ay - y1) * rx:
            ts |= {t for t in (((x - x1) * rx + (y - y1) * ry) / (rx * rx + ry * ry) for x, y in ((ax, ay), (bx, by))) if 0 < t < 1}
    ts, out = sorted(ts), []
    for a, b in zip(ts, ts[1:]):
        if b - a > 1e-12 and covers(rings, x1 + (a + b) / 2 * rx, y1 + (a + b) / 2 * ry):
            out = [*out[:-1], (out[-1][0], b)] if out and a - out[-1][1] <= 1e-12 else [*out, (a, b)]
    return out


def test_lines_in_areas(spark):
    """Lines across concave areas and holes, along borders, through corners, far off, of no length."""
    rng = random.Random(6)
    lines = [tuple(rng.uniform(-6, 18) for _ in range(4)) for _ in range(150)] + [tuple(float(rng.randrange(-4, 12)) for _ in range(4)) for _ in range(150)]
    lines += [(-5.0, 3.0, 20.0, 3.0), (0.0, 0.0, 6.0, 0.0), (-2.0, 0.0, 20.0, 0.0), (2.0, 2.0, 2.0, 6.0), (100.0, 100.0, 101.0, 101.0), (3.0, 3.0, 3.0, 3.0), (-1000.0, 1.0, 1000.0, 1.5)]
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(lines)], "id int, x1 double, y1 double, x2 double, y2 double")
    edges = areas.ring_edges(vertices(spark, SHAPES))
    got = sorted((r.id, r.area, round(r.t0, 9), round(r.t1, 9)) for r in areas.lines_in_areas(d, edges, ["id"]).collect())
    want = sorted((i, a, round(s, 9), round(t, 9)) for i, x in enumerate(lines) if x[:2] != x[2:] for a, rings in SHAPES.items() for s, t in plain_stretches(rings, *x))
    assert got == want
    met = {(r.id, r.area) for r in areas.lines_meeting_areas(d, edges, ["id"]).collect()}
    assert {(i, a) for i, a, *_ in want} <= met
    assert (305, 2) not in met and (305, 3) in met and (305, 6) in met  # the point 3, 3
    assert all(a != 5 for _, a in met) and not any(i == 304 for i, _ in met)


def plain_rings(cells):
    """Rings of a union of unit squares of a grid, by walking with the inside to the left and turning left where there is a choice."""
    out = {}
    for x, y in cells:
        for a, b, beside in (((x, y), (x + 1, y), (x, y - 1)), ((x + 1, y), (x + 1, y + 1), (x + 1, y)), ((x + 1, y + 1), (x, y + 1), (x, y + 1)), ((x, y + 1), (x, y), (x - 1, y))):
            if beside not in cells:
                out.setdefault(a, []).append(b)
    rings = []
    while out:
        a = min(out)
        ring, b = [a], min(out[a])
        out[a].remove(b)
        if not out[a]:
            del out[a]
        start = (a, b)
        while True:
            ring.append(b)
            d = (b[0] - a[0], b[1] - a[1])
            turn = lambda c: math.atan2(d[0] * (c[1] - b[1]) - d[1] * (c[0] - b[0]), d[0] * (c[0] - b[0]) + d[1] * (c[1] - b[1]))  # noqa: E731, B023
            if b not in out:
                break
            c = max(out[b], key=turn)
            if b == start[0] and turn(start[1]) > turn(c):
                break
            out[b].remove(c)
            if not out[b]:
                del out[b]
            a, b = b, c
        k = ring.index(min(ring[:-1]))
        body = ring[:-1]
        rings.append(tuple(body[k:] + body[:k] + [body[k]]))
    return sorted(rings)


def squares(cells, side=1):
    return {i: [[(x, y), (x + side, y), (x + side, y + side), (x, y + side)]] for i, (x, y) in enumerate(sorted(cells))}


def test_dissolve_of_squares(spark):
    """Random patterns with holes, islands and corners that touch, one group each; some squares run clockwise."""
    rng = random.Random(8)
    rows, want = [], {}
    for g in range(5):
        cells = {(x, y) for x in range(7) for y in range(7) if rng.random() < 0.35 + 0.12 * g}
        want[g] = plain_rings(cells)
        for i, rings in squares(cells).items():
            ring = rings[0][::-1] if i % 3 == 0 else rings[0]
            rows += [(g, 100 * g + i, 0, k, float(x), float(y)) for k, (x, y) in enumerate(ring)]
    d = spark.createDataFrame(rows, "grp int, area int, ring int, k int, x double, y double")
    edges = areas.ring_edges(d).join(d.select("area", "grp").distinct(), "area")
    got = areas.dissolve(edges, store(spark)).collect()
    for g, rings in want.items():
        mine = [r for r in got if r.grp == g]
        assert sorted(tuple((p.x, p.y) for p in r.points) for r in mine) == [tuple((float(x), float(y)) for x, y in r) for r in rings]
        assert sum(r.signed_area for r in mine) == len({r.area for r in d.where(F.col("grp") == g).select("area").collect()})
        by = {r.ring: r for r in mine}
        for r in mine:
            if r.signed_area > 0:
                assert r.shell == r.ring
            else:
                shell = by[r.shell]
                assert shell.signed_area > -r.signed_area and all(covers([[(p.x, p.y) for p in shell.points[:-1]]], p.x, p.y) for p in r.points)


def test_dissolve_across_different_vertices(spark):
    """A large square beside two small ones and one with a hole that another fills: borders cancel though their vertices differ."""
    shapes = {1: [[(0, 0), (4, 0), (4, 4), (0, 4)]], 2: [[(4, 0), (6, 0), (6, 2), (4, 2)]], 3: [[(4, 2), (6, 2), (6, 4), (4, 4)]], 4: [[(10, 0), (14, 0), (14, 4), (10, 4)], [(11, 1), (13, 1), (13, 3), (11, 3)]], 5: [[(11, 1), (13, 1), (13, 3), (11, 3)]]}
    v = vertices(spark, shapes)
    edges = areas.ring_edges(v).withColumn("grp", F.when(F.col("area") < 4, "a").otherwise("b"))
    got = {r.grp: r for r in areas.dissolve(edges, store(spark)).collect()}
    assert sorted(got) == ["a", "b"] and got["a"].signed_area == 24.0 and got["b"].signed_area == 16.0
    assert [(p.x, p.y) for p in got["b"].points] == [(10, 0), (14, 0), (14, 4), (10, 4), (10, 0)]
    assert areas.dissolve(edges.limit(0), store(spark)).count() == 0


def wavy(n, m, seed, size=1.0):
    """A grid of n x n areas with crooked sides of m points each that neighbours share."""
    rng, off = random.Random(seed), {}

    def at(gx, gy):
        if (gx, gy) not in off:
            d = rng.uniform(-0.035, 0.035)
            off[gx, gy] = (0, 0) if gx % m == 0 and gy % m == 0 else (0, d) if gy % m == 0 else (d, 0)
        dx, dy = off[gx, gy]
        return (gx / m + dx) * size, (gy / m + dy) * size

    out = {}
    for c in range(n):
        for r in range(n):
            x, y = c * m, r * m
            ring = [(x + j, y) for j in range(m)] + [(x + m, y + j) for j in range(m)] + [(x + m - j, y + m) for j in range(m)] + [(x, y + m - j) for j in range(m)]
            out[c * n + r] = [[at(*p) for p in ring]]
    return out


def area_of(ring):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1])) / 2


def crossing(s, t):
    (a, b), (c, d) = s, t
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    apart = any(max(a[i], b[i]) < min(c[i], d[i]) or max(c[i], d[i]) < min(a[i], b[i]) for i in (0, 1))
    return not apart and len({a, b, c, d}) == 4 and turn(a, b, c) * turn(a, b, d) <= 0 and turn(c, d, a) * turn(c, d, b) <= 0


@pytest.mark.parametrize("tolerance", [0.03, 0.3, 5.0])
def test_simplified_neighbours_keep_one_border(spark, tolerance):
    """A coverage with an island, an area in a hole, and a small area in a bay that a chord would pass: no gap, no overlap, no crossing."""
    shapes = wavy(3, 12, 3)
    island = star(9, 40, 8, 1.5, 1)
    shapes[20] = [island]
    hole = star(10, 30, 8, 6, 1)
    shapes[21], shapes[22] = [[(6, 4), (10, 4), (10, 8), (6, 8)], hole], [hole]
    shapes[23] = [[(12, 0), (16, 0), (16, 0.2), (14.2, 0.2), (14, 0.02), (13.8, 0.2), (12, 0.2)]]
    shapes[24] = [[(13.97, 0.15), (14.03, 0.15), (14, 0.18)]]
    given = [x for rings in shapes.values() for x in sides(rings)]
    assert not any(crossing(s, t) for i, s in enumerate(given) for t in given[:i])
    rows = arcs.simplify_areas(vertices(spark, shapes), tolerance, store(spark)).collect()
    after = {(r.area, r.ring): [(p.x, p.y) for p in r.points] for r in rows}
    assert set(after) == {(a, k) for a, rings in shapes.items() for k in range(len(rings))}
    assert all(r[0] == r[-1] and len(set(r)) >= 3 for r in after.values())
    # every border line between two areas is in both of them, in opposite directions; outer lines are in one
    lines = {}
    for key, ring in after.items():
        for p, q in zip(ring, ring[1:]):
            lines.setdefault(frozenset((p, q)), []).append((key, p))
    assert all(len(v) <= 2 for v in lines.values())
    whole = [[(x, y) for x, y in after[a, 0][:-1]] for a in range(9)]
    before = [shapes[a][0] for a in range(9)]
    outer = [v[0][1] for k, v in lines.items() if len(v) == 1 and v[0][0][0] < 9]
    assert outer and sum(len(v) == 2 for k, v in lines.items() if v[0][0][0] < 9) >= 12
    assert all(abs(area_of(a) - area_of(b)) < 1 for a, b in zip(whole, before))
    sides_ = [tuple(k) for k in lines]
    assert not any(crossing(s, t) for i, s in enumerate(sides_) for t in sides_[:i])
    assert sum(map(len, after.values())) < sum(len(r) + 1 for rings in shapes.values() for r in rings)
    # the small area stays in its bay
    assert not any(covers([after[23, 0][:-1]], *p) for p in after[24, 0])


def test_polygon_tiles(spark):
    """Against every tile of the box: touched by a side, or its middle inside."""
    zones = {1: [[(18.0, 49.8), (18.6, 49.75), (18.7, 50.2), (18.35, 49.95), (18.05, 50.15)], [(18.2, 49.84), (18.2, 49.88), (18.3, 49.88), (18.3, 49.84)]], 2: [[(-0.2, -0.2), (0.3, -0.1), (0.1, 0.3)]]}
    d = tiles.polygon_tiles(areas.ring_edges(vertices(spark, zones)), max_zoom=12)
    got = {(r.area, r.z, r.x, r.y): r.whole for r in d.collect()}
    merged = {(r.area, r.z, r.x, r.y) for r in tiles.merged_whole_tiles(d).collect()}
    north = lambda y, z: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / 2**z))))
    tx = lambda v, z: math.floor((v + 180) / 360 * 2**z)
    ty = lambda v, z: math.floor((1 - math.asinh(math.tan(math.radians(v))) / math.pi) / 2 * 2**z)
    want = {}
    for a, rings in zones.items():
        xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
        for z in range(7, 13):
            for x in range(tx(min(xs), z), tx(max(xs), z) + 1):
                for y in range(ty(max(ys), z), ty(min(ys), z) + 1):
                    w, e, n, s = x / 2**z * 360 - 180, (x + 1) / 2**z * 360 - 180, north(y, z), north(y + 1, z)
                    turn = lambda p, q, cx, cy: (q[0] - p[0]) * (cy - p[1]) - (q[1] - p[1]) * (cx - p[0])
                    touched = False
                    for p, q in sides(rings):
                        c = [turn(p, q, cx, cy) for cx in (w, e) for cy in (s, n)]
                        touched |= min(p[0], q[0]) <= e and max(p[0], q[0]) >= w and min(p[1], q[1]) <= n and max(p[1], q[1]) >= s and min(c) <= 0 <= max(c)
                    if touched or covers(rings, (w + e) / 2, north(y + 0.5, z)):
                        want[a, z, x, y] = not touched
    assert got == want and any(want.values())
    whole = {k for k, v in want.items() if v}
    assert merged == {(a, z, x, y) for a, z, x, y in whole if (a, z - 1, x // 2, y // 2) not in whole}


def test_areas_of_many_edges(spark):
    """A ring of thousands of edges has finer rows of cells; short and long lines and paths, and points on its corners, against plain Python."""
    rng = random.Random(11)
    shapes = {1: [star(4, 3000, 3, 3, 4)], 2: [U]}
    frame = {r.area: r.fine for r in areas.frames(areas.ring_edges(vertices(spark, shapes))).collect()}
    assert frame == {1: 4, 2: 0}
    edges = areas.ring_edges(vertices(spark, shapes))
    pts = [(rng.uniform(-2, 8), rng.uniform(-2, 8)) for _ in range(60)] + shapes[1][0][::200]
    d = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id int, x double, y double")
    assert sorted((r.id, r.area) for r in areas.points_in_areas(d, edges, ["id"]).collect()) == sorted((i, a) for i, p in enumerate(pts) for a, rings in shapes.items() if covers(rings, *p))
    lines = [(x, y, x + rng.uniform(-s, s), y + rng.uniform(-s, s)) for s in (0.02, 0.3, 6) for x, y in ((rng.uniform(-1, 7), rng.uniform(-1, 7)) for _ in range(12))]
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(lines)], "id int, x1 double, y1 double, x2 double, y2 double")
    want = sorted((i, a, round(s, 8), round(t, 8)) for i, x in enumerate(lines) for a, rings in shapes.items() for s, t in plain_stretches(rings, *x))
    assert sorted((r.id, r.area, round(r.t0, 8), round(r.t1, 8)) for r in areas.lines_in_areas(d, edges, ["id"]).collect()) == want
    paths = d.groupBy((F.col("id") % 12).alias("id")).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("parts"))
    assert {(r.id, r.area) for r in areas.paths_meeting_areas(paths, edges, ["id"]).collect()} == {(i % 12, a) for i, a, *_ in want}
