"""Hierarchies, nested relations and crossing sides against plain Python."""

import math
import random
import time

from pyspark.sql import functions as F

from gridloom.operators import hierarchy, validity
from tests.test_areas import store


def test_climb(spark):
    """Long chains, a cycle, what hangs on it, a parent that is not there, roots of other kinds, null ids."""
    parent = {i: i - 1 for i in range(1, 300)} | {0: None, 500: 501, 501: 502, 502: 500, 503: 502, 504: 503, 600: 999, 601: 600, 700: None, 701: 700, 800: 800}
    kind = {i: "top" if i == 0 else "x" for i in parent}
    d = spark.createDataFrame([(i, p, kind[i]) for i, p in parent.items()] + [(None, 0, "x")], "id int, parent_id int, kind string")
    got = {r.id: (r.root, r.depth, r.problem) for r in hierarchy.climb(d, store(spark), "top").collect()}

    def plain(i):
        seen = []
        while i not in seen:
            seen.append(i)
            if parent[i] is None:
                return i, len(seen) - 1, None if kind[i] == "top" else "kind"
            if parent[i] not in parent:
                return None, None, "missing_parent"
            i = parent[i]
        return None, None, "cycle"

    assert got == {i: plain(i) for i in parent}
    s = spark.createDataFrame([(1, 5), (1, 7), (2, 5), (2, 701), (3, 503), (4, 12345), (5, 5), (5, 5), (6, 601)], "request_id int, unit int")
    assert {r.request_id: (r.n_roots, r.root, r.problem) for r in hierarchy.selection_roots(s, hierarchy.climb(d, store(spark))).collect()} == {
        1: (1, 0, None), 2: (2, None, "several_roots"), 3: (0, None, "cycle"), 4: (0, None, "unknown_unit"), 5: (1, 0, None), 6: (0, None, "missing_parent")}
    assert hierarchy.climb(d.limit(0), store(spark)).count() == 0


def test_nested_relations(spark):
    inner = {1: [2, 3], 2: [4], 3: [], 4: [5], 5: [2], 6: [], 7: [99]} | {i: [i + 1] for i in range(10, 40)}
    ways = {3: [30], 5: [50, 51], 6: [60], 40: [400], 10: [30]}
    rows = [(r, "relation", x) for r, xs in inner.items() for x in xs] + [(r, "way", w) for r, ws in ways.items() for w in ws] + [(6, "node", 1), (4, "node", 500)]
    d = spark.createDataFrame(rows, "relation_id int, type string, ref int")
    nodes = spark.createDataFrame([(50, 500), (50, 501), (30, 300)], "way_id int, node_id int")

    def below(r):
        seen, todo = {r}, [r]
        while todo:
            for x in inner.get(todo.pop(), []):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    named = {r for r, *_ in rows}
    pairs = {(r.relation_id, r.inner) for r in hierarchy.nested_relations(d, store(spark)).collect()}
    assert pairs == {(r, x) for r in named for x in below(r)}
    want = {("relation", x, r) for r, x in pairs if r != x} | {(t, ref, r) for r, x in pairs for q, t, ref in rows if q == x and t != "relation"}
    want |= {("node", n, r) for t, w, r in want if t == "way" for a, n in ((50, 500), (50, 501), (30, 300)) if a == w}
    assert {(r.type, r.ref, r.relation_id) for r in hierarchy.member_index(d, nodes, store(spark)).collect()} == want


def plain_crossing(line):
    s, closed = list(zip(line, line[1:])), line[0] == line[-1]
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) > 0
    cross = lambda p, q: turn(*p, q[0]) != turn(*p, q[1]) and turn(*q, p[0]) != turn(*q, p[1])
    return any(cross(s[i], s[j]) for i in range(len(s)) for j in range(i + 2, len(s)) if not (closed and i == 0 and j == len(s) - 1))


def test_crossing_sides(spark):
    rng = random.Random(3)
    lines = [[(rng.uniform(0, 5), rng.uniform(0, 5)) for _ in range(rng.randrange(2, 9))] for _ in range(60)]
    lines += [p + p[:1] for p in lines[:30]] + [[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)], [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)], [(0.0, 0.0), (100.0, 0.0), (50.0, -1.0), (50.0, 1.0)], [(1, 1)]]
    d = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in p]) for i, p in enumerate(lines)], "id int, line array<struct<x:double,y:double>>")
    got = {r.id: r.self_crossing for r in validity.with_crossing(d, ["id"]).collect()}
    assert got == {i: plain_crossing(p) for i, p in enumerate(lines)}
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    kinds = spark.createDataFrame([(1, square, "Polygon"), (2, [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)], "Polygon"), (3, [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)], "Polygon")], "id int, line array<struct<x:double,y:double>>, kind string")
    assert {r.id: r.k for r in validity.with_crossing(kinds, ["id"]).select("id", validity.kind_or_line(F.col("kind")).alias("k")).collect()} == {1: "Polygon", 2: "LineString", 3: "LineString"}


def test_a_ring_of_many_points(spark):
    """100,000 points in seconds; one side out of place is found."""
    n = 100_000
    x, y = F.cos(2 * math.pi * F.col("id") / n), F.sin(2 * math.pi * F.col("id") / n)
    r = 1 + 0.2 * F.sin(40 * math.pi * F.col("id") / n)
    rows = spark.range(n).select(F.lit(1).alias("line_id"), F.col("id"), (x * r).alias("ax"), (y * r).alias("ay"))
    nxt = F.col("id") + 1
    r2 = 1 + 0.2 * F.sin(40 * math.pi * nxt / n)
    sides = rows.select("line_id", (F.col("id") + 1).alias("k"), F.lit(n).alias("n"), F.lit(True).alias("closed"), "ax", "ay", (F.cos(2 * math.pi * nxt / n) * r2).alias("bx"), (F.sin(2 * math.pi * nxt / n) * r2).alias("by"))
    began = time.time()
    assert validity.crossing_lines(sides, ["line_id"]).count() == 0
    assert time.time() - began < 60
    bad = sides.withColumns({"bx": F.when(F.col("k") == 700, -2.0).otherwise(F.col("bx")), "by": F.when(F.col("k") == 700, 0.01).otherwise(F.col("by"))})
    assert validity.crossing_lines(bad, ["line_id"]).count() == 1
