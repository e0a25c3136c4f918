"""What keeps the queries' work in proportion to their input: results against plain code, and plans that do a step once."""

import numpy as np
from pyspark.sql import functions as F

from gridloom import registry
from gridloom.functions import geo, polygons
from gridloom.operators import hexgrid, snapshots

SF = "/root/testdata/sf0.001"


def optimized(spark, name) -> str:
    return registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_rings_are_worked_out_once(spark):
    assert optimized(spark, "canonical_ring").count("array_min(") == 1
    assert optimized(spark, "geodesic_ring").count("asin(") == 1 and "lambda" not in optimized(spark, "geodesic_ring")
    assert optimized(spark, "aoi_area_limit").count("atanh(") <= 4


def test_rings_are_cut_by_the_batch():
    area = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
    square = np.array([(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)], float)
    points, size = polygons.clip_rings(np.concatenate([square, square + 10, square + 2]), np.array([5, 5, 0, 5]), area)
    assert size.tolist() == [5, 0, 0, 5] and sorted(map(tuple, points[:4])) == [(0, 0), (0, 1), (1, 0), (1, 1)] and (points[0] == points[4]).all() and (points[5:] == square + 2).all()
    got = polygons.surface_points(np.concatenate([square, square[:3], square + 10]), np.array([5, 3, 0, 5]))
    assert np.isnan(got[1:3]).all() and got[0].tolist() == [0, 0] and got[3].tolist() == [10, 10]


def test_rings_are_cut_once(spark):
    for name in ("clip_polygons", "clip_unless_boundary"):
        plan = optimized(spark, name)
        assert plan.count("clip(") == 1


def test_boxes_meet_as_all_pairs_do(spark):
    rng = np.random.default_rng(7)

    def boxes(n, size):
        low = np.round(rng.uniform(0, 4, (n, 2)), 2)
        high = low + np.round(rng.uniform(0, size, (n, 2)), 2)
        return [tuple(map(float, (*a, *b))) for a, b in zip(low, high)]

    for size in (0.02, 0.8):
        mine, theirs = boxes(150, size) + boxes(1, 0) * 3, boxes(60, size)
        want = {b for b in mine if any(b[0] <= o[2] and b[2] >= o[0] and b[1] <= o[3] and b[3] >= o[1] for o in theirs)}
        frame = lambda rows: spark.createDataFrame(rows, ", ".join(f"{c} double" for c in snapshots.BOX))
        got = [tuple(r) for r in snapshots.meeting_boxes(frame(mine), frame(theirs), 0.1).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_requests_text_is_made_before_its_layers(spark):
    plan = optimized(spark, "reference_coverage").split("join", 1)
    assert "format_string" not in plan[0] and "format_string" in plan[1]


def test_steps_of_hexes_and_tiles_are_worked_out_once(spark):
    """The tests of a hex and of a tile do not repeat one step in the next: sides of a tile are four sinh, a filter reads what is there."""
    plan = optimized(spark, "tile_features")
    assert plan.count("sinh(") <= 6  # the band of a row and the bounds of a tile
    a, b = geo.clip_to_box(*[F.col(k) for k in "wsenabcd"])
    assert len(str(a)) < 2000 and len(str(b)) < 2000
    d = hexgrid.segment_hexes(spark.createDataFrame([(1, "local", 500.0, 0.0, 0.0, 4000.0, 0.0, 0.0, 900.0, 700.0)], "aoi_id int, level string, edge double, cx double, cy double, r double, cx1 double, cy1 double, cx2 double, cy2 double"))
    assert max(len(line) for line in d._jdf.queryExecution().optimizedPlan().toString().splitlines()) < 6000
    assert abs(d.agg(F.sum("hex_length")).first()[0] - (900**2 + 700**2) ** 0.5) < 1e-6


def test_no_task_holds_more_than_its_keys(spark):
    """Tiles are counted without their features as keys, and areas are told apart before the domains are laid out."""
    from gridloom.operators import tiles

    assert "source_id" not in optimized(spark, "tile_counts").splitlines()[0].split("aggregate [")[1].split("]")[0]
    assert optimized(spark, "tile_counts").count("expand") == 0 and sum("aggregate [z" in x for x in optimized(spark, "tile_counts").splitlines()) == 1
    assert "explode" in optimized(spark, "profile_outcomes").split("join")[0] and "explode" not in optimized(spark, "profile_outcomes").split("join", 1)[1]
    rows = spark.createDataFrame([(7, 1, 1, "line", 5), (7, 1, 1, "line", 5), (7, 1, 1, "line", 6)], "z int, x int, y int, layer string, source_id long")
    assert tiles.tile_counts(rows).first()["n_features"] == 2 and tiles.tile_counts(rows.distinct(), once_each=True).first()["n_features"] == 2


def test_rules_are_asked_of_sets_of_tags(spark):
    for name in ("layer_assignment", "presentation_rows"):
        plan = optimized(spark, name).splitlines()
        rules = next(i for i, line in enumerate(plan) if "filter(array(" in line)
        depth = len(plan[rules]) - len(plan[rules].lstrip(" :+-"))
        below = [x for x in plan[rules + 1:]]
        own = below[: next((i for i, x in enumerate(below) if len(x) - len(x.lstrip(" :+-")) <= depth), len(below))]
        assert not any("l_orderkey" in x for x in own)


def test_pairs_with_areas_are_not_shuffled(spark):
    """What meets an area is settled in the row where the two meet: nothing is grouped, joined or dealt after that."""
    for name in ("points_in_areas", "lines_in_areas", "lines_meeting_areas"):
        steps = [line.lstrip(" :+-").split(" ")[0] for line in optimized(spark, name).splitlines()]
        assert set(steps[: steps.index("join")]) <= {"project", "filter", "generate"}, name


def test_places_meet_in_few_cells(spark):
    """Against all pairs, on places that lie on the sides of cells; a right feature is in far fewer than nine cells."""
    from gridloom.operators import quality

    rng = np.random.default_rng(4)
    place = lambda n: (np.round(rng.integers(-12, 12, (n, 2)) * 0.00005, 8) + rng.choice([0.0, 1e-6], (n, 2))).tolist()
    left, right = [(i, None, x, y) for i, (x, y) in enumerate(place(120))], [(i, None, x, y) for i, (x, y) in enumerate(place(120))]
    frame = lambda rows: spark.createDataFrame(rows, "id long, stable_id string, lon double, lat double")
    cell = lambda v: int(np.floor(v / 0.0001))
    want = {}
    for i, _, x, y in left:
        near = [(round(float(np.hypot(x - a, y - b)), 8), j) for j, _, a, b in right if np.hypot(x - a, y - b) <= 0.0001 and abs(cell(x) - cell(a)) <= 1 and abs(cell(y) - cell(b)) <= 1]
        want |= {i: min(near)[1]} if near else {}
    assert {r.id: r.right_id for r in quality.pairs(frame(left), frame(right)).collect()} == want and len(want) > 60
    assert "explode(array(" not in optimized(spark, "cross_source_pairs")


def test_short_lines_are_told_in_their_row(spark):
    """Both ways tell the same: by cells, and in the row of the line."""
    from gridloom.operators import validity

    rng = np.random.default_rng(9)
    lines = [[tuple(map(float, p)) for p in rng.integers(0, 5, (n, 2))] for n in (1, 2, 3, 4, 4, 5, 6, 7, 9) for _ in range(12)]
    lines = [p + [p[0]] if i % 3 == 0 else p for i, p in enumerate(lines)]
    d = spark.createDataFrame([(i, p) for i, p in enumerate(lines)], "id int, line array<struct<x:double,y:double>>")
    by_cells = {r.id for r in validity.crossing_lines(validity.line_sides(d, ["id"]), ["id"]).collect()}
    assert {r.id for r in validity.with_crossing(d, ["id"]).where("self_crossing").collect()} == by_cells and 20 < len(by_cells) < 90
    assert validity.SHORT >= 7


def test_boxes_are_dealt_before_their_tiles(spark):
    plan = optimized(spark, "tile_cover")
    assert "repartition" in plan and plan.count("asinh(") == 2


def test_pairs_with_areas_are_told_in_code_that_the_jvm_compiles(spark):
    """The step above the join is generated code, in methods below the 8000 bytes beyond which the JVM only interprets."""
    import re

    debug = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$")
    for name in ("points_in_areas", "lines_in_areas", "lines_meeting_areas"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().sparkPlan()
        lines = plan.toString().splitlines()
        above = lines[: next(i for i, line in enumerate(lines) if "Join" in line.split("[")[0])]
        assert "lambda" not in above[-1], name
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            text = debug.codegenString(registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan())
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
        assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)) < 8000, name


def test_lines_are_told_with_and_without_pieces(spark):
    """Shares of lines that cross plainly, and of those along borders, through corners and near many edges, against their pieces."""
    from gridloom.operators import areas

    rng = np.random.default_rng(12)
    ring = lambda points: [(float(x), float(y)) for x, y in points]
    star = [(5 + r * np.cos(a), 5 + r * np.sin(a)) for a, r in zip(np.linspace(0, 2 * np.pi, 60, endpoint=False), rng.uniform(1, 4, 60))]
    shapes = {1: ring(star), 2: ring([(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6)])}
    d = spark.createDataFrame([(a, 0, k, x, y) for a, points in shapes.items() for k, (x, y) in enumerate(points)], "area int, ring int, k int, x double, y double")
    whole = rng.integers(-1, 9, (150, 4)).astype(float).tolist()
    short = [[x, y, x + u, y + v] for x, y, u, v in np.column_stack([rng.uniform(-1, 9, (300, 2)), rng.uniform(-0.6, 0.6, (300, 2))]).tolist()]
    lines = spark.createDataFrame([(i, *x) for i, x in enumerate(whole + short)], "id int, x1 double, y1 double, x2 double, y2 double")
    edges = areas.ring_edges(d)
    want = {(r.id, r.area): (len(r.pieces), round(sum(p.t1 - p.t0 for p in r.pieces), 9)) for r in areas.line_pieces(lines, edges, ["id"]).collect()}
    got = {(r.id, r.area): (r.n_pieces, round(r.share, 9)) for r in areas.line_shares(lines, edges, ["id"]).collect()}
    assert got == want and len(want) > 150 and {n for n, _ in want.values()} >= {1, 2}
