"""Queries of hexagon analytics: all levels around many areas, one of which belongs to each nation."""

from pyspark.sql import functions as F

from gridloom.functions import classify as c
from gridloom.functions.tags import tag_maps
from gridloom.operators import hexgrid as h
from gridloom.operators.ways import clip_segments, segments
from gridloom.plans.classify import ASKS, CASES
from gridloom.plans.geometry import AREA_SQL, areas, metric
from gridloom.plans.views import query

# What these queries hold against, stated by itself: levels, corners, counters, scores.
_UNIT = [(0.8660254037844386, -0.5), (0.8660254037844386, 0.5), (0.0, 1.0), (-0.8660254037844386, 0.5), (-0.8660254037844386, -0.5), (0.0, -1.0)]
_CORNERS = ", ".join(f"({i}, {a}e0, {b}e0, {d}e0, {e}e0)" for i, ((a, b), (d, e)) in enumerate(zip(_UNIT, _UNIT[1:] + _UNIT[:1])))
_ANGLE = lambda ax, ay, bx, by: f"rad * rad / 2 * atan2({ax} * {by} - {ay} * {bx}, {ax} * {bx} + {ay} * {by})"
_HEX = f"""{AREA_SQL}, lvl(level, edge) AS (VALUES ('regional', 3000e0), ('urban', 1000e0), ('local', 500e0)), al AS (SELECT *, sqrt(3e0) * edge AS w FROM area, lvl),
corner(i, ax, ay, ex, ey) AS (VALUES {_CORNERS}),
cell AS (SELECT aoi_id, level, edge, w, cx, cy, rad, CAST(k AS INT) AS "row", CAST(l AS INT) AS col, cx - rad - w + CASE WHEN k % 2 = 1 THEN w / 2 ELSE 0 END + l * w AS x, cy - rad - edge + k * 1.5e0 * edge AS y
 FROM al, range(30) a(k), range(30) b(l) WHERE k <= floor((2 * rad + 2 * edge) / (1.5e0 * edge)) AND l <= floor((2 * rad + 2 * w) / w)),
side AS (SELECT *, qx - px AS dx, qy - py AS dy FROM (SELECT cell.*, x + ax * edge - cx AS px, y + ay * edge - cy AS py, x + ex * edge - cx AS qx, y + ey * edge - cy AS qy FROM cell, corner)),
root AS (SELECT *, px * dx + py * dy AS b, power(px * dx + py * dy, 2) - (dx * dx + dy * dy) * (px * px + py * py - rad * rad) AS disc FROM side),
part AS (SELECT *, CASE WHEN disc < 0 THEN 1e0 ELSE greatest(0e0, (-b - sqrt(greatest(disc, 0e0))) / (dx * dx + dy * dy)) END AS t0, CASE WHEN disc < 0 THEN 0e0 ELSE least(1e0, (-b + sqrt(greatest(disc, 0e0))) / (dx * dx + dy * dy)) END AS t1 FROM root),
ends AS (SELECT *, px + t0 * dx AS ux, py + t0 * dy AS uy, px + t1 * dx AS vx, py + t1 * dy AS vy FROM part),
hex AS (SELECT aoi_id, level, edge, w, "row", col, x, y FROM ends GROUP BY ALL
 HAVING abs(sum(CASE WHEN t0 < t1 THEN {_ANGLE('px', 'py', 'ux', 'uy')} + (ux * vy - uy * vx) / 2 + {_ANGLE('vx', 'vy', 'qx', 'qy')} ELSE {_ANGLE('px', 'py', 'qx', 'qy')} END)) > 1)"""
_S = lambda x, y: (x, f"(({x}) / 2 + ({y}) * 0.8660254037844386e0)", f"(({x}) / 2 - ({y}) * 0.8660254037844386e0)")
_CROSS = f"""seg AS (SELECT s.*, aoi_id, x2 - x1 AS dx, y2 - y1 AS dy, x1 - cx AS fx, y1 - cy AS fy, rad FROM metric_segment s, area WHERE x2 IS NOT NULL AND least(x1, x2) <= cx + rad AND greatest(x1, x2) >= cx - rad AND least(y1, y2) <= cy + rad AND greatest(y1, y2) >= cy - rad),
cut AS (SELECT *, dx * dx + dy * dy AS a, fx * dx + fy * dy AS b, fx * fx + fy * fy - rad * rad AS c FROM seg),
par AS (SELECT *, greatest(0e0, (-b - sqrt(greatest(b * b - a * c, 0e0))) / a) AS t0, least(1e0, (-b + sqrt(greatest(b * b - a * c, 0e0))) / a) AS t1 FROM cut WHERE a > 0 AND b * b - a * c >= 0),
inside AS (SELECT aoi_id, way_id, seq, tag_id, x1 + t0 * dx AS px, y1 + t0 * dy AS py, (t1 - t0) * dx AS vx, (t1 - t0) * dy AS vy FROM par WHERE t0 < t1),
slab AS (SELECT h.aoi_id, level, way_id, seq, tag_id, "row", col, vx, vy, w / 2 AS half, {', '.join(f'{a} AS a{i}' for i, a in enumerate(_S('px - x', 'py - y')))}, {', '.join(f'{a} AS d{i}' for i, a in enumerate(_S('vx', 'vy')))}
 FROM inside i JOIN hex h ON i.aoi_id = h.aoi_id WHERE abs(px + vx / 2 - x) <= 2 * edge + abs(vx) AND abs(py + vy / 2 - y) <= 2 * edge + abs(vy)),
crossing AS (SELECT * FROM (SELECT *, greatest(0e0, {', '.join(f'least((-half - a{i}) / d{i}, (half - a{i}) / d{i})' for i in range(3))}) AS u0, least(1e0, {', '.join(f'greatest((-half - a{i}) / d{i}, (half - a{i}) / d{i})' for i in range(3))}) AS u1 FROM slab WHERE d0 <> 0 AND d1 <> 0 AND d2 <> 0) WHERE u0 < u1)"""
_POWER = f"pnode AS (SELECT aoi_id, m.id, m.x, m.y, {CASES['power']} AS category FROM metric m JOIN tag_wide w ON m.tag_id = w.tag_id, area WHERE sqrt(power(m.x - cx, 2) + power(m.y - cy, 2)) <= rad AND ({ASKS['power']}))"
_PLACED = f"""{_POWER}, placed AS (SELECT n.id, h.aoi_id, h.level, h."row", h.col, n.category FROM pnode n JOIN hex h ON n.aoi_id = h.aoi_id AND n.x BETWEEN h.x - h.edge AND h.x + h.edge AND n.y BETWEEN h.y - h.edge AND h.y + h.edge
 WHERE {' AND '.join(f'abs({s}) <= w / 2 + 1e-6' for s in _S('n.x - h.x', 'n.y - h.y'))})"""
_K = 'aoi_id, level, "row", col'


def grid(t):
    return h.hex_grids(h.with_levels(areas(t)))


def crossings(t):
    """Segments of power ways inside each area's circle, by hex."""
    s = clip_segments(h.segments_near_areas(segments(t("geo_node")), areas(t))).withColumn("tag_id", (F.col("way_id") % 90).cast("int"))
    s = s.join(tag_maps(t("tag_kv")), "tag_id").withColumn("category", c.power_category(F.col("tags")))
    return h.segment_hexes(h.with_levels(s.select("aoi_id", "cx", "cy", "r", "way_id", "seq", "category", "cx1", "cy1", "cx2", "cy2")))


def power_nodes(t):
    p = metric(t).join(tag_maps(t("tag_kv")), "tag_id").where(c.asks("power", F.col("tags"))).select("id", "x", "y", c.power_category(F.col("tags")).alias("category"))
    return h.points_in_areas(p, areas(t))


def placed(t):
    return h.point_hexes(h.with_levels(power_nodes(t)))


def measured(t):
    return h.with_metrics(h.nearest(grid(t), power_nodes(t)), h.line_metrics(crossings(t)), h.node_metrics(placed(t)))


@query("hex_grid", f"WITH {_HEX} SELECT {_K}, CAST(round(x, 1) AS DOUBLE) AS x, CAST(round(y, 1) AS DOUBLE) AS y FROM hex", "nation_area")
def hex_grid(t):
    return grid(t).select(*h.KEY, F.round("x", 1).alias("x"), F.round("y", 1).alias("y"))


@query("hex_ids", f"WITH {_HEX} SELECT {_K}, concat(level, '-', lpad(CAST(row_number() OVER (PARTITION BY aoi_id, level ORDER BY \"row\", col) - 1 AS VARCHAR), 4, '0')) AS hex_id FROM hex", "nation_area")
def hex_ids(t):
    return h.hex_ids(grid(t)).select(*h.KEY, "hex_id")


_NB = "nb AS (SELECT a.aoi_id, a.level, a.\"row\", a.col, b.\"row\" AS nrow, b.col AS ncol FROM hex a JOIN hex b ON a.aoi_id = b.aoi_id AND a.level = b.level AND (a.\"row\" <> b.\"row\" OR a.col <> b.col) AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= a.w * 1.05e0)"


@query("hex_neighbors", f"WITH {_HEX}, {_NB} SELECT * FROM nb", "nation_area")
def hex_neighbors(t):
    return h.neighbours(grid(t))


@query("hex_line_join", f"WITH {_HEX}, {_CROSS} SELECT way_id, {_K}, round(sum((u1 - u0) * sqrt(vx * vx + vy * vy)), 1) AS length_m FROM crossing GROUP BY ALL", "metric_segment", "nation_area")
def hex_line_join(t):
    return crossings(t).groupBy("way_id", *h.KEY).agg(F.round(F.sum("hex_length"), 1).alias("length_m"))


@query("hex_node_join", f"WITH {_HEX}, {_PLACED} SELECT id, {_K} FROM placed", "metric", "tag_wide", "nation_area")
def hex_node_join(t):
    return placed(t).select("id", *h.KEY)


_ROLES = {"substation_count": "'substation'", "transformer_count": "'transformer'", "generator_count": "'generator'", "plant_count": "'plant'", "support_count": "'tower', 'pole', 'portal', 'utility_pole'", "switchgear_count": "'switch', 'terminal', 'converter', 'compensator'"}
_LM = f"""lm AS (SELECT {_K}, count(*) AS line_count, round(sum(m), 1) AS line_length_m, count(*) FILTER (WHERE category = 'line') AS major_line_count, count(*) FILTER (WHERE category = 'minor_line') AS minor_line_count, count(*) FILTER (WHERE category = 'cable') AS cable_count
 FROM (SELECT {_K}, way_id, {CASES['power']} AS category, sum((u1 - u0) * sqrt(vx * vx + vy * vy)) AS m FROM crossing x JOIN tag_wide w ON x.tag_id = w.tag_id GROUP BY ALL) GROUP BY ALL)"""
_NM = f"""nm AS (SELECT {_K}, count(*) AS node_count, {', '.join(f"count(*) FILTER (WHERE category IN ({v})) AS {k}" for k, v in _ROLES.items())} FROM placed GROUP BY ALL)"""
_LMC, _NMC = ("line_count", "line_length_m", "major_line_count", "minor_line_count", "cable_count"), ("node_count", *_ROLES)
_KH = 'h.aoi_id, h.level, h."row", h.col'
_ON = lambda b: f"h.aoi_id = {b}.aoi_id AND h.level = {b}.level AND h.\"row\" = {b}.\"row\" AND h.col = {b}.col"


@query("hex_line_metrics", f"WITH {_HEX}, {_CROSS}, {_LM} SELECT {_KH}, {', '.join(f'coalesce({k}, 0) AS {k}' for k in _LMC)} FROM hex h LEFT JOIN lm ON {_ON('lm')}", "metric_segment", "tag_wide", "nation_area")
def hex_line_metrics(t):
    return grid(t).join(h.line_metrics(crossings(t)), list(h.KEY), "left").select(*h.KEY, *[F.coalesce(k, F.lit(0)).alias(k) for k in _LMC])


@query("hex_node_metrics", f"WITH {_HEX}, {_PLACED}, {_NM} SELECT {_KH}, {', '.join(f'coalesce({k}, 0) AS {k}' for k in _NMC)} FROM hex h LEFT JOIN nm ON {_ON('nm')}", "metric", "tag_wide", "nation_area")
def hex_node_metrics(t):
    return grid(t).join(h.node_metrics(placed(t)), list(h.KEY), "left").select(*h.KEY, *[F.coalesce(k, F.lit(0)).alias(k) for k in _NMC])


_NEAREST = f"near AS (SELECT {_KH}, round(min(sqrt(power(p.x - h.x, 2) + power(p.y - h.y, 2))), 1) AS nearest_m FROM hex h LEFT JOIN pnode p ON h.aoi_id = p.aoi_id GROUP BY ALL)"


@query("hex_nearest", f"WITH {_HEX}, {_POWER}, {_NEAREST} SELECT * FROM near", "metric", "tag_wide", "nation_area")
def hex_nearest(t):
    return h.nearest(grid(t), power_nodes(t)).select(*h.KEY, "nearest_m")


_FULL = f"""WITH {_HEX}, {_CROSS}, {_PLACED}, {_LM}, {_NM}, {_NB}, {_NEAREST}, base AS (SELECT {_KH}, edge, {', '.join(f'coalesce({k}, 0) AS {k}' for k in (*_LMC, *_NMC))}, nearest_m FROM hex h LEFT JOIN lm ON {_ON('lm')} LEFT JOIN nm ON {_ON('nm')} LEFT JOIN near ON {_ON('near')}),
act AS (SELECT *, line_length_m > 0 OR node_count > 0 AS active FROM base), con AS (SELECT h.aoi_id, h.level, h."row", h.col, count(*) AS k FROM nb h JOIN act a ON a.aoi_id = h.aoi_id AND a.level = h.level AND a."row" = nrow AND a.col = ncol WHERE a.active GROUP BY ALL),
done AS (SELECT h.*, coalesce(k, 0) AS connected_count, CASE WHEN line_length_m >= 500 AND substation_count + transformer_count + generator_count + plant_count > 0 THEN 'high' WHEN line_length_m > 0 OR substation_count + transformer_count + generator_count + plant_count > 0 THEN 'medium' WHEN node_count > 0 OR nearest_m <= 1.5e0 * edge THEN 'low' ELSE 'unknown' END AS confidence FROM act h LEFT JOIN con ON {_ON('con')})"""
_ALL = ("metric", "metric_segment", "tag_wide", "nation_area")


def finished(t):
    return h.connected(measured(t)).withColumn("confidence", h.confidence()).withColumn("score", h.score())


@query("hex_connected", f"{_FULL} SELECT {_K}, connected_count FROM done", *_ALL)
def hex_connected(t):
    m = h.with_metrics(grid(t), h.line_metrics(crossings(t)), h.node_metrics(placed(t)))
    return h.connected(m).select(*h.KEY, "connected_count")


@query("hex_confidence", f"{_FULL} SELECT {_K}, confidence, CASE confidence WHEN 'high' THEN 0.85e0 WHEN 'medium' THEN 0.62e0 WHEN 'low' THEN 0.35e0 ELSE 0e0 END AS confidence_score FROM done", *_ALL)
def hex_confidence(t):
    scores = F.create_map(*[F.lit(x) for kv in h.CONFIDENCE_SCORE.items() for x in kv])
    return measured(t).select(*h.KEY, h.confidence().alias("confidence")).withColumn("confidence_score", scores[F.col("confidence")])


_POINTS = "line_length_m / 900 + major_line_count * 2 + minor_line_count + substation_count * 15 + transformer_count * 8 + generator_count * 6 + plant_count * 12 + switchgear_count * 3 + connected_count * 2"


@query("hex_score", f"{_FULL} SELECT {_K}, CASE WHEN active THEN round(least(100e0, {_POINTS}), 1) ELSE 0e0 END AS score FROM done", *_ALL)
def hex_score(t):
    return finished(t).select(*h.KEY, "score")


@query("hex_report", f"{_FULL} SELECT aoi_id, level, count(*) AS n_hexes, count(*) FILTER (WHERE active) AS n_active, {', '.join(f'count(*) FILTER (WHERE confidence = {k!r}) AS n_{k}' for k in ('high', 'medium', 'low', 'unknown'))} FROM done GROUP BY ALL", *_ALL)
def hex_report(t):
    """The report of each area and level."""
    d = measured(t).withColumn("confidence", h.confidence())
    return d.groupBy("aoi_id", "level").agg(F.count("*").alias("n_hexes"), F.count_if("active").alias("n_active"), *[F.count_if(F.col("confidence") == k).alias(f"n_{k}") for k in h.CONFIDENCE_SCORE])
