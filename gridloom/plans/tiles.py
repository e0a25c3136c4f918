"""Queries of map tiles."""

import math

from pyspark.sql import functions as F

from gridloom.functions import geo
from gridloom.functions import classify as c
from gridloom.functions.tags import tag_maps
from gridloom.operators import tiles as ops
from gridloom.operators.layers import min_zoom
from gridloom.plans.classify import ASKS, CASES, features
from gridloom.plans.views import query

_TX = lambda v, z: f"CAST(greatest(0, least(pow(2e0, {z}) - 1, floor(({v} + 180) / 360 * pow(2e0, {z})))) AS INT)"
_TY = lambda v, z: f"CAST(greatest(0, least(pow(2e0, {z}) - 1, floor((1 - asinh(tan(radians(greatest(-85.05112878, least(85.05112878, {v}))))) / {math.pi!r}) / 2 * pow(2e0, {z})))) AS INT)"


@query("tile_of_point", f"SELECT id, {_TX('lon', 12)} AS x, {_TY('lat', 12)} AS y FROM geo_node", "geo_node")
def tile_of_point(t):
    z = F.lit(12)
    return t("geo_node").select("id", geo.tile_x(F.col("lon"), z).alias("x"), geo.tile_y(F.col("lat"), z).alias("y"))


@query("tile_bounds", f"SELECT DISTINCT x, y, round(x / 1024e0 * 360 - 180, 7) AS west, round(degrees(atan(sinh({math.pi!r} * (1 - 2 * y / 1024e0)))), 7) AS north, round(degrees(atan(sinh({math.pi!r} * (1 - 2 * (y + 1) / 1024e0)))), 7) AS south FROM (SELECT {_TX('lon', 10)} AS x, {_TY('lat', 10)} AS y FROM geo_node)", "geo_node")
def tile_bounds(t):
    z = F.lit(10)
    d = t("geo_node").select(geo.tile_x(F.col("lon"), z).alias("x"), geo.tile_y(F.col("lat"), z).alias("y")).distinct()
    return d.select("x", "y", F.round(geo.tile_west(F.col("x"), z), 7).alias("west"), F.round(geo.tile_north(F.col("y"), z), 7).alias("north"), F.round(geo.tile_north(F.col("y") + 1, z), 7).alias("south"))


@query("tile_cover", f"SELECT id, z, x, y FROM (SELECT id, z, unnest(range({_TX('min_lon', 'z')}, {_TX('max_lon', 'z')} + 1)) AS x, y0, y1 FROM (SELECT *, {_TY('max_lat', 'z')} AS y0, {_TY('min_lat', 'z')} AS y1 FROM site_box, (SELECT CAST(i AS INT) AS z FROM range(7, 15) r(i)))), range(16384) q(y) WHERE y BETWEEN y0 AND y1", "site_box")
def tile_cover(t):
    # few bytes a row give one task for them all, and each becomes hundreds
    u = t("site_box").repartition("id").select("id", F.col("min_lon").alias("xmin"), F.col("min_lat").alias("ymin"), F.col("max_lon").alias("xmax"), F.col("max_lat").alias("ymax"))
    return ops.tile_cover(u, F.lit(7)).select("id", "z", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


def _placed(t):
    """Points of power objects in the tiles of their zooms."""
    f = features(t).where(c.asks("power", F.col("tags"))).withColumn("layer", c.power_category(F.col("tags")))
    box = f.select(F.col("id").alias("source_id"), "layer", F.col("lon").alias("xmin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymin"), F.col("lat").alias("ymax"))
    return ops.tile_cover(box, min_zoom(F.col("layer")))


_PL = f"(SELECT id AS source_id, layer, z, {_TX('lon', 'z')} AS x, {_TY('lat', 'z')} AS y FROM (SELECT n.id, lon, lat, {CASES['power']} AS layer FROM geo_node n JOIN tag_wide w ON n.tag_id = w.tag_id WHERE {ASKS['power']}), (SELECT CAST(i AS INT) AS z FROM range(7, 15) r(i)) WHERE z >= CASE WHEN layer IN ('tower','portal','utility_pole') THEN 12 WHEN layer = 'pole' THEN 14 ELSE 7 END)"


@query("tile_counts", f"SELECT z, x, y, layer, count(DISTINCT source_id) AS n_features FROM {_PL} GROUP BY ALL", "geo_node", "tag_wide")
def tile_counts(t):
    """A node is a group of rows, so its id is its own, and a point lies in one tile of each zoom."""
    return ops.tile_counts(_placed(t), once_each=True)


def crc32_sql(text: str) -> str:
    """The checksum of an ASCII text, for an engine without that function: one table look-up for each byte."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    step = f"xor(c >> 8, (CAST({table} AS BIGINT[]))[CAST(xor(c, x) & 255 AS INT) + 1])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda k: CAST(ascii(k) AS BIGINT))), lambda c, x: {step}), 4294967295)"


@query("tile_contents", f"""WITH p AS (SELECT DISTINCT z, x, y, layer, source_id FROM {_PL}), h AS (SELECT source_id, {crc32_sql('CAST(source_id AS VARCHAR)')} AS h FROM (SELECT DISTINCT source_id FROM p)), n AS (SELECT z, x, y, layer, CAST(ceil(count(*) / 1000) AS BIGINT) AS n FROM p GROUP BY ALL)
SELECT z, x, y, layer, CAST(h % n AS INT) AS part, string_agg(CAST(source_id AS VARCHAR), ',' ORDER BY CAST(source_id AS VARCHAR)) AS features FROM p JOIN n USING (z, x, y, layer) JOIN h USING (source_id) GROUP BY z, x, y, layer, h % n""", "geo_node", "tag_wide")
def tile_contents(t):
    d = ops.tile_contents(_placed(t).withColumn("source_id", F.col("source_id").cast("string")))
    return d.withColumn("features", F.array_join("features", ","))


_SEG = f"(SELECT way_id, seq, lon1, lat1, lon2, lat2, z, x, y, x / pow(2e0, z) * 360 - 180 AS w, (x + 1) / pow(2e0, z) * 360 - 180 AS e, degrees(atan(sinh({math.pi!r} * (1 - 2 * y / pow(2e0, z))))) AS n, degrees(atan(sinh({math.pi!r} * (1 - 2 * (y + 1) / pow(2e0, z))))) AS s FROM (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM (SELECT *, {_TX('least(lon1, lon2)', 'z')} AS x0, {_TX('greatest(lon1, lon2)', 'z')} AS x1, {_TY('greatest(lat1, lat2)', 'z')} AS y0, {_TY('least(lat1, lat2)', 'z')} AS y1 FROM geo_segment, (SELECT CAST(i AS INT) AS z FROM range(7, 15) r(i)) WHERE lon2 IS NOT NULL))))"


@query("tile_features", f"SELECT DISTINCT way_id, z, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT *, greatest(0e0, least((w - lon1) / (lon2 - lon1), (e - lon1) / (lon2 - lon1)), least((s - lat1) / (lat2 - lat1), (n - lat1) / (lat2 - lat1))) AS a, least(1e0, greatest((w - lon1) / (lon2 - lon1), (e - lon1) / (lon2 - lon1)), greatest((s - lat1) / (lat2 - lat1), (n - lat1) / (lat2 - lat1))) AS b FROM {_SEG}) WHERE a <= b", "geo_segment")
def tile_features(t):
    s = t("geo_segment").where("lon2 is not null")
    return ops.segment_tiles(s, F.lit(7)).select("way_id", "z", "x", "y").distinct()


_CURVE = """WITH RECURSIVE t AS (SELECT DISTINCT z, x, y FROM {0}), c(z, x, y, s, px, py, d) AS (SELECT z, x, y, CAST(8192 AS BIGINT), CAST(x AS BIGINT), CAST(y AS BIGINT), CAST(0 AS BIGINT) FROM t UNION ALL
SELECT z, x, y, s // 2, CASE WHEN ry = 0 THEN fy ELSE fx END, CASE WHEN ry = 0 THEN fx ELSE fy END, d + s * s * xor(3 * rx, ry) FROM (SELECT *, CASE WHEN ry = 0 AND rx = 1 THEN s - 1 - px % s ELSE px % s END AS fx, CASE WHEN ry = 0 AND rx = 1 THEN s - 1 - py % s ELSE py % s END AS fy
 FROM (SELECT *, (px // s) % 2 AS rx, (py // s) % 2 AS ry FROM c WHERE s > 0)))
SELECT z, x, y, d AS place FROM c WHERE s = 0"""


@query("tile_order", _CURVE.format(_PL), "geo_node", "tag_wide")
def tile_order(t):
    """Tiles along the Hilbert curve of the largest zoom."""
    return ops.in_curve_order(_placed(t).select("z", "x", "y").distinct()).select("z", "x", "y", "place")


@query("presentation_benchmark", f"SELECT CAST(sum(n) AS BIGINT) AS n_placements, count(*) AS n_tiles, CAST(sum(bytes) AS BIGINT) AS n_bytes FROM (SELECT z, x, y, count(*) AS n, sum(length(concat(layer, '/', CAST(source_id AS VARCHAR))) + 1) AS bytes FROM {_PL} GROUP BY z, x, y)", "geo_node", "tag_wide")
def presentation_benchmark(t):
    """Placements, tiles and the bytes of a tile's list of features."""
    size = F.length(F.concat_ws("/", "layer", F.col("source_id").cast("string"))) + 1
    g = _placed(t).groupBy("z", "x", "y").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    return g.agg(F.sum("n").alias("n_placements"), F.count("*").alias("n_tiles"), F.sum("bytes").cast("long").alias("n_bytes"))
