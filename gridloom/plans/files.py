"""Queries of file sources, sinks and polygon clipping. Texts are derived from the tables, as if their rows were landed files."""

from pyspark.sql import functions as F

from gridloom.functions.geo import ring_area
from gridloom.functions.polygons import clip_to_convex, polygon_representative, simplify_for_zoom
from gridloom.plans.classify import _J, NODES, features
from gridloom.plans.geometry import _XS, _YS, lines
from gridloom.plans.views import query
from gridloom.sources import files


@query("osm_elements_split", "SELECT 'node' AS type, id % 2 = 0 AS is_feature, count(*) AS n FROM geo_node GROUP BY 2 UNION ALL SELECT 'way', true, count(*) FROM (SELECT DISTINCT way_id FROM geo_node) UNION ALL SELECT 'relation', true, count(DISTINCT relation_id) FROM circuit_member", "geo_node", "circuit_member")
def osm_elements_split(t):
    tags = F.create_map(F.lit("power"), F.lit("line"))
    none = lambda *names: {n: F.lit(None).cast(k) for n, k in (("lat", "double"), ("lon", "double"), ("nodes", "array<long>"), ("members", "array<struct<type:string,ref:long,role:string>>")) if n in names}
    n = t("geo_node").select(F.lit("node").alias("type"), "id", "lat", "lon", F.when(F.col("id") % 2 == 0, tags).alias("tags")).withColumns(none("nodes", "members"))
    w = t("geo_node").groupBy(F.col("way_id").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("nodes")).withColumns({"type": F.lit("way"), "tags": tags, **none("lat", "lon", "members")})
    r = t("circuit_member").groupBy(F.col("relation_id").alias("id")).agg(F.collect_list(F.struct(F.lit("way").alias("type"), F.col("way_id").alias("ref"), "role")).alias("members")).withColumns({"type": F.lit("relation"), "tags": tags, **none("lat", "lon", "nodes")})
    parts = files.split_elements(n.unionByName(w).unionByName(r))
    count = [d.groupBy("is_feature").agg(F.count("*").alias("n")).select(F.lit(k).alias("type"), "is_feature", "n") for k, d in parts.items()]
    return count[0].unionByName(count[1]).unionByName(count[2])


def _collections(t):
    k = F.col("c_custkey")
    doc = F.concat(F.lit('{"type":"'), F.when(k % 7 == 0, "Feature").otherwise("FeatureCollection"), F.lit('","features":[{"type":"Feature","properties":{"id":"'), k.cast("string"), F.lit('"},"geometry":{"type":"Point","coordinates":['), (k % 90).cast("string"), F.lit(".5,50]}}]}"))
    return t("customer").select(k.alias("file_id"), doc.alias("text"))


@query("geojson_scan", "SELECT c_custkey AS file_id, CAST(c_custkey AS VARCHAR) AS id, c_custkey % 90 + 0.5e0 AS lon, 50e0 AS lat, 'EPSG:4326' AS crs FROM customer WHERE c_custkey % 7 <> 0")
def geojson_scan(t):
    f = files.points(files.geojson_features(_collections(t)), "Point")
    return f.select("file_id", F.col("properties")["id"].alias("id"), F.get("coordinates", F.lit(0)).alias("lon"), F.get("coordinates", F.lit(1)).alias("lat"), "crs")


@query("geojson_rejects", "SELECT c_custkey AS file_id FROM customer WHERE c_custkey % 7 = 0")
def geojson_rejects(t):
    return files.geojson_rejects(_collections(t)).select("file_id")


@query("class_scan_bbox", "SELECT id, tag_id, seq FROM geo_node WHERE lon BETWEEN 18.2 AND 18.9 AND lat BETWEEN 49.9 AND 50.3", "geo_node")
def class_scan_bbox(t):
    b = t("geo_node").withColumns({"xmin": F.col("lon"), "xmax": F.col("lon"), "ymin": F.col("lat"), "ymax": F.col("lat")})
    return files.in_box(b, ["id", "tag_id", "seq"], (18.2, 49.9, 18.9, 50.3))


@query("class_drift", """SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 13 = 5 THEN 'checksum' WHEN o_orderkey % 7 = 2 THEN 'missing geometry' WHEN o_orderkey % 11 = 3 THEN 'crs missing' WHEN o_orderkey % 5 = 1 THEN 'crs' WHEN (o_orderkey % 3) <> (o_orderkey // 3 % 3) THEN 'geometry' END AS drift FROM orders""")
def class_drift(t):
    """Class files of orders against what was agreed: checksum, columns, coordinate system, geometry family."""
    k = F.col("o_orderkey")
    d = t("orders").select(
        k.alias("file_id"), F.when(k % 7 == 2, F.lit(["id", "name"])).otherwise(F.lit(["id", "name", "geometry"])).alias("columns"), F.when(k % 11 == 3, F.lit(None).cast("string")).when(k % 5 == 1, "EPSG:4326").otherwise("epsg:2180").alias("crs"),
        F.element_at(F.lit(["point", "line", "polygon"]), (k % 3 + 1).cast("int")).alias("family"), F.element_at(F.lit(["Point", "MultiLineString", "Polygon"]), (F.expr("o_orderkey div 3") % 3 + 1).cast("int")).alias("gtype"),
        F.lit("a").alias("sha256"), F.when(k % 13 == 5, "b").when(k % 2 == 0, "a").alias("expected_sha256"))
    return d.select("file_id", files.class_drift(("id", "geometry")).alias("drift"))


@query("gml_features", "SELECT s_suppkey AS file_id, CASE WHEN s_suppkey % 3 > 0 THEN concat('iip', CAST(s_suppkey AS VARCHAR)) WHEN s_suppkey % 2 = 0 THEN 'jpt' END AS official_id, s_name AS name, CAST(CASE WHEN s_suppkey % 5 > 0 THEN 3 END AS INT) AS n_points, CASE WHEN s_suppkey % 5 > 0 THEN 18e0 + s_suppkey % 7 END AS first_lon, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 1 THEN 'id' WHEN s_suppkey % 5 = 0 THEN 'geometry' END AS error FROM supplier")
def gml_features(t):
    k = F.col("s_suppkey")
    lon = (18 + k % 7).cast("string")
    pos = F.when(k % 5 > 0, F.concat(F.lit("<posList>50.1 "), lon, F.lit(" 50.2 "), lon, F.lit(" 50.1 "), lon, F.lit("</posList>"))).otherwise("")
    ident = F.when(k % 3 > 0, F.concat(F.lit("<IIP_IDENTY>iip"), k.cast("string"), F.lit("</IIP_IDENTY>"))).otherwise("")
    xml = F.concat(F.lit("<m><JPT_NAZWA_>"), F.col("s_name"), F.lit("</JPT_NAZWA_>"), ident, F.when(k % 2 == 0, "<JPT_ID>jpt</JPT_ID>").otherwise(""), pos, F.lit("</m>"))
    g = files.gml_members(t("supplier").select(k.alias("file_id"), xml.alias("text")))
    return g.select("file_id", "official_id", "name", F.when(F.col("ring").isNotNull(), F.size("ring")).alias("n_points"), F.get("ring", F.lit(0))["x"].alias("first_lon"), "error")


@query("capability_layers", """SELECT s_suppkey AS file_id, layer, CASE layer WHEN 'power' THEN 'Power lines' ELSE 'gas' END AS title, CASE layer WHEN 'power' THEN 500e0 * (s_suppkey % 4 + 1) END AS max_scale, CASE layer WHEN 'power' THEN 14e0 + s_suppkey % 5 ELSE 15e0 END AS west, CASE WHEN layer = 'gas' AND s_suppkey % 11 = 4 THEN NULL ELSE 49e0 END AS south,
CASE WHEN layer = 'power' AND s_suppkey % 2 = 0 THEN 'https://example.org/GetLegendGraphic' END AS legend, CASE WHEN s_suppkey % 13 = 6 THEN 'version' WHEN s_suppkey % 11 = 4 THEN 'bounds' WHEN s_suppkey % 3 = 0 THEN 'missing gas' END AS drift
FROM supplier, (VALUES ('power'),('gas')) AS l(layer) WHERE layer = 'power' OR s_suppkey % 3 <> 0 OR s_suppkey % 11 = 4""")
def capability_layers(t):
    """Documents of a service: two named layers with boxes, one without a box; some lack a layer, a number or the version."""
    k = F.col("s_suppkey")
    box = lambda w, s: F.concat(F.lit("<EX_GeographicBoundingBox><westBoundLongitude>"), w, F.lit("</westBoundLongitude><eastBoundLongitude>24</eastBoundLongitude><southBoundLatitude>"), s, F.lit("</southBoundLatitude><northBoundLatitude>55</northBoundLatitude></EX_GeographicBoundingBox>"))
    power = F.concat(F.lit("<Layer><Name>power</Name><Title>Power lines</Title>"), box((14 + k % 5).cast("string"), F.lit("49")), F.when(k % 2 == 0, '<Style><LegendURL><OnlineResource href="https://example.org/GetLegendGraphic"/></LegendURL></Style>').otherwise(""), F.lit("<MaxScaleDenominator>"), (500 * (k % 4 + 1)).cast("string"), F.lit("</MaxScaleDenominator></Layer>"))
    gas = F.when((k % 3 != 0) | (k % 11 == 4), F.concat(F.lit("<Layer><Name>gas</Name>"), box(F.lit("15"), F.when(k % 11 == 4, "south").otherwise("49")), F.lit("</Layer>"))).otherwise("")
    xml = F.concat(F.lit('<c version="'), F.when(k % 13 == 6, "1.1.1").otherwise("1.3.0"), F.lit('">'), power, gas, F.lit("<Layer><Name>frame</Name></Layer></c>"))
    return files.capability_layers(t("supplier").select(k.alias("file_id"), xml.alias("text")), required=("power", "gas")).select("file_id", "layer", "title", "max_scale", "west", "south", "legend", "drift")


@query("relation_xml", "SELECT o_orderkey AS relation_id, 0 AS pos, 'way' AS type, o_custkey AS ref, CASE WHEN o_orderkey % 2 = 0 THEN 'section' ELSE 'member' END AS role FROM orders WHERE o_orderkey % 3 = 0")
def relation_xml(t):
    k = F.col("o_orderkey")
    xml = F.concat(F.lit('<relation id="'), k.cast("string"), F.lit('"><member type="way" ref="'), F.col("o_custkey").cast("string"), F.lit('" role="'), F.when(k % 2 == 0, "section").otherwise(""),
                   F.lit('"/><member type="area" ref="1" role=""/><tag k="power" v="'), F.when(k % 3 == 0, "circuit").otherwise("line"), F.lit('"/></relation>'))
    return files.relation_members(t("orders").select(xml.alias("text")))


@query("layer_sink", f"SELECT tag_id % 3 AS aoi_id, CAST(tag_id AS VARCHAR) AS layer_id, count(*) AS n FROM (SELECT n.tag_id {_J}) GROUP BY 1, 2", *NODES)
def layer_sink(t):
    """Layers written to one folder each and read back."""
    f = features(t).select((F.col("tag_id") % 3).alias("aoi_id"), F.lit("all").alias("domain"), F.col("tag_id").cast("string").alias("layer_id"), "id")
    path = files.scratch_folder(t.spark, "layers")
    files.write_layers(f, path)
    back = t.spark.read.schema("id long, aoi_id int, domain string, layer_id string").parquet(path)
    return back.groupBy("aoi_id", "layer_id").agg(F.count("*").alias("n"))


@query("layer_list", f"SELECT e.aoi_id, e.layer_id, e.layer_id IS NOT NULL AS expected, coalesce(n, 0) AS n FROM (SELECT DISTINCT tag_id % 3 AS aoi_id, CAST(tag_id AS VARCHAR) AS layer_id FROM tag_kv UNION SELECT DISTINCT tag_id % 3, CAST(tag_id + 500 AS VARCHAR) FROM tag_kv WHERE tag_id % 10 = 0) e LEFT JOIN (SELECT CAST(tag_id AS VARCHAR) AS layer_id, count(*) AS n FROM (SELECT n.tag_id {_J}) GROUP BY 1) f ON f.layer_id = e.layer_id", "tag_kv", *NODES)
def layer_list(t):
    """Layers written and listed, those without a feature too."""
    f = features(t).select((F.col("tag_id") % 3).alias("aoi_id"), F.lit("all").alias("domain"), F.col("tag_id").cast("string").alias("layer_id"), "id")
    k = t("tag_kv").select("tag_id").distinct()
    e = k.select((F.col("tag_id") % 3).alias("aoi_id"), F.lit("all").alias("domain"), F.col("tag_id").cast("string").alias("layer_id"))
    e = e.unionByName(k.where("tag_id % 10 = 0").select((F.col("tag_id") % 3).alias("aoi_id"), F.lit("all").alias("domain"), (F.col("tag_id") + 500).cast("string").alias("layer_id")))
    path = files.scratch_folder(t.spark, "layers")
    files.write_layers(f, path, e)
    return files.layer_list(t.spark, path).select("aoi_id", "layer_id", "expected", F.col("feature_count").alias("n"))


# ---- polygons

_AREA = [(min(_XS), min(_YS)), (max(_XS), min(_YS)), (max(_XS), max(_YS)), (min(_XS), max(_YS))]
_H = 0.03


def _squares(t):
    """A square around every node, as the footprint of a site."""
    p = lambda dx, dy: F.struct((F.col("lon") + dx).alias("x"), (F.col("lat") + dy).alias("y"))
    return t("geo_node").select("id", F.array(p(-_H, -_H), p(_H, -_H), p(_H, _H), p(-_H, _H), p(-_H, -_H)).alias("ring"))


_CUT = f"greatest(0e0, least(lon + {_H}, {max(_XS)}) - greatest(lon - {_H}, {min(_XS)})) * greatest(0e0, least(lat + {_H}, {max(_YS)}) - greatest(lat - {_H}, {min(_YS)}))"


@query("clip_polygons", f"SELECT id, round(a, 8) AS area FROM (SELECT id, {_CUT} AS a FROM geo_node) WHERE a > 1e-12", "geo_node")
def clip_polygons(t):
    c = _squares(t).select("id", clip_to_convex(_AREA)(F.col("ring")).alias("ring")).where("ring is not null")
    return c.select("id", ring_area(F.col("ring")).alias("a")).where("a > 1e-12").select("id", F.round("a", 8).alias("area"))


@query("clip_unless_boundary", f"SELECT id, round(CASE WHEN id % 5 = 0 THEN {4 * _H * _H!r} ELSE a END, 8) AS area FROM (SELECT id, {_CUT} AS a FROM geo_node) WHERE id % 5 = 0 OR a > 1e-12", "geo_node")
def clip_unless_boundary(t):
    """Boundaries stay whole, all else is cut."""
    s = _squares(t)
    cut = s.where("id % 5 <> 0").withColumn("ring", clip_to_convex(_AREA)(F.col("ring"))).where("ring is not null")
    return s.where("id % 5 = 0").unionByName(cut).select("id", ring_area(F.col("ring")).alias("a")).where("a > 1e-12").select("id", F.round("a", 8).alias("area"))


@query("polygon_points", f"SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM geo_node", "geo_node")
def polygon_points(t):
    """A point on each footprint; of a square it is the middle."""
    return _squares(t).select("id", polygon_representative()(F.col("ring")).alias("p")).select("id", F.round("p.x", 6).alias("lon"), F.round("p.y", 6).alias("lat"))


_TOL = f"{360 / 2**7 / 2048!r}"
_DX, _DY = "(p[j].x - p[i].x)", "(p[j].y - p[i].y)"
_AT = f"CASE WHEN {_DX} * {_DX} + {_DY} * {_DY} > 0 THEN greatest(0e0, least(1e0, ((p[q].x - p[i].x) * {_DX} + (p[q].y - p[i].y) * {_DY}) / ({_DX} * {_DX} + {_DY} * {_DY}))) ELSE 0e0 END"
_OFF = f"sqrt(power(p[i].x + ({_AT}) * {_DX} - p[q].x, 2) + power(p[i].y + ({_AT}) * {_DY} - p[q].y, 2))"


@query("simplify_zoom", f"""WITH RECURSIVE line AS (SELECT way_id, list({{'x': lon, 'y': lat}} ORDER BY seq) AS p FROM geo_node GROUP BY way_id HAVING count(*) >= 2),
cut(way_id, p, i, j) AS (SELECT way_id, p, CAST(1 AS BIGINT), len(p) FROM line UNION ALL
 SELECT way_id, p, unnest([i, k]), unnest([k, j]) FROM (SELECT way_id, p, i, j, i + list_position(d, list_max(d)) AS k, list_max(d) AS m FROM (SELECT *, list_transform(range(i + 1, j), lambda q: {_OFF}) AS d FROM cut WHERE j - i >= 2)) WHERE m > {_TOL})
SELECT way_id, CAST(len(any_value(p)) AS BIGINT) AS n_before, CAST(2 + (count(*) - 1) // 2 AS BIGINT) AS n_after FROM cut GROUP BY way_id""", "geo_node")
def simplify_zoom(t):
    """Lines of ways as a tile of zoom 7 shows them."""
    return lines(t).select("way_id", F.size("line").cast("long").alias("n_before"), F.size(simplify_for_zoom(7)(F.col("line"))).cast("long").alias("n_after"))
