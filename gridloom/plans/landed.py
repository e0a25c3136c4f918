"""Queries of landed files: the files are written from the tables first, then read by their path."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import wkb
from gridloom.plans.areas import _store
from gridloom.plans.views import query
from gridloom.sources import landed
from gridloom.sources.files import scratch_folder

_N, _M = 12, 20  # columns and rows of the sample grids
_V = "CAST((s_suppkey * 31 + r * 7 + c * 3) % 1000 AS DOUBLE)"


@query("grid_files", f"""SELECT s_suppkey AS raster_id, CASE WHEN s_suppkey % 4 = 0 THEN 'rows' WHEN s_suppkey % 7 = 3 THEN 'row' END AS error, CASE WHEN s_suppkey % 4 <> 0 AND s_suppkey % 7 <> 3 THEN count(*) ELSE 0 END AS n_cells,
CASE WHEN s_suppkey % 4 <> 0 AND s_suppkey % 7 <> 3 THEN sum({_V} * (r * {_N} + c)) END AS weighted FROM supplier, range({_M}) a(r), range({_N}) b(c) GROUP BY s_suppkey""")
def grid_files(t):
    """One grid file for each supplier, read by lines: which rule it breaks, and its cells, each weighed by its place."""
    s = t("supplier").select(F.col("s_suppkey").alias("k"))
    head = F.array(F.lit(f"ncols {_N}"), F.concat(F.lit("nrows "), F.when(F.col("k") % 4 == 0, str(_M + 1)).otherwise(str(_M))), F.lit("xllcorner 0"), F.lit("yllcorner 0"), F.lit("cellsize 10"), F.lit("NODATA_value -9999"))

    def line(r):
        cell = lambda c: F.when((F.col("k") % 7 == 3) & (r == 5) & (c == 5), "x").otherwise(((F.col("k") * 31 + r * 7 + c * 3) % 1000).cast("string"))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(_N - 1)), cell), " ")

    rows = s.select(F.col("k").alias("raster_id"), F.posexplode(F.concat(head, F.transform(F.sequence(F.lit(0), F.lit(_M - 1)), line))).alias("line", "value"))
    path = scratch_folder(t.spark, "grids")
    rows.repartition("raster_id").sortWithinPartitions("raster_id", "line").select("raster_id", "value").write.partitionBy("raster_id").text(path)
    cells, files = landed.ascii_grids(t.spark, path, _store(t))
    known = F.regexp_extract("file", r"raster_id=([0-9]+)", 1).cast("long").alias("raster_id")
    by = cells.select(known, (F.col("value") * (F.col("row_ix") * _N + F.col("col_ix"))).alias("w")).groupBy("raster_id").agg(F.count("*").alias("n"), F.sum("w").alias("weighted"))
    return files.select(known, "error").join(by, "raster_id", "left").select("raster_id", "error", F.coalesce("n", F.lit(0)).alias("n_cells"), "weighted")


_XY = "round(49e0 + CAST(s_suppkey % 997 AS DOUBLE) * 0.001e0, 7) AS lat, round(18e0 + CAST(s_suppkey % 991 AS DOUBLE) * 0.001e0, 7) AS lon"


@query("gml_files", f"""SELECT CASE WHEN s_suppkey % 11 <> 5 THEN concat('PL.', CAST(s_suppkey AS VARCHAR)) END AS official_id, s_name AS name, CASE WHEN s_suppkey % 13 = 2 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'Point' ELSE 'Polygon' END AS gtype, CAST(CASE WHEN s_suppkey % 13 = 2 THEN -1 WHEN s_suppkey % 3 = 0 THEN 1 ELSE 4 END AS INT) AS n_points,
CASE WHEN s_suppkey % 13 <> 2 THEN lon END AS lon, CASE WHEN s_suppkey % 13 <> 2 THEN lat END AS lat, CASE WHEN s_suppkey % 11 = 5 THEN 'id' WHEN s_suppkey % 13 = 2 THEN 'geometry' END AS error FROM (SELECT *, {_XY} FROM supplier)""")
def gml_files(t):
    """Official features in XML files, read by their tag: points and rings, what is missing named."""
    k = F.col("s_suppkey")
    lat, lon = F.round(49.0 + (k % 997) * 0.001, 7), F.round(18.0 + (k % 991) * 0.001, 7)
    at = lambda a, b: F.concat_ws(" ", F.format_string("%.7f", lat + a), F.format_string("%.7f", lon + b))
    ring = F.concat_ws(" ", at(0.0, 0.0), at(0.0, 0.01), at(0.01, 0.0), at(0.0, 0.0))
    shape = F.when(k % 13 == 2, "").when(k % 3 == 0, F.concat(F.lit("<gml:Point><gml:pos>"), at(0.0, 0.0), F.lit("</gml:pos></gml:Point>")))
    shape = shape.otherwise(F.concat(F.lit("<gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>"), ring, F.lit("</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon>")))
    ident = F.when(k % 11 == 5, "").when(k % 2 == 0, F.concat(F.lit("<ms:IIP_IDENTY>PL."), k.cast("string"), F.lit("</ms:IIP_IDENTY>"))).otherwise(F.concat(F.lit("<ms:JPT_ID>PL."), k.cast("string"), F.lit("</ms:JPT_ID>")))
    text = F.concat(F.lit("<wfs:member><ms:A03><ms:msGeometry>"), shape, F.lit("</ms:msGeometry><ms:JPT_NAZWA_>"), "s_name", F.lit("</ms:JPT_NAZWA_>"), ident, F.lit("</ms:A03></wfs:member>"))
    path = scratch_folder(t.spark, "gml")
    head, foot = "<wfs:FeatureCollection xmlns:wfs='w' xmlns:gml='g' xmlns:ms='m'>", "</wfs:FeatureCollection>"
    # a file for each nation: its first line, its members, its last line
    lines = t("supplier").select("s_nationkey", F.lit(1).alias("at"), text.alias("value"))
    ends = t("supplier").select("s_nationkey").distinct().select("s_nationkey", F.explode(F.array(F.struct(F.lit(0).alias("at"), F.lit(head).alias("value")), F.struct(F.lit(2).alias("at"), F.lit(foot).alias("value")))).alias("e")).select("s_nationkey", "e.at", "e.value")
    lines.unionByName(ends).repartition("s_nationkey").sortWithinPartitions("s_nationkey", "at").select("s_nationkey", "value").write.partitionBy("s_nationkey").text(path)
    d = landed.gml_features(t.spark, path, "ms:A03", metric=False)
    first = F.get("points", F.lit(0))
    return d.select("official_id", "name", "gtype", F.coalesce(F.size("points"), F.lit(-1)).alias("n_points"), first["x"].alias("lon"), first["y"].alias("lat"), "error")


@query("wkb_zones", "SELECT area, 'MultiPolygon' AS gtype, count(DISTINCT ring) AS n_rings, count(*) AS n_points, round(sum(ax * by_ - bx * ay) / 2, 9) AS signed_area FROM zone_edge GROUP BY area", "zone_edge")
def wkb_zones(t):
    """Zones written as well-known binary and read again; each ring is a part here."""
    rings = t("zone_vertex").groupBy("area", "ring").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("p"))
    ring = F.struct("ring", F.transform(F.concat("p", F.slice("p", 1, 1)), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points"))
    zones = rings.groupBy("area").agg(F.array_sort(F.collect_list(ring)).alias("r"))
    parts = F.transform("r", lambda q: F.struct(q["ring"].alias("part"), F.lit(0).alias("ring"), q["points"].alias("points")))
    back = wkb.decode(zones.select("area", wkb.encoded(F.lit("MultiPolygon"), parts).alias("wkb")), "wkb").where("wkb_error is null")
    strip = lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(0.0), lambda s, i: s + F.element_at(p, i)["x"] * F.element_at(p, i + 1)["y"] - F.element_at(p, i + 1)["x"] * F.element_at(p, i)["y"])
    each = back.select("area", "gtype", F.explode("parts").alias("q")).select("area", "gtype", (F.size("q.points") - 1).alias("n"), strip(F.col("q.points")).alias("s"))
    return each.groupBy("area", "gtype").agg(F.count("*").alias("n_rings"), F.sum("n").alias("n_points"), F.round(F.sum("s") / 2, 9).alias("signed_area"))
