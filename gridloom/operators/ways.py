"""Ways: assembly from node references, segments, endpoints, geometry kind."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.functions import geo

#: Keys that make a closed way an area.
AREA_KEYS = ("building", "landuse", "amenity", "emergency", "healthcare", "industrial", "leisure", "natural", "water")


def assemble_ways(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Coordinates of each way in order: ``refs`` (way_id, pos, ref) meet ``nodes`` (id, lon, lat); unknown nodes are skipped, ways of fewer than two points dropped."""
    met = refs.join(nodes.select(F.col("id").alias("ref"), "lon", "lat"), "ref")
    line = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("lon").alias("x"), F.col("lat").alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return met.groupBy("way_id").agg(line.alias("line")).where(F.size("line") >= 2)


def geometry_kind(line: Column, tags: Column) -> Column:
    """Polygon for a closed line of four points or more with an area key, else LineString."""
    closed = (F.size(line) >= 4) & (F.element_at(line, 1) == F.element_at(line, -1))
    return F.when(closed & F.arrays_overlap(F.map_keys(tags), F.lit(list(AREA_KEYS))), "Polygon").otherwise("LineString")


def segments(nodes: DataFrame, *extra: str) -> DataFrame:
    """Consecutive points of each way (way_id, seq, lon, lat) in degrees and metres: one shuffle on the way."""
    w = W.partitionBy("way_id").orderBy("seq")
    p = geo.with_metric(nodes.select("way_id", "seq", *extra, F.col("lon").alias("lon1"), F.col("lat").alias("lat1")), "lon1", "lat1", "x1", "y1")
    for c in ("lon", "lat", "x", "y"):
        p = p.withColumn(f"{c}2", F.lead(f"{c}1").over(w))
    return p.where("lon2 is not null")


def clip_segments(seg: DataFrame, cx="cx", cy="cy", r="r") -> DataFrame:
    """Segments cut to the circle that they carry (columns), with the ends of what is inside and its ``length``; those outside go."""
    t_in, t_out = geo.clip_to_circle(F.col(cx), F.col(cy), F.col(r), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    s = geo.once(seg, "_t", a=t_in, b=t_out).where("_t.a < _t.b")
    dx, dy, a, b = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("_t.a"), F.col("_t.b")
    s = s.withColumns({"cx1": F.col("x1") + a * dx, "cy1": F.col("y1") + a * dy, "cx2": F.col("x1") + b * dx, "cy2": F.col("y1") + b * dy})
    return s.withColumn("length", (b - a) * F.hypot(dx, dy)).drop("_t")


def line_representative(line: Column) -> Column:
    """A vertex that stands for a line: the inner one nearest to the mean of all, an end where there is none."""
    n = F.size(line)
    mean = lambda f: F.aggregate(line, F.lit(0.0), lambda a, p: a + p[f]) / n
    mx, my = mean("x"), mean("y")
    inner = F.when(n > 2, F.slice(line, 2, n - 2)).otherwise(line)
    ranked = F.transform(inner, lambda p: F.struct(F.round(F.hypot(p["x"] - mx, p["y"] - my), 12).alias("d"), p["x"].alias("x"), p["y"].alias("y")))
    return F.array_min(ranked)


def circle_points(areas: DataFrame, segments: int = 32) -> DataFrame:
    """``areas`` (cx, cy, r in metres) once for each point of their closed ring: ``pos, lon, lat``, rounded to 7 decimals. Rows rather than arrays, so that
    the projection runs in generated code."""
    d = areas.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(segments))))
    angle = (F.col("pos") % segments).cast("double") * (2 * math.pi / segments)
    lon, lat = geo.to_degrees(F.col("cx") + F.col("r") * F.cos(angle), F.col("cy") + F.col("r") * F.sin(angle))
    return d.withColumn("lon", F.round(lon, 7)).withColumn("lat", F.round(lat, 7))
