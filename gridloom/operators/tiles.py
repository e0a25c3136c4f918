"""Map tiles: cover of boxes, features in tiles, contents, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.functions import geo

MIN_ZOOM, MAX_ZOOM = 7, 14


def tile_cover(boxes: DataFrame, min_zoom: Column, max_zoom: int = MAX_ZOOM) -> DataFrame:
    """``boxes`` (xmin, ymin, xmax, ymax) once for each tile (z, x, y) that they meet."""
    first = F.greatest(min_zoom, F.lit(MIN_ZOOM))
    d = boxes.where(first <= max_zoom).withColumn("z", F.explode(F.sequence(first, F.lit(max_zoom))))
    z = F.col("z")
    # the range of a box at a zoom is worked out once, not again for each column of tiles
    d = geo.once(d, "_q", w=geo.tile_x(F.col("xmin"), z), e=geo.tile_x(F.col("xmax"), z), n=geo.tile_y(F.col("ymax"), z), s=geo.tile_y(F.col("ymin"), z))
    d = d.withColumn("x", F.explode(F.sequence("_q.w", "_q.e")))
    return d.withColumn("y", F.explode(F.sequence("_q.n", "_q.s"))).drop("_q")


def segment_tiles(seg: DataFrame, min_zoom: Column, max_zoom: int = MAX_ZOOM) -> DataFrame:
    """Segments (lon1, lat1, lon2, lat2) once for each tile they touch. A segment is laid out by the rows of tiles that it crosses, and in each row by the columns of the part inside, so
    a long one costs what it crosses and not what its box covers."""
    first = F.greatest(min_zoom, F.lit(MIN_ZOOM))
    d = seg.where(first <= max_zoom).withColumn("z", F.explode(F.sequence(first, F.lit(max_zoom))))
    z = F.col("z")
    low, high = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    d = d.withColumn("y", F.explode(F.sequence(geo.tile_y(high, z), geo.tile_y(low, z))))
    y = F.col("y")
    # the part of the segment in the row, by latitude
    band = F.explode(F.array(F.struct(F.greatest(low, geo.tile_north(y + 1, z)).alias("s"), F.least(high, geo.tile_north(y, z)).alias("n"))))
    d = d.withColumn("_b", band)
    dlat, dlon = F.col("lat2") - F.col("lat1"), F.col("lon2") - F.col("lon1")
    at = lambda lat: F.when(dlat != 0, F.col("lon1") + (lat - F.col("lat1")) / F.nullif(dlat, F.lit(0.0)) * dlon)
    d = d.withColumn("_e", F.explode(F.array(F.struct(F.coalesce(at(F.col("_b.s")), F.col("lon1")).alias("p"), F.coalesce(at(F.col("_b.n")), F.col("lon2")).alias("q")))))
    west, east = F.greatest(F.least("_e.p", "_e.q"), F.least("lon1", "lon2")), F.least(F.greatest("_e.p", "_e.q"), F.greatest("lon1", "lon2"))
    d = d.withColumn("x", F.explode(F.sequence(geo.tile_x(west - 1e-12, z), geo.tile_x(east + 1e-12, z)))).drop("_b", "_e")
    x = F.col("x")
    # bounds of the tile and the part inside are worked out once, since the next step reads them several times
    d = geo.once(d, "_k", w=geo.tile_west(x, z), s=geo.tile_north(y + 1, z), e=geo.tile_west(x + 1, z), n=geo.tile_north(y, z))
    a, b = geo.clip_to_box(*[F.col(f"_k.{k}") for k in "wsen"], F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    return geo.once(d, "_t", a=a, b=b).where("_t.a <= _t.b").drop("_k", "_t")


def polygon_tiles(edges: DataFrame, min_zoom: int = MIN_ZOOM, max_zoom: int = MAX_ZOOM) -> DataFrame:
    """``area, z, x, y, whole``: the tiles that areas (directed edges area, ax, ay, bx, by in degrees; holes and parts by even and odd crossings) meet; ``whole`` where the tile lies inside of the area without an edge.

    Along the middle latitude of each row of tiles the crossings of the edges, in order, bound the stretches inside; their tiles that no edge touches are whole."""
    seg = edges.select("area", F.col("ax").alias("lon1"), F.col("ay").alias("lat1"), F.col("bx").alias("lon2"), F.col("by").alias("lat2"))
    border = segment_tiles(seg, F.lit(min_zoom), max_zoom).select("area", "z", "x", "y").distinct()
    z = F.col("z")
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    d = edges.select("area", "ax", "ay", "bx", "by").withColumn("z", F.explode(F.sequence(F.lit(max(MIN_ZOOM, min_zoom)), F.lit(max_zoom))))
    d = d.withColumn("y", F.explode(F.sequence(geo.tile_y(high, z), geo.tile_y(low, z))))
    d = d.withColumn("_m", F.explode(F.array(geo.tile_north(F.col("y") + 0.5, z)))).where((F.col("_m") >= low) & (F.col("_m") < high))
    lon = F.col("ax") + (F.col("_m") - F.col("ay")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0)) * (F.col("bx") - F.col("ax"))
    w = W.partitionBy("area", "z", "y").orderBy("lon")  # the edges of one area that cross one line
    d = d.select("area", "z", "y", lon.alias("lon")).select("*", F.row_number().over(w).alias("i"), F.lead("lon").over(w).alias("to")).where("i % 2 = 1 and to is not null")
    inside = d.select("area", "z", F.explode(F.sequence(geo.tile_x(F.col("lon"), z), geo.tile_x(F.col("to"), z))).alias("x"), "y").join(border, ["area", "z", "x", "y"], "left_anti").distinct()
    return border.withColumn("whole", F.lit(False)).unionByName(inside.withColumn("whole", F.lit(True)))


def merged_whole_tiles(tiles: DataFrame) -> DataFrame:
    """The whole tiles of :func:`polygon_tiles` that no whole tile of the zoom before contains: with their parts at higher zooms they are all of them."""
    whole = tiles.where("whole").select("area", "z", "x", "y")
    above = whole.select("area", (F.col("z") + 1).alias("z"), F.col("x").alias("px"), F.col("y").alias("py"))
    inner = whole.withColumns({"px": F.shiftright("x", 1), "py": F.shiftright("y", 1)})
    return inner.join(above, ["area", "z", "px", "py"], "left_anti").drop("px", "py")


def tile_counts(placed: DataFrame, layer: str = "layer", once_each: bool = False) -> DataFrame:
    """Distinct features by tile and layer. ``once_each``: no feature comes twice in a tile, as points with keys of their own do; then rows are counted and no task holds the features of its tiles."""
    return placed.groupBy("z", "x", "y", layer).agg((F.count("source_id") if once_each else F.count_distinct("source_id")).alias("n_features"))


#: Features of a part of a tile's contents, on average.
PART = 1000


def tile_contents(placed: DataFrame, layer: str = "layer", part: int = PART) -> DataFrame:
    """The features of each tile and layer for a tile writer, as sorted arrays of about ``part`` features each, told apart by ``part``. A tile of a low zoom holds a whole region, so it is dealt over
    as many parts as it needs by a hash of the feature; no array and no task holds a tile in whole."""
    key = ["z", "x", "y", layer]
    size = placed.groupBy(*key).agg(F.ceil(F.count("*") / part).alias("_n"))
    d = placed.join(size, key).withColumn("part", F.pmod(F.crc32(F.encode(F.col("source_id").cast("string"), "UTF-8")), F.col("_n")).cast("int"))
    return d.groupBy(*key, "part").agg(F.array_sort(F.collect_set("source_id")).alias("features"))


def in_curve_order(tiles: DataFrame, bits: int = MAX_ZOOM) -> DataFrame:
    """Tiles dealt and sorted by zoom and place on the Hilbert curve, so that near tiles lie in one file."""
    t = tiles.withColumn("place", geo.hilbert(F.col("x"), F.col("y"), bits))
    return t.repartitionByRange("z", "place").sortWithinPartitions("z", "place")
