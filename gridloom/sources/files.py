"""Landed files as tables: map elements, GeoJSON, official GML, capability documents, relation XML, ASCII grids, GeoParquet classes.

XML and JSON are parsed by Spark's own readers; where files are already rows of text, by the same parsers as
functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENT = "type string, id long, lat double, lon double, nodes array<long>, tags map<string,string>, members array<struct<type:string,ref:long,role:string>>"
GRID_KEYS = ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value")


def map_elements(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the ``elements`` array of JSON files."""
    return spark.read.schema(f"elements array<struct<{', '.join(x.replace(' ', ':', 1) for x in ELEMENT.split(', '))}>>").json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*")


def split_elements(elements: DataFrame) -> dict[str, DataFrame]:
    """Nodes, ways and relations; nodes without tags are kept, since ways need their places, and marked ``is_feature`` false."""
    tagged = F.coalesce(F.size("tags") > 0, F.lit(False))
    e = elements.withColumn("is_feature", tagged)
    return {"node": e.where("type = 'node'").select("id", "lon", "lat", "tags", "is_feature"), "way": e.where("type = 'way'").select("id", "nodes", "tags", "is_feature"),
            "relation": e.where("type = 'relation'").select("id", "members", "tags", "is_feature")}


_COORDS = {"Point": "array<double>", "LineString": "array<array<double>>", "MultiPoint": "array<array<double>>", "Polygon": "array<array<array<double>>>", "MultiLineString": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>"}


def geojson_features(texts: DataFrame, column: str = "text") -> DataFrame:
    """Features of FeatureCollection texts: ``properties`` as a map, ``gtype``, coordinates as JSON text and ``crs`` (EPSG:4326 where missing).

    Texts of another type give no row; see :func:`geojson_rejects`."""
    doc = F.from_json(column, "type string, crs struct<properties:struct<name:string>>, features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>")
    d = texts.withColumn("_d", doc).where("_d.type = 'FeatureCollection'")
    d = d.withColumn("crs", F.coalesce("_d.crs.properties.name", F.lit("EPSG:4326"))).withColumn("_f", F.explode("_d.features"))
    return d.select(*texts.columns, "crs", F.col("_f.properties").alias("properties"), F.col("_f.geometry.type").alias("gtype"), F.col("_f.geometry.coordinates").alias("coordinates")).drop(column)


def geojson_rejects(texts: DataFrame, column: str = "text") -> DataFrame:
    return texts.where(~F.coalesce(F.get_json_object(column, "$.type") == "FeatureCollection", F.lit(False)))


def points(features: DataFrame, gtype: str) -> DataFrame:
    """Coordinates of one geometry type, parsed by its own schema."""
    return features.where(F.col("gtype") == gtype).withColumn("coordinates", F.from_json("coordinates", _COORDS[gtype]))


def in_box(d: DataFrame, columns: list[str], box: tuple[float, float, float, float]) -> DataFrame:
    """The named columns of rows whose box (xmin, ymin, xmax, ymax) meets ``box``; over a Parquet scan the predicate reaches the reader."""
    lost = [c for c in (*columns, "xmin", "ymin", "xmax", "ymax") if c not in d.columns]
    if lost:
        raise ValueError(f"the class file lacks {', '.join(lost)}")
    x0, y0, x1, y1 = box
    return d.where((F.col("xmax") >= x0) & (F.col("xmin") <= x1) & (F.col("ymax") >= y0) & (F.col("ymin") <= y1)).select(*columns)


#: Coordinate system that class files must have, and the geometry types of each family.
CLASS_CRS = "EPSG:2180"
FAMILIES = {"point": ("Point",), "line": ("LineString", "MultiLineString"), "polygon": ("Polygon", "MultiPolygon")}


def class_drift(required: tuple[str, ...]):
    """The first way in which a class file (columns, crs, family, gtype, sha256, expected_sha256) is not what was agreed, or null."""
    family = F.when(F.col("gtype").isin(*FAMILIES["point"]), "point").when(F.col("gtype").isin(*FAMILIES["line"]), "line").when(F.col("gtype").isin(*FAMILIES["polygon"]), "polygon").otherwise("other")
    lost = F.array_except(F.lit(list(required)), F.col("columns"))
    return (F.when(F.col("expected_sha256").isNotNull() & (F.col("sha256") != F.col("expected_sha256")), "checksum").when(F.size(lost) > 0, F.concat(F.lit("missing "), F.array_join(F.array_sort(lost), ",")))
            .when(F.col("crs").isNull(), "crs missing").when(F.upper("crs") != CLASS_CRS, "crs").when(family != F.col("family"), "geometry"))


def class_scan(spark: SparkSession, path: str, columns: list[str], box: tuple[float, float, float, float]) -> DataFrame:
    """A class file: the needed columns of the row groups and rows near ``box``."""
    return in_box(spark.read.parquet(path), columns, box)


_GML = "JPT_NAZWA_ string, IIP_IDENTY string, JPT_ID string, posList string"


def gml_members(texts: DataFrame, column: str = "text") -> DataFrame:
    """Members of official GML rows: id (IIP_IDENTY, else JPT_ID), name and ring; the order of axes is turned to longitude, latitude. ``error`` names what is missing."""
    x = F.from_xml(column, _GML)
    d = texts.withColumn("_x", x)
    n = F.filter(F.split(F.trim("_x.posList"), r"\s+"), lambda v: v != "")
    pair = F.transform(F.sequence(F.lit(0), (F.size(n) / 2).cast("int") - 1), lambda i: F.struct(F.round(F.element_at(n, 2 * i + 2).cast("double"), 7).alias("x"), F.round(F.element_at(n, 2 * i + 1).cast("double"), 7).alias("y")))
    ident = F.coalesce("_x.IIP_IDENTY", "_x.JPT_ID")
    fine = F.coalesce(F.size(n) >= 2, F.lit(False))
    error = F.when(ident.isNull(), "id").when(~fine, "geometry")
    return d.select(*[c for c in texts.columns if c != column], ident.alias("official_id"), F.col("_x.JPT_NAZWA_").alias("name"), F.when(fine, pair).alias("ring"), error.alias("error"))


def capability_layers(texts: DataFrame, column: str = "text", required: tuple[str, ...] = (), version: str = "1.3.0") -> DataFrame:
    """Layers of capability documents that have a name and a box: title (else the name), scale range, box and legend, with ``drift``: what the whole document breaks (its version, a box
    that is no number, layers of ``required`` that are missing), or null."""
    box = "EX_GeographicBoundingBox struct<westBoundLongitude:string,southBoundLatitude:string,eastBoundLongitude:string,northBoundLatitude:string>"
    schema = f"_version string, Layer array<struct<Name:string,Title:string,MinScaleDenominator:double,MaxScaleDenominator:double,{box.replace(' struct', ':struct', 1)},Style:struct<LegendURL:struct<OnlineResource:struct<_href:string>>>>>"
    d = texts.withColumn("_d", F.from_xml(column, schema))
    named = F.filter("_d.Layer", lambda l: l["Name"].isNotNull() & l["EX_GeographicBoundingBox"].isNotNull())
    side = lambda l, c: l["EX_GeographicBoundingBox"][f"{c}"].try_cast("double")
    sides = ("westBoundLongitude", "southBoundLatitude", "eastBoundLongitude", "northBoundLatitude")
    total = lambda l: side(l, sides[0]) + side(l, sides[1]) + side(l, sides[2]) + side(l, sides[3])
    bad = F.exists("_n", lambda l: total(l).isNull() | F.isnan(total(l)))
    lost = F.array_except(F.lit(list(required)) if required else F.array().cast("array<string>"), F.transform("_n", lambda l: l["Name"]))
    d = d.withColumn("_n", F.coalesce(named, F.filter("_d.Layer", lambda l: F.lit(False)))).withColumn("drift", F.when(~F.coalesce(F.col("_d._version") == version, F.lit(False)), "version").when(bad, "bounds").when(F.size(lost) > 0, F.concat(F.lit("missing "), F.array_join(F.array_sort(lost), ","))))
    l = d.withColumn("_l", F.explode_outer("_n"))
    legend = F.col("_l.Style.LegendURL.OnlineResource._href")
    return l.select(*[c for c in texts.columns if c != column], F.col("_l.Name").alias("layer"), F.coalesce("_l.Title", "_l.Name").alias("title"), F.col("_l.MinScaleDenominator").alias("min_scale"), F.col("_l.MaxScaleDenominator").alias("max_scale"),
                    *[side(F.col("_l"), c).alias(n) for c, n in zip(sides, ("west", "south", "east", "north"))], F.when(F.contains(legend, F.lit("GetLegendGraphic")), legend).alias("legend"), "drift")


def relation_members(texts: DataFrame, column: str = "text") -> DataFrame:
    """Members of relation XML rows whose tag power is circuit; members of other types or without a whole number as reference go."""
    schema = "_id long, member array<struct<_type:string,_ref:string,_role:string>>, tag array<struct<_k:string,_v:string>>"
    d = texts.withColumn("_r", F.from_xml(column, schema)).where(F.exists("_r.tag", lambda x: (x["_k"] == "power") & (x["_v"] == "circuit")))
    m = d.select(F.col("_r._id").alias("relation_id"), F.posexplode("_r.member").alias("pos", "m"))
    return m.where(F.col("m._type").isin("node", "way", "relation") & F.col("m._ref").rlike("^[0-9]+$")).select("relation_id", "pos", F.col("m._type").alias("type"), F.col("m._ref").cast("long").alias("ref"), F.coalesce(F.nullif(F.col("m._role"), F.lit("")), F.lit("member")).alias("role"))


def grid_cells(files: DataFrame, id_col: str = "raster_id", column: str = "text") -> DataFrame:
    """Cells of ASCII grids: the six header fields in order, exact numbers of rows and columns, finite values; a file that breaks a rule gives no cell."""
    lines = F.filter(F.transform(F.split(column, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    d = files.select(F.col(id_col), lines.alias("_l"))
    part = lambda i, j: F.get(F.split(F.get("_l", F.lit(i)), r"\s+"), F.lit(j))
    d = d.where(F.size("_l") > 6)
    fine = F.lit(True)
    for i, k in enumerate(GRID_KEYS):
        fine = fine & F.coalesce((F.lower(part(i, 0)) == k) & part(i, 1).try_cast("double").isNotNull(), F.lit(False))
    rows = F.transform(F.slice("_l", 7, F.greatest(F.size("_l") - 6, F.lit(0))), lambda x: F.split(x, r"\s+"))
    d = d.where(fine).select(id_col, part(0, 1).try_cast("int").alias("_n"), part(1, 1).try_cast("int").alias("_m"), rows.alias("_v"))
    number = lambda v: F.coalesce(F.abs(v.try_cast("double")) < F.lit(float("inf")), F.lit(False))
    d = d.where((F.size("_v") == F.col("_m")) & F.forall("_v", lambda r: (F.size(r) == F.col("_n")) & F.forall(r, number)))
    d = d.select(id_col, F.posexplode("_v").alias("row_ix", "_r")).select(id_col, "row_ix", F.posexplode("_r").alias("col_ix", "_x"))
    return d.select(id_col, "row_ix", "col_ix", F.col("_x").try_cast("double").alias("value"))


LAYER = ["aoi_id", "domain", "layer_id"]


def write_layers(features: DataFrame, path: str, expected: DataFrame | None = None) -> None:
    """One folder for each area, domain and layer. With ``expected`` (aoi_id, domain, layer_id) a table of all layers, filled, empty or not expected, is written after them, with what lies on disk counted: so an empty layer
    leaves a trace, and a folder without that table is an unfinished one."""
    features.write.mode("overwrite").partitionBy(*LAYER).parquet(path)
    if expected is None:
        return
    there = _read_layers(features.sparkSession, features.schema, path).groupBy(*LAYER).agg(F.count("*").alias("feature_count")).withColumnsRenamed({c: f"w_{c}" for c in LAYER})
    asked = expected.select(*LAYER).distinct().withColumn("expected", F.lit(True))
    both = asked.join(there, [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in LAYER], "full")
    both = both.select(*[F.coalesce(c, f"w_{c}").alias(c) for c in LAYER], F.coalesce("expected", F.lit(False)).alias("expected"), F.coalesce("feature_count", F.lit(0)).cast("long").alias("feature_count"))
    both.write.mode("overwrite").parquet(f"{path.rstrip('/')}/_layers")


def _read_layers(spark: SparkSession, schema, path: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def layer_list(spark: SparkSession, path: str) -> DataFrame:
    """``aoi_id, domain, layer_id, expected, feature_count`` of the layers under a path, the empty ones among them. Fails if writing them did not end."""
    return spark.read.parquet(f"{path.rstrip('/')}/_layers")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir), removed when the driver's JVM ends. Where that is unset a local master, as in tests, has a temporary
    folder; on a cluster it is an error."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}"
    own = f"{base.rstrip('/')}/gridloom-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(own)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return f"{own}/{name}"
