"""Landed files by their path: GeoParquet classes with their metadata, official GML, large ASCII grids. What is refused is a row, not an exception."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import geo, wkb
from gridloom.sources.files import GRID_KEYS, class_drift

#: Bytes at the end of a Parquet file that are looked at for its footer.
FOOTER_BYTES = 8 << 20


class _Tail(io.RawIOBase):
    """A file of which only the end is there."""

    def __init__(self, tail: bytes, size: int):
        self.tail, self.size, self.at = tail, size, 0

    def readable(self):
        return True

    def seekable(self):
        return True

    def tell(self):
        return self.at

    def seek(self, to, whence=0):
        self.at = to + (0, self.at, self.size)[whence]
        return self.at

    def read(self, n=-1):
        lo = self.at - (self.size - len(self.tail))
        if lo < 0:
            raise ValueError("footer longer than FOOTER_BYTES")
        out = self.tail[lo:] if n < 0 else self.tail[lo : lo + n]
        self.at += len(out)
        return out


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq

    for pdf in batches:
        rows = []
        for path, size, tail in zip(pdf["path"], pdf["length"], pdf["tail"]):
            try:
                schema = pq.ParquetFile(_Tail(bytes(tail), int(size))).schema_arrow
                geo_ = json.loads((schema.metadata or {}).get(b"geo", b"{}"))
                own = geo_.get("columns", {}).get(geo_.get("primary_column", "geometry"), {})
                crs = own.get("crs", "OGC:CRS84") if own else None
                name = f"{crs['id']['authority']}:{crs['id']['code']}" if isinstance(crs, dict) and "id" in crs else crs if isinstance(crs, str) else None
                rows.append((path, schema.names, geo_.get("primary_column"), name, own.get("encoding"), sorted(own.get("geometry_types", [])), None))
            except Exception as e:  # whatever a broken file raises is its row
                rows.append((path, None, None, None, None, None, type(e).__name__))
        yield pd.DataFrame(rows, columns=["path", "columns", "geometry_column", "crs", "encoding", "geometry_types", "unreadable"])


def class_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each Parquet file under ``path``: its columns, the geometry column with its reference system, encoding and types as the file's own metadata states them, and the file's SHA-256. Files that are no Parquet are ``unreadable``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    tail = F.substring("content", -FOOTER_BYTES, FOOTER_BYTES)
    # a file is one value here, as for the checksum; few of them go to Python at once, and only their ends
    d = files.select("path", "length", F.sha2("content", 256).alias("sha256"), F.when(F.length("content") > FOOTER_BYTES, tail).otherwise(F.col("content")).alias("tail"))
    found = d.select("path", "length", "tail").mapInPandas(_footers, "path string, columns array<string>, geometry_column string, crs string, encoding string, geometry_types array<string>, unreadable string")
    return found.join(d.select("path", "sha256"), "path")


def class_file_drift(files: DataFrame, required: tuple[str, ...], family: str, expected: DataFrame | None = None) -> DataFrame:
    """``path, drift``: the first way in which each of ``class_files`` is not what was agreed, or null. ``expected`` (name, expected_sha256) has checksums by file name."""
    d = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    d = d.join(expected, "name", "left") if expected is not None else d.withColumn("expected_sha256", F.lit(None).cast("string"))
    # types are checked one by one; a file that states none is checked by its rows
    each = d.withColumn("family", F.lit(family)).withColumn("gtype", F.explode_outer(F.when(F.size("geometry_types") > 0, F.col("geometry_types"))))
    known = F.create_map(*[F.lit(x) for k in ("point", "line", "polygon") for x in (k, {"point": "Point", "line": "LineString", "polygon": "Polygon"}[k])])
    each = each.withColumn("gtype", F.coalesce("gtype", known[F.col("family")]))
    drift = F.when(F.col("unreadable").isNotNull(), "unreadable").otherwise(F.coalesce(class_drift(required), F.when(F.coalesce(F.col("encoding") != "WKB", F.lit(True)), "encoding")))
    return each.withColumn("drift", drift).groupBy("path").agg(F.min("drift").alias("drift"))


def scan_classes(spark: SparkSession, path: str, columns: list[str], family: str, box: tuple[float, float, float, float], expected: DataFrame | None = None, geometry: str = "geometry") -> tuple[DataFrame, DataFrame]:
    """(rows, refused) of class files: the named columns and the decoded geometry of rows near ``box``, and ``path, drift`` of files that are not read, or hold a geometry that is broken or of another family.

    The box is a predicate on the plain columns xmin, ymin, xmax and ymax or on the fields of a ``bbox`` column, so it reaches the reader and skips row groups. The names of the accepted files are the driver's, as for any scan."""
    drift = class_file_drift(class_files(spark, path), (*columns, geometry), family, expected)
    known = drift.collect()  # one row for each file
    good = [r.path for r in known if r.drift is None]
    bad = spark.createDataFrame([(r.path, r.drift) for r in known if r.drift is not None], "path string, drift string")
    if not good:
        return spark.createDataFrame([], ", ".join([*[f"`{c}` string" for c in columns], "gtype string", f"parts {wkb.PARTS}"])), bad
    d = spark.read.option("mergeSchema", "true").parquet(*good)
    side = (lambda c: F.col(c)) if "xmin" in d.columns else (lambda c: F.col(f"bbox.{c}"))
    x0, y0, x1, y1 = box
    near = d.where((side("xmax") >= x0) & (side("xmin") <= x1) & (side("ymax") >= y0) & (side("ymin") <= y1))
    rows = wkb.decode(near.select(*columns, geometry, F.col("_metadata.file_path").alias("_path")), geometry)
    wrong = F.when(F.col("wkb_error").isNotNull(), F.concat(F.lit("geometry "), F.col("wkb_error"))).when(F.col("gtype").isNotNull() & ~F.lower("gtype").endswith({"point": "point", "line": "linestring", "polygon": "polygon"}[family]), F.lit("geometry"))
    rows = rows.withColumn("_wrong", wrong)
    broken = rows.where("_wrong is not null").groupBy(F.col("_path").alias("path")).agg(F.min("_wrong").alias("drift"))
    fine = rows.join(broken.select(F.col("path").alias("_b")), F.col("_path") == F.col("_b"), "left_anti")
    return fine.select(*columns, "gtype", "parts"), bad.unionByName(broken)


_GML = ("`JPT_NAZWA_` string, `IIP_IDENTY` string, `JPT_ID` string, `msGeometry` struct<Polygon:struct<exterior:struct<LinearRing:struct<posList:string>>>,Point:struct<pos:string>,"
        "MultiSurface:struct<surfaceMember:array<struct<Polygon:struct<exterior:struct<LinearRing:struct<posList:string>>>>>>>, `_bad` string")


def gml_features(spark: SparkSession, path: str, feature_type: str, metric: bool = True) -> DataFrame:
    """``official_id, name, gtype, points, error`` of every element ``feature_type`` (its prefix plays no part) in the GML files under ``path``. Spark's XML reader goes through a file element by element, so a file may be of any size; files are shared out among tasks.

    Positions are northing before easting, of EPSG:2180 (else latitude before longitude, if not ``metric``), and become longitude and latitude rounded to 7 decimals. ``error`` is ``id`` or ``geometry`` for what is missing or odd in number; where a file is no XML from some place on, a row ``malformed`` stands for the rest of it."""
    d = (spark.read.format("xml").option("rowTag", feature_type.split(":")[-1]).option("ignoreNamespace", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(_GML).load(path))
    surface = F.coalesce("msGeometry.Polygon.exterior.LinearRing.posList", F.get("msGeometry.MultiSurface.surfaceMember.Polygon.exterior.LinearRing.posList", F.lit(0)))
    numbers = lambda c: F.transform(F.filter(F.split(F.trim(c), r"\s+"), lambda v: v != ""), lambda v: v.try_cast("double"))
    d = d.select("_bad", F.coalesce(F.nullif(F.trim("IIP_IDENTY"), F.lit("")), F.nullif(F.trim("JPT_ID"), F.lit(""))).alias("official_id"), F.trim("JPT_NAZWA_").alias("name"), numbers(surface).alias("ring"), numbers(F.col("msGeometry.Point.pos")).alias("pos"))
    whole = lambda c: F.forall(c, lambda v: v.isNotNull())
    polygon = F.coalesce((F.size("ring") >= 8) & (F.size("ring") % 2 == 0) & whole("ring"), F.lit(False))
    point = F.coalesce((F.size("pos") == 2) & whole("pos"), F.lit(False)) & F.col("ring").isNull()

    def place(north, east):
        lon, lat = geo.to_degrees(east, north) if metric else (east, north)
        return F.struct(F.round(lon, 7).alias("x"), F.round(lat, 7).alias("y"))

    values = F.when(polygon, F.col("ring")).when(point, F.col("pos"))
    pairs = F.transform(F.sequence(F.lit(1), F.size(values) - 1, F.lit(2)), lambda i: place(F.element_at(values, i), F.element_at(values, i + 1)))
    error = F.when(F.col("_bad").isNotNull(), "malformed").when(F.col("official_id").isNull(), "id").when(~(polygon | point), "geometry")
    return d.select("official_id", "name", F.when(polygon, "Polygon").when(point, "Point").alias("gtype"), F.when(polygon | point, pairs).alias("points"), error.alias("error"))


def grid_lines(spark: SparkSession, path: str, store) -> DataFrame:
    """``file, line, text``: the lines of text files that are not blank, numbered from 1 in each file, of files that Spark reads in splits. Lines of a split are counted, and the counts of the splits before it give its first number.
    ``store`` writes a table and reads it back, so that the numbers stay what they are."""
    d = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("text"))
    d = store(d.where("text <> ''").withColumn("m", F.monotonically_increasing_id()), "lines")
    splits = d.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "block", "first", before.alias("start"))  # a row for each split
    return d.join(starts, ["file", "block"]).select("file", (F.col("start") + F.col("m") - F.col("first") + 1).alias("line"), "text")


def ascii_grids(spark: SparkSession, path: str, store) -> tuple[DataFrame, DataFrame]:
    """(cells, files) of ASCII grids under ``path``: ``file, row_ix, col_ix, value``, and for each file its header and ``error``, the rule that it breaks, or null. No file and no grid is ever one value: lines are rows.

    Rules in order: ``header`` (the six fields, each once, in the first six lines, numbers of rows and columns whole and above 0, all finite, cells wider than 0), ``rows`` (as many as stated), ``row`` (a row of another width or with what is no finite number)."""
    lines = store(grid_lines(spark, path, store), "numbered")
    words = F.split("text", " ")
    head = lines.where("line <= 6").select("file", F.size(words).alias("n"), F.lower(F.get(words, F.lit(0))).alias("key"), F.get(words, F.lit(1)).alias("raw"))
    head = head.withColumn("value", F.col("raw").try_cast("double"))
    pick = lambda k, c: F.max(F.when(F.col("key") == k, F.col(c))).alias(k if c == "value" else f"raw_{k}")
    by = head.groupBy("file").agg(F.count_if((F.col("n") == 2) & F.col("key").isin(*GRID_KEYS) & (F.abs("value") < float("inf"))).alias("good"), F.count_distinct("key").alias("keys"), *[pick(k, "value") for k in GRID_KEYS], pick("ncols", "raw"), pick("nrows", "raw"))
    whole = F.col("raw_ncols").rlike("^[+]?[0-9]+$") & F.col("raw_nrows").rlike("^[+]?[0-9]+$") & (F.col("ncols") > 0) & (F.col("nrows") > 0) & (F.col("cellsize") > 0)
    by = by.select("file", *GRID_KEYS, (F.coalesce((F.col("good") == 6) & (F.col("keys") == 6) & whole, F.lit(False))).alias("headed"))
    body = lines.where("line > 6").select("file", "line", words.alias("w")).join(by.select("file", "ncols"), "file")
    number = lambda v: F.coalesce(F.abs(v.try_cast("double")) < float("inf"), F.lit(False))
    counts = body.groupBy("file").agg(F.count("*").alias("n"), F.count_if(~F.coalesce((F.size("w") == F.col("ncols")) & F.forall("w", number), F.lit(False))).alias("bad"))
    files = by.join(counts, "file", "left")
    error = F.when(~F.col("headed"), "header").when(F.coalesce("n", F.lit(0)) != F.col("nrows"), "rows").when(F.col("bad") > 0, "row")
    files = store(files.select("file", *GRID_KEYS, error.alias("error")), "grids")
    good = files.where("error is null").select("file")
    cells = lines.where("line > 6").join(good, "file").select("file", (F.col("line") - 7).cast("int").alias("row_ix"), F.posexplode(words).alias("col_ix", "v"))
    return cells.select("file", "row_ix", "col_ix", F.col("v").cast("double").alias("value")), files
