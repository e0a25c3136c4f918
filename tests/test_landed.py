"""Files written here and read back: GeoParquet classes, GML, ASCII grids; broken ones are rows."""

import hashlib
import json
import math
import random
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geo, wkb
from gridloom.sources import landed
from tests.test_areas import store


def raw(kind, body, end="<", code=None):
    return (b"\x01" if end == "<" else b"\x00") + struct.pack(end + "I", code or wkb._CODES[kind]) + body


def xy(points, end="<"):
    return b"".join(struct.pack(end + "d" * len(p), *p) for p in points)


def counted(points, end="<"):
    return struct.pack(end + "I", len(points)) + xy(points, end)


SQUARE, HOLE = [(0, 0), (4, 0), (4, 4), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)]
CASES = [
    (raw("Point", xy([(1.5, -2)])), "Point", [(0, 0, [(1.5, -2)])]),
    (raw("Point", xy([(1.5, -2)], ">"), ">"), "Point", [(0, 0, [(1.5, -2)])]),
    (raw("Point", xy([(math.nan, math.nan)])), "Point", []),
    (raw("LineString", counted([(0, 0), (1, 2), (3, 4)])), "LineString", [(0, 0, [(0, 0), (1, 2), (3, 4)])]),
    (raw("LineString", counted([])), "LineString", []),
    (raw("LineString", counted([(0, 0, 9), (1, 2, 9)]), code=1002), "LineString", [(0, 0, [(0, 0), (1, 2)])]),
    (raw("LineString", counted([(0, 0, 9, 8), (1, 2, 9, 8)]), code=3002), "LineString", [(0, 0, [(0, 0), (1, 2)])]),
    (raw("Point", struct.pack("<I", 2180) + xy([(7, 8, 9)]), code=0xA0000001), "Point", [(0, 0, [(7, 8)])]),
    (raw("Polygon", struct.pack("<I", 2) + counted(SQUARE) + counted(HOLE)), "Polygon", [(0, 0, SQUARE), (0, 1, HOLE)]),
    (raw("MultiPoint", struct.pack("<I", 2) + raw("Point", xy([(1, 1)])) + raw("Point", xy([(2, 2)], ">"), ">")), "MultiPoint", [(0, 0, [(1, 1)]), (1, 0, [(2, 2)])]),
    (raw("MultiLineString", struct.pack("<I", 2) + raw("LineString", counted([(0, 0), (1, 1)])) + raw("LineString", counted([(5, 5), (6, 6)]))), "MultiLineString", [(0, 0, [(0, 0), (1, 1)]), (1, 0, [(5, 5), (6, 6)])]),
    (raw("MultiPolygon", struct.pack("<I", 2) + raw("Polygon", struct.pack("<I", 1) + counted(SQUARE)) + raw("Polygon", struct.pack("<I", 2) + counted(SQUARE) + counted(HOLE))), "MultiPolygon", [(0, 0, SQUARE), (1, 0, SQUARE), (1, 1, HOLE)]),
    (raw("GeometryCollection", struct.pack("<I", 1) + raw("Point", xy([(1, 1)]))), "GeometryCollection", []),
]
BROKEN = [b"", b"\x01", CASES[3][0][:-1], CASES[0][0] + b"x", raw("Point", xy([(1, 1)]), code=99), raw("LineString", struct.pack("<I", 2**31))]


def test_wkb(spark):
    rows = [(i, c[0]) for i, c in enumerate(CASES)] + [(100 + i, b) for i, b in enumerate(BROKEN)] + [(200, None)]
    d = spark.createDataFrame(rows, "id int, wkb binary")
    got = {r.id: r for r in wkb.decode(d, "wkb").collect()}
    for i, (_, kind, parts) in enumerate(CASES):
        assert got[i].gtype == kind and got[i].wkb_error is None
        assert [(p.part, p.ring, [(q.x, q.y) for q in p.points]) for p in got[i].parts] == parts
    assert all(got[100 + i].wkb_error and got[100 + i].gtype is None and got[100 + i].parts is None for i in range(len(BROKEN)))
    assert got[200].gtype is None and got[200].wkb_error is None
    again = wkb.decode(wkb.decode(d, "wkb").withColumn("w", wkb.encoded(F.col("gtype"), F.col("parts"))).drop("gtype", "parts", "wkb_error").where("id < 100"), "w").collect()
    assert all((r.gtype, r.parts) == (got[r.id].gtype, got[r.id].parts) for r in again if r.gtype != "GeometryCollection") and len(again) == len(CASES)


COLUMNS = ["gml_id", "class", "name", "flag"]


def class_file(path, rows, crs="EPSG:2180", types=("LineString",), encoding="WKB", drop=(), nested=False, geo_meta=True):
    boxes = [(min(p[0] for p in line), min(p[1] for p in line), max(p[0] for p in line), max(p[1] for p in line)) for _, line, _ in rows]
    data = {c: [f"{c}{i}" for i, _, _ in rows] for c in COLUMNS if c not in drop} | {"more": [1] * len(rows), "geometry": [w for _, _, w in rows]}
    data |= {"bbox": [dict(zip(("xmin", "ymin", "xmax", "ymax"), b)) for b in boxes]} if nested else {k: [float(b[j]) for b in boxes] for j, k in enumerate(("xmin", "ymin", "xmax", "ymax"))}
    t = pa.table(data)
    auth, code = crs.split(":") if crs else (None, None)
    meta = {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": encoding, "geometry_types": list(types), "crs": {"id": {"authority": auth, "code": int(code)}} if crs else None}}}
    pq.write_table(t.replace_schema_metadata({"geo": json.dumps(meta)} if geo_meta else {}), path, row_group_size=10)


def line_row(i, x, y):
    line = [(float(x), float(y)), (x + 5.0, y + 5.0)]
    return i, line, raw("LineString", counted(line))


@pytest.mark.parametrize("nested", [False, True])
def test_class_files(spark, tmp_path, nested):
    rows = [line_row(i, 100 * i, 50 * i) for i in range(60)]
    class_file(tmp_path / "good.parquet", rows, nested=nested)
    class_file(tmp_path / "multi.parquet", [(99, [(0.0, 0.0), (1.0, 1.0)], raw("MultiLineString", struct.pack("<I", 1) + raw("LineString", counted([(0, 0), (1, 1)]))))], types=("MultiLineString", "LineString"), nested=nested)
    class_file(tmp_path / "crs.parquet", rows[:3], crs="EPSG:4326", nested=nested)
    class_file(tmp_path / "nocrs.parquet", rows[:3], crs=None, nested=nested)
    class_file(tmp_path / "columns.parquet", rows[:3], drop=("name", "flag"), nested=nested)
    class_file(tmp_path / "types.parquet", rows[:3], types=("Polygon",), nested=nested)
    class_file(tmp_path / "encoding.parquet", rows[:3], encoding="point", nested=nested)
    class_file(tmp_path / "nogeo.parquet", rows[:3], geo_meta=False, nested=nested)
    class_file(tmp_path / "liar.parquet", [(7, [(0.0, 0.0), (1.0, 1.0)], raw("Point", xy([(1, 1)])))], nested=nested)
    class_file(tmp_path / "broken.parquet", [(8, [(0.0, 0.0), (1.0, 1.0)], b"\x01\x02")], nested=nested)
    class_file(tmp_path / "sum.parquet", rows[:3], nested=nested)
    (tmp_path / "junk.parquet").write_bytes(b"no parquet at all")
    sums = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.glob("*.parquet")}
    stated = spark.createDataFrame([("good.parquet", sums["good.parquet"]), ("sum.parquet", "0" * 64)], "name string, expected_sha256 string")
    files = {r.path.split("/")[-1]: r for r in landed.class_files(spark, str(tmp_path)).collect()}
    assert {k: r.sha256 for k, r in files.items()} == sums and files["junk.parquet"].unreadable and files["good.parquet"].geometry_types == ["LineString"]
    got, refused = landed.scan_classes(spark, str(tmp_path), COLUMNS, "line", (1000.0, 0.0, 2000.0, 10_000.0), stated)
    assert {r.path.split("/")[-1]: r.drift for r in refused.collect()} == {"crs.parquet": "crs", "nocrs.parquet": "crs missing", "columns.parquet": "missing flag,name", "types.parquet": "geometry", "encoding.parquet": "encoding",
                                                                           "nogeo.parquet": "crs missing", "sum.parquet": "checksum", "junk.parquet": "unreadable"}
    assert got.columns == [*COLUMNS, "gtype", "parts"]
    assert sorted(r.gml_id for r in got.collect()) == sorted(f"gml_id{i}" for i in range(10, 21))
    one = got.where("gml_id = 'gml_id12'").first()
    assert [(p.x, p.y) for p in one.parts[0].points] == [(1200.0, 600.0), (1205.0, 605.0)]
    every, refused = landed.scan_classes(spark, str(tmp_path), COLUMNS, "line", (-1e9, -1e9, 1e9, 1e9))
    assert {k: v for k, v in ((r.path.split("/")[-1], r.drift) for r in refused.collect()) if k in ("liar.parquet", "broken.parquet", "sum.parquet")} == {"liar.parquet": "geometry", "broken.parquet": "geometry cut off"}
    assert every.count() == 60 + 1 + 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "xmax" in plan.split("PushedFilters")[1][:200]
    none, refused = landed.scan_classes(spark, str(tmp_path / "junk.parquet"), COLUMNS, "line", (0.0, 0.0, 1.0, 1.0))
    assert none.count() == 0 and refused.count() == 1


def test_gml(spark, tmp_path):
    """Many members in one file that Spark splits, and one of each fault."""
    rng = random.Random(1)
    spot = lambda: (rng.uniform(200_000, 500_000), rng.uniform(400_000, 600_000))
    member = lambda ident, name, geometry: f"<wfs:member><ms:A03 gml:id='x'>{geometry}<ms:JPT_NAZWA_> {name} </ms:JPT_NAZWA_>{ident}<ms:OTHER>1</ms:OTHER></ms:A03></wfs:member>\n"
    polygon = lambda ring: f"<ms:msGeometry><gml:Polygon srsName='EPSG:2180'><gml:exterior><gml:LinearRing><gml:posList srsDimension='2'> {' '.join(f'{n} {e}' for n, e in ring)}\n</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></ms:msGeometry>"
    point = lambda p: f"<ms:msGeometry><gml:Point><gml:pos>{p[0]} {p[1]}</gml:pos></gml:Point></ms:msGeometry>"
    rings = {f"PL.{i}": [spot() for _ in range(4)] for i in range(400)}
    body = "".join(member(f"<ms:IIP_IDENTY>{k}</ms:IIP_IDENTY><ms:JPT_ID>0</ms:JPT_ID>", f"ünit {k}", polygon(v)) for k, v in rings.items())
    where = spot()
    body += member("<ms:JPT_ID>77</ms:JPT_ID>", "station", point(where)) + member("", "no id", point(where)) + member("<ms:JPT_ID>78</ms:JPT_ID>", "none", "") + member("<ms:JPT_ID>79</ms:JPT_ID>", "odd", polygon(rings["PL.0"]).replace("\n", " 5"))
    body += member("<ms:JPT_ID>80</ms:JPT_ID>", "text", point(("a", "b"))) + member("<ms:JPT_ID>81</ms:JPT_ID>", "short", polygon(rings["PL.0"][:3])) + "<ms:A03><ms:JPT_ID>82</ms:JPT_IDX></ms:A03>\n<ms:A04><ms:JPT_ID>90</ms:JPT_ID></ms:A04>"
    head = "<?xml version='1.0' encoding='UTF-8'?><wfs:FeatureCollection xmlns:wfs='w' xmlns:gml='g' xmlns:ms='m'>"
    (tmp_path / "a.gml").write_text(head + body + "</wfs:FeatureCollection>", encoding="utf-8")
    d = landed.gml_features(spark, str(tmp_path), "ms:A03").collect()
    fine = {r.official_id: r for r in d if r.error is None}
    assert set(fine) == {*rings, "77"} and fine["PL.7"].name == "ünit PL.7" and fine["77"].gtype == "Point"
    for k, ring in [*rings.items(), ("77", [where])]:
        assert len(fine[k].points) == len(ring)
        for (north, east), p in zip(ring, fine[k].points):
            x, y = geo.metric_point(p.x, p.y)
            assert abs(x - east) < 0.02 and abs(y - north) < 0.02
    assert sorted(str((r.official_id, r.error)) for r in d if r.error not in (None, "malformed")) == sorted(str(x) for x in [(None, "id"), ("78", "geometry"), ("79", "geometry"), ("80", "geometry"), ("81", "geometry")])
    assert sum(r.error == "malformed" for r in d) == 1 and "90" not in {r.official_id for r in d}
    (tmp_path / "a.gml").unlink()
    (tmp_path / "b.gml").write_text(head + member("<ms:JPT_ID>1</ms:JPT_ID>", "one", point(where)) + "</wfs:FeatureCollection>")
    assert landed.gml_features(spark, str(tmp_path), "ms:B01").count() == 0 and landed.gml_features(spark, str(tmp_path), "A03").count() == 1


def grid_text(ncols, nrows, rows, **header):
    h = {"ncols": ncols, "nrows": nrows, "xllcorner": 0, "yllcorner": 0, "cellsize": 10, "NODATA_value": -9999} | header
    return "".join(f"{k}   {v}\n" for k, v in h.items() if v is not None) + "\n".join(" ".join(map(str, r)) for r in rows) + "\n"


def test_ascii_grids(spark, tmp_path):
    """A grid over several splits, with blank lines; every rule broken once."""
    rows = [[r * 60 + c for c in range(60)] for r in range(700)]
    (tmp_path / "large.asc").write_text(grid_text(60, 700, rows).replace("\n1200 ", "\n\n   \n1200 "))
    bad = {"missing": grid_text(2, 1, [[1, 2]], cellsize=None), "zero": grid_text(2, 1, [[1, 2]], cellsize=0), "half": grid_text("2.0", 1, [[1, 2]]), "inf": grid_text(2, 1, [[1, 2]], xllcorner="inf"), "word": grid_text(2, 1, [[1, 2]], yllcorner="north"),
           "twice": grid_text(2, 1, [[1, 2]]).replace("nrows   1", "ncols   2", 1), "few": grid_text(2, 3, [[1, 2], [3, 4]]), "many": grid_text(2, 1, [[1, 2], [3, 4]]), "wide": grid_text(2, 2, [[1, 2], [3, 4, 5]]), "nan": grid_text(2, 1, [["nan", 2]]), "text": grid_text(2, 1, [["x", 2]]), "short": "ncols 2\nnrows 1\n"}
    want = {"missing": "header", "zero": "header", "half": "header", "inf": "header", "word": "header", "twice": "header", "few": "rows", "many": "rows", "wide": "row", "nan": "row", "text": "row", "short": "header"}
    for k, v in bad.items():
        (tmp_path / f"{k}.asc").write_text(v)
    (tmp_path / "small.asc").write_text(grid_text(2, 1, [["1e2", "-.5"]]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        cells, files = landed.ascii_grids(spark, str(tmp_path), store(spark))
        name = lambda p: p.split("/")[-1][:-4]
        assert {name(r.file): r.error for r in files.collect()} == want | {"large": None, "small": None}
        got = sorted((r.row_ix, r.col_ix, r.value) for r in cells.where("file like '%large.asc'").collect())
        assert got == [(r, c, float(rows[r][c])) for r in range(700) for c in range(60)]
        assert sorted((r.row_ix, r.col_ix, r.value) for r in cells.where("file like '%small.asc'").collect()) == [(0, 0, 100.0), (0, 1, -0.5)]
        assert cells.count() == 42_002
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
