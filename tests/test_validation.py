"""Validation reports of layers that are right, absent, empty or wrong."""

from gridloom.operators.quality import validation_report

SCHEMA = "layer string, gtype string, n_points int, self_crossing boolean, outside boolean, min_lon double, min_lat double, max_lon double, max_lat double"


def test_validation_report(spark):
    rows = [("good", "Point", 1, False, False, 1.0, 2.0, 1.0, 2.0), ("good", "MultiPoint", 2, False, False, -1.0, 2.0, 0.0, 5.0),
            ("wrong", "Point", 1, False, False, 1.0, 1.0, 1.0, 1.0), ("wrong", "LineString", 2, False, False, 0.0, 0.0, 1.0, 1.0), ("wrong", "Polygon", 4, False, False, 0.0, 0.0, 2.0, 2.0),
            ("blank", "LineString", 0, False, False, None, None, None, None), ("crossed", "LineString", 4, True, False, 0.0, 0.0, 1.0, 1.0), ("far", "LineString", 2, False, True, 0.0, 0.0, 1.0, 1.0),
            ("null", None, None, None, None, None, None, None, None), ("absent", "Point", 1, False, False, 0.0, 0.0, 0.0, 0.0), ("unasked", "Point", 1, False, False, 0.0, 0.0, 0.0, 0.0)]
    points, lines = ["Point", "MultiPoint"], ["LineString"]
    expected = spark.createDataFrame([("good", points), ("wrong", lines), ("blank", lines), ("crossed", lines), ("far", lines), ("null", points), ("absent", points), ("nothing", points)], "layer string, expected array<string>")
    landed = spark.createDataFrame([(n,) for n in ("good", "wrong", "blank", "crossed", "far", "null", "nothing", "nothing", "unasked")], "layer string")
    got = {r.layer: r for r in validation_report(spark.createDataFrame(rows, SCHEMA), expected, landed).collect()}
    assert len(got) == 8
    told = {n: (r.feature_count, r.errors, r.warnings, r.status) for n, r in got.items()}
    assert told == {"good": (2, "", "", "pass"), "wrong": (3, "unexpected_geometry_types", "", "fail"), "blank": (1, "empty_geometries", "", "fail"), "crossed": (1, "", "invalid_geometries", "warn"),
                    "far": (1, "", "features_outside_aoi", "warn"), "null": (1, "unexpected_geometry_types,empty_geometries", "invalid_geometries", "fail"), "absent": (0, "file_missing", "", "fail"), "nothing": (0, "", "empty_layer", "warn")}
    assert (got["good"].types, got["wrong"].types, got["wrong"].unexpected, got["null"].unexpected) == ("MultiPoint:1,Point:1", "LineString:1,Point:1,Polygon:1", "Point,Polygon", "None")
    box = lambda r: (r.min_lon, r.min_lat, r.max_lon, r.max_lat)
    assert box(got["good"]) == (-1.0, 2.0, 1.0, 5.0) and box(got["blank"]) == box(got["nothing"]) == box(got["absent"]) == (None,) * 4


def test_empty_layers_leave_a_trace(spark, tmp_path):
    import pytest

    from gridloom.sources import files

    path, schema = str(tmp_path / "out"), "aoi_id string, domain string, layer_id string, id int"
    d = spark.createDataFrame([("a", "power", "lines", 1), ("a", "power", "lines", 2), ("b", "water", "rivers", 3), (None, "water", "rivers", 4)], schema)
    expected = spark.createDataFrame([("a", "power", "lines"), ("a", "power", "lines"), ("a", "power", "nodes"), ("b", "water", "wells")], "aoi_id string, domain string, layer_id string")
    files.write_layers(d, path, expected)
    listed = lambda: {tuple(r) for r in files.layer_list(spark, path).select(*files.LAYER, "expected", "feature_count").collect()}
    assert listed() == {("a", "power", "lines", True, 2), ("a", "power", "nodes", True, 0), ("b", "water", "wells", True, 0), ("b", "water", "rivers", False, 1), (None, "water", "rivers", False, 1)}
    assert spark.read.parquet(path).count() == 4  # the list is no layer
    files.write_layers(d.where("false"), path, expected)  # all layers are empty now
    assert listed() == {("a", "power", "lines", True, 0), ("a", "power", "nodes", True, 0), ("b", "water", "wells", True, 0)}
    files.write_layers(d, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.layer_list(spark, path)
