"""Golden values and invariants of the library's own operators; every query with SQL is held against DuckDB."""

import json
import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom import registry
from gridloom.functions import classify as c
from gridloom.functions import geo
from gridloom.functions.tags import voltage_label, voltage_style
from gridloom.operators import hexgrid, layers, snapshots, ways
from gridloom.plans.geometry import CX, CY
from gridloom.sources import files

SF = "/root/testdata/sf0.001"
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    d = duckdb.connect()
    d.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        d.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return d


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    res = duck.execute(ORACLE[name])
    have = [d[0] for d in res.description]
    assert sorted(have) == cols
    want = sorted(tuple(plain(r[have.index(k)]) for k in cols) for r in res.fetchall())
    assert sorted(tuple(plain(r[k]) for k in cols) for r in df.collect()) == want
    spark.catalog.clearCache()


def test_every_query_has_sql():
    assert set(registry.queries()) == set(ORACLE)


def test_entry_without_the_training_data_part(tmp_path):
    """The rest of the library and its queries are there when the folders of the other part, or its pipeline too, are gone."""
    root = Path(__file__).resolve().parent.parent
    for gone in (("gridloom/llm", "tests/llm"), ("gridloom/llm", "tests/llm", "corpus_pipeline.py")):
        copy = tmp_path / str(len(gone))
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
        for g in gone:
            if (copy / g).is_dir():
                shutil.rmtree(copy / g)
            elif (copy / g).exists():
                (copy / g).unlink()
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(q) == set(o) and 'pipeline' not in q and len(q) > 150"
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})


def tagged(spark, *maps):
    return spark.createDataFrame([(i, m) for i, m in enumerate(maps)], "id int, tags map<string,string>")


@pytest.mark.parametrize("domain,tags,want", [
    ("water", {"man_made": "pumping_station", "pumping": "water"}, "facilities"), ("water", {"man_made": "pumping_station"}, None), ("water", {"waterway": "ditch"}, "waterways"),
    ("gas", {"pipeline": "valve"}, None), ("gas", {"pipeline": "valve", "substance": "gas"}, "facilities"), ("gas", {"man_made": "pipeline"}, None), ("gas", {"pipeline": "gas"}, "pipelines"),
    ("sewer", {"pipeline": "sewer"}, "pipelines"), ("sewer", {"pipeline": "sewer", "substance": "stormwater"}, None), ("sewer", {"man_made": "manhole", "utility": "sewer"}, "facilities"), ("sewer", {"man_made": "wastewater_plant", "sewer": "drain"}, None),
    ("telecom", {"man_made": "mast"}, None), ("telecom", {"man_made": "mast", "communication:radio": "yes"}, "towers"), ("telecom", {"man_made": "antenna", "communication:bos": "yes"}, "facilities"), ("telecom", {"cable": "communication"}, "lines"),
    ("district_heating", {"power": "plant", "plant:output:heat": "YES"}, "plants"), ("district_heating", {"power": "plant"}, None), ("district_heating", {"man_made": "pipeline", "substance": "steam"}, "lines"),
    ("industrial", {"landuse": "military", "man_made": "works"}, "military_context"), ("industrial", {"man_made": "works", "industrial": "factory"}, "works"), ("bridges", {"bridge": "aqueduct"}, "bridges"), ("bridges", {"highway": "viaduct"}, "viaducts"),
    ("emergency", {"healthcare": "hospital"}, "hospital"), ("public", {"office": "government"}, "administration"), ("transport", {"aeroway": "helipad"}, "aviation"), ("power", {"man_made": "utility_pole"}, "utility_pole"), ("power", {"power": "odd"}, "other"), ("power", {}, "other")])
def test_categories(spark, domain, tags, want):
    assert tagged(spark, tags).select(c.category(domain, F.col("tags")).alias("c")).first().c == want


@pytest.mark.parametrize("raw,state,bucket,label", [("23000", "medium_voltage", "medium", "23 kV"), ("110000;220000", "multiple_voltage", "high_220", "110/220 kV"), (None, "missing", "unknown", "voltage unknown"), ("  ", "missing", "unknown", "  "),
                                                    ("yes", "unparseable", "unknown", "yes"), ("-5", "unparseable", "unknown", "-5"), ("1_000", "medium_voltage", "medium", "1 kV"), ("400", "low_voltage", "low", "0.4 kV"), ("400000", "ultra_high_voltage", "high_400", "400 kV"), (";", "unparseable", "unknown", ";")])
def test_voltage(spark, raw, state, bucket, label):
    r = spark.createDataFrame([(raw,)], "v string").select(voltage_style(F.col("v")).alias("s"), voltage_label(F.col("v")).alias("l")).first()
    assert (r.s.state, r.s.bucket, r.l) == (state, bucket, label)


def test_projection_round_trip(spark):
    p = spark.range(2000).select((14 + F.rand(1) * 10).alias("lon"), (49 + F.rand(2) * 6).alias("lat"))
    x, y = geo.to_metric(F.col("lon"), F.col("lat"))
    q = p.withColumn("x", x).withColumn("y", y)
    lon, lat = geo.to_degrees(F.col("x"), F.col("y"))
    worst = q.agg(F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(lat - F.col("lat")))).first()
    assert max(worst) < 1e-7
    mx, my = geo.metric_point(19.0, 52.0)
    assert mx == pytest.approx(500000.0) and 400_000 < my < 500_000


def one_area(spark, r=35_000.0):
    return spark.createDataFrame([(7, CX, CY, r)], "aoi_id int, cx double, cy double, r double")


def test_clip_never_lengthens(spark):
    from gridloom.plans.views import Tables

    s = hexgrid.segments_near_areas(ways.segments(Tables(spark, SF)("geo_node")), one_area(spark))
    cut = ways.clip_segments(s)
    assert cut.where("length > hypot(x2 - x1, y2 - y1) + 1e-6").count() == 0
    total = cut.agg(F.sum("length")).first()[0]
    for level, part in {r.level: r.m for r in hexgrid.segment_hexes(hexgrid.with_levels(cut)).groupBy("level").agg(F.sum("hex_length").alias("m")).collect()}.items():
        assert part == pytest.approx(total, rel=1e-9), level  # the hexes tile the circle


def test_hexes_cover_the_circle(spark):
    """The parts of all hexes in the circle add up to it; a hex inside has its whole area; ids count the hexes that are left."""
    g = hexgrid.hex_grids(hexgrid.with_levels(one_area(spark, 5000.0)))
    rows = g.withColumn("area", hexgrid.overlap_area(F.col("x"), F.col("y"))).withColumn("far", F.hypot(F.col("x") - CX, F.col("y") - CY)).collect()
    for level, edge in hexgrid.LEVELS.items():
        mine = [r for r in rows if r.level == level]
        assert sum(r.area for r in mine) == pytest.approx(math.pi * 5000.0**2, rel=1e-6)
        whole = 1.5 * math.sqrt(3) * edge**2
        assert all(r.area == pytest.approx(whole) for r in mine if r.far < 5000.0 - edge) and all(1 < r.area <= whole * (1 + 1e-9) for r in mine)
    ids = {r.hex_id for r in hexgrid.hex_ids(g).where("level = 'urban'").collect()}
    assert ids == {f"urban-{i:04d}" for i in range(sum(r.level == "urban" for r in rows))}


def test_nearest_far_from_all(spark):
    """Hexes that have no point around them find the nearest one too; an area without points has none."""
    areas = spark.createDataFrame([(1, 0.0, 0.0, 30_000.0), (2, 0.0, 0.0, 3000.0)], "aoi_id int, cx double, cy double, r double")
    points = [(1, -29_000.0, 100.0), (1, -28_500.0, 0.0), (1, 20_000.0, 20_000.0), (1, 20_000.0, 20_000.0)]
    got = hexgrid.nearest(hexgrid.hex_grids(hexgrid.with_levels(areas, {"regional": 3000.0})), spark.createDataFrame(points, "aoi_id int, x double, y double")).collect()
    assert len(got) > 100
    for r in got:
        want = min(math.hypot(x - r.x, y - r.y) for _, x, y in points) if r.aoi_id == 1 else None
        assert r.nearest_m is None if want is None else r.nearest_m == pytest.approx(want, abs=0.051)


def test_clip_cases(spark):
    rows = [(0.0, 0.0, 0.0, 0.0), (-5.0, 0.0, 5.0, 0.0), (3.0, 3.0, 9.0, 9.0), (9.0, 0.0, 12.0, 0.0), (-2.0, 1.0, 2.0, 1.0)]
    d = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double")
    a, b = geo.clip_to_circle(F.lit(0.0), F.lit(0.0), F.lit(2.0), *[F.col(k) for k in ("x1", "y1", "x2", "y2")])
    assert [r.k for r in d.select((a <= b).alias("k")).collect()] == [True, True, False, False, True]
    a, b = geo.clip_to_box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(2.0), *[F.col(k) for k in ("x1", "y1", "x2", "y2")])
    assert [r.k for r in d.select((a <= b).alias("k")).collect()] == [True, True, False, False, True]


def test_point_in_ring(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0), (0.0, 0.0))])
    d = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (4.0, 2.0), (0.0, 0.0), (5.0, 1.0)], "x double, y double")
    assert [r.i for r in d.select(geo.in_ring(F.col("x"), F.col("y"), ring).alias("i")).collect()] == [True, False, True, True, False]


def test_rings(spark):
    x, y = geo.metric_point(18.5, 50.1)
    r = spark.range(1).select(geo.circle_ring(F.lit(x), F.lit(y), F.lit(1000.0)).alias("r")).first().r
    assert len(r) == 33 and r[0] == r[-1]
    assert all(math.hypot(*[p - q for p, q in zip(geo.metric_point(k.x, k.y), (x, y))]) == pytest.approx(1000, abs=0.05) for k in r)


def test_tiles(spark):
    z = F.lit(12)
    d = spark.createDataFrame([(18.5, 50.1), (-180.0, 90.0), (179.999, -90.0)], "lon double, lat double")
    r = d.select(geo.tile_x(F.col("lon"), z).alias("x"), geo.tile_y(F.col("lat"), z).alias("y")).collect()
    assert [(k.x, k.y) for k in r][1:] == [(0, 0), (4095, 4095)]
    b = spark.createDataFrame([(r[0].x, r[0].y)], "x int, y int").select(geo.tile_west(F.col("x"), z).alias("w"), geo.tile_north(F.col("y"), z).alias("n"), geo.tile_north(F.col("y") + 1, z).alias("s")).first()
    assert b.w <= 18.5 < b.w + 360 / 4096 and b.s < 50.1 <= b.n


def test_hilbert(spark):
    """Neighbours along the curve are neighbours on the grid, and every cell has one place."""
    n = 8
    d = spark.range(n * n).select((F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("y"))
    r = sorted((k.d, k.x, k.y) for k in d.select("x", "y", geo.hilbert(F.col("x"), F.col("y"), 3).alias("d")).collect())
    assert [k[0] for k in r] == list(range(n * n))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(r, r[1:]))


def test_way_assembly_skips_unknown_nodes(spark):
    refs = spark.createDataFrame([(1, 0, 10), (1, 1, 99), (1, 2, 11), (2, 0, 10), (2, 1, 99)], "way_id long, pos int, ref long")
    nodes = spark.createDataFrame([(10, 1.0, 2.0), (11, 3.0, 4.0)], "id long, lon double, lat double")
    got = ways.assemble_ways(refs, nodes).collect()
    assert [(r.way_id, [(p.x, p.y) for p in r.line]) for r in got] == [(1, [(1.0, 2.0), (3.0, 4.0)])]


def test_digest_ignores_order_and_sees_change(spark):
    rows = [(1, "a"), (1, "b"), (1, None), (2, "a")]
    d = lambda r: {x.k: x.digest for x in layers.layer_digest(spark.createDataFrame(r, "k int, v string"), ["k"], ["v"]).collect()}
    assert d(rows) == d(rows[::-1]) and d(rows)[1] != d([(1, "a"), (1, "b"), (1, "c")])[1]


def test_contiguity(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    sel = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "c"), (3, "a"), (4, "a"), (4, "b"), (4, "c"), (4, "d")], "request_id int, unit string")
    assert {r.request_id: r.code for r in snapshots.contiguous(sel, edges).collect()} == {1: "ready", 2: "not_contiguous", 3: "ready", 4: "too_many"}


def test_merge_attributes(spark):
    base, more = tagged(spark, {"a": "1", "b": "2"}, {"a": "1"}), tagged(spark, {"b": "9", "c": "3"})
    assert {r.id: r.tags for r in snapshots.merge_attributes(base, more).collect()} == {0: {"a": "1", "b": "9", "c": "3"}, 1: {"a": "1"}}


# ---- sources


def test_map_elements(spark, tmp_path):
    doc = {"elements": [{"type": "node", "id": 1, "lat": 50.0, "lon": 18.0}, {"type": "node", "id": 2, "lat": 50.1, "lon": 18.1, "tags": {"power": "tower"}}, {"type": "way", "id": 3, "nodes": [1, 2], "tags": {"power": "line"}},
                        {"type": "relation", "id": 4, "tags": {"power": "circuit"}, "members": [{"type": "way", "ref": 3, "role": "section"}]}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    s = files.split_elements(files.map_elements(spark, str(tmp_path)))
    assert {r.id: r.is_feature for r in s["node"].collect()} == {1: False, 2: True}
    assert s["way"].first().nodes == [1, 2] and s["relation"].first().members[0].ref == 3


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "k int, text string")


def test_geojson(spark):
    good = json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"power": "tower"}, "geometry": {"type": "Point", "coordinates": [18.5, 50.1]}}]})
    d = texts(spark, good, '{"type": "Feature"}', "no json", None)
    f = files.geojson_features(d)
    r = files.points(f, "Point").first()
    assert (r.k, r.crs, r.properties["power"], r.coordinates) == (0, "EPSG:4326", "tower", [18.5, 50.1]) and f.count() == 1
    assert {x.k for x in files.geojson_rejects(d).collect()} == {1, 2, 3}


def test_gml(spark):
    d = texts(spark, "<m><JPT_NAZWA_>A</JPT_NAZWA_><IIP_IDENTY>x1</IIP_IDENTY><posList>50.1 18.5 50.2 18.6 50.1 18.5</posList></m>", "<m><JPT_ID>7</JPT_ID></m>", "<m><posList>50 18</posList></m>")
    r = files.gml_members(d).orderBy("k").collect()
    assert r[0].official_id == "x1" and (r[0].ring[0].x, r[0].ring[0].y) == (18.5, 50.1) and r[0].error is None
    assert (r[1].official_id, r[1].error, r[2].error) == ("7", "geometry", "id")


def test_relation_xml(spark):
    x = '<relation id="5"><member type="way" ref="3" role=""/><member type="area" ref="4" role="x"/><member type="node" ref="bad" role="x"/><tag k="power" v="circuit"/></relation>'
    d = texts(spark, x, x.replace("circuit", "line"))
    assert [(r.relation_id, r.type, r.ref, r.role) for r in files.relation_members(d).collect()] == [(5, "way", 3, "member")]


def test_capabilities(spark):
    box = "<EX_GeographicBoundingBox><westBoundLongitude>14</westBoundLongitude><eastBoundLongitude>24</eastBoundLongitude><southBoundLatitude>49</southBoundLatitude><northBoundLatitude>55</northBoundLatitude></EX_GeographicBoundingBox>"
    doc = f'<c version="1.3.0"><Layer><Name>power</Name><Title>P</Title>{box}<MaxScaleDenominator>5000</MaxScaleDenominator></Layer><Layer><Name>gas</Name>{box}</Layer><Layer><Name>frame</Name></Layer></c>'
    got = {r.layer: r for r in files.capability_layers(texts(spark, doc), required=("power",)).collect()}
    assert {k: (r.title, r.max_scale, r.west, r.drift) for k, r in got.items()} == {"power": ("P", 5000.0, 14.0, None), "gas": ("gas", None, 14.0, None)}
    drift = lambda d, **k: {r.drift for r in files.capability_layers(texts(spark, d), **k).collect()}
    assert drift(doc, required=("power", "water")) == {"missing water"} and drift(doc.replace("1.3.0", "1.1.1")) == {"version"} and drift(doc.replace(">49<", ">south<")) == {"bounds"}
    assert drift("<c><Layer>", required=("power",)) == {"version"}


def test_grid(spark):
    head = "ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 10\nNODATA_value -9999\n"
    d = spark.createDataFrame([(1, head + "1 2\n3 -9999"), (2, head + "1 2"), (3, head + "1 2\n3 x"), (4, "nrows 2"), (5, head + "1 2 3\n4 5 6"), (6, None)], "raster_id int, text string")
    assert {(r.raster_id, r.row_ix, r.col_ix): r.value for r in files.grid_cells(d).collect()} == {(1, 0, 0): 1.0, (1, 0, 1): 2.0, (1, 1, 0): 3.0, (1, 1, 1): -9999.0}


def test_class_scan_pushes_the_box(spark, tmp_path):
    p = str(tmp_path / "c")
    spark.range(100).select(F.col("id"), *[F.col("id").cast("double").alias(k) for k in ("xmin", "ymin", "xmax", "ymax")], F.lit("x").alias("other")).write.parquet(p)
    d = files.class_scan(spark, p, ["id"], (10.0, 10.0, 12.0, 12.0))
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = d._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert d.count() == 3 and "PushedFilters: [" in plan and "GreaterThanOrEqual(xmax,10.0)" in plan and "other:" not in plan
    with pytest.raises(ValueError, match="lacks voltage"):
        files.class_scan(spark, p, ["voltage"], (0.0, 0.0, 1.0, 1.0))


def test_layer_sink(spark, tmp_path):
    d = spark.createDataFrame([("a", "power", "power.lines", 1)], "aoi_id string, domain string, layer_id string, id int")
    files.write_layers(d, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("domain = 'power'").count() == 1


# ---- streams


def test_reviews_by_hand(spark):
    """What an update expects decides: conflict, move that is not allowed, note kept, note cleared."""
    from gridloom.operators.reviews import fold_reviews

    rows = [(1, 1, 1, "resolved", "x", 5), (1, 2, 2, "acknowledged", "seen", None), (1, 3, 3, "resolved", None, None), (1, 4, 4, "acknowledged", None, 2), (1, 5, 5, "accepted", None, 2), (1, 6, 6, "ignored", "y", 5), (1, 7, 7, "ignored", "y", 2),
            (2, 1, 8, "ignored", "a", None), (2, 2, 9, "resolved", "b", 1), (3, 1, 10, "acknowledged", "n", None), (3, 2, 11, "resolved", "", 1), (4, 1, 12, "resolved", "n", 9)]
    d = spark.createDataFrame([(i, e, s, n, t, x) for i, t, e, s, n, x in rows], "issue_id long, event_id long, status string, note string, t long, x long")
    d = d.withColumn("ts", F.timestamp_seconds("t")).withColumn("expected", F.timestamp_seconds("x"))
    got = {r.issue_id: (r.status, r.note, r.n_accepted, r.n_conflict, r.n_invalid) for r in fold_reviews(d).collect()}
    assert got == {1: ("accepted", "seen", 2, 3, 2), 2: ("ignored", "a", 1, 0, 1), 3: ("resolved", None, 2, 0, 0), 4: ("open", None, 0, 1, 0)}


def test_stream_equals_batch(spark, tmp_path):
    from gridloom.operators.reviews import fold_reviews
    from gridloom.plans.views import Tables
    from gridloom.streaming import reviews as stream

    u = Tables(spark, SF)("review_update").where("issue_id < 6")
    for part, cond in (("a", "ts < timestamp '2024-01-10'"), ("b", "ts >= timestamp '2024-01-10'")):
        u.where(cond).coalesce(1).write.parquet(str(tmp_path / "in" / part))
    src = spark.readStream.schema(u.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "*"))
    q = stream.review_states(src).writeStream.outputMode("update").format("memory").queryName("review_states").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {}
    for r in spark.sql("select * from review_states").collect():
        k = (r.n_accepted + r.n_conflict + r.n_invalid, r.status, r.note or "", r.n_accepted, r.n_conflict, r.n_invalid)
        got[r.issue_id] = max(got.get(r.issue_id, k), k)
    want = {r.issue_id: (r.n_accepted + r.n_conflict + r.n_invalid, r.status, r.note or "", r.n_accepted, r.n_conflict, r.n_invalid) for r in fold_reviews(u).collect()}
    assert got == want

    e = spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).parquet(f"{SF}/events*.parquet")
    q = stream.job_states(e).writeStream.outputMode("complete").format("memory").queryName("job_states").option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    batch = registry.queries()["job_latest"](spark, SF)
    assert {tuple(r) for r in spark.sql("select job_id, status, n_events from job_states").collect()} == {tuple(r) for r in batch.select("job_id", "status", "n_events").collect()}


def test_first_requests_and_partial_publication(spark, tmp_path):
    """Two streams against what the batch queries say."""
    from gridloom.streaming import reviews as stream

    rows = [(1, "2024-01-01 00:00:00", 5, "a"), (2, "2024-01-01 10:00:00", 5, "a"), (3, "2024-01-01 11:00:00", 5, "b"), (4, "2024-01-01 12:00:00", 6, "a")]
    spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string").withColumn("ts", F.col("t").cast("timestamp")).drop("t").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("event_id long, user_id long, event_type string, ts timestamp").parquet(str(tmp_path / "in"))
    q = stream.first_requests(events).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.event_id for r in spark.table("firsts").collect()} == {1, 3, 4}
    for part in ([(1, "power", 3), (2, "water", 1)], [(1, "power", 3), (1, "gas", 2)]):  # the second batch changes snapshot 1 only
        spark.createDataFrame(part, "snapshot_id long, domain string, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "out_in"))
        source = spark.readStream.schema("snapshot_id long, domain string, n long").parquet(str(tmp_path / "out_in"))
        q = stream.publish_partial(source, str(tmp_path / "published")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "published")).select("snapshot_id", "domain", "n").collect()) == [(1, "gas", 2), (1, "power", 3), (2, "water", 1)]


def test_polygons(spark):
    import numpy as np

    from gridloom.functions import polygons as p

    square = np.array([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], float)
    area = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, np.roll(r, -1, axis=0)))) / 2
    triangle = np.array([(2, -10), (12, 2), (2, 14)], float)
    cut = p.clip_convex(square, triangle)
    assert area(cut) == pytest.approx(8) and (cut[:, 0] >= 2 - 1e-9).all()
    assert len(p.clip_convex(square + 100, triangle)) == 0
    x, y = p.surface_point(np.array([(0, 0), (6, 0), (6, 6), (5, 6), (5, 1), (0, 1), (0, 0)], float))
    assert 5 < x < 6 or y < 1
    rng = np.random.default_rng(2)
    line = np.cumsum(rng.normal(size=(300, 2)), axis=0)
    kept = p.simplify_line(line, 1.0)
    assert (kept[0] == line[0]).all() and (kept[-1] == line[-1]).all() and len(kept) < 300

    def off(q):
        best = np.inf
        for a, b in zip(kept, kept[1:]):
            d = b - a
            t = np.clip((q - a) @ d / max(d @ d, 1e-30), 0, 1)
            best = min(best, np.hypot(*(a + t * d - q)))
        return best

    assert max(off(q) for q in line) <= 1.0 + 1e-9
    assert len(p.simplify_line(np.zeros((0, 2)), 1.0)) == 0
