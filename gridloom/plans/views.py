"""Map objects derived from the driver's tables, in SQL that Spark and DuckDB both accept.

The tables hold no coordinates, so nodes, ways, units and snapshots are computed from their keys. In the texts below a name in
braces is another view or a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Centre of the area of interest: longitude, latitude, radius in metres.
CENTRE = (18.546285, 50.102174, 35_000.0)

# Tag sets of the sample objects, as (set, key, value).
_TAGS = """
0 power line|0 voltage 400000|1 power line|1 voltage 110000;220000|2 power minor_line|2 voltage 15000|3 power cable|4 power line|4 voltage unknown|5 power cable|5 voltage 400
6 power substation|7 power transformer|8 power tower|9 power pole|10 man_made utility_pole|11 power plant|11 plant:output:heat yes|12 amenity hospital|13 amenity fire_station
14 emergency mountain_rescue|15 amenity school|16 highway trunk|17 highway tertiary|18 railway rail|19 bridge viaduct|20 waterway river|21 man_made pumping_station|21 substance water
22 man_made pipeline|22 substance gas|23 pipeline sewer|23 substance stormwater|24 man_made wastewater_plant|25 landuse industrial|26 man_made works|27 man_made mast|28 man_made mast
28 tower:type communication|29 communication line|30 man_made pipeline|30 substance steam|31 aeroway aerodrome|32 aeroway helipad|33 office government|34 healthcare hospital|35 amenity police
36 amenity ambulance_station|37 amenity townhall|38 amenity post_office|39 amenity library|40 railway station|41 highway viaduct|42 bridge yes|43 man_made water_works|44 pipeline water
45 man_made pumping_station|45 pumping water|46 pipeline valve|46 substance gas|47 pipeline valve|48 man_made gasometer|49 pipeline gas|50 pipeline sewer|51 man_made manhole|51 utility sewer
52 man_made pumping_station|52 pumping wastewater|53 man_made septic_tank|53 sewer drainage|54 military base|54 man_made works|55 landuse military|56 industrial factory|57 building industrial
58 man_made communications_tower|59 man_made tower|59 communication:radio yes|60 man_made antenna|60 communication:mobile_phone yes|61 telecom exchange|62 cable communication|63 man_made antenna
64 industrial heating_station|65 power generator|65 generator:output:heat YES|66 power plant|66 plant:source heat|67 power generator|67 generator:source heat|68 man_made heat_exchanger
69 pipeline heating|70 power generator|71 power switch|72 power terminal|73 power converter|74 power compensator|75 power busbar|76 power bay|77 power portal|78 power odd|79 power line
79 voltage 220000|79 name Two names|80 power minor_line|80 voltage 900|81 power cable|81 voltage 60000|82 highway motorway|83 highway secondary|84 emergency lifeguard_base|85 waterway ditch
86 man_made pipeline|86 substance water|87 man_made pipeline|87 substance sewerage|88 amenity water_point|89 industrial works
"""
TAG_ROWS = [tuple(x.split(" ", 2)) for line in _TAGS.strip().splitlines() for x in line.split("|")]
TAG_KEYS = sorted({k for _, k, _ in TAG_ROWS})


def _values(rows) -> str:
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).lower() if isinstance(v, bool) else "'" + v + "'"
    return ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in rows)


# The sources that may contribute, with their governance fields.
SOURCES = [
    ("openstreetmap", "vector", "osm_query", "community", "public_query", "analytical", "qualified_free", "allowed", False, True),
    ("manual_power_seed", "vector", "geojson", "project_local", "local_review_input", "review", "qualified_free", "prohibited", True, False),
    ("prg_wfs", "vector", "wfs_gml", "official", "public_service", "analytical", "qualified_free", "prohibited", False, True),
    ("bdot10k", "vector", "gpkg_geoparquet", "official", "public_download", "analytical", "qualified_free", "prohibited", False, True),
    ("kiut_gesut_wms", "rendered_imagery", "wms", "official", "public_service", "reference", "qualified_free", "prohibited", True, False),
    ("geoportal_orthophoto", "rendered_imagery", "wms", "official", "public_service", "reference", "qualified_free", "prohibited", True, False),
    ("nmt_nmpt", "raster", "geotiff_ascii_grid", "official", "public_download", "analytical", "qualified_free", "prohibited", False, True),
    ("paid_candidate", "vector", "geojson", "official", "paid", "analytical", "rejected", "prohibited", False, True),
]
DOMAINS = ("power", "emergency", "public", "transport", "bridges", "water", "gas", "sewer", "industrial", "telecom", "district_heating")
_DOMAIN_CASE = "CASE o_orderkey % 11 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DOMAINS[:-1])) + f" ELSE '{DOMAINS[-1]}' END"

VIEWS = {
    "tag_kv": f"SELECT * FROM (VALUES {_values([(int(a), k, v) for a, k, v in TAG_ROWS])}) AS t(tag_id, k, v)",
    "tag_wide": "SELECT tag_id, " + ", ".join(f"max(CASE WHEN k = '{k}' THEN v END) AS {k.replace(':', '_')}" for k in TAG_KEYS) + " FROM {tag_kv} GROUP BY tag_id",
    "geo_node": """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS way_id, l_linenumber AS seq, min(l_partkey) AS pk,
 CAST(min(l_partkey) % 90 AS INT) AS tag_id, count(*) AS dup_count,
 17.95e0 + CAST((l_orderkey * 7919) % 100003 AS DOUBLE) / 100003e0 * 1.2e0 + CAST((l_linenumber * 37) % 11 - 5 AS DOUBLE) * 0.002e0 AS lon,
 49.75e0 + CAST((l_orderkey * 104729) % 100019 AS DOUBLE) / 100019e0 * 0.7e0 + CAST((l_linenumber * 53) % 13 - 6 AS DOUBLE) * 0.0015e0 AS lat
 FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "geo_segment": """SELECT way_id, CAST(way_id % 90 AS INT) AS tag_id, seq, lon AS lon1, lat AS lat1,
 lead(lon) OVER (PARTITION BY way_id ORDER BY seq) AS lon2, lead(lat) OVER (PARTITION BY way_id ORDER BY seq) AS lat2 FROM {geo_node}""",
    "admin_unit": """SELECT concat('voivodeship_', CAST(r_regionkey AS STRING)) AS id, 'voivodeship' AS kind, CAST(NULL AS STRING) AS parent_id, CAST(NULL AS DOUBLE) AS min_lon, CAST(NULL AS DOUBLE) AS min_lat, CAST(NULL AS DOUBLE) AS max_lon, CAST(NULL AS DOUBLE) AS max_lat FROM {region}
UNION ALL SELECT concat('county_', CAST(n_nationkey AS STRING)), 'county', concat('voivodeship_', CAST(n_regionkey AS STRING)),
 17.95e0 + 0.24e0 * CAST(n_nationkey % 5 AS DOUBLE), 49.75e0 + 0.14e0 * floor(CAST(n_nationkey AS DOUBLE) / 5e0), 17.95e0 + 0.24e0 * CAST(n_nationkey % 5 + 1 AS DOUBLE), 49.75e0 + 0.14e0 * (floor(CAST(n_nationkey AS DOUBLE) / 5e0) + 1e0) FROM {nation}
UNION ALL SELECT concat('gmina_', CAST(s_suppkey AS STRING)), 'gmina', concat('county_', CAST(s_nationkey AS STRING)), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM {supplier}""",
    "circuit_member": "SELECT o_custkey AS relation_id, o_orderkey AS way_id, CASE o_orderkey % 3 WHEN 0 THEN 'section' WHEN 1 THEN '' ELSE 'branch' END AS role FROM {orders}",
    # updates of reviews: some know nothing, some the first change, some a change that never was
    "review_update": """SELECT event_id, ts, user_id AS issue_id, CASE event_type WHEN 'view' THEN 'acknowledged' WHEN 'click' THEN 'resolved' WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'ignored' ELSE 'acknowledged' END AS status,
 CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN concat('note ', CAST(event_id AS STRING)) END AS note, CASE WHEN event_id % 4 IN (1, 2) THEN min(CASE WHEN event_id % 4 = 0 THEN ts END) OVER (PARTITION BY user_id) WHEN event_id % 4 = 3 THEN ts END AS expected FROM {events}""",
    "measure_obs": "SELECT event_type AS endpoint, event_id, value AS duration_ms, CAST(event_id % 4096 + 512 AS BIGINT) AS response_bytes, CASE event_id % 7 WHEN 0 THEN 304 ELSE 206 END AS status FROM {events}",
    "xs_feature": """SELECT 'openstreetmap' AS source_id, id, CASE WHEN id % 4 = 0 THEN concat('n', CAST(id AS STRING)) END AS stable_id, CASE WHEN id % 17 = 0 THEN CAST(NULL AS STRING) WHEN tag_id < 6 THEN 'line' ELSE 'asset' END AS asset_type, lon, lat FROM {geo_node}
UNION ALL SELECT CASE WHEN id % 29 = 0 THEN 'kiut_gesut_wms' ELSE 'bdot10k' END, id, CASE WHEN id % 8 = 0 THEN concat('n', CAST(id AS STRING)) END, CASE WHEN (id % 5 = 0) = (tag_id < 6) THEN 'asset' ELSE 'line' END, lon + 0.00006e0 * CAST(id % 3 AS DOUBLE), lat FROM {geo_node} WHERE id % 7 <> 0""",
    "raster_cell": "SELECT CAST(floor(CAST(p_partkey AS DOUBLE) / 40e0) AS INT) AS row_ix, CAST(p_partkey % 40 AS INT) AS col_ix, CASE WHEN (p_partkey * 31) % 23 = 0 THEN -9999e0 ELSE 200e0 + CAST(p_size AS DOUBLE) END AS value FROM {part}",
    "source_registry": f"SELECT * FROM (VALUES {_values(SOURCES)}) AS t(source_id, data_kind, format, authority, access_method, usage_role, qualification, public_export, not_authoritative, eligible_for_analysis)",
    "domain_outcome": f"""SELECT o_custkey AS snapshot_id, {_DOMAIN_CASE} AS domain,
 CASE WHEN count(CASE WHEN o_orderstatus = 'F' THEN 1 END) = count(*) THEN 'failed' WHEN max(o_orderkey) % 6 = 0 THEN 'pending_qualification' WHEN max(o_orderkey) % 5 = 0 THEN 'needs_source' ELSE 'ready' END AS status,
 min(o_orderdate) AS source_observed_at, sum(o_orderkey % 500) AS queried_feature_count, sum(o_orderkey % 300) AS accepted_feature_count, CASE WHEN o_custkey % 9 = 0 THEN 'mirror_b' ELSE 'mirror_a' END AS endpoint
 FROM {{orders}} GROUP BY o_custkey, {_DOMAIN_CASE}""",
    # one circle per nation, as metres from the centre
    "nation_area": """SELECT n_nationkey AS aoi_id, CAST(n_nationkey % 5 - 2 AS DOUBLE) * 15000e0 AS dx, (floor(CAST(n_nationkey AS DOUBLE) / 5e0) - 2e0) * 13000e0 AS dy, 4000e0 + CAST(n_nationkey % 5 AS DOUBLE) * 1000e0 AS r FROM {nation}""",
    # one box per customer: sites and requested areas
    "site_box": """SELECT c_custkey AS id, CAST(c_custkey % 25 AS INT) AS n, 17.95e0 + 0.0024e0 * CAST(c_custkey % 400 AS DOUBLE) AS min_lon, 49.75e0 + 0.0014e0 * CAST(c_custkey % 390 AS DOUBLE) AS min_lat,
 17.95e0 + 0.0024e0 * CAST(c_custkey % 400 AS DOUBLE) + 0.24e0 AS max_lon, 49.75e0 + 0.0014e0 * CAST(c_custkey % 390 AS DOUBLE) + 0.14e0 AS max_lat FROM {customer}""",
    # one summary row per layer of an area: what quality rules and readiness look at
    "layer_summary": """SELECT o_custkey AS aoi_id, concat('layer.', CAST(o_orderkey AS STRING)) AS layer_id,
 CASE o_orderkey % 4 WHEN 0 THEN 'reference_overlay' WHEN 1 THEN 'manual_seed' ELSE 'analytical_vector' END AS source_type,
 CASE o_orderkey % 5 WHEN 0 THEN ' OK ' WHEN 1 THEN 'Passed-With-Warnings' WHEN 2 THEN 'FAIL' WHEN 3 THEN 'pass' ELSE 'odd' END AS validation_status_raw,
 CAST(o_orderkey % 7 AS BIGINT) * 10 AS feature_count, CAST(o_orderkey % 3 AS BIGINT) AS invalid_geometry_count, CAST(o_orderkey % 2 AS BIGINT) AS duplicate_count,
 CASE WHEN o_orderkey % 6 = 0 THEN 'voltage' END AS missing_attribute, CASE WHEN o_orderkey % 9 = 0 THEN 'GeometryCollection' END AS unsupported_geometry, o_orderkey % 10 <> 0 AS source_metadata_valid,
 CASE o_orderkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS issue_severity, CASE o_orderkey % 8 WHEN 0 THEN 'conflicting' WHEN 1 THEN 'matched' END AS comparison_outcome FROM {orders}""",
    # registry records as they are handed in, one per supplier, some of which break a rule
    "source_record": """SELECT s_suppkey AS record_id, CASE WHEN s_suppkey % 23 = 7 THEN '' ELSE concat('src_', CAST(s_suppkey - CASE WHEN s_suppkey % 29 = 3 THEN 1 ELSE 0 END AS STRING)) END AS source_id, CASE WHEN s_suppkey % 31 = 5 THEN '' ELSE s_name END AS name,
 CASE s_suppkey % 7 WHEN 0 THEN 'wms' WHEN 1 THEN 'geojson' WHEN 2 THEN 'osm_query' WHEN 3 THEN 'wfs_gml' WHEN 4 THEN 'gpkg_geoparquet' WHEN 5 THEN 'wmts' ELSE 'geotiff_ascii_grid' END AS format,
 CASE WHEN s_suppkey % 37 = 11 THEN 'table' WHEN s_suppkey % 7 IN (0, 5) THEN CASE WHEN s_suppkey % 3 = 0 THEN 'vector' ELSE 'rendered_imagery' END WHEN s_suppkey % 7 = 6 THEN 'raster' ELSE 'vector' END AS data_kind,
 CASE s_suppkey % 5 WHEN 0 THEN 'official' WHEN 1 THEN 'community' WHEN 2 THEN 'project_local' WHEN 3 THEN 'official' ELSE 'hearsay' END AS authority,
 CASE s_suppkey % 6 WHEN 0 THEN 'paid' WHEN 1 THEN 'public_query' WHEN 2 THEN 'public_download' WHEN 3 THEN 'public_service' WHEN 4 THEN 'agreement_only' ELSE 'public_download' END AS access_method,
 CASE s_suppkey % 4 WHEN 0 THEN 'analytical' WHEN 1 THEN 'reference' WHEN 2 THEN 'analytical' ELSE 'review' END AS usage_role, CASE WHEN s_suppkey % 5 = 2 THEN 'rejected' ELSE 'qualified_free' END AS qualification,
 CASE WHEN s_suppkey % 3 = 1 THEN 'allowed' WHEN s_suppkey % 41 = 2 THEN 'maybe' ELSE 'prohibited' END AS public_export, CASE WHEN s_suppkey % 13 = 4 THEN '' ELSE 'stated' END AS reason, s_suppkey % 8 = 3 AS not_authoritative, s_suppkey % 2 = 0 AS eligible_for_analysis,
 CASE WHEN s_suppkey % 17 = 1 THEN '' ELSE 'https://example.org' END AS source_url, CASE WHEN s_suppkey % 19 = 2 THEN CAST(NULL AS STRING) ELSE 'owner' END AS attribution, CASE WHEN s_suppkey % 43 = 9 THEN '' ELSE 'terms' END AS license, CASE WHEN s_suppkey % 3 = 2 THEN 'retrieved_at,sha256' END AS cache_fields FROM {supplier}""",
    # features as a provider hands them in, some of which break the contract
    "provider_feature": """SELECT o_orderkey AS ord, o_custkey AS layer_key, CASE WHEN o_orderkey % 29 = 3 THEN 'Thing' ELSE 'Feature' END AS type, CASE WHEN o_orderkey % 23 = 5 THEN CAST(NULL AS STRING) WHEN o_orderkey % 23 = 6 THEN ' ' ELSE 'Point' END AS geometry_type,
 CASE WHEN o_orderkey % 19 = 4 THEN CAST(NULL AS STRING) ELSE '[18.5,50.1]' END AS coordinates, o_orderkey % 31 <> 7 AS has_properties, CASE o_orderkey % 7 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '  ' ELSE 'openstreetmap' END AS source,
 CASE WHEN o_orderkey % 11 = 2 THEN CAST(NULL AS STRING) ELSE CAST(o_orderkey AS STRING) END AS source_id, CASE WHEN o_orderkey % 13 = 1 THEN '' ELSE 'power' END AS domain, CASE WHEN o_orderkey % 17 = 3 THEN CAST(NULL AS STRING) ELSE 'line' END AS asset_type,
 CASE o_orderkey % 5 WHEN 0 THEN 'certain' WHEN 1 THEN CAST(NULL AS STRING) ELSE 'high' END AS confidence, o_orderkey % 9 <> 2 AS missing_is_list, o_orderkey % 10 <> 4 AS limits_is_list, CASE WHEN o_orderkey % 6 = 5 THEN CAST(NULL AS BOOLEAN) ELSE true END AS eligible_for_analysis FROM {orders}""",
    # prepared snapshots of the sites' boxes
    "snapshot_box": """SELECT id AS snapshot_id, CASE WHEN id % 3 = 0 THEN id + 1 ELSE id END AS aoi_id, CASE id % 8 WHEN 0 THEN 'ready' WHEN 1 THEN 'queued' WHEN 2 THEN 'failed' WHEN 3 THEN 'partial' WHEN 4 THEN 'running' ELSE 'ready' END AS state, min_lon, min_lat, max_lon, max_lat FROM {site_box} WHERE id % 4 = 0""",
    # published artifacts: files of layers with the sources they come from
    "artifact": """SELECT o_orderkey AS artifact_ord, o_custkey AS aoi_id, concat('art.', CAST(o_orderkey % 12 AS STRING), '-', CAST(o_orderkey AS STRING)) AS artifact_id,
 o_orderkey % 4 <> 0 AS public_export, CASE WHEN o_orderkey % 5 = 0 THEN 'pmtiles' ELSE 'geojson' END AS format,
 CASE o_orderkey % 6 WHEN 0 THEN 'processed_vector' WHEN 1 THEN 'derived_vector' WHEN 2 THEN 'representative_points' ELSE 'raw' END AS kind,
 CASE WHEN o_orderkey % 13 <> 0 THEN concat('layers/', CAST(o_orderkey AS STRING), '.geojson') END AS path, CASE WHEN o_orderkey % 17 <> 0 THEN concat('sha', CAST(o_orderkey AS STRING)) END AS sha256,
 CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_orderkey % 100 AS BIGINT) END AS feature_count,
 CASE o_orderkey % 4 WHEN 0 THEN 'openstreetmap' WHEN 1 THEN 'bdot10k' WHEN 2 THEN 'kiut_gesut_wms' ELSE 'unlisted' END AS source_a,
 CASE o_orderkey % 3 WHEN 0 THEN 'openstreetmap' WHEN 1 THEN 'prg_wfs' ELSE 'manual_power_seed' END AS source_b FROM {orders}""",
}


def needed(*names: str) -> list[str]:
    """The views that ``names`` rest on, those first that others need."""
    out: list[str] = []
    for n in names:
        for m in [*needed(*[x for x in re.findall(r"\{(\w+)\}", VIEWS[n]) if x in VIEWS]), n]:
            if m not in out:
                out.append(m)
    return out


def ctes(*names: str) -> str:
    """The views as common table expressions, for SQL outside Spark."""
    return ", ".join(f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[n])})" for n in needed(*names))


class Tables:
    """Tables and derived views of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._known = spark, sf_dir, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in VIEWS:
                deps = {x: self(x) for x in re.findall(r"\{(\w+)\}", VIEWS[name])}
                self._known[name] = self.spark.sql(VIEWS[name], **deps)
            else:
                self._known[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._known[name]


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    """Register a function of :class:`Tables` under ``name``; ``sql`` states its result over ``views``. A leading WITH is added."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            body = sql.strip()
            if views:
                more = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
                body = f"WITH {'RECURSIVE ' if more and more[1] else ''}{ctes(*views)}" + (f", {body[more.end():]}" if more else f" {body}")
            SQL[name] = body
        return f

    return add


# ---- only for the SQL of other engines: the projection and what follows from it, as plain SQL


def _series(fn_x: str, fn_y: str, a: str, b: str, coef, outer: str, sign: str) -> str:
    return outer + "".join(f" {sign} {c!r} * {fn_x}({2 * j}e0 * {a}) * {fn_y}({2 * j}e0 * {b})" for j, c in enumerate(coef, 1))


def _projected(source: str, lon: str, lat: str, keep: str) -> str:
    from gridloom.functions import geo as g

    t = f"sinh(atanh(sin(radians({lat}))) - {g._E!r} * atanh({g._E!r} * sin(radians({lat}))))"
    x, y = _series("cos", "sinh", "xi", "eta", g._ALPHA, "eta", "+"), _series("sin", "cosh", "xi", "eta", g._ALPHA, "xi", "+")
    return f"""SELECT {keep}, {g._FE} + {g._K0 * g._RECT!r} * ({x}) AS x, {g._FN} + {g._K0 * g._RECT!r} * ({y}) AS y FROM (
 SELECT *, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1e0 + t * t)) AS eta FROM (SELECT *, {t} AS t, radians({lon} - 19e0) AS d FROM {source}))"""


VIEWS["metric"] = _projected("{geo_node}", "lon", "lat", "id, way_id, seq, tag_id, dup_count, lon, lat")
VIEWS["metric_segment"] = """SELECT way_id, CAST(way_id % 90 AS INT) AS tag_id, seq, lon AS lon1, lat AS lat1, x AS x1, y AS y1, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, lead(x) OVER w AS x2, lead(y) OVER w AS y2
 FROM {metric} WINDOW w AS (PARTITION BY way_id ORDER BY seq)"""
