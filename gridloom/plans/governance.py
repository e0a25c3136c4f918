"""Queries of source governance and of requests for areas."""

from pyspark.sql import functions as F

from gridloom.functions.classify import DOMAINS
from gridloom.operators import governance as g
from gridloom.plans.views import query

# each registry row with the number of artifacts that name it, so that work grows with the artifacts
_ELIG = """CASE WHEN qualification <> 'qualified_free' THEN 'rejected|not_qualified_free' WHEN use IN ('acquisition','local_import') THEN 'allowed|qualified_free' WHEN use = 'reference' THEN CASE WHEN usage_role = 'reference' THEN 'allowed|qualified_free_reference' ELSE 'rejected|not_reference_source' END
WHEN use = 'analytical_processing' THEN CASE WHEN usage_role <> 'analytical' OR NOT eligible_for_analysis THEN 'rejected|not_analytical_source' WHEN data_kind = 'rendered_imagery' THEN 'rejected|rendered_imagery_not_analytical' ELSE 'allowed|qualified_free_analytical' END
WHEN use = 'comparison' THEN CASE WHEN usage_role <> 'analytical' OR NOT eligible_for_analysis THEN 'not_comparable|reference_or_review_only' WHEN data_kind <> 'vector' THEN 'not_comparable|not_analytical_vector' ELSE 'allowed|qualified_free_analytical_vector' END
WHEN "public_export" = 'allowed' AND usage_role = 'analytical' AND data_kind <> 'rendered_imagery' THEN 'allowed|qualified_free_public_export' ELSE 'rejected|public_export_prohibited' END"""


def _named(t):
    return g.provenance(t("artifact")).groupBy("source_id").agg(F.count("*").alias("n_artifacts"))


@query("source_eligibility", f"WITH n AS (SELECT source_id, count(*) AS n_artifacts FROM (SELECT source_a AS source_id FROM artifact UNION ALL SELECT source_b FROM artifact) GROUP BY 1) SELECT r.source_id, use, split_part(d, '|', 1) AS outcome, split_part(d, '|', 2) AS reason, coalesce(n_artifacts, 0) AS n_artifacts FROM (SELECT *, {_ELIG} AS d FROM source_registry, (VALUES ('acquisition'),('local_import'),('reference'),('analytical_processing'),('comparison'),('public_export')) AS u(use)) r LEFT JOIN n ON n.source_id = r.source_id", "source_registry", "artifact")
def source_eligibility(t):
    return g.all_uses(t("source_registry")).join(_named(t), "source_id", "left").fillna(0, ["n_artifacts"])


_KIND = "CASE WHEN format IN ('geojson','osm_query','wfs_gml','gpkg_geoparquet') THEN 'vector' WHEN format IN ('wms','wmts') THEN 'rendered_imagery' ELSE 'raster' END"
_CODES = {
    "id": "source_id = ''", "name": "name = ''", "data_kind": "data_kind NOT IN ('vector','raster','rendered_imagery')", "authority": "authority NOT IN ('official','community','project_local')",
    "restricted_free": "access_method IN ('paid','agreement_only','private_partner') AND qualification = 'qualified_free'", "public_export": "public_export NOT IN ('allowed','prohibited')", "distribution_reason": "reason = ''", "source_url": "source_url = ''",
    "attribution": "attribution IS NULL OR license = ''", "kind_of_format": f"data_kind <> {_KIND}", "imagery_analytical": "usage_role = 'analytical' AND data_kind = 'rendered_imagery'", "eligible_role": "usage_role <> 'analytical' AND eligible_for_analysis",
    "export_role": "usage_role <> 'analytical' AND public_export <> 'prohibited'", "export_unqualified": "qualification <> 'qualified_free' AND public_export <> 'prohibited'",
    "export_not_authoritative": "public_export = 'allowed' AND usage_role = 'analytical' AND qualification = 'qualified_free' AND data_kind <> 'rendered_imagery' AND not_authoritative",
    "cache_provenance": "usage_role = 'analytical' AND data_kind = 'vector' AND qualification = 'qualified_free' AND cache_fields IS NULL",
}


@query("registry_violations", " UNION ALL ".join(f"SELECT record_id, source_id, '{k}' AS code FROM source_record WHERE {v}" for k, v in _CODES.items()) + " UNION ALL SELECT record_id, source_id, 'duplicate_id' FROM source_record WHERE source_id <> '' AND source_id IN (SELECT source_id FROM source_record GROUP BY 1 HAVING count(*) > 1)", "source_record")
def registry_violations(t):
    return g.registry_problems(t("source_record"))


@query("missing_source_families", "SELECT aoi_id, f AS source_id FROM (SELECT DISTINCT aoi_id FROM artifact) a, (VALUES ('openstreetmap'),('prg_wfs'),('bdot10k'),('kiut_gesut_wms'),('geoportal_orthophoto'),('nmt_nmpt')) AS r(f) WHERE NOT EXISTS (SELECT 1 FROM artifact x WHERE x.aoi_id = a.aoi_id AND (x.source_a = f OR x.source_b = f))", "artifact")
def missing_source_families(t):
    """Families that a registry must know and that no artifact of an area comes from."""
    have = t("artifact").groupBy("aoi_id").agg(F.collect_set("source_a").alias("a"), F.collect_set("source_b").alias("b"))  # as many as there are sources
    lost = F.array_except(F.lit(list(g.REQUIRED_SOURCES)), F.array_union("a", "b"))
    return have.select("aoi_id", F.explode(lost).alias("source_id"))


@query("artifact_sources", "SELECT a.artifact_id, count(*) AS n_sources, count(r.source_id) AS n_known, coalesce(bool_and(r.eligible_for_analysis), false) AS all_eligible, string_agg(r.authority, ',' ORDER BY pos) AS authorities FROM (SELECT artifact_id, 0 AS pos, source_a AS source_id FROM artifact UNION ALL SELECT artifact_id, 1, source_b FROM artifact) a LEFT JOIN source_registry r ON r.source_id = a.source_id GROUP BY 1", "artifact", "source_registry")
def artifact_sources(t):
    p = g.provenance(t("artifact").drop("public_export")).join(t("source_registry").select("source_id", F.col("source_id").alias("known"), "eligible_for_analysis", "authority"), "source_id", "left")
    a = p.groupBy("artifact_id").agg(F.count("*").alias("n_sources"), F.count("known").alias("n_known"), F.coalesce(F.bool_and("eligible_for_analysis"), F.lit(False)).alias("all_eligible"), F.array_sort(F.collect_list(F.when(F.col("known").isNotNull(), F.struct("pos", "authority")))).alias("l"))
    return a.select("artifact_id", "n_sources", "n_known", "all_eligible", F.when(F.size("l") > 0, F.array_join(F.transform("l", lambda x: x["authority"]), ",")).alias("authorities"))


@query("provenance_violations", "WITH p AS (SELECT a.*, r.source_id AS known, r.public_export AS may, r.usage_role FROM (SELECT artifact_id, public_export, 0 AS pos, source_a AS source_id FROM artifact UNION ALL SELECT artifact_id, public_export, 1, source_b FROM artifact) a LEFT JOIN source_registry r ON r.source_id = a.source_id) SELECT DISTINCT artifact_id, 'unknown_source' AS code FROM p WHERE known IS NULL UNION ALL SELECT DISTINCT artifact_id, 'export_not_allowed' FROM p WHERE public_export AND may <> 'allowed' UNION ALL SELECT DISTINCT artifact_id, 'role_not_allowed' FROM p WHERE pos = 0 AND usage_role = 'reference' UNION ALL SELECT artifact_id, 'duplicate_source' FROM artifact WHERE source_a = source_b", "artifact", "source_registry")
def provenance_violations(t):
    return g.provenance_violations(t("artifact"), t("source_registry"))


# availability reports: one per event, dated by it
_AV = """(SELECT event_id, CASE user_id % 8 WHEN 0 THEN 'openstreetmap' WHEN 1 THEN 'manual_power_seed' WHEN 2 THEN 'prg_wfs' WHEN 3 THEN 'bdot10k' WHEN 4 THEN 'kiut_gesut_wms' WHEN 5 THEN 'geoportal_orthophoto' WHEN 6 THEN 'nmt_nmpt' ELSE 'paid_candidate' END AS source_id,
CASE event_id % 4 WHEN 0 THEN 'available' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'not_eligible' ELSE 'reference_only' END AS availability, CASE WHEN event_id % 3 = 0 THEN 'uncovered' ELSE 'covered' END AS aoi_coverage, ts, CAST(event_id % 30 + 1 AS INT) AS days FROM {events})"""
_NOW = "TIMESTAMP '2024-01-20 00:00:00'"


def reports(t):
    names = [x for x in ("openstreetmap", "manual_power_seed", "prg_wfs", "bdot10k", "kiut_gesut_wms", "geoportal_orthophoto", "nmt_nmpt", "paid_candidate")]
    r = t("events").select("event_id", F.element_at(F.lit(names), (F.col("user_id") % 8 + 1).cast("int")).alias("source_id"), F.element_at(F.lit(["available", "unavailable", "not_eligible", "reference_only"]), (F.col("event_id") % 4 + 1).cast("int")).alias("availability"),
                           F.when(F.col("event_id") % 3 == 0, "uncovered").otherwise("covered").alias("aoi_coverage"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 30 + 1).cast("int").alias("days"))
    reg = t("source_registry").select("source_id", "usage_role", g.eligibility("analytical_processing")["outcome"].alias("eligibility"))
    r = r.join(reg, "source_id").withColumn("freshness", g.freshness(F.col("ts"), F.col("days"), F.expr(_NOW)))
    return r.withColumn("actionable_gap", F.col("availability").isin("unavailable", "not_eligible") | ((F.col("aoi_coverage") == "uncovered") & (F.col("usage_role") == "analytical")))


_REP = f"""(SELECT v.*, usage_role, CASE WHEN qualification = 'qualified_free' AND usage_role = 'analytical' AND eligible_for_analysis AND data_kind <> 'rendered_imagery' THEN 'allowed' ELSE 'rejected' END AS eligibility, CASE WHEN {_NOW} <= v.ts + to_days(v.days) THEN 'fresh' ELSE 'stale' END AS freshness,
availability IN ('unavailable','not_eligible') OR (aoi_coverage = 'uncovered' AND usage_role = 'analytical') AS actionable_gap FROM {_AV.replace('{events}', 'events')} v JOIN source_registry r ON r.source_id = v.source_id)"""


@query("source_availability", f"SELECT event_id, source_id, freshness, eligibility, actionable_gap, availability = 'not_eligible' AND eligibility = 'allowed' AS contradiction FROM {_REP}", "source_registry")
def source_availability(t):
    return reports(t).select("event_id", "source_id", "freshness", "eligibility", "actionable_gap", ((F.col("availability") == "not_eligible") & (F.col("eligibility") == "allowed")).alias("contradiction"))


@query("source_freshness", f"SELECT source_id, freshness, count(*) AS n FROM {_REP} GROUP BY 1, 2", "source_registry")
def source_freshness(t):
    return reports(t).groupBy("source_id", "freshness").agg(F.count("*").alias("n"))


@query("source_problems", f"SELECT event_id, CASE WHEN availability = 'unavailable' THEN 'unavailable' WHEN source_id = 'bdot10k' AND aoi_coverage = 'uncovered' THEN 'no_local_package' WHEN source_id = 'manual_power_seed' OR availability = 'not_eligible' THEN 'not_analytical' WHEN freshness = 'stale' THEN 'outdated' WHEN actionable_gap THEN 'gap' WHEN aoi_coverage = 'uncovered' AND availability <> 'reference_only' THEN 'uncovered' END AS problem FROM {_REP}", "source_registry")
def source_problems(t):
    return reports(t).select("event_id", g.source_problem().alias("problem"))


@query("cache_freshness", f"SELECT event_id, {_NOW} <= ts + INTERVAL 24 HOUR AS fresh FROM events")
def cache_freshness(t):
    return t("events").select("event_id", (F.expr(_NOW) <= F.col("ts").cast("timestamp") + F.expr("INTERVAL 24 HOURS")).alias("fresh"))


@query("default_availability", "SELECT c_custkey AS aoi_id, source_id, CASE WHEN usage_role = 'reference' THEN 'reference_only' WHEN qualification <> 'qualified_free' OR NOT eligible_for_analysis THEN 'not_eligible' ELSE 'available' END AS availability FROM customer, source_registry", "source_registry")
def default_availability(t):
    """Each area with one row per registered source: the registry is one array value, not a join."""
    state = F.when(F.col("usage_role") == "reference", "reference_only").when((F.col("qualification") != "qualified_free") | ~F.col("eligible_for_analysis"), "not_eligible").otherwise("available")
    known = t("source_registry").agg(F.array_sort(F.collect_list(F.struct("source_id", state.alias("availability"))))).scalar()
    return t("customer").select(F.col("c_custkey").alias("aoi_id"), known.alias("known")).select("aoi_id", F.explode("known").alias("s")).select("aoi_id", "s.source_id", "s.availability")


_CAND = "SELECT domain, CASE WHEN domain IN ('sewer','telecom','gas') THEN 'rejected' WHEN snapshot_id % 7 = 0 THEN 'adopted' WHEN snapshot_id % 7 = 1 THEN 'rejected' ELSE 'candidate' END AS decision, snapshot_id % 14 IN (0, 2) AS enabled FROM domain_outcome"


@query("strategy_coverage", f"SELECT d.domain, CASE WHEN count(*) FILTER (WHERE decision = 'adopted') > 0 THEN 'adopted' WHEN d.domain IN ('sewer','gas') THEN 'gap' ELSE 'uncovered' END AS state, count(*) FILTER (WHERE decision = 'adopted') AS n_adopted, count(*) FILTER (WHERE enabled AND decision <> 'adopted') AS n_wrongly_enabled FROM (VALUES {', '.join(f'({d!r})' for d in DOMAINS)}) AS d(domain) LEFT JOIN ({_CAND}) c ON c.domain = d.domain GROUP BY 1", "domain_outcome")
def strategy_coverage(t):
    """Candidates of all domains, one for each outcome; two domains have a stated gap, and one has neither."""
    k = F.col("snapshot_id") % 7
    c = t("domain_outcome").select("domain", F.when(F.col("domain").isin("sewer", "telecom", "gas"), "rejected").when(k == 0, "adopted").when(k == 1, "rejected").otherwise("candidate").alias("decision"), (F.col("snapshot_id") % 14).isin(0, 2).alias("enabled"))
    domains = t.spark.createDataFrame([(x,) for x in DOMAINS], "domain string")
    return g.strategy_states(domains, c, t.spark.createDataFrame([("sewer",), ("gas",)], "domain string"))


_REFERENCE = "(SELECT s_suppkey AS layer_id, 17.9e0 + CAST(s_suppkey % 12 AS DOUBLE) * 0.1e0 AS west, 49.7e0 + CAST(s_suppkey % 7 AS DOUBLE) * 0.1e0 AS south, 18.3e0 + CAST(s_suppkey % 12 AS DOUBLE) * 0.1e0 AS east, 50.0e0 + CAST(s_suppkey % 7 AS DOUBLE) * 0.1e0 AS north, 500e0 * CAST(s_suppkey % 4 AS DOUBLE) AS min_scale, 4000e0 + 3000e0 * CAST(s_suppkey % 5 AS DOUBLE) AS max_scale FROM supplier)"


@query("reference_coverage", f"""SELECT b.id AS request_id, layer_id, CASE WHEN NOT (min_lon <= east AND max_lon >= west AND min_lat <= north AND max_lat >= south) THEN 'uncovered' WHEN scale NOT BETWEEN min_scale AND max_scale THEN 'unsupported_scale' ELSE 'available' END AS state,
concat_ws('&', concat('layers=', CAST(layer_id AS VARCHAR)), concat('bbox=', concat_ws(',', printf('%.4f', min_lon), printf('%.4f', min_lat), printf('%.4f', max_lon), printf('%.4f', max_lat)))) AS url
FROM (SELECT *, 1000e0 + CAST(id % 9 AS DOUBLE) * 1500e0 AS scale FROM site_box) b JOIN {_REFERENCE} l ON b.id % 97 = l.layer_id % 97""", "site_box")
def reference_coverage(t):
    """A request's reference layer: its box must meet the request's, and its scales must hold the request's."""
    k = F.col("s_suppkey")
    l = t("supplier").select(k.alias("layer_id"), (k % 97).alias("key"), (17.9 + k % 12 * 0.1).alias("west"), (49.7 + k % 7 * 0.1).alias("south"), (18.3 + k % 12 * 0.1).alias("east"), (50.0 + k % 7 * 0.1).alias("north"), (500.0 * (k % 4)).alias("min_scale"), (4000.0 + 3000.0 * (k % 5)).alias("max_scale"))
    # the text of a request's box is made once for it, not once for each of its layers; its rows are few bytes, but have many partners, so they are dealt (behind the text, which generated code would else put off into the loop over the partners)
    bbox = F.concat(F.lit("&bbox="), F.concat_ws(",", *[F.format_string("%.4f", c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")]))
    b = t("site_box").withColumn("key", F.col("id") % 97).withColumn("scale", 1000.0 + F.col("id") % 9 * 1500.0).withColumn("bbox", bbox).repartition("id")
    url = F.concat(F.lit("layers="), F.col("layer_id").cast("string"), F.col("bbox"))
    return b.join(l, "key").select(F.col("id").alias("request_id"), "layer_id", g.reference_state().alias("state"), url.alias("url"))


_RQ = "(SELECT c_custkey AS request_id, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 12e0 + c_custkey % 13 END AS lon, 48e0 + c_custkey % 8 AS lat, (c_custkey % 12) * 10000e0 AS radius_m, c_custkey % 3 = 0 AS demo FROM customer)"


def requests(t):
    k = F.col("c_custkey")
    return t("customer").select(k.alias("request_id"), F.when(k % 11 != 0, 12.0 + k % 13).alias("lon"), (48.0 + k % 8).alias("lat"), (k % 12 * 10000.0).alias("radius_m"), (k % 3 == 0).alias("demo"))


@query("request_preflight", f"SELECT request_id, CASE WHEN lon IS NULL THEN 'invalid_point' WHEN NOT (lon BETWEEN 14.0 AND 24.2 AND lat BETWEEN 49.0 AND 54.9) THEN 'outside_country' WHEN NOT radius_m BETWEEN 100 AND 100000 THEN 'invalid_radius' WHEN demo AND radius_m > 10000 THEN 'demo_limit' WHEN radius_m > 30000 THEN 'runtime_limit' ELSE 'ready' END AS code FROM {_RQ}")
def request_preflight(t):
    return requests(t).select("request_id", g.preflight().alias("code"))


_AREA = """(SELECT c_custkey AS request_id, CASE c_custkey % 5 WHEN 0 THEN 'alias' WHEN 1 THEN 'circle' WHEN 2 THEN 'circle' WHEN 3 THEN 'administrative_reference' ELSE CASE WHEN c_custkey % 2 = 0 THEN 'square' ELSE 'circle' END END AS type, CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'elsewhere' ELSE 'rybnik_35km' END END AS alias,
CASE WHEN c_custkey % 5 IN (1, 2, 4) THEN CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 12e0 + c_custkey % 200 END END AS longitude, CASE WHEN c_custkey % 5 IN (1, 2, 4) OR c_custkey % 13 = 1 THEN 48e0 + c_custkey % 50 END AS latitude, CASE WHEN c_custkey % 5 IN (1, 2, 4) THEN (c_custkey % 12) * 10000e0 END AS radius_m,
CASE WHEN c_custkey % 5 = 3 THEN CASE WHEN c_custkey % 4 = 0 THEN 'prg_gmina_other' ELSE 'prg_gmina_rybnik' END END AS reference_id FROM customer)"""
_AREA_CODES = {"type": "type = 'square'", "fields": "type IN ('alias','administrative_reference') AND latitude IS NOT NULL", "alias": "type = 'alias' AND alias <> 'rybnik_35km'", "reference_id": "type = 'administrative_reference' AND reference_id <> 'prg_gmina_rybnik'",
               "centre": "type = 'circle' AND (longitude IS NULL OR longitude > 180 OR latitude > 90)", "radius": "type = 'circle' AND NOT radius_m BETWEEN 100 AND 100000"}


@query("aoi_resolve", " UNION ALL ".join(f"SELECT request_id, type, '{k}' AS error FROM {_AREA} WHERE {v}" for k, v in _AREA_CODES.items()))
def aoi_resolve(t):
    """Requests of all types, some of which are wrong."""
    k = F.col("c_custkey")
    circle = (k % 5).isin(1, 2, 4)
    r = t("customer").select(
        k.alias("request_id"), F.when(k % 5 == 0, "alias").when(k % 5 == 3, "administrative_reference").when((k % 5 == 4) & (k % 2 == 0), "square").otherwise("circle").alias("type"), F.when(k % 5 == 0, F.when(k % 3 == 0, "elsewhere").otherwise("rybnik_35km")).alias("alias"),
        F.when(circle & (k % 11 != 0), 12.0 + k % 200).alias("longitude"), F.when(circle | (k % 13 == 1), 48.0 + k % 50).alias("latitude"), F.when(circle, k % 12 * 10000.0).alias("radius_m"), F.when(k % 5 == 3, F.when(k % 4 == 0, "prg_gmina_other").otherwise("prg_gmina_rybnik")).alias("reference_id"))
    return r.select("request_id", "type", F.explode(g.area_errors(F.lit(["rybnik_35km"]), F.lit(["prg_gmina_rybnik"]))).alias("error"))


@query("aoi_identity", f"SELECT request_id, substr(sha256(concat_ws('|', 'circle', printf('%.7f', lon), printf('%.7f', lat), printf('%.1f', radius_m))), 1, 16) AS aoi_id FROM {_RQ} WHERE lon IS NOT NULL")
def aoi_identity(t):
    return requests(t).where("lon is not null").select("request_id", g.identity(F.lit("circle"), F.format_string("%.7f", "lon"), F.format_string("%.7f", "lat"), F.format_string("%.1f", "radius_m")).alias("aoi_id"))


@query("request_identity", "SELECT snapshot_id, substr(sha256(concat_ws('|', CAST(snapshot_id AS VARCHAR), string_agg(DISTINCT domain, ',' ORDER BY domain))), 1, 16) AS request_id FROM domain_outcome GROUP BY snapshot_id", "domain_outcome")
def request_identity(t):
    o = t("domain_outcome").groupBy("snapshot_id").agg(F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("d"))
    return o.select("snapshot_id", g.identity(F.col("snapshot_id").cast("string"), F.col("d")).alias("request_id"))


@query("context_outcomes", "SELECT c_custkey AS aoi_id, source_id, CASE usage_role WHEN 'reference' THEN 'reference_only' ELSE 'context_only' END AS status FROM customer, source_registry WHERE usage_role <> 'analytical' UNION ALL SELECT c_custkey, 'prg_wfs', 'administrative' FROM customer WHERE c_custkey % 3 = 2", "source_registry")
def context_outcomes(t):
    """Each area with its rows of context: the rules of the registry are one array value, so areas stay where they are."""
    rule = F.struct("source_id", F.when(F.col("usage_role") == "reference", "reference_only").otherwise("context_only").alias("status"))
    rules = t("source_registry").where("usage_role <> 'analytical'").agg(F.array_sort(F.collect_list(rule))).scalar()
    own = F.when(F.col("c_custkey") % 3 == 2, F.array(F.struct(F.lit("prg_wfs").alias("source_id"), F.lit("administrative").alias("status"))))
    a = t("customer").withColumns({"rules": rules, "own": own})
    a = a.select(F.col("c_custkey").alias("aoi_id"), F.explode(F.when(F.col("own").isNull(), F.col("rules")).otherwise(F.concat("rules", "own"))).alias("r"))
    return a.select("aoi_id", "r.source_id", "r.status")
