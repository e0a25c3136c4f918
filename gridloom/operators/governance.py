"""Governance of sources: eligibility, registry rules, availability, provenance, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USES = ("acquisition", "local_import", "reference", "analytical_processing", "comparison", "public_export")


def eligibility(use: str) -> Column:
    """Struct (outcome, reason) of a registry row for one use."""
    free, role, kind = F.col("qualification") == "qualified_free", F.col("usage_role"), F.col("data_kind")
    yes = lambda why: F.struct(F.lit("allowed").alias("outcome"), F.lit(why).alias("reason"))
    no = lambda why, o="rejected": F.struct(F.lit(o).alias("outcome"), F.lit(why).alias("reason"))
    analytical = (role == "analytical") & F.coalesce(F.col("eligible_for_analysis"), F.lit(False))
    image = kind == "rendered_imagery"
    first = F.when(~F.coalesce(free, F.lit(False)), no("not_qualified_free"))
    if use in ("acquisition", "local_import"):
        return first.otherwise(yes("qualified_free"))
    if use == "reference":
        return first.when(role == "reference", yes("qualified_free_reference")).otherwise(no("not_reference_source"))
    if use == "analytical_processing":
        return first.when(~analytical, no("not_analytical_source")).when(image, no("rendered_imagery_not_analytical")).otherwise(yes("qualified_free_analytical"))
    if use == "comparison":
        return first.when(~analytical, no("reference_or_review_only", "not_comparable")).when(kind != "vector", no("not_analytical_vector", "not_comparable")).otherwise(yes("qualified_free_analytical_vector"))
    if use == "public_export":
        return first.when((F.col("public_export") == "allowed") & (role == "analytical") & ~image, yes("qualified_free_public_export")).otherwise(no("public_export_prohibited"))
    raise ValueError(f"unknown use {use}")


def all_uses(registry: DataFrame) -> DataFrame:
    e = F.array(*[F.struct(F.lit(u).alias("use"), eligibility(u).alias("d")) for u in USES])
    return registry.select("source_id", F.explode(e).alias("e")).select("source_id", "e.use", "e.d.outcome", "e.d.reason")


# Closed vocabularies of a registry record, and the kind that each format holds.
DATA_KINDS = ("vector", "raster", "rendered_imagery")
AUTHORITIES = ("official", "community", "project_local")
ACCESS_METHODS = ("public_query", "public_service", "public_download", "local_review_input", "paid", "agreement_only", "private_partner")
RESTRICTED = ("paid", "agreement_only", "private_partner")
USAGE_ROLES = ("analytical", "reference", "review")
QUALIFICATIONS = ("qualified_free", "rejected", "not_qualified")
KIND_OF_FORMAT = {"geojson": "vector", "osm_query": "vector", "wfs_gml": "vector", "gpkg_geoparquet": "vector", "wms": "rendered_imagery", "wmts": "rendered_imagery", "geotiff_ascii_grid": "raster"}


def registry_violations() -> Column:
    """Codes of a registry record that lacks what it needs, leaves the closed vocabularies or contradicts itself."""
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    outside = lambda c, known: ~F.coalesce(F.col(c).isin(*known), F.lit(False))
    kind = F.create_map(*[F.lit(x) for kv in KIND_OF_FORMAT.items() for x in kv])[F.col("format")]
    analytical, free, exported = F.col("usage_role") == "analytical", F.col("qualification") == "qualified_free", F.col("public_export") != "prohibited"
    tests = [("id", blank("source_id")), ("name", blank("name")), ("data_kind", outside("data_kind", DATA_KINDS)), ("format", outside("format", KIND_OF_FORMAT)), ("authority", outside("authority", AUTHORITIES)),
             ("access_method", outside("access_method", ACCESS_METHODS)), ("usage_role", outside("usage_role", USAGE_ROLES)), ("qualification", outside("qualification", QUALIFICATIONS)), ("restricted_free", F.col("access_method").isin(*RESTRICTED) & free),
             ("public_export", outside("public_export", ("allowed", "prohibited"))), ("distribution_reason", blank("reason")), ("source_url", blank("source_url")), ("attribution", blank("attribution") | blank("license")),
             ("kind_of_format", F.col("data_kind") != kind), ("imagery_analytical", analytical & (F.col("data_kind") == "rendered_imagery")), ("eligible_role", ~analytical & F.col("eligible_for_analysis")),
             ("export_role", ~analytical & exported), ("export_unqualified", ~free & exported), ("export_not_authoritative", (F.col("public_export") == "allowed") & analytical & free & (F.col("data_kind") != "rendered_imagery") & F.col("not_authoritative")),
             ("cache_provenance", analytical & (F.col("data_kind") == "vector") & free & blank("cache_fields"))]
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), n) for n, t in tests]))


#: Source families that a registry cannot do without.
REQUIRED_SOURCES = ("openstreetmap", "prg_wfs", "bdot10k", "kiut_gesut_wms", "geoportal_orthophoto", "nmt_nmpt")


def registry_problems(records: DataFrame, key: str = "record_id") -> DataFrame:
    """``key, source_id, code`` of all records: their own violations, and ids that several share."""
    own = records.select(key, "source_id", F.explode(registry_violations()).alias("code"))
    shared = records.where("source_id <> ''").groupBy(F.col("source_id").alias("_s")).count().where("count > 1")
    twice = records.join(shared, F.col("source_id") == F.col("_s"), "left_semi").select(key, "source_id", F.lit("duplicate_id").alias("code"))
    return own.unionByName(twice)


def freshness(stamp: Column, days: Column, now: Column) -> Column:
    return F.when(now <= stamp + F.make_dt_interval(days), "fresh").otherwise("stale")


def source_problem() -> Column:
    """The class of a source's problem, first match; null if there is none."""
    return (F.when(F.col("availability") == "unavailable", "unavailable").when((F.col("source_id") == "bdot10k") & (F.col("aoi_coverage") == "uncovered"), "no_local_package")
            .when((F.col("source_id") == "manual_power_seed") | (F.col("availability") == "not_eligible"), "not_analytical").when(F.col("freshness") == "stale", "outdated")
            .when(F.col("actionable_gap"), "gap").when((F.col("aoi_coverage") == "uncovered") & (F.col("availability") != "reference_only"), "uncovered"))


def provenance(artifacts: DataFrame) -> DataFrame:
    """Artifacts by contributing source, in order."""
    return artifacts.select("*", F.posexplode(F.array("source_a", "source_b")).alias("pos", "source_id"))


def provenance_violations(artifacts: DataFrame, registry: DataFrame) -> DataFrame:
    """``artifact_id, code``: unknown source, source named twice, public file from a source that may not be exported."""
    known = registry.select("source_id", F.col("public_export").alias("may"), "usage_role")
    p = provenance(artifacts).join(known, "source_id", "left")  # a registry row per source
    bad = p.select("artifact_id", F.explode(F.array_compact(F.array(F.when(F.col("may").isNull(), "unknown_source"), F.when(F.col("public_export") & (F.col("may") != "allowed"), "export_not_allowed"),
                                                                     F.when((F.col("pos") == 0) & (F.col("usage_role") == "reference"), "role_not_allowed")))).alias("code")).distinct()
    return bad.unionByName(artifacts.where(F.col("source_a") == F.col("source_b")).select("artifact_id", F.lit("duplicate_source").alias("code")))


def reference_state() -> Column:
    """Of a request (min_lon .. max_lat, scale) and a layer (west .. north, min_scale, max_scale); a layer without a scale range takes all scales."""
    meets = (F.col("min_lon") <= F.col("east")) & (F.col("max_lon") >= F.col("west")) & (F.col("min_lat") <= F.col("north")) & (F.col("max_lat") >= F.col("south"))
    fits = (F.col("scale") >= F.coalesce("min_scale", F.lit(0.0))) & (F.col("scale") <= F.coalesce("max_scale", F.lit(float("inf"))))
    return F.when(~F.coalesce(meets, F.lit(False)), "uncovered").when(~F.coalesce(fits, F.lit(False)), "unsupported_scale").otherwise("available")


def strategy_states(domains: DataFrame, candidates: DataFrame, gaps: DataFrame) -> DataFrame:
    """``domain, state, n_adopted, n_wrongly_enabled``: a domain is covered by an adopted candidate (domain, decision, enabled) or by a stated gap; only adopted candidates may be enabled."""
    c = candidates.groupBy("domain").agg(F.count_if(F.col("decision") == "adopted").alias("n_adopted"), F.count_if(F.col("enabled") & (F.col("decision") != "adopted")).alias("n_wrongly_enabled"))
    d = domains.join(c, "domain", "left").join(gaps.withColumn("gap", F.lit(True)), "domain", "left").fillna(0, ["n_adopted", "n_wrongly_enabled"])
    return d.select("domain", F.when(F.col("n_adopted") > 0, "adopted").when(F.col("gap"), "gap").otherwise("uncovered").alias("state"), "n_adopted", "n_wrongly_enabled")


#: Fields of each kind of request for an area.
AREA_FIELDS = {"alias": ("alias",), "circle": ("longitude", "latitude", "radius_m"), "administrative_reference": ("reference_id",)}


def area_errors(aliases: Column, references: Column) -> Column:
    """What is wrong with a request for an area (type and the fields of all types): its type, fields that belong to another type, names that are not known, numbers that are none or out of range."""
    of = lambda kind: F.coalesce(F.col("type") == kind, F.lit(False))
    stray = F.lit(False)
    for kind, own in AREA_FIELDS.items():
        others = [f for k, fs in AREA_FIELDS.items() if k != kind for f in fs]
        stray = stray | (of(kind) & F.greatest(*[F.col(f).isNotNull().cast("int") for f in others]).cast("boolean"))
    number = lambda c, lo, hi: F.coalesce(F.col(c).between(lo, hi) & ~F.isnan(c), F.lit(False))
    tests = [("type", ~F.coalesce(F.col("type").isin(*AREA_FIELDS), F.lit(False))), ("fields", stray), ("alias", of("alias") & ~F.coalesce(F.array_contains(aliases, F.col("alias")), F.lit(False))),
             ("reference_id", of("administrative_reference") & ~F.coalesce(F.array_contains(references, F.col("reference_id")), F.lit(False))), ("centre", of("circle") & ~(number("longitude", -180.0, 180.0) & number("latitude", -90.0, 90.0))),
             ("radius", of("circle") & ~number("radius_m", MIN_RADIUS, MAX_RADIUS))]
    return F.array_compact(F.array(*[F.when(t, n) for n, t in tests]))


MIN_RADIUS, MAX_RADIUS, RUNTIME_RADIUS, DEMO_RADIUS = 100.0, 100_000.0, 30_000.0, 10_000.0


def preflight() -> Column:
    """The first reason to refuse a point request (lon, lat, radius_m, demo), else "ready"."""
    place = F.col("lon").between(14.0, 24.2) & F.col("lat").between(49.0, 54.9)
    return (F.when(F.col("lon").isNull() | F.col("lat").isNull() | F.isnan("lon") | F.isnan("lat"), "invalid_point").when(~place, "outside_country").when(~F.col("radius_m").between(MIN_RADIUS, MAX_RADIUS), "invalid_radius")
            .when(F.col("demo") & (F.col("radius_m") > DEMO_RADIUS), "demo_limit").when(F.col("radius_m") > RUNTIME_RADIUS, "runtime_limit").otherwise("ready"))


def identity(*parts: Column) -> Column:
    """Sixteen hex digits of the canonical text of a request."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
