"""Queries of quality rules, readiness, validation reports, comparison and the contract."""

from pyspark.sql import functions as F

from gridloom.operators import quality as q
from gridloom.plans.classify import CASES, _J, NODES, features
from gridloom.functions import classify as c
from gridloom.plans.geometry import CX, CY
from gridloom.plans.views import query

_ST = "CASE translate(lower(trim(validation_status_raw)), '- ', '__') WHEN 'pass' THEN 'passed' WHEN 'ok' THEN 'passed' WHEN 'success' THEN 'passed' WHEN 'valid' THEN 'passed' WHEN 'warn' THEN 'warning' WHEN 'warning' THEN 'warning' WHEN 'fail' THEN 'failed' WHEN 'failed' THEN 'failed' WHEN 'error' THEN 'failed' WHEN 'invalid' THEN 'failed' ELSE 'unknown' END"


def layers(t):
    return t("layer_summary").withColumn("quality", q.quality_status(F.col("validation_status_raw")))


@query("normalize_status", f"SELECT layer_id, {_ST} AS quality FROM layer_summary", "layer_summary")
def normalize_status(t):
    return layers(t).select("layer_id", "quality")


_RD = f"""CASE WHEN source_type = 'reference_overlay' THEN 'needs_source' WHEN issue_severity = 'high' OR feature_count = 0 OR quality = 'failed' THEN 'not_usable' WHEN quality = 'unknown' THEN 'needs_source'
WHEN source_type = 'manual_seed' OR quality = 'warning' OR issue_severity IN ('low','medium') OR comparison_outcome IN ('conflicting','source_only','ambiguous') THEN 'usable_with_limitations' ELSE 'ready' END"""
_L = f"(SELECT *, {_ST} AS quality FROM layer_summary)"


def with_readiness(t):
    return layers(t).withColumn("readiness", q.readiness(F.col("quality"), F.col("feature_count"), F.col("source_type"), F.col("issue_severity"), F.col("comparison_outcome")))


@query("readiness", f"SELECT layer_id, {_RD} AS readiness FROM {_L}", "layer_summary")
def readiness(t):
    return with_readiness(t).select("layer_id", "readiness")


@query("layer_readiness_list", f"SELECT aoi_id, string_agg(concat(layer_id, ':', readiness), ',' ORDER BY layer_id) AS layers FROM (SELECT aoi_id, layer_id, {_RD} AS readiness FROM {_L}) GROUP BY aoi_id", "layer_summary")
def layer_readiness_list(t):
    r = with_readiness(t).groupBy("aoi_id").agg(F.array_sort(F.collect_list(F.struct("layer_id", "readiness"))).alias("l"))
    return r.select("aoi_id", F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["layer_id"], x["readiness"])), ",").alias("layers"))


_V = "'analytical_vector','manual_seed'"
_RULES = [("layer.empty", "EMPTY", "high", _V, "feature_count = 0"), ("geometry.invalid", "INVALID-GEOMETRY", "high", _V, "invalid_geometry_count > 0"), ("attributes.missing_required", "MISSING-ATTRIBUTES", "medium", "'analytical_vector'", "missing_attribute IS NOT NULL"),
          ("features.duplicates", "DUPLICATES", "medium", "'analytical_vector'", "duplicate_count > 0"), ("geometry.unsupported", "UNSUPPORTED-GEOMETRY", "medium", _V, "unsupported_geometry IS NOT NULL"),
          ("source.inconsistent", "SOURCE-METADATA", "high", f"{_V},'reference_overlay'", "NOT source_metadata_valid"), ("validation.status", "QUALITY", "medium", _V, "quality <> 'passed'"),
          ("manual.non_authoritative", "NON-AUTHORITATIVE", "medium", "'manual_seed'", "feature_count > 0"), ("reference.overlay", "REFERENCE-ONLY", "medium", "'reference_overlay'", "true")]
_EV = " UNION ALL ".join(f"SELECT layer_id, aoi_id, '{r}' AS rule_id, '{k}' AS code, '{s}' AS severity, CASE WHEN source_type NOT IN ({ty}) THEN 'not_applicable' WHEN {p} THEN 'triggered' ELSE 'passed' END AS outcome FROM {_L}" for r, k, s, ty, p in _RULES)


@query("quality_rules", f"SELECT layer_id, rule_id, outcome FROM ({_EV})", "layer_summary")
def quality_rules(t):
    return q.evaluate_rules(layers(t)).select("layer_id", "rule_id", "outcome")


@query("quality_issues", f"SELECT concat('DQ-', upper(replace(layer_id, '.', '-')), '-', code) AS issue_id, layer_id, severity FROM ({_EV}) WHERE outcome = 'triggered'", "layer_summary")
def quality_issues(t):
    e = q.evaluate_rules(layers(t)).where("outcome = 'triggered'")
    return e.select(q.issue_id(F.col("layer_id"), F.col("rule_id"), F.col("code")).alias("issue_id"), "layer_id", "severity")


@query("issue_ids", f"SELECT layer_id, rule_id, concat('DQ-', upper(replace(layer_id, '.', '-')), '-', code) AS issue_id FROM ({_EV})", "layer_summary")
def issue_ids(t):
    e = q.evaluate_rules(layers(t))
    return e.select("layer_id", "rule_id", q.issue_id(F.col("layer_id"), F.col("rule_id"), F.col("code")).alias("issue_id"))


@query("highest_severity", f"SELECT aoi_id, CASE max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n_issues FROM ({_EV}) WHERE outcome = 'triggered' GROUP BY aoi_id", "layer_summary")
def highest_severity(t):
    e = q.evaluate_rules(layers(t)).where("outcome = 'triggered'")
    return e.groupBy("aoi_id").agg(F.max_by("severity", q.severity_rank(F.col("severity"))).alias("severity"), F.count("*").alias("n_issues"))


@query("layer_missing_attributes", "SELECT aoi_id, string_agg(DISTINCT missing_attribute, ',' ORDER BY missing_attribute) AS missing FROM layer_summary WHERE missing_attribute IS NOT NULL GROUP BY aoi_id", "layer_summary")
def layer_missing_attributes(t):
    return t("layer_summary").where("missing_attribute is not null").groupBy("aoi_id").agg(F.array_join(F.array_sort(F.collect_set("missing_attribute")), ",").alias("missing"))


@query("duplicate_features", "SELECT id, dup_count AS n FROM geo_node WHERE dup_count > 1", "geo_node")
def duplicate_features(t):
    l = t("lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.count("*").alias("n"))
    return l.where("n > 1")


_SUBS = {"power_major_lines": "line", "power_minor_lines": "minor_line", "power_cables": "cable", "power_substations": "substation", "power_transformers": "transformer", "power_plants": "plant", "power_switchgear": "switch", "power_missing": "none"}
_OBJ = """o AS (SELECT n.tag_id, 'Point' AS gtype, 1 AS n_points, false AS self_crossing, sqrt(power(m.x - {cx!r}, 2) + power(m.y - {cy!r}, 2)) > 35000e0 AS outside FROM geo_node n JOIN metric m ON m.id = n.id UNION ALL
SELECT CAST(way_id % 90 AS INT), 'LineString', CASE WHEN way_id % 61 = 0 THEN 0 ELSE count(*) END, way_id IN (SELECT way_id FROM x), bool_or(sqrt(power(x - {cx!r}, 2) + power(y - {cy!r}, 2)) > 35000e0) FROM metric GROUP BY way_id HAVING count(*) >= 2)"""
# ways of which two sides that are not neighbours cross
CROSSING = """sd AS (SELECT way_id, seq, row_number() OVER (PARTITION BY way_id ORDER BY seq) AS k, lon1 AS ax, lat1 AS ay, lon2 AS bx, lat2 AS by_ FROM geo_segment WHERE lon2 IS NOT NULL),
x AS (SELECT DISTINCT p.way_id FROM sd p JOIN sd q ON p.way_id = q.way_id AND q.k > p.k + 1 WHERE ((p.bx - p.ax) * (q.ay - p.ay) - (p.by_ - p.ay) * (q.ax - p.ax) > 0) <> ((p.bx - p.ax) * (q.by_ - p.ay) - (p.by_ - p.ay) * (q.bx - p.ax) > 0)
 AND ((q.bx - q.ax) * (p.ay - q.ay) - (q.by_ - q.ay) * (p.ax - q.ax) > 0) <> ((q.bx - q.ax) * (p.by_ - q.ay) - (q.by_ - q.ay) * (p.bx - q.ax) > 0))"""


def _checked(t):
    """Nodes and ways with what a validation looks at; some ways are emptied on purpose."""
    from gridloom.functions.geo import with_metric
    from gridloom.functions.tags import tag_maps
    from gridloom.operators.validity import with_crossing
    from gridloom.operators.ways import assemble_ways
    from gridloom.plans.geometry import CX, CY

    tags = tag_maps(t("tag_kv")).select("tag_id", F.col("tags")["power"].alias("power"))
    m = with_metric(t("geo_node")).withColumn("outside", F.hypot(F.col("x") - CX, F.col("y") - CY) > 35_000.0)
    n = m.select("tag_id", F.lit("Point").alias("gtype"), F.lit(1).alias("n_points"), F.lit(False).alias("self_crossing"), "outside", *[F.col(c[4:]).alias(c) for c in q.BOX])
    far = m.groupBy(F.col("way_id").alias("w")).agg(F.bool_or("outside").alias("outside"), *[(F.min if c.startswith("min") else F.max)(c[4:]).alias(c) for c in q.BOX])
    l = assemble_ways(t("geo_node").select("way_id", F.col("seq").alias("pos"), F.col("id").alias("ref")), t("geo_node")).join(far, F.col("way_id") == F.col("w"))
    l = with_crossing(l, ["way_id"])
    l = l.select((F.col("way_id") % 90).cast("int").alias("tag_id"), F.lit("LineString").alias("gtype"), F.when(F.col("way_id") % 61 == 0, 0).otherwise(F.size("line")).alias("n_points"), "self_crossing", "outside", *[F.when(F.col("way_id") % 61 != 0, F.col(c)).alias(c) for c in q.BOX])
    return n.unionByName(l).join(tags, "tag_id")


_VAL = _OBJ.format(cx=CX, cy=CY)
_LAYERS = ", ".join(f"('{k}', '{v}', '{'LineString' if v in ('line', 'minor_line', 'cable') else 'Point'}')" for k, v in _SUBS.items())


@query("layer_validation", f"""WITH {CROSSING}, {_VAL}, g AS (SELECT power, gtype, count(*) AS n, count(*) FILTER (WHERE n_points = 0) AS empty, count(*) FILTER (WHERE self_crossing) AS invalid, count(*) FILTER (WHERE outside) AS outside FROM o JOIN tag_wide w ON w.tag_id = o.tag_id GROUP BY 1, 2),
r AS (SELECT layer, coalesce(CAST(sum(n) AS BIGINT), 0) AS feature_count, string_agg(concat(gtype, ':', CAST(n AS VARCHAR)), ',' ORDER BY gtype) FILTER (WHERE n IS NOT NULL) AS types, coalesce(CAST(sum(empty) AS BIGINT), 0) AS empty, coalesce(CAST(sum(invalid) AS BIGINT), 0) AS invalid, coalesce(CAST(sum(outside) AS BIGINT), 0) AS outside, coalesce(string_agg(gtype, ',' ORDER BY gtype) FILTER (WHERE gtype <> want), '') AS unexpected
FROM (VALUES {_LAYERS}) AS e(layer, power, want) LEFT JOIN g ON g.power = e.power GROUP BY layer) SELECT *, CASE WHEN feature_count = 0 THEN 'warn' WHEN unexpected <> '' OR empty > 0 THEN 'fail' WHEN invalid > 0 OR outside > 0 THEN 'warn' ELSE 'pass' END AS status FROM r""", "geo_segment", "metric", "tag_wide")
def layer_validation(t):
    """Expected layers keep their row when they are empty."""
    kind = {v: k for k, v in _SUBS.items()}
    names = F.create_map(*[F.lit(x) for kv in kind.items() for x in kv])
    f = _checked(t).withColumn("layer", names[F.col("power")]).where("layer is not null")
    e = t.spark.createDataFrame([(k, ["LineString" if v in ("line", "minor_line", "cable") else "Point"]) for k, v in _SUBS.items()], "layer string, expected array<string>")
    return q.validate_layers(f, e).select("layer", "feature_count", "types", "empty", "invalid", "outside", "unexpected", "status")


# The layers that a validation of the power domain expects, the geometry types of each, and what goes into it.
_LINE_GROUPS = {"power_major_lines": ("line",), "power_minor_lines": ("minor_line",), "power_cables": ("cable",), "power_busbars": ("busbar", "bay")}
_NODE_GROUPS = {"power_substations": ("substation",), "power_transformers": ("transformer",), "power_plants": ("plant",), "power_generators": ("generator",), "power_supports": ("tower", "pole", "portal"),
                "power_switchgear": ("switch", "terminal", "converter", "compensator")}
_SHOWN = ("substation", "transformer", "plant", "switch", "terminal", "converter", "compensator")
_TYPES = {"line": ("LineString", "MultiLineString"), "node": ("MultiPoint", "MultiPolygon", "Point", "Polygon"), "point": ("MultiPoint", "Point")}


def _power_layers():
    """(layer, kind, power values)"""
    flat = lambda groups: tuple(v for vs in groups.values() for v in vs)
    yield from (("power_lines", "line", flat(_LINE_GROUPS)), ("power_nodes", "node", flat(_NODE_GROUPS)), ("power_node_points", "point", flat(_NODE_GROUPS)), ("power_node_points_display", "point", _SHOWN))
    yield from ((k, "line", v) for k, v in _LINE_GROUPS.items())
    yield from ((k, "node", v) for k, v in _NODE_GROUPS.items())
    yield from ((f"{k}_points", "point", v) for k, v in _NODE_GROUPS.items())
    yield from (("power_missing", "node", ("none",)), ("power_odd", "node", ("odd",)))  # one without files, one without features


_PL = ", ".join(f"('{n}', '{k}', '{p}')" for n, k, ps in _power_layers() for p in ps)
_WANT = " ".join(f"WHEN '{k}' THEN {list(v)!r}" for k, v in _TYPES.items())
_POB = f"""ob AS (SELECT n.tag_id, 'Point' AS gtype, false AS gone, false AS crossed, sqrt(power(m.x - {CX!r}, 2) + power(m.y - {CY!r}, 2)) > 35000e0 AS far, n.lon AS min_lon, n.lat AS min_lat, n.lon AS max_lon, n.lat AS max_lat FROM geo_node n JOIN metric m ON m.id = n.id UNION ALL
SELECT CAST(way_id % 90 AS INT), 'LineString', way_id % 61 = 0, way_id IN (SELECT way_id FROM x), bool_or(sqrt(power(x - {CX!r}, 2) + power(y - {CY!r}, 2)) > 35000e0), CASE WHEN way_id % 61 <> 0 THEN min(lon) END, CASE WHEN way_id % 61 <> 0 THEN min(lat) END,
 CASE WHEN way_id % 61 <> 0 THEN max(lon) END, CASE WHEN way_id % 61 <> 0 THEN max(lat) END FROM metric GROUP BY way_id HAVING count(*) >= 2)"""


@query("power_validation", f"""WITH {CROSSING}, {_POB}, e AS (SELECT * FROM (VALUES {_PL}) AS v(layer, kind, power)),
f AS (SELECT e.layer, ob.* FROM ob JOIN tag_wide w ON w.tag_id = ob.tag_id JOIN e ON e.power = w.power AND (e.kind <> 'point' OR ob.gtype = 'Point') WHERE e.layer <> 'power_odd'),
h AS (SELECT layer, gtype, count(*) AS n FROM f GROUP BY 1, 2), t AS (SELECT layer, string_agg(concat(gtype, ':', CAST(n AS VARCHAR)), ',' ORDER BY gtype) AS types FROM h GROUP BY 1),
u AS (SELECT h.layer, string_agg(gtype, ',' ORDER BY gtype) AS unexpected FROM h JOIN (SELECT DISTINCT layer, kind FROM e) k ON k.layer = h.layer WHERE NOT list_contains(CASE k.kind {_WANT} END, gtype) GROUP BY 1),
g AS (SELECT layer, count(*) AS n, count(*) FILTER (WHERE gone) AS empty, count(*) FILTER (WHERE crossed) AS invalid, count(*) FILTER (WHERE far) AS outside, min(min_lon) AS a, min(min_lat) AS b, max(max_lon) AS c, max(max_lat) AS d FROM f GROUP BY 1),
r AS (SELECT l.layer, l.layer <> 'power_missing' AS landed, coalesce(n, 0) AS feature_count, coalesce(types, '') AS types, coalesce(unexpected, '') AS unexpected, coalesce(empty, 0) AS empty, coalesce(invalid, 0) AS invalid, coalesce(outside, 0) AS outside,
 round(a, 7) AS min_lon, round(b, 7) AS min_lat, round(c, 7) AS max_lon, round(d, 7) AS max_lat FROM (SELECT DISTINCT layer FROM e) l LEFT JOIN g ON g.layer = l.layer LEFT JOIN t ON t.layer = l.layer LEFT JOIN u ON u.layer = l.layer),
k AS (SELECT *, concat_ws(',', CASE WHEN NOT landed THEN 'file_missing' END, CASE WHEN unexpected <> '' THEN 'unexpected_geometry_types' END, CASE WHEN empty > 0 THEN 'empty_geometries' END) AS errors,
 concat_ws(',', CASE WHEN landed AND feature_count = 0 THEN 'empty_layer' END, CASE WHEN invalid > 0 THEN 'invalid_geometries' END, CASE WHEN outside > 0 THEN 'features_outside_aoi' END) AS warnings FROM r)
SELECT *, CASE WHEN errors <> '' THEN 'fail' WHEN warnings <> '' THEN 'warn' ELSE 'pass' END AS status FROM k""", "geo_segment", "geo_node", "metric", "tag_wide")
def power_validation(t):
    """All layers of the power domain: the three that must be there, those of its ten groups and their points, one that has not landed and one that has landed empty."""
    layers = list(_power_layers())
    held = t.spark.createDataFrame([(p, n, k) for n, k, ps in layers for p in ps if n != "power_odd"], "held string, layer string, kind string")
    f = _checked(t)
    f = f.join(F.broadcast(held), (F.col("power") == F.col("held")) & ((F.col("kind") != "point") | (F.col("gtype") == "Point")))  # the fixed values above
    expected = t.spark.createDataFrame([(n, list(_TYPES[k])) for n, k, _ in layers], "layer string, expected array<string>")
    r = q.validation_report(f, expected, expected.where("layer <> 'power_missing'"))
    return r.withColumns({c: F.round(c, 7) for c in q.BOX})


@query("power_group_counts", "SELECT count(*) FILTER (WHERE power IN ('line','minor_line','cable','busbar','bay')) AS lines, count(*) FILTER (WHERE power IN ('substation','transformer','plant','generator','tower','pole','portal','switch','terminal','converter','compensator')) AS nodes, bool_or(power IN ('line','minor_line','cable','busbar','bay')) AS has_power_lines, bool_or(power IN ('minor_line','cable','transformer','tower','pole','portal')) AS has_distribution_candidates FROM geo_node n JOIN tag_wide w ON n.tag_id = w.tag_id", "geo_node", "tag_wide")
def power_group_counts(t):
    """Group counts of the power domain and what they say of its quality."""
    from gridloom.operators.layers import POWER_GROUPS

    p = features(t).select(F.col("tags")["power"].alias("p"))
    of = lambda *names: F.coalesce(F.col("p").isin(*[x for k in names for x in POWER_GROUPS[k] if x != "utility_pole"]), F.lit(False))
    lines = of("power_major_lines", "power_minor_lines", "power_cables", "power_busbars")
    nodes = of("power_substations", "power_transformers", "power_plants", "power_generators", "power_supports", "power_switchgear")
    return p.agg(F.count_if(lines).alias("lines"), F.count_if(nodes).alias("nodes"), F.bool_or(lines).alias("has_power_lines"), F.bool_or(of("power_minor_lines", "power_cables", "power_transformers", "power_supports")).alias("has_distribution_candidates"))


@query("domain_validation", f"SELECT aoi_id, CASE max(CASE quality WHEN 'failed' THEN 2 WHEN 'passed' THEN 0 ELSE 1 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS status, bool_or(feature_count > 0) AS has_features, count(*) AS n_layers FROM {_L} GROUP BY aoi_id", "layer_summary")
def domain_validation(t):
    worst = F.max(F.when(F.col("quality") == "failed", 2).when(F.col("quality") == "passed", 0).otherwise(1))
    g = layers(t).groupBy("aoi_id").agg(worst.alias("w"), F.bool_or(F.col("feature_count") > 0).alias("has_features"), F.count("*").alias("n_layers"))
    return g.select("aoi_id", F.element_at(F.lit(["pass", "warn", "fail"]), F.col("w") + 1).alias("status"), "has_features", "n_layers")


_LINKED = "SELECT artifact_ord, aoi_id, CAST(feature_count AS BIGINT) AS said FROM artifact WHERE feature_count IS NOT NULL"


@query("count_reconciliation", f"SELECT a.artifact_ord, coalesce(n, 0) AS counted, said, coalesce(n, 0) = said AS same FROM ({_LINKED}) a LEFT JOIN (SELECT way_id, count(*) AS n FROM geo_node GROUP BY way_id) g ON g.way_id = a.artifact_ord", "artifact", "geo_node")
def count_reconciliation(t):
    """What the metadata of an artifact says against the rows that are there; an artifact without rows has none."""
    a = t("artifact").where("feature_count is not null").select("artifact_ord", F.col("feature_count").alias("said"))
    n = t("geo_node").groupBy(F.col("way_id").alias("artifact_ord")).agg(F.count("*").alias("n"))
    counted = F.coalesce("n", F.lit(0))
    return a.join(n, "artifact_ord", "left").select("artifact_ord", counted.alias("counted"), "said", (counted == F.col("said")).alias("same"))


_FIT = "('openstreetmap','bdot10k','prg_wfs')"
_SIDE = lambda c, p: f"max(CASE WHEN source_id {'=' if p == 'l' else '<>'} 'openstreetmap' THEN {c} END) AS {p}_{c}"
#: Ids are unique on either side, so one grouping brings both sides together.
_CMP = f"""WITH g AS (SELECT id, {", ".join(_SIDE(c, p) for p in "lr" for c in ("source_id", "stable_id", "asset_type", "lon", "lat"))} FROM xs_feature GROUP BY id),
d AS (SELECT *, sqrt(power(l_lon - r_lon, 2) + power(l_lat - r_lat, 2)) AS d FROM g WHERE l_source_id IS NOT NULL)
SELECT id, CASE WHEN r_source_id IS NULL THEN 'source_only' WHEN l_source_id NOT IN {_FIT} OR r_source_id NOT IN {_FIT} THEN 'not_comparable' WHEN l_stable_id = r_stable_id THEN 'matched' WHEN l_asset_type IS NULL OR r_asset_type IS NULL THEN 'ambiguous'
WHEN l_asset_type <> r_asset_type THEN 'conflicting' WHEN d <= 0.0001e0 THEN 'matched' ELSE 'source_only' END AS outcome, round(d, 8) AS distance FROM d"""


def compared(t):
    from gridloom.operators.governance import eligibility

    fit = t("source_registry").select("source_id", (eligibility("comparison")["outcome"] == "allowed").alias("fit"))
    side = lambda p, d: d.join(fit, "source_id", "left").select(F.col("id").alias(f"{p}_id"), F.col("source_id").alias(f"{p}_source"), F.col("stable_id").alias(f"{p}_stable"), F.col("asset_type").alias(f"{p}_type"), F.col("lon").alias(f"{p}_lon"), F.col("lat").alias(f"{p}_lat"), F.coalesce("fit", F.lit(False)).alias(f"{p}_fit"))
    x = t("xs_feature")
    l, r = side("l", x.where("source_id = 'openstreetmap'")), side("r", x.where("source_id <> 'openstreetmap'"))
    return q.compare(l.join(r, F.col("l_id") == F.col("r_id"), "left"))


@query("cross_source_compare", _CMP, "xs_feature")
def cross_source_compare(t):
    return compared(t).select(F.col("l_id").alias("id"), "outcome", "distance")


@query("comparison_summary", f"SELECT o.outcome, count(x.id) AS n, CASE o.outcome WHEN 'ambiguous' THEN 'low' WHEN 'conflicting' THEN 'medium' WHEN 'source_only' THEN 'medium' END AS severity FROM (VALUES ('matched'),('source_only'),('conflicting'),('ambiguous'),('not_comparable')) AS o(outcome) LEFT JOIN ({_CMP}) x ON x.outcome = o.outcome GROUP BY o.outcome", "xs_feature")
def comparison_summary(t):
    n = compared(t).groupBy("outcome").agg(F.count("*").alias("n"))
    e = t.spark.createDataFrame([(o,) for o in q.OUTCOMES], "outcome string").join(n, "outcome", "left").fillna(0, ["n"])
    return e.withColumn("severity", F.when(F.col("outcome").isin("conflicting", "source_only"), "medium").when(F.col("outcome") == "ambiguous", "low"))


@query("cross_source_pairs", """WITH l AS (SELECT * FROM xs_feature WHERE source_id = 'openstreetmap'), r AS (SELECT * FROM xs_feature WHERE source_id <> 'openstreetmap'),
a AS (SELECT l.id, min(r.id) AS right_id FROM l JOIN r ON l.stable_id = r.stable_id GROUP BY l.id),
b AS (SELECT l.id, r.id AS right_id, round(sqrt(power(l.lon - r.lon, 2) + power(l.lat - r.lat, 2)), 8) AS d FROM l JOIN r ON CAST(floor(l.lon / 0.0001e0) AS BIGINT) BETWEEN CAST(floor(r.lon / 0.0001e0) AS BIGINT) - 1 AND CAST(floor(r.lon / 0.0001e0) AS BIGINT) + 1 AND CAST(floor(l.lat / 0.0001e0) AS BIGINT) BETWEEN CAST(floor(r.lat / 0.0001e0) AS BIGINT) - 1 AND CAST(floor(r.lat / 0.0001e0) AS BIGINT) + 1
 WHERE sqrt(power(l.lon - r.lon, 2) + power(l.lat - r.lat, 2)) <= 0.0001e0 AND l.id NOT IN (SELECT id FROM a))
SELECT id, right_id, 'stable_id' AS how FROM a UNION ALL SELECT id, right_id, 'place' FROM (SELECT id, min({'d': d, 'r': right_id}).r AS right_id FROM b GROUP BY id)""", "xs_feature")
def cross_source_pairs(t):
    x = t("xs_feature")
    return q.pairs(x.where("source_id = 'openstreetmap'"), x.where("source_id <> 'openstreetmap'"))


_META = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE 'aoi' END AS aoi_id, CASE WHEN o_orderkey % 5 = 0 THEN 'provider_geojson/v0' ELSE 'provider_geojson/v1' END AS contract_version, CASE WHEN o_orderkey % 4 = 0 THEN 'done' ELSE 'ready' END AS readiness, CASE WHEN o_orderkey % 3 = 0 THEN 'high' ELSE NULL END AS confidence, o_orderkey % 9 - 1 AS feature_count, CASE WHEN o_orderkey % 2 = 0 THEN '2026-01-02T03:04:05Z' ELSE '2026-01-02T03:04:05' END AS snapshot_at FROM orders)"


@query("contract_violations", f"""SELECT o_orderkey AS layer_key, unnest(list_filter([CASE WHEN trim(aoi_id) = '' THEN 'metadata.aoi_id' END, CASE WHEN contract_version <> 'provider_geojson/v1' THEN 'metadata.contract_version' END, CASE WHEN readiness = 'done' THEN 'metadata.readiness' END,
CASE WHEN confidence IS NULL THEN 'metadata.confidence' END, CASE WHEN feature_count < 0 THEN 'metadata.feature_count' END, CASE WHEN snapshot_at NOT LIKE '%Z' THEN 'metadata.snapshot_at' END], lambda x: x IS NOT NULL)) AS code FROM {_META}""")
def contract_violations(t):
    k = F.col("o_orderkey")
    m = t("orders").select(k.alias("layer_key"), F.when(k % 7 == 0, " ").otherwise("aoi").alias("aoi_id"), F.when(k % 5 == 0, "provider_geojson/v0").otherwise(q.CONTRACT).alias("contract_version"), F.when(k % 4 == 0, "done").otherwise("ready").alias("readiness"),
                           F.when(k % 3 == 0, "high").alias("confidence"), (k % 9 - 1).alias("feature_count"), F.when(k % 2 == 0, "2026-01-02T03:04:05Z").otherwise("2026-01-02T03:04:05").alias("snapshot_at"))
    return m.select("layer_key", F.explode(q.contract_violations(m)).alias("code"))


@query("identifier_checks", "SELECT artifact_id, regexp_matches(artifact_id, '^[a-z0-9_]+$') AS plain, replace(replace(artifact_id, '.', '_'), '-', '_') AS layer_name FROM artifact", "artifact")
def identifier_checks(t):
    return t("artifact").select("artifact_id", F.col("artifact_id").rlike("^[a-z0-9_]+$").alias("plain"), F.translate("artifact_id", ".-", "__").alias("layer_name"))


_BAD = {"properties.missing:source": "source IS NULL", "properties.source": "trim(source) = ''", "properties.missing:source_id": "source_id IS NULL", "properties.domain": "domain = ''", "properties.missing:asset_type": "asset_type IS NULL", "properties.missing:confidence": "confidence IS NULL",
        "properties.confidence": "coalesce(confidence, '') <> 'high'", "properties.missing_fields": "NOT missing_is_list", "properties.limitations": "NOT limits_is_list", "properties.eligible_for_analysis": "eligible_for_analysis IS NULL"}
_FRAME = "CASE WHEN type <> 'Feature' THEN 'type' WHEN geometry_type IS NULL OR trim(geometry_type) = '' OR coordinates IS NULL THEN 'geometry' WHEN NOT has_properties THEN 'properties' END"


@query("feature_violations", f"SELECT ord, {_FRAME} AS code FROM provider_feature WHERE {_FRAME} IS NOT NULL" + "".join(f" UNION ALL SELECT ord, '{k}' FROM provider_feature WHERE {_FRAME} IS NULL AND ({v})" for k, v in _BAD.items()), "provider_feature")
def feature_violations(t):
    return t("provider_feature").select("ord", F.explode(q.feature_violations()).alias("code"))
