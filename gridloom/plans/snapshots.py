"""Queries of snapshots, exports, circuits, units and work lists."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.operators import quality as q
from gridloom.operators import snapshots as s
from gridloom.plans.classify import ALL_SQL, _J, NODES, features
from gridloom.functions import classify as c
from gridloom.plans.views import query


@query("snapshot_state", "SELECT snapshot_id, CASE WHEN bool_or(status IN ('failed','pending_qualification')) THEN 'partial' ELSE 'ready' END AS state, min(CASE WHEN status = 'ready' THEN source_observed_at END) AS source_observed_at, CASE WHEN count(DISTINCT endpoint) = 1 THEN min(endpoint) END AS endpoint, count(*) AS n_domains FROM domain_outcome GROUP BY snapshot_id", "domain_outcome")
def snapshot_state(t):
    return s.snapshot_state(t("domain_outcome"))


@query("acquisition_evidence", "SELECT snapshot_id, domain, CAST(greatest(queried_feature_count - accepted_feature_count, 0) AS BIGINT) AS rejected_feature_count, CASE status WHEN 'ready' THEN 'passed' WHEN 'failed' THEN 'failed' ELSE 'not_run' END AS validation FROM domain_outcome", "domain_outcome")
def acquisition_evidence(t):
    return s.acquisition_evidence(t("domain_outcome")).select("snapshot_id", "domain", "rejected_feature_count", "validation")


_DG = "sha256(concat_ws('|', CAST(snapshot_id AS VARCHAR), domain, CAST(CAST(accepted_feature_count AS BIGINT) + CASE WHEN snapshot_id % 10 = 0 THEN 1 ELSE 0 END AS VARCHAR)))"


def _digests(t):
    o = t("domain_outcome")
    key = F.concat_ws(":", F.col("snapshot_id").cast("string"), "domain")
    ready = o.where("status = 'ready'").select("snapshot_id", "domain", key.alias("key"), s.digest(F.col("snapshot_id").cast("string"), F.col("domain"), F.col("accepted_feature_count").cast("string")).alias("digest"))
    moved = F.col("accepted_feature_count") + F.when(F.col("snapshot_id") % 10 == 0, 1).otherwise(0)
    packs = o.where("snapshot_id % 7 <> 0").select(key.alias("key"), s.digest(F.col("snapshot_id").cast("string"), F.col("domain"), moved.cast("string")).alias("digest"))
    return ready, packs


@query("snapshot_integrity", "SELECT snapshot_id, domain, CASE WHEN snapshot_id % 7 = 0 THEN 'missing' WHEN snapshot_id % 10 = 0 THEN 'different' ELSE 'ok' END AS integrity FROM domain_outcome WHERE status = 'ready'", "domain_outcome")
def snapshot_integrity(t):
    ready, packs = _digests(t)
    return s.integrity(ready, packs).select("snapshot_id", "domain", "integrity")


_SIGN = "sha256(string_agg(concat_ws(':', domain, status, coalesce(digest, '')), ',' ORDER BY concat_ws(':', domain, status, coalesce(digest, ''))))"
_OUT = "SELECT snapshot_id, domain, status, CASE WHEN status = 'ready' THEN sha256(concat_ws('|', CAST(snapshot_id AS VARCHAR), domain, CAST(CAST(accepted_feature_count AS BIGINT) AS VARCHAR))) END AS digest FROM domain_outcome"


@query("refresh_digest", f"""WITH o AS ({_OUT}), n AS (SELECT o.*, CASE WHEN status = 'ready' AND domain = 'power' AND snapshot_id % 2 = 0 THEN sha256(concat('new|', CAST(snapshot_id AS VARCHAR))) END AS fresh FROM o),
own AS (SELECT snapshot_id, {_SIGN} AS own FROM o GROUP BY 1), aft AS (SELECT snapshot_id, {_SIGN} AS renewed, bool_or(hit) AS touched FROM (SELECT snapshot_id, domain, status, coalesce(fresh, digest) AS digest, fresh IS NOT NULL AS hit FROM n) GROUP BY 1),
j AS (SELECT own.snapshot_id, CASE WHEN own.snapshot_id % 9 = 4 THEN 'broken' ELSE own END AS checksum, own, renewed, touched FROM own JOIN aft ON aft.snapshot_id = own.snapshot_id)
SELECT snapshot_id, CASE WHEN checksum <> own THEN 'refused' WHEN touched THEN 'updated' ELSE 'unchanged' END AS result, CASE WHEN checksum = own AND touched THEN renewed ELSE checksum END AS checksum FROM j""", "domain_outcome")
def refresh_digest(t):
    """New digests of one domain, for every other snapshot; some snapshots carry a broken checksum."""
    o = t("domain_outcome")
    own = s.digest(F.col("snapshot_id").cast("string"), F.col("domain"), F.col("accepted_feature_count").cast("string"))
    o = o.select("snapshot_id", "domain", "status", F.when(F.col("status") == "ready", own).alias("digest"))
    news = o.where("domain = 'power' and snapshot_id % 2 = 0").select("snapshot_id", "domain", s.digest(F.lit("new"), F.col("snapshot_id").cast("string")).alias("new"))
    signed = s.signature(o).withColumn("checksum", F.when(F.col("snapshot_id") % 9 == 4, "broken").otherwise(F.col("checksum")))
    return s.refresh_digests(o, signed, news)


_PUB = "public_export AND format = 'geojson' AND kind IN ('processed_vector','derived_vector','representative_points') AND path IS NOT NULL AND sha256 IS NOT NULL AND feature_count IS NOT NULL"


@query("stale_presentations", f"""WITH m AS (SELECT aoi_id, sha256(string_agg(concat_ws(':', artifact_id, coalesce(sha256, '')), ',' ORDER BY concat_ws(':', artifact_id, coalesce(sha256, '')))) AS digest, coalesce(string_agg(artifact_id, ',' ORDER BY artifact_id) FILTER (WHERE {_PUB}), '') AS public, coalesce(string_agg(artifact_id, ',' ORDER BY artifact_id) FILTER (WHERE {_PUB} AND NOT (aoi_id % 5 = 2 AND artifact_ord % 2 = 0)), '') AS layers FROM artifact GROUP BY aoi_id)
SELECT aoi_id, CASE WHEN aoi_id % 13 = 1 THEN 'missing' WHEN aoi_id % 11 = 3 THEN 'unsupported_version' WHEN aoi_id % 7 = 5 THEN 'stale' WHEN layers = '' THEN 'no_layers' WHEN layers <> public THEN 'layers_differ' ELSE 'current' END AS state FROM m""", "artifact")
def stale_presentations(t):
    """Presentations against the manifests that they were made of: version, digest of the manifest, and the set of public layers. An area has as many artifacts as layers."""
    from gridloom.operators.layers import public_artifacts

    a, k = t("artifact"), F.col("aoi_id")
    public = public_artifacts(a).select("artifact_ord", F.lit(True).alias("shown"))
    a = a.join(public, "artifact_ord", "left")
    kept = F.col("shown") & ~((k % 5 == 2) & (F.col("artifact_ord") % 2 == 0))
    ids = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("artifact_id"))))
    m = a.groupBy("aoi_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "artifact_id", F.coalesce("sha256", F.lit(""))))), ","), 256).alias("digest"), ids(F.col("shown")).alias("public"), ids(kept).alias("layers"))
    m = m.withColumn("version", F.when(k % 13 == 1, F.lit(None).cast("string")).when(k % 11 == 3, "map_presentation/v0").otherwise(s.PRESENTATION_VERSION)).withColumn("parent_digest", F.when(k % 7 == 5, "old").otherwise(F.col("digest")))
    return m.select("aoi_id", s.presentation_problem().alias("state"))


_ASKED = "(SELECT c_custkey, domain, pos FROM customer, (VALUES ('power', 0),('water', 1),('gas', 2)) AS d(domain, pos))"


@query("multi_domain_export", f"""SELECT r.c_custkey AS request_id, r.domain, CASE WHEN o.status = 'ready' AND r.c_custkey % 7 <> 0 THEN 'ready' WHEN o.status = 'ready' THEN 'pack_missing' ELSE coalesce(o.status, 'not_prepared') END AS status,
CASE WHEN o.status = 'ready' AND r.c_custkey % 7 <> 0 THEN coalesce(n, 0) ELSE 0 END AS n_layers, CASE WHEN o.status = 'ready' AND r.c_custkey % 7 <> 0 THEN coalesce(k, 0) ELSE 0 END AS n_issues
FROM {_ASKED} r LEFT JOIN domain_outcome o ON o.snapshot_id = r.c_custkey AND o.domain = r.domain
LEFT JOIN (SELECT aoi_id, artifact_ord % 3 AS pos, count(*) AS n FROM artifact WHERE {_PUB} GROUP BY 1, 2) a ON a.aoi_id = r.c_custkey AND a.pos = r.pos
LEFT JOIN (SELECT l.aoi_id, a.artifact_ord % 3 AS pos, count(*) AS k FROM layer_summary l JOIN artifact a ON l.layer_id = concat('layer.', CAST(a.artifact_ord AS VARCHAR)) WHERE l.issue_severity IS NOT NULL AND {_PUB.replace('feature_count', 'a.feature_count')} GROUP BY 1, 2) i ON i.aoi_id = r.c_custkey AND i.pos = r.pos""", "domain_outcome", "artifact", "layer_summary")
def multi_domain_export(t):
    """Requested domains in the order they were first named, once each, with the public layers that they bring and the issues of these layers only."""
    from gridloom.operators.layers import public_artifacts

    asked = F.array_distinct(F.lit(["power", "water", "power", "gas"]))
    r = t("customer").select(F.col("c_custkey").alias("request_id"), F.posexplode(asked).alias("pos", "domain"))
    o = t("domain_outcome").select(F.col("snapshot_id").alias("request_id"), "domain", F.col("status").alias("st"))
    public = public_artifacts(t("artifact")).select(F.col("aoi_id").alias("request_id"), "artifact_ord", (F.col("artifact_ord") % 3).cast("int").alias("pos"))
    layers = public.groupBy("request_id", "pos").agg(F.count("*").alias("n"))
    issues = t("layer_summary").where("issue_severity is not null").select("layer_id").join(public.withColumn("layer_id", F.concat(F.lit("layer."), F.col("artifact_ord").cast("string"))), "layer_id").groupBy("request_id", "pos").agg(F.count("*").alias("k"))
    pack = F.when(F.col("request_id") % 7 != 0, "ready").otherwise("pack_missing")
    d = r.join(o, ["request_id", "domain"], "left").join(layers, ["request_id", "pos"], "left").join(issues, ["request_id", "pos"], "left")
    d = d.withColumn("status", F.when(F.col("st") == "ready", pack).otherwise(F.coalesce("st", F.lit("not_prepared"))))
    own = lambda c: F.when(F.col("status") == "ready", F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    return d.select("request_id", "domain", "status", own("n").alias("n_layers"), own("k").alias("n_issues"))


@query("promote_snapshot", "SELECT p.*, observed_at FROM (SELECT aoi_id, bool_and(readiness IN ('ready','usable_with_limitations')) AS promoted, CAST(sum(feature_count) AS BIGINT) AS accepted FROM (SELECT aoi_id, feature_count, CASE WHEN source_type = 'reference_overlay' THEN 'needs_source' WHEN issue_severity = 'high' OR feature_count = 0 OR q = 'failed' THEN 'not_usable' WHEN q = 'unknown' THEN 'needs_source' ELSE 'ready' END AS readiness FROM (SELECT *, CASE validation_status_raw WHEN ' OK ' THEN 'passed' WHEN 'pass' THEN 'passed' WHEN 'FAIL' THEN 'failed' ELSE 'unknown' END AS q FROM layer_summary)) GROUP BY aoi_id) p LEFT JOIN (SELECT snapshot_id, min(source_observed_at) AS observed_at FROM domain_outcome WHERE status = 'ready' GROUP BY 1) d ON d.snapshot_id = p.aoi_id", "layer_summary", "domain_outcome")
def promote_snapshot(t):
    l = t("layer_summary").withColumn("quality", q.quality_status(F.col("validation_status_raw")))
    r = q.readiness(F.col("quality"), F.col("feature_count"), F.col("source_type"), F.col("issue_severity"), F.col("comparison_outcome"))
    p = l.groupBy("aoi_id").agg(F.bool_and(r.isin("ready", "usable_with_limitations")).alias("promoted"), F.sum("feature_count").alias("accepted"))
    d = t("domain_outcome").where("status = 'ready'").groupBy(F.col("snapshot_id").alias("aoi_id")).agg(F.min("source_observed_at").alias("observed_at"))
    return p.join(d, "aoi_id", "left").select("aoi_id", "promoted", "accepted", "observed_at")


_W = "w AS (SELECT way_id, min_by(id, seq) AS first_node, max_by(id, seq) AS last_node FROM geo_node GROUP BY way_id HAVING count(*) >= 2)"


def delivered(t):
    ends = t("geo_node").groupBy("way_id").agg(F.count("*").alias("n"), F.min_by("id", "seq").alias("first_node"), F.max_by("id", "seq").alias("last_node")).where("n >= 2").drop("n")
    return s.delivered_members(t("circuit_member"), ends)


@query("circuit_members", f"WITH {_W} SELECT relation_id, c.way_id, CASE role WHEN '' THEN 'member' ELSE role END AS role, first_node, last_node FROM circuit_member c JOIN w ON w.way_id = c.way_id", "circuit_member", "geo_node")
def circuit_members(t):
    return delivered(t).select("relation_id", "way_id", "role", "first_node", "last_node")


@query("reverse_member_index", f"WITH {_W} SELECT c.way_id, string_agg(DISTINCT CAST(relation_id AS VARCHAR), ',' ORDER BY CAST(relation_id AS VARCHAR)) AS relations FROM circuit_member c JOIN w ON w.way_id = c.way_id GROUP BY c.way_id", "circuit_member", "geo_node")
def reverse_member_index(t):
    r = s.reverse_index(delivered(t).withColumn("relation_id", F.col("relation_id").cast("string")))
    return r.select("way_id", F.array_join("relations", ",").alias("relations"))


@query("circuits_for_feature", f"WITH {_W} SELECT f.l_orderkey AS way_id, CASE WHEN w.way_id IS NULL THEN 'unavailable' WHEN count(c.relation_id) = 0 THEN 'not_applicable' ELSE 'available' END AS state, count(c.relation_id) AS n_circuits FROM (SELECT DISTINCT l_orderkey FROM lineitem) f LEFT JOIN w ON w.way_id = f.l_orderkey LEFT JOIN circuit_member c ON c.way_id = w.way_id GROUP BY f.l_orderkey, w.way_id", "circuit_member", "geo_node")
def circuits_for_feature(t):
    f = t("geo_node").groupBy("way_id").agg(F.count("*").alias("n"))
    m = t("circuit_member").groupBy("way_id").agg(F.count("*").alias("k"))
    d = f.join(m, "way_id", "left").withColumn("n_circuits", F.when(F.col("n") >= 2, F.coalesce("k", F.lit(0))).otherwise(0))
    return d.select("way_id", F.when(F.col("n") < 2, "unavailable").when(F.col("n_circuits") == 0, "not_applicable").otherwise("available").alias("state"), F.col("n_circuits").cast("long").alias("n_circuits"))


@query("merge_evidence", "SELECT relation_id, way_id, 'new' AS origin FROM circuit_member WHERE relation_id % 4 = 0 UNION ALL SELECT relation_id, way_id, 'old' FROM circuit_member WHERE relation_id % 4 <> 0 AND way_id % 2 = 0", "circuit_member")
def merge_evidence(t):
    """New evidence of a relation replaces all that was known of it."""
    old, new = t("circuit_member").where("way_id % 2 = 0"), t("circuit_member").where("relation_id % 4 = 0")
    kept = old.join(new.select("relation_id").distinct(), "relation_id", "left_anti")
    return new.select("relation_id", "way_id", F.lit("new").alias("origin")).unionByName(kept.select("relation_id", "way_id", F.lit("old").alias("origin")))


@query("feature_detail", f"SELECT l_partkey AS feature_id, min(artifact_ord) AS artifact, min_by(artifact_id, artifact_ord) AS layer, count(DISTINCT artifact_ord) AS n_layers FROM lineitem JOIN artifact ON artifact_ord = l_orderkey WHERE {_PUB} GROUP BY l_partkey", "artifact")
def feature_detail(t):
    """The first public layer, in the order of the manifest, that holds the feature, and how many do."""
    from gridloom.operators.layers import public_artifacts

    a = public_artifacts(t("artifact")).select("artifact_ord", "artifact_id")
    l = t("lineitem").select(F.col("l_partkey").alias("feature_id"), F.col("l_orderkey").alias("artifact_ord")).join(a, "artifact_ord")
    return l.groupBy("feature_id").agg(F.min("artifact_ord").alias("artifact"), F.min_by("artifact_id", "artifact_ord").alias("layer"), F.count_distinct("artifact_ord").alias("n_layers"))


@query("merge_attributes", f"SELECT id, CASE WHEN id % 6 = 0 THEN 'survey' ELSE power END AS power, CASE WHEN id % 6 = 0 THEN 'yes' END AS checked, voltage {_J}", *NODES)
def merge_attributes(t):
    f = features(t).select("id", "tags")
    e = t("geo_node").where("id % 6 = 0").select("id", F.create_map(F.lit("power"), F.lit("survey"), F.lit("checked"), F.lit("yes")).alias("tags"))
    m = s.merge_attributes(f, e)
    return m.select("id", F.col("tags")["power"].alias("power"), F.col("tags")["checked"].alias("checked"), F.col("tags")["voltage"].alias("voltage"))


# ---- administrative units


@query("admin_catalog_build", """WITH v AS (SELECT id, kind, parent_id FROM admin_unit WHERE kind = 'voivodeship'), c AS (SELECT id, kind, parent_id FROM admin_unit WHERE kind = 'county'), g AS (SELECT id, kind, parent_id FROM admin_unit WHERE kind = 'gmina' AND CAST(split_part(id, '_', 2) AS BIGINT) % 50 <> 7),
u AS (SELECT * FROM v UNION ALL SELECT * FROM c UNION ALL SELECT * FROM g), n AS (SELECT kind, count(*) AS said FROM admin_unit GROUP BY kind)
SELECT u.id, u.kind, u.parent_id, CASE WHEN (SELECT count(*) FROM u x WHERE x.kind = u.kind) = said THEN 'complete' ELSE 'count_differs' END AS layer_state, u.parent_id IS NULL OR EXISTS (SELECT 1 FROM u p WHERE p.id = u.parent_id) AS has_parent FROM u JOIN n ON n.kind = u.kind""", "admin_unit")
def admin_catalog_build(t):
    """Three layers of units, as pages bring them, in one catalogue. A layer whose rows do not come to what its service says is marked, and so are units without their parent; some pages of the last layer lack a row."""
    u = t("admin_unit").select("id", "kind", "parent_id")
    said = u.groupBy("kind").agg(F.count("*").alias("said"))
    layers = [u.where(F.col("kind") == k) for k in ("voivodeship", "county")]
    layers.append(u.where("kind = 'gmina'").where(F.split("id", "_")[1].cast("long") % 50 != 7))
    all_ = layers[0].unionByName(layers[1]).unionByName(layers[2])
    have = all_.groupBy("kind").agg(F.count("*").alias("have"))
    state = have.join(said, "kind").select("kind", F.when(F.col("have") == F.col("said"), "complete").otherwise("count_differs").alias("layer_state"))
    parents = all_.select(F.col("id").alias("p"))
    d = all_.join(state, "kind").join(parents, F.col("parent_id") == F.col("p"), "left")
    return d.select("id", "kind", "parent_id", "layer_state", (F.col("parent_id").isNull() | F.col("p").isNotNull()).alias("has_parent"))


@query("admin_catalog_index", "SELECT id, kind, coalesce(parent_id, '') AS parent_id FROM admin_unit ORDER BY id", "admin_unit")
def admin_catalog_index(t):
    return t("admin_unit").select("id", "kind", F.coalesce("parent_id", F.lit("")).alias("parent_id"))


@query("unknown_units", "SELECT c_custkey AS request_id, concat('gmina_', CAST(c_custkey AS VARCHAR)) AS unit FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)")
def unknown_units(t):
    r = t("customer").select(F.col("c_custkey").alias("request_id"), F.concat(F.lit("gmina_"), F.col("c_custkey").cast("string")).alias("unit"))
    return r.join(t("admin_unit").select(F.col("id").alias("unit")), "unit", "left_anti").select("request_id", "unit")


@query("missing_domains", "SELECT snapshot_id FROM domain_outcome GROUP BY snapshot_id HAVING count(*) FILTER (WHERE domain = 'power') = 0", "domain_outcome")
def missing_domains(t):
    o = t("domain_outcome")
    return o.select("snapshot_id").distinct().join(o.where("domain = 'power'").select("snapshot_id"), "snapshot_id", "left_anti")


@query("admin_roots", "WITH RECURSIVE up AS (SELECT id, id AS root, parent_id FROM admin_unit UNION ALL SELECT up.id, p.id, p.parent_id FROM up JOIN admin_unit p ON p.id = up.parent_id) SELECT id, root FROM up WHERE parent_id IS NULL", "admin_unit")
def admin_roots(t):
    return s.top_units(t("admin_unit"))


_SELN = "(SELECT c_custkey AS request_id, unnest(list_distinct([c_nationkey, (c_nationkey + CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 2 END) % 25])) AS n FROM customer)"


@query("selection_contiguity", f"WITH s AS (SELECT DISTINCT request_id, concat('county_', CAST(n AS VARCHAR)) AS unit FROM {_SELN}), p AS (SELECT a.request_id, count(*) AS k FROM s a JOIN s b ON a.request_id = b.request_id AND a.unit < b.unit JOIN admin_unit x ON x.id = a.unit JOIN admin_unit y ON y.id = b.unit WHERE greatest(x.min_lon - y.max_lon, y.min_lon - x.max_lon, 0e0) < 0.001 AND greatest(x.min_lat - y.max_lat, y.min_lat - x.max_lat, 0e0) < 0.001 GROUP BY 1) SELECT s.request_id, count(*) + CASE WHEN s.request_id % 17 = 4 THEN 1 ELSE 0 END + CASE WHEN s.request_id % 19 = 6 THEN 2 ELSE 0 END AS n_units, CASE WHEN s.request_id % 17 = 4 THEN 'whole_unit' WHEN count(*) + CASE WHEN s.request_id % 19 = 6 THEN 2 ELSE 0 END > 3 THEN 'too_many' WHEN s.request_id % 19 = 6 OR count(*) > 1 AND max(coalesce(k, 0)) = 0 THEN 'not_contiguous' ELSE 'ready' END AS code FROM s LEFT JOIN p ON p.request_id = s.request_id GROUP BY s.request_id", "admin_unit")
def selection_contiguity(t):
    step = F.when(F.col("c_custkey") % 3 == 0, 1).when(F.col("c_custkey") % 3 == 1, 5).otherwise(2)
    sel = t("customer").select(F.col("c_custkey").alias("request_id"), F.explode(F.array_distinct(F.array(F.col("c_nationkey").cast("int"), ((F.col("c_nationkey") + step) % 25).cast("int")))).alias("n"))
    sel = sel.select("request_id", F.concat(F.lit("county_"), F.col("n").cast("string")).alias("unit"))
    k = t("customer").select(F.col("c_custkey").alias("request_id"))
    sel = sel.unionByName(k.where("request_id % 17 = 4").select("request_id", F.lit("voivodeship_1").alias("unit"))).unionByName(k.where("request_id % 19 = 6").select("request_id", F.explode(F.lit(["far_1", "far_2"])).alias("unit")))
    counties = t("admin_unit").where("kind = 'county'").select("id", "min_lon", "min_lat", "max_lon", "max_lat")
    whole = t("admin_unit").where("kind = 'voivodeship'").select(F.col("id").alias("unit"))
    return s.contiguous(sel, s.touching(counties), whole=whole).select("request_id", "n_units", "code")


@query("dissolve_edges", "SELECT voivodeship, n_border_edges, area FROM (SELECT voivodeship, count(*) AS n_border_edges FROM (SELECT voivodeship, k FROM (SELECT parent_id AS voivodeship, unnest([concat('h', printf('%.4f', min_lon), printf('%.4f', min_lat)), concat('h', printf('%.4f', min_lon), printf('%.4f', max_lat)), concat('v', printf('%.4f', min_lon), printf('%.4f', min_lat)), concat('v', printf('%.4f', max_lon), printf('%.4f', min_lat))]) AS k FROM admin_unit WHERE kind = 'county') GROUP BY 1, 2 HAVING count(*) = 1) GROUP BY 1) JOIN (SELECT parent_id AS voivodeship, round(sum((max_lon - min_lon) * (max_lat - min_lat)), 6) AS area FROM admin_unit WHERE kind = 'county' GROUP BY 1) USING (voivodeship)", "admin_unit")
def dissolve_edges(t):
    """Edges that two units share cancel out; the others are the border of the union, and their signed strips its area."""
    f = lambda x: F.format_string("%.4f", x)
    high = F.col("max_lat") - F.col("min_lat")
    edge = lambda k, x, y, strip: F.struct(F.concat(F.lit(k), f(F.col(x)), f(F.col(y))).alias("k"), strip.alias("strip"))
    none = F.lit(0.0)
    edges = F.array(edge("h", "min_lon", "min_lat", none), edge("h", "min_lon", "max_lat", none), edge("v", "min_lon", "min_lat", -F.col("min_lon") * high), edge("v", "max_lon", "min_lat", F.col("max_lon") * high))
    e = t("admin_unit").where("kind = 'county'").select(F.col("parent_id").alias("voivodeship"), F.explode(edges).alias("e")).groupBy("voivodeship", "e.k").agg(F.count("*").alias("n"), F.sum("e.strip").alias("strip")).where("n = 1")
    return e.groupBy("voivodeship").agg(F.count("*").alias("n_border_edges"), F.round(F.sum("strip"), 6).alias("area"))


@query("aoi_availability", """SELECT b.id AS aoi_id, CASE e.r WHEN 0 THEN 'ready' WHEN 1 THEN 'running' WHEN 2 THEN 'queued' WHEN 3 THEN 'failed' WHEN 4 THEN 'partial_coverage' ELSE CASE WHEN EXISTS (SELECT 1 FROM snapshot_box s WHERE b.min_lon <= s.max_lon AND b.max_lon >= s.min_lon AND b.min_lat <= s.max_lat AND b.max_lat >= s.min_lat) THEN 'partial_coverage' ELSE 'not_prepared' END END AS state
FROM (SELECT id, min_lon + CASE WHEN id % 6 = 5 THEN 3e0 ELSE 0e0 END AS min_lon, min_lat, max_lon + CASE WHEN id % 6 = 5 THEN 3e0 ELSE 0e0 END AS max_lon, max_lat FROM site_box) b LEFT JOIN (SELECT aoi_id, min(CASE state WHEN 'ready' THEN 0 WHEN 'running' THEN 1 WHEN 'queued' THEN 2 WHEN 'failed' THEN 3 ELSE 4 END) AS r FROM snapshot_box GROUP BY 1) e ON e.aoi_id = b.id""", "snapshot_box")
def aoi_availability(t):
    """Requests for the sites' areas; some lie far from all snapshots."""
    far = F.when(F.col("id") % 6 == 5, 3.0).otherwise(0.0)
    r = t("site_box").select(F.col("id").alias("aoi_id"), (F.col("min_lon") + far).alias("min_lon"), "min_lat", (F.col("max_lon") + far).alias("max_lon"), "max_lat")
    return s.availability(r, t("snapshot_box"))


# ---- jobs and work lists


@query("job_latest", "SELECT user_id AS job_id, max_by(event_type, (ts, event_id)) AS status, count(*) AS n_events, max(ts) AS last_ts FROM events GROUP BY user_id")
def job_latest(t):
    e = t("events")
    return e.groupBy(F.col("user_id").alias("job_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("n_events"), F.max("ts").alias("last_ts"))


@query("job_progress", "SELECT event_id, user_id AS job_id, count(*) FILTER (WHERE event_type = 'purchase') OVER w AS n_done, count(*) FILTER (WHERE event_type = 'error') OVER w AS n_failed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def job_progress(t):
    e = t("events").withColumnRenamed("user_id", "job_id")
    d = s.running(e, "job_id", ["ts", "event_id"], ("n_done", (F.col("event_type") == "purchase").cast("long")), ("n_failed", (F.col("event_type") == "error").cast("long")))
    return d.select("event_id", "job_id", "n_done", "n_failed")


@query("partial_snapshots", "SELECT snapshot_id, domain, row_number() OVER w AS version, string_agg(domain, ',') OVER w AS domains FROM domain_outcome WHERE status = 'ready' WINDOW w AS (PARTITION BY snapshot_id ORDER BY source_observed_at, domain ROWS UNBOUNDED PRECEDING)", "domain_outcome")
def partial_snapshots(t):
    """Each domain that is done makes a version that holds all before it; a snapshot has eleven domains at most."""
    w = W.partitionBy("snapshot_id").orderBy("source_observed_at", "domain").rowsBetween(W.unboundedPreceding, 0)
    o = t("domain_outcome").where("status = 'ready'")
    return o.select("snapshot_id", "domain", F.row_number().over(w).cast("long").alias("version"), F.array_join(F.collect_list("domain").over(w), ",").alias("domains"))


_ASKED = ", ".join(f"('{d}', {i})" for i, d in enumerate(c.DOMAINS))


@query("publication_state", f"""WITH o AS (SELECT snapshot_id, domain, source_observed_at AS seen, CASE WHEN status IN ('ready', 'failed') THEN status END AS status FROM domain_outcome),
g AS (SELECT snapshot_id, count(*) FILTER (WHERE status = 'ready') AS version, coalesce(string_agg(domain, ',' ORDER BY seen, domain) FILTER (WHERE status = 'ready'), '') AS ready, coalesce(string_agg(domain, ',' ORDER BY seen, domain) FILTER (WHERE status = 'failed'), '') AS failed FROM o GROUP BY 1),
p AS (SELECT i.snapshot_id, string_agg(d.name, ',' ORDER BY d.n) AS pending FROM (SELECT DISTINCT snapshot_id FROM o) i, (VALUES {_ASKED}) AS d(name, n) WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.snapshot_id = i.snapshot_id AND o.domain = d.name AND o.status IS NOT NULL) GROUP BY 1)
SELECT g.snapshot_id, version, ready, failed, coalesce(pending, '') AS pending, CASE WHEN version = {len(c.DOMAINS)} THEN 'ready' WHEN version > 0 THEN 'partial' WHEN pending IS NULL THEN 'failed' ELSE 'pending' END AS state FROM g LEFT JOIN p ON p.snapshot_id = g.snapshot_id""", "domain_outcome")
def publication_state(t):
    """What of each snapshot is published, failed and pending."""
    from gridloom.operators.publication import publication_state as state

    d = state(t("domain_outcome").withColumnRenamed("source_observed_at", "at"), F.lit(list(c.DOMAINS)))
    return d.withColumns({k: F.array_join(k, ",") for k in ("ready", "failed", "pending")})


@query("work_remaining", "SELECT snapshot_id, domain FROM domain_outcome WHERE status <> 'ready' OR source_observed_at < DATE '1995-01-01'", "domain_outcome")
def work_remaining(t):
    o = t("domain_outcome")
    done = o.where((F.col("status") == "ready") & (F.col("source_observed_at") >= F.lit("1995-01-01").cast("date"))).select("snapshot_id", "domain")
    return o.join(done, ["snapshot_id", "domain"], "left_anti").select("snapshot_id", "domain")


@query("coalesced_requests", "SELECT event_id, prev IS NOT NULL AND ts <= prev + INTERVAL 24 HOUR AS served FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prev FROM events)")
def coalesced_requests(t):
    d = s.previous_time(t("events").select("event_id", "ts", "user_id", "event_type"), ["user_id", "event_type"], "ts", "event_id")
    return d.select("event_id", F.coalesce(F.col("ts") <= F.col("previous") + F.expr("INTERVAL 24 HOURS"), F.lit(False)).alias("served"))


@query("latest_report", "SELECT o_custkey AS bundle_id, o_orderkey AS report FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderstatus = 'F') WHERE n = 1")
def latest_report(t):
    o = t("orders").where("o_orderstatus = 'F'")
    return q.latest(o.select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], "o_orderdate", "o_orderkey").select(F.col("o_custkey").alias("bundle_id"), F.col("o_orderkey").alias("report"))


@query("reusable_job", "SELECT user_id AS request_key, event_id AS job_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'purchase' AND value > 10 AND ts >= TIMESTAMP '2024-01-05 00:00:00') WHERE n = 1")
def reusable_job(t):
    e = t("events").where("event_type = 'purchase' and value > 10").where(F.col("ts") >= F.lit("2024-01-05 00:00:00").cast("timestamp"))
    return q.latest(e.select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id").select(F.col("user_id").alias("request_key"), F.col("event_id").alias("job_id"))


@query("delivered_inventory", f"SELECT domain, count(*) AS n_features, count(DISTINCT category) AS n_layers FROM ({ALL_SQL}) WHERE category IS NOT NULL GROUP BY domain", *NODES)
def delivered_inventory(t):
    a = c.classify_all(features(t))
    return a.groupBy("domain", "category").agg(F.count("*").alias("n")).groupBy("domain").agg(F.sum("n").alias("n_features"), F.count("*").alias("n_layers"))
