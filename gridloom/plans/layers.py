"""Queries of layers, contract columns, manifests and sources."""

from pyspark.sql import functions as F

from gridloom.functions import classify as c
from gridloom.functions.tags import only, tag_maps, tag_text, voltage_label, voltage_style
from gridloom.operators import layers as ops
from gridloom.plans.classify import _BUCKET, _J, _STYLE, ALL_SQL, ASKS, CASES, LAYER_SQL, NODES, features
from gridloom.plans.views import query


def ways(t):
    """Ways of two nodes or more, with the tags of their set."""
    w = t("geo_node").groupBy("way_id").agg(F.count("*").alias("n")).where("n >= 2").select(F.col("way_id").alias("id"), (F.col("way_id") % 90).cast("int").alias("tag_id"))
    return w.join(tag_maps(t("tag_kv")), "tag_id")


def classified(t, things):
    """``things`` (tag_id) by the domains that take their tags. The rules are asked once for each set of tags, not for each thing that has it."""
    return things.join(c.classify_all(tag_maps(t("tag_kv"))), "tag_id")


def objects(t):
    """Nodes as points and ways as lines, in one table."""
    n = features(t).select("id", F.lit("node").alias("element"), F.lit("Point").alias("gtype"), "tags")
    return n.unionByName(ways(t).select("id", F.lit("way").alias("element"), F.lit("LineString").alias("gtype"), "tags"))


_WAY = "(SELECT way_id AS id, CAST(way_id % 90 AS INT) AS tag_id FROM geo_node GROUP BY way_id HAVING count(*) >= 2)"
_ALL = f"{ALL_SQL.replace('SELECT id, ', 'SELECT id, 1 AS p, ')} UNION ALL {ALL_SQL.replace('SELECT id, ', 'SELECT id, 0 AS p, ').replace('FROM geo_node n', f'FROM {_WAY} n')}"
_LAYER = LAYER_SQL


@query("layer_assignment", f"""WITH a AS (SELECT domain, {_LAYER} AS layer_id, count(*) AS n FROM ({_ALL}) WHERE category IS NOT NULL GROUP BY 1, 2)
SELECT * FROM a UNION ALL SELECT domain, layer_id, 0 FROM (VALUES ('telecom','telecom.towers'),('telecom','telecom.facilities'),('telecom','telecom.lines'),('district_heating','district_heating.plants'),('district_heating','district_heating.facilities'),('district_heating','district_heating.lines')) AS d(domain, layer_id)
WHERE domain IN (SELECT domain FROM a) AND layer_id NOT IN (SELECT layer_id FROM a)""", *NODES)
def layer_assignment(t):
    points = t("geo_node").select("tag_id", F.lit("Point").alias("gtype"))
    w = t("geo_node").groupBy("way_id").agg(F.count("*").alias("n")).where("n >= 2").select((F.col("way_id") % 90).cast("int").alias("tag_id"), F.lit("LineString").alias("gtype"))
    return ops.layer_counts(classified(t, points.unionByName(w)))


_SUB = " ".join(f"WHEN power IN ({', '.join(repr(x) for x in v)}) OR ('{k}' = 'power_supports' AND power IS NULL AND man_made = 'utility_pole') THEN '{k}'" for k, v in ops.POWER_GROUPS.items())


@query("power_sublayers", f"SELECT sublayer, count(*) AS n, count(*) FILTER (WHERE power IN ('substation','transformer','plant','switch','terminal','converter','compensator')) AS n_displayed FROM (SELECT power, CASE {_SUB} END AS sublayer {_J}) WHERE sublayer IS NOT NULL GROUP BY sublayer", *NODES)
def power_sublayers(t):
    f = features(t).withColumn("category", c.power_category(F.col("tags"))).withColumn("sublayer", ops.power_sublayer(F.col("category"))).where("sublayer is not null")
    return f.groupBy("sublayer").agg(F.count("*").alias("n"), F.count_if(F.col("category").isin(*ops.DISPLAYED)).alias("n_displayed"))


@query("geometry_type_filter", f"SELECT id FROM {_WAY}", *NODES)
def geometry_type_filter(t):
    return objects(t).where(F.col("gtype").isin(*ops.LINES)).select("id")


_ASSET = f"coalesce({CASES['emergency']}, {CASES['power']})"


def _normal(t):
    f = features(t).withColumn("element", F.when(F.col("id") % 3 > 0, "node"))
    return ops.normalize(f.withColumn("provider_category", c.category("emergency", F.col("tags"))).withColumn("power_category", c.power_category(F.col("tags"))))


@query("normalize_feature", f"SELECT id, concat(CASE WHEN id % 3 > 0 THEN 'node' ELSE 'feature' END, '/', CAST(id AS VARCHAR)) AS source_id, {_ASSET} AS asset_type {_J}", *NODES)
def normalize_feature(t):
    return _normal(t).select("id", "source_id", "asset_type")


@query("missing_fields", f"SELECT id, 'voltage' AS field {_J} WHERE power IN ('line','minor_line','cable') AND voltage IS NULL", *NODES)
def missing_fields(t):
    return _normal(t).select("id", F.explode("missing_fields").alias("field"))


@query("attribute_container", f"SELECT id, CASE WHEN id % 2 = 0 THEN power END AS source_power, CASE WHEN id % 2 = 1 THEN power END AS osm_power {_J}", *NODES)
def attribute_container(t):
    a = ops.attribute_containers(features(t), F.col("id") % 2 == 0)
    return a.select("id", F.col("source_attributes")["power"].alias("source_power"), F.col("osm_tags")["power"].alias("osm_power"))


@query("presentation_row", f"""SELECT concat('node/', CAST(id AS VARCHAR)) AS source_id, 'openstreetmap' AS source, 'power' AS domain, {CASES['power']} AS asset_type, {_STYLE} AS voltage_state, {_BUCKET} AS voltage_bucket,
CASE voltage WHEN '400000' THEN '400 kV' WHEN '220000' THEN '220 kV' WHEN '110000;220000' THEN '110/220 kV' WHEN '60000' THEN '60 kV' WHEN '15000' THEN '15 kV' WHEN '900' THEN '0.9 kV' WHEN '400' THEN '0.4 kV' ELSE coalesce(voltage, 'voltage unknown') END AS voltage_label,
CASE WHEN power IN ('line','minor_line','cable') AND voltage IS NULL THEN 'voltage' ELSE '' END AS missing_fields, 'partial; community data' AS limitations
FROM (SELECT n.id, w.*, list_max(list_transform(string_split(voltage, ';'), lambda x: TRY_CAST(x AS BIGINT))) AS v {_J})""", *NODES)
def presentation_row(t):
    f = features(t).withColumn("asset_type", c.power_category(F.col("tags"))).withColumn("v", voltage_style(F.col("tags")["voltage"]))
    limits = F.array(F.lit("partial"), F.lit("community data"))
    return f.select(F.concat(F.lit("node/"), F.col("id").cast("string")).alias("source_id"), F.lit("openstreetmap").alias("source"), F.lit("power").alias("domain"), "asset_type", F.col("v.state").alias("voltage_state"),
                    F.col("v.bucket").alias("voltage_bucket"), voltage_label(F.col("tags")["voltage"]).alias("voltage_label"),
                    F.array_join(ops.missing_fields(F.col("asset_type"), F.col("tags")), ", ").alias("missing_fields"), F.array_join(limits, "; ").alias("limitations"))


_LABEL = "CASE voltage WHEN '400000' THEN '400 kV' WHEN '220000' THEN '220 kV' WHEN '110000;220000' THEN '110/220 kV' WHEN '60000' THEN '60 kV' WHEN '15000' THEN '15 kV' WHEN '900' THEN '0.9 kV' WHEN '400' THEN '0.4 kV' ELSE coalesce(voltage, 'voltage unknown') END"
_WITH = ALL_SQL.replace("SELECT id, ", "SELECT id, w.tag_id, highway, power, voltage, ")


@query("presentation_rows", f"""SELECT concat('node/', CAST(id AS VARCHAR)) AS source_id, domain, CASE WHEN id % 4 <> 1 THEN 'openstreetmap' ELSE 'prg_wfs' END AS source, category AS asset_type,
CASE WHEN domain <> 'transport' OR category <> 'roads' THEN NULL WHEN highway IN ('motorway','trunk','primary') THEN 'major' ELSE 'secondary' END AS road_class, {_STYLE} AS voltage_state, {_BUCKET} AS voltage_bucket, {_LABEL} AS voltage_label,
CASE WHEN id % 3 = 0 THEN concat('n', CAST(id AS VARCHAR)) WHEN id % 3 = 1 THEN 'plain' END AS name, CASE WHEN id % 5 = 0 THEN 'R5' END AS ref, CASE WHEN id % 7 = 0 THEN 'owner' END AS operator, CASE WHEN id % 3 = 0 THEN 'high' ELSE 'medium' END AS confidence,
CASE WHEN domain = 'power' AND category IN ('line','minor_line','cable') AND voltage IS NULL THEN 'voltage' ELSE '' END AS missing_fields, CASE WHEN id % 2 = 0 THEN 'partial; community data' ELSE concat('layer of ', domain) END AS limitations
FROM (SELECT *, list_max(list_transform(string_split(voltage, ';'), lambda x: TRY_CAST(x AS BIGINT))) AS v FROM ({_WITH}) WHERE category IS NOT NULL)""", *NODES)
def presentation_rows(t):
    """Nodes of all domains with all fields of a presentation; some do not state what their layer does."""
    f = classified(t, t("geo_node")).withColumn("layer_id", ops.layer_id(F.col("domain"), F.col("category"), F.lit("Point")))
    meta = f.select("layer_id", "domain").distinct().select("layer_id", "domain", F.lit("prg_wfs").alias("source"), F.lit("medium").alias("confidence"), F.array(F.concat(F.lit("layer of "), "domain")).alias("limitations"))
    k = F.col("id")
    more = F.map_filter(F.map_from_arrays(F.lit(["name", "ref", "operator"]), F.array(F.when(k % 3 == 0, F.concat(F.lit("n"), k.cast("string"))), F.when(k % 5 == 0, "R5"), F.when(k % 7 == 0, "owner"))), lambda _, v: v.isNotNull())
    f = f.select("layer_id", F.concat(F.lit("node/"), k.cast("string")).alias("source_id"), F.col("domain").alias("own_domain"), F.when(k % 4 != 1, "openstreetmap").alias("source"), F.lit(None).cast("string").alias("domain"), F.col("category").alias("asset_type"),
                 F.when((F.col("domain") == "transport") & (F.col("category") == "roads"), c.road_class(F.col("tags"))).alias("road_class"), F.when(k % 3 == 0, "high").alias("confidence"), F.when(k % 3 == 1, "plain").alias("name"), F.lit(None).cast("string").alias("ref"),
                 F.lit(None).cast("string").alias("operator"), F.when(F.col("domain") == "power", ops.missing_fields(F.col("category"), F.col("tags"))).alias("missing_fields"), F.when(k % 2 == 0, F.array(F.lit("partial"), F.lit("community data"))).alias("limitations"), F.map_concat(F.map_filter("tags", lambda n, _: ~n.isin("name", "ref", "operator")), more).alias("tags"))
    return ops.presentation(f, meta, ["source_id"]).select(*ops.PRESENTATION)


@query("feature_min_zoom", f"SELECT id, CASE WHEN a IN ('tower','portal','utility_pole') THEN 12 WHEN a = 'pole' THEN 14 ELSE 7 END AS min_zoom FROM (SELECT id, {CASES['power']} AS a {_J})", *NODES)
def feature_min_zoom(t):
    return features(t).select("id", ops.min_zoom(c.power_category(F.col("tags"))).alias("min_zoom"))


_PUBLIC = "public_export AND format = 'geojson' AND kind IN ('processed_vector','derived_vector','representative_points') AND path IS NOT NULL AND sha256 IS NOT NULL AND feature_count IS NOT NULL"


@query("public_artifacts", f"SELECT artifact_id, replace(replace(artifact_id, '.', '_'), '-', '_') AS layer_name FROM artifact WHERE {_PUBLIC}", "artifact")
def public_artifacts(t):
    return ops.public_artifacts(t("artifact")).select("artifact_id", F.translate("artifact_id", ".-", "__").alias("layer_name"))


@query("preview_layers", "SELECT artifact_id FROM artifact WHERE kind <> 'representative_points' AND public_export", "artifact")
def preview_layers(t):
    return t("artifact").where("public_export and kind <> 'representative_points'").select("artifact_id")


@query("source_separated_layers", f"SELECT layer_id, public, count(*) AS n FROM (SELECT concat('emergency.', category, CASE WHEN id % 4 = 0 THEN '.prg_wfs' ELSE '.openstreetmap' END) AS layer_id, id % 4 <> 0 AS public FROM (SELECT id, {CASES['emergency']} AS category {_J}) WHERE category IS NOT NULL) GROUP BY 1, 2", *NODES)
def source_separated_layers(t):
    f = features(t).withColumn("category", c.category("emergency", F.col("tags"))).where("category is not null").withColumn("source_id", F.when(F.col("id") % 4 == 0, "prg_wfs").otherwise("openstreetmap"))
    r = t("source_registry").select("source_id", (F.col("public_export") == "allowed").alias("public"))
    return f.join(r, "source_id").groupBy(F.concat_ws(".", F.lit("emergency"), "category", "source_id").alias("layer_id"), "public").agg(F.count("*").alias("n"))


@query("combine_layers", f"SELECT id, 'roads' AS layer {_J} WHERE highway IN ('motorway','trunk','primary','secondary','tertiary') UNION ALL SELECT id, 'rail' {_J} WHERE railway = 'rail'", *NODES)
def combine_layers(t):
    f = features(t).withColumn("c", c.category("transport", F.col("tags")))
    return f.where("c = 'roads'").select("id", F.lit("roads").alias("layer")).unionByName(f.where("c = 'railways'").select("id", F.lit("rail").alias("layer")))


_TEXTS = f"""o AS (SELECT 'node' AS element, n.id, 1 AS p, w.* FROM geo_node n JOIN tag_wide w ON n.tag_id = w.tag_id UNION ALL SELECT 'way', v.id, 0, w.* FROM {_WAY} v JOIN tag_wide w ON v.tag_id = w.tag_id),
f AS ({' UNION ALL '.join(f"SELECT element, id, p, tag_id, '{d}' AS domain, {CASES[d]} AS category FROM o" + (f" WHERE {ASKS[d]}" if d == 'power' else '') for d in CASES)}),
tt AS (SELECT tag_id, string_agg(concat(k, '=', v), ',' ORDER BY concat(k, '=', v)) AS tag_text FROM tag_kv GROUP BY tag_id),
h AS (SELECT {LAYER_SQL} AS layer_id, sha256(concat_ws(chr(31), element, CAST(id AS VARCHAR), category, tag_text)) AS t FROM f JOIN tt ON f.tag_id = tt.tag_id WHERE category IS NOT NULL)"""
_HEX12 = lambda i: f"sum(CAST(concat('0x', substr(t, {1 + 12 * i}, 12)) AS BIGINT))"


@query("artifact_manifest", f"WITH {_TEXTS}, g AS (SELECT layer_id, count(*) AS n, {', '.join(f'{_HEX12(i)} AS s{i}' for i in range(3))} FROM h GROUP BY layer_id) SELECT layer_id, n AS feature_count, sha256(concat_ws(':', CAST(n AS VARCHAR), CAST(s0 AS VARCHAR), CAST(s1 AS VARCHAR), CAST(s2 AS VARCHAR))) AS digest, concat('gridloom:', layer_id) AS origin FROM g", "geo_node", "tag_wide", "tag_kv")
def artifact_manifest(t):
    """Each layer with its count, its digest and where it comes from."""
    f = c.classify_all(objects(t)).withColumn("layer_id", ops.layer_id(F.col("domain"), F.col("category"), F.col("gtype"))).withColumn("tag_text", tag_text(F.col("tags")))
    return ops.layer_digest(f, ["layer_id"], ["element", "id", "category", "tag_text"]).withColumn("origin", F.concat(F.lit("gridloom:"), F.col("layer_id")))


@query("artifact_digests", f"WITH {_TEXTS}, g AS (SELECT layer_id, count(*) AS n, {', '.join(f'{_HEX12(i)} AS s{i}' for i in range(3))} FROM h GROUP BY layer_id) SELECT layer_id, n AS feature_count, sha256(concat_ws(':', CAST(n AS VARCHAR), CAST(s0 AS VARCHAR), CAST(s1 AS VARCHAR), CAST(s2 AS VARCHAR))) AS digest FROM g", "geo_node", "tag_wide", "tag_kv")
def artifact_digests(t):
    """The digest column of the manifest."""
    f = c.classify_all(objects(t)).withColumn("layer_id", ops.layer_id(F.col("domain"), F.col("category"), F.col("gtype"))).withColumn("tag_text", tag_text(F.col("tags")))
    return ops.layer_digest(f, ["layer_id"], ["element", "id", "category", "tag_text"])


@query("source_evidence", f"WITH {_TEXTS.split('tt AS')[0]} x AS (SELECT {LAYER_SQL} AS layer_id, domain, element, id, concat(k, '=', v) AS tag FROM f JOIN tag_kv t ON f.tag_id = t.tag_id WHERE category IS NOT NULL) SELECT layer_id, domain, 'openstreetmap' AS source_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags, count(DISTINCT concat(element, '/', CAST(id AS VARCHAR))) AS n FROM x GROUP BY layer_id, domain", "geo_node", "tag_wide", "tag_kv")
def source_evidence(t):
    """The tags behind each layer of all domains, and how many objects show them. Tags are counted by tag set first, so a layer's tags are bounded by the dictionary."""
    f = c.classify_all(objects(t)).withColumn("layer_id", ops.layer_id(F.col("domain"), F.col("category"), F.col("gtype")))
    n = f.withColumn("tags_text", tag_text(F.col("tags"))).groupBy("layer_id", "domain", "tags_text").agg(F.count("*").alias("n"))
    g = n.groupBy("layer_id", "domain").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("tags_text", ","))))), ",").alias("tags"), F.sum("n").alias("n"))
    return g.select("layer_id", "domain", F.lit("openstreetmap").alias("source_id"), "tags", "n")


# The allow lists, stated here by themselves.
_CLASSES = """('OT_SKDR_L','transport','line','road',false),('OT_BUIN_L','bridge_context','line','engineering_structure',false),('OT_SWRS_L','water_context','line','river_or_stream',false),('OT_BUBD_A','building_context','polygon','building',false),
('OT_KUPG_A','industrial_context','polygon','industrial_economic_complex',false),('OT_KUPG_P','industrial_context','point','industrial_economic_complex',false),('OT_PTKM_A','military_context','polygon','military_complex',false),
('ms:A01_Granice_wojewodztw','administrative_boundary','polygon','wojewodztwo',true),('ms:A02_Granice_powiatow','administrative_boundary','polygon','powiat',true),('ms:A03_Granice_gmin','administrative_boundary','polygon','gmina',true),
('ms:K01_Komenda_wojewodzka_policji','official_public_service','point','police_command_voivodeship',false),('ms:K02_Komenda_powiatowa_policji','official_public_service','point','police_command_county',false),('ms:K03_Komenda_stoleczna_policji','official_public_service','point','police_command_capital',false),
('ms:K04_Komenda_rejonowa_policji','official_public_service','point','police_command_district',false),('ms:K05_Komisariat_policji','official_public_service','point','police_station',false),('ms:K06_Komenda_wojewodzka_strazy_pozarnej','official_public_service','point','fire_command_voivodeship',false),
('ms:K07_Komenda_powiatowa_strazy_pozarnej','official_public_service','point','fire_command_county',false)"""
_SEEN = ["OT_SKDR_L", "OT_BUIN_L", "OT_SWRS_L", "OT_BUBD_A", "OT_KUPG_A", "OT_KUPG_P", "OT_PTKM_A", "OT_XXXX_L", "ms:A01_Granice_wojewodztw", "ms:A02_Granice_powiatow", "ms:A03_Granice_gmin", "ms:K05_Komisariat_policji", "ms:K06_Komenda_wojewodzka_strazy_pozarnej", "ms:Z99_Inne"]


@query("class_allowlist", f"SELECT s.class, m.role, m.family, m.label, m.boundary, m.class IS NOT NULL AS mapped, count(*) AS n FROM (SELECT ([{', '.join(repr(x) for x in _SEEN)}])[CAST(o_orderkey % 14 AS INT) + 1] AS class FROM orders) s LEFT JOIN (VALUES {_CLASSES}) AS m(class, role, family, label, boundary) ON s.class = m.class GROUP BY ALL")
def class_allowlist(t):
    """Classes of delivered rows with their role, geometry family and label; those that are not on a list show as unmapped."""
    seen = t("orders").select(F.element_at(F.lit(_SEEN), (F.col("o_orderkey") % 14 + 1).cast("int")).alias("class")).groupBy("class").agg(F.count("*").alias("n"))
    return seen.join(ops.named_classes(t.spark), "class", "left").select("class", "role", "family", "label", "boundary", F.col("role").isNotNull().alias("mapped"), "n")


@query("sanitize_attrs", f"SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE CAST(id AS VARCHAR) END AS a, concat('[\"', power, '\"]') AS b {_J} WHERE power IS NOT NULL", *NODES)
def sanitize_attrs(t):
    """Numbers that are not numbers become null, nested values become JSON text."""
    f = features(t).where(F.col("tags")["power"].isNotNull()).withColumn("x", F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("id").cast("double")))
    return f.select("id", F.when(~F.isnan("x"), F.col("x").cast("long").cast("string")).alias("a"), F.to_json(F.array(F.col("tags")["power"])).alias("b"))


_SEED = """(SELECT o_orderkey AS seed_id, CASE WHEN o_orderkey % 17 = 3 THEN '' ELSE o_orderstatus END AS name, CASE o_orderkey % 5 WHEN 0 THEN 'substation' WHEN 1 THEN 'line' WHEN 2 THEN 'plant' WHEN 3 THEN 'transformer' ELSE 'castle' END AS kind, CASE o_orderkey % 4 WHEN 3 THEN 'certain' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
CASE WHEN o_orderkey % 7 = 2 THEN 'unknown' ELSE 'needs_review' END AS review_status, CASE WHEN o_orderkey % 11 = 5 THEN 'Polygon' ELSE 'Point' END AS geometry_type, CASE WHEN o_orderkey % 13 = 1 THEN NULL ELSE 'note' END AS source_note, CASE WHEN o_orderkey % 19 = 4 THEN NULL ELSE 'owner' END AS operator, CASE WHEN o_totalprice < 5000 THEN 0e0 ELSE 110e0 END AS voltage_estimate,
CASE WHEN o_orderkey % 23 = 8 THEN NULL ELSE o_orderdate END AS created_at, CASE WHEN o_orderkey % 29 = 9 THEN NULL ELSE 18.5e0 END AS lon, CASE WHEN o_orderkey % 29 = 9 THEN NULL ELSE 50.1e0 END AS lat, CASE WHEN o_orderkey % 31 = 7 THEN '' ELSE 'power' END AS domain, o_orderkey % 6 <> 0 AS not_authoritative FROM orders)"""
_SEED_CODES = {"name": "name = ''", "kind": "kind = 'castle'", "confidence": "confidence = 'certain'", "review_status": "review_status = 'unknown'", "geometry_type": "geometry_type = 'Polygon'", "source_note": "source_note IS NULL", "operator": "operator IS NULL",
               "voltage_estimate": "voltage_estimate <= 0", "created_at": "created_at IS NULL", "lon": "lon IS NULL", "lat": "lat IS NULL", "domain": "domain = ''", "not_authoritative": "NOT not_authoritative"}


@query("seed_validation", " UNION ALL ".join(f"SELECT seed_id, '{k}' AS code FROM {_SEED} WHERE {v}" for k, v in _SEED_CODES.items()) + " UNION ALL SELECT o_orderkey, 'duplicate' FROM orders GROUP BY o_orderkey HAVING count(*) > 1")
def seed_validation(t):
    """Records of hand-made seeds, derived from orders, some of which break a rule."""
    k = F.col("o_orderkey")
    pick = lambda n, *v: F.element_at(F.lit(list(v)), (k % n + 1).cast("int"))
    unless = lambda n, r, v: F.when(k % n != r, v)
    seeds = t("orders").select(
        k.alias("seed_id"), F.when(k % 17 == 3, "").otherwise(F.col("o_orderstatus")).alias("name"), pick(5, "substation", "line", "plant", "transformer", "castle").alias("kind"), pick(4, "low", "medium", "high", "certain").alias("confidence"),
        F.when(k % 7 == 2, "unknown").otherwise("needs_review").alias("review_status"), F.when(k % 11 == 5, "Polygon").otherwise("Point").alias("geometry_type"), unless(13, 1, F.lit("note")).alias("source_note"), unless(19, 4, F.lit("owner")).alias("operator"),
        F.when(F.col("o_totalprice") < 5000, 0.0).otherwise(110.0).alias("voltage_estimate"), unless(23, 8, F.col("o_orderdate")).alias("created_at"), unless(29, 9, F.lit(18.5)).alias("lon"), unless(29, 9, F.lit(50.1)).alias("lat"), F.when(k % 31 == 7, "").otherwise("power").alias("domain"), (k % 6 != 0).alias("not_authoritative"))
    return ops.seed_problems(seeds)


@query("profile_outcomes", f"""SELECT r.o_custkey AS aoi_id, r.domain, CASE WHEN max(CASE WHEN d.status = 'ready' THEN 1 ELSE 0 END) = 1 THEN 'ready' ELSE 'needs_source' END AS status
FROM (SELECT DISTINCT c_custkey AS o_custkey, domain FROM customer, (VALUES {', '.join(f"('{d}')" for d in c.DOMAINS)}) AS p(domain)) r LEFT JOIN domain_outcome d ON d.snapshot_id = r.o_custkey AND d.domain = r.domain GROUP BY 1, 2""", "domain_outcome")
def profile_outcomes(t):
    """Areas meet their ready domains, eleven at most, as one row each; the profile's domains are laid out behind that, so no task holds areas times domains."""
    wanted = t("customer").select(F.col("c_custkey").alias("aoi_id")).distinct()
    ready = t("domain_outcome").where("status = 'ready'").groupBy(F.col("snapshot_id").alias("aoi_id")).agg(F.collect_set("domain").alias("ready"))
    d = wanted.join(ready, "aoi_id", "left").select("aoi_id", "ready", F.explode(F.lit(list(c.DOMAINS))).alias("domain"))
    return d.select("aoi_id", "domain", F.when(F.array_contains("ready", F.col("domain")), "ready").otherwise("needs_source").alias("status"))


@query("set_difference", "SELECT o_custkey AS snapshot_id, string_agg(d, ',' ORDER BY d) AS missing FROM (SELECT DISTINCT o_custkey FROM orders) s, (VALUES ('power'),('water'),('gas')) AS e(d) WHERE NOT EXISTS (SELECT 1 FROM domain_outcome x WHERE x.snapshot_id = s.o_custkey AND x.domain = e.d) GROUP BY 1", "domain_outcome")
def set_difference(t):
    have = t("domain_outcome").groupBy("snapshot_id").agg(F.collect_set("domain").alias("have"))
    return have.select("snapshot_id", F.array_join(F.array_sort(F.array_except(F.lit(["power", "water", "gas"]), "have")), ",").alias("missing")).where("missing <> ''")


@query("distinct_selection", "SELECT snapshot_id, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains FROM domain_outcome GROUP BY snapshot_id", "domain_outcome")
def distinct_selection(t):
    return t("domain_outcome").groupBy("snapshot_id").agg(F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"))


@query("power_columns", f"SELECT id, concat_ws(',', CASE WHEN power IS NOT NULL THEN 'power' END, CASE WHEN voltage IS NOT NULL THEN 'voltage' END) AS columns {_J}", *NODES)
def power_columns(t):
    return features(t).select("id", F.array_join(F.array_sort(F.map_keys(only(F.col("tags"), ["power", "voltage"]))), ",").alias("columns"))
