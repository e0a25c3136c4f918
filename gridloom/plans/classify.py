"""Queries of candidates and classification: one row per object and domain."""

from pyspark.sql import functions as F

from gridloom.functions import classify as c
from gridloom.functions.tags import only, tag_maps, tag_text, voltage_label, voltage_style
from gridloom.plans.views import query


def features(t):
    """Nodes with their tag maps. How they meet is left to the planner, which knows the size of the tag dictionary."""
    return t("geo_node").join(tag_maps(t("tag_kv")), "tag_id")


NODES = ("geo_node", "tag_wide")
_J = "FROM geo_node n JOIN tag_wide w ON n.tag_id = w.tag_id"
# The categories as SQL over one column per tag key, with all keys of the rules.
_SERVICE = "coalesce(communication_mobile_phone = 'yes' OR communication_radio = 'yes', false)"
_HOT = "(coalesce(plant_source, '') = 'heat' OR coalesce(generator_source, '') = 'heat' OR coalesce(lower(plant_output_heat), '') IN ('yes','true','1','heat') OR coalesce(lower(generator_output_heat), '') IN ('yes','true','1','heat'))"
_NO_SEWER = " OR ".join(f"coalesce({k}, '') IN ('water','gas','stormwater','drain','drainage')" for k in ("pipeline", "pumping", "substance", "utility", "sewer"))
CASES = {
    "power": "CASE WHEN power IN ('line','minor_line','cable','substation','transformer','plant','generator','tower','pole','portal','utility_pole','switch','terminal','converter','compensator','busbar','bay','other') THEN power WHEN man_made = 'utility_pole' THEN 'utility_pole' ELSE 'other' END",
    "emergency": "CASE WHEN amenity = 'hospital' OR healthcare = 'hospital' THEN 'hospital' WHEN amenity = 'fire_station' THEN 'fire_service' WHEN amenity = 'police' THEN 'police' WHEN amenity = 'ambulance_station' OR emergency IN ('ambulance_station','mountain_rescue','lifeguard_base') THEN 'ambulance_rescue' END",
    "public": "CASE WHEN amenity = 'townhall' OR office = 'government' THEN 'administration' WHEN amenity IN ('school','college','university','kindergarten') THEN 'education' WHEN amenity = 'post_office' THEN 'post' WHEN amenity IN ('community_centre','social_facility','library','arts_centre') THEN 'community_social' END",
    "transport": "CASE WHEN highway IN ('motorway','trunk','primary','secondary','tertiary') THEN 'roads' WHEN railway = 'rail' THEN 'railways' WHEN railway IN ('station','halt') THEN 'stations' WHEN aeroway IN ('aerodrome','helipad') THEN 'aviation' END",
    "bridges": "CASE WHEN bridge IN ('yes','aqueduct','boardwalk') THEN 'bridges' WHEN bridge = 'viaduct' OR highway = 'viaduct' THEN 'viaducts' END",
    "water": "CASE WHEN man_made IN ('water_works','water_tower') OR amenity = 'water_point' THEN 'facilities' WHEN pipeline = 'water' THEN 'pipelines' WHEN waterway IN ('river','stream','canal','drain','ditch') THEN 'waterways' WHEN man_made = 'pumping_station' AND (substance = 'water' OR pumping = 'water') THEN 'facilities' WHEN man_made = 'pipeline' AND substance = 'water' THEN 'pipelines' END",
    "gas": "CASE WHEN man_made IN ('gasometer','gas_station') OR (pipeline = 'valve' AND substance = 'gas') THEN 'facilities' WHEN pipeline = 'gas' OR (man_made = 'pipeline' AND substance = 'gas') THEN 'pipelines' END",
    "sewer": f"CASE WHEN {_NO_SEWER} THEN NULL WHEN man_made IN ('wastewater_plant','septic_tank') OR (man_made = 'pumping_station' AND (pumping IN ('sewer','wastewater') OR substance IN ('sewerage','wastewater'))) OR (man_made = 'manhole' AND utility = 'sewer') THEN 'facilities' WHEN pipeline = 'sewer' AND (substance IS NULL OR substance IN ('sewerage','wastewater')) OR man_made = 'pipeline' AND substance IN ('sewerage','wastewater') THEN 'pipelines' END",
    "industrial": "CASE WHEN military IN ('danger_area','base') OR landuse = 'military' THEN 'military_context' WHEN landuse = 'industrial' THEN 'land_use' WHEN man_made = 'works' THEN 'works' WHEN industrial IN ('factory','works') THEN 'facilities' WHEN building = 'industrial' THEN 'building_context' END",
    "telecom": f"CASE WHEN communication = 'line' OR cable = 'communication' THEN 'lines' WHEN man_made = 'communications_tower' OR (man_made IN ('mast','tower') AND (tower_type = 'communication' OR {_SERVICE})) THEN 'towers' WHEN telecom IN ('antenna','exchange','distribution_point','service_point','street_cabinet','data_center','cable_landing_station') OR (man_made = 'antenna' AND {_SERVICE}) THEN 'facilities' END",
    "district_heating": f"CASE WHEN industrial = 'heating_station' OR (power IN ('plant','generator') AND {_HOT}) THEN 'plants' WHEN man_made = 'heat_exchanger' THEN 'facilities' WHEN pipeline = 'heating' OR (man_made = 'pipeline' AND substance IN ('hot_water','steam','heat')) THEN 'lines' END",
}
ASKS = {
    "power": "power IN ('line','minor_line','cable','substation','transformer','plant','generator','tower','pole','portal','switch','terminal','converter','compensator','busbar','bay') OR man_made = 'utility_pole'",
    "emergency": "amenity IN ('hospital','fire_station','police','ambulance_station') OR healthcare = 'hospital' OR emergency IN ('ambulance_station','mountain_rescue','lifeguard_base')",
    "public": "amenity IN ('townhall','school','college','university','kindergarten','post_office','community_centre','social_facility','library','arts_centre') OR office = 'government'",
    "transport": "highway IN ('motorway','trunk','primary','secondary') OR railway IN ('rail','station','halt') OR aeroway IN ('aerodrome','helipad')", "bridges": "bridge IN ('yes','viaduct','aqueduct','boardwalk') OR highway = 'viaduct'",
    "water": "waterway IN ('river','stream','canal','drain','ditch') OR pipeline = 'water' OR man_made IN ('water_works','water_tower') OR amenity = 'water_point' OR pumping = 'water' OR substance = 'water'",
    "gas": "pipeline IN ('gas','valve') OR man_made IN ('gasometer','gas_station') OR substance = 'gas'", "sewer": "pipeline = 'sewer' OR man_made IN ('wastewater_plant','septic_tank') OR pumping IN ('sewer','wastewater') OR substance IN ('sewerage','wastewater') OR utility = 'sewer'",
    "industrial": "landuse IN ('industrial','military') OR man_made = 'works' OR industrial IN ('factory','works') OR building = 'industrial' OR military IN ('danger_area','base')",
    "telecom": "man_made IN ('communications_tower','mast','tower','antenna') OR tower_type = 'communication' OR communication_mobile_phone = 'yes' OR communication_radio = 'yes' OR communication = 'line' OR cable = 'communication' OR telecom IN ('antenna','exchange','distribution_point','service_point','street_cabinet','data_center','cable_landing_station')",
    "district_heating": "industrial = 'heating_station' OR man_made IN ('heat_exchanger','pipeline') OR power IN ('plant','generator') OR plant_source = 'heat' OR generator_source = 'heat' OR plant_output_heat IN ('yes','true','1','heat') OR generator_output_heat IN ('yes','true','1','heat') OR pipeline = 'heating' OR substance IN ('hot_water','steam','heat')",
}


def _one(name, domain):
    @query(name, f"SELECT * FROM (SELECT id, {CASES[domain]} AS category {_J}) WHERE category IS NOT NULL", *NODES)
    def run(t):
        return features(t).select("id", c.category(domain, F.col("tags")).alias("category")).where("category is not null")


for _name, _domain in (("emergency", "emergency"), ("public", "public"), ("transport", "transport"), ("bridges", "bridges"), ("water", "water"), ("gas", "gas"), ("sewer", "sewer"), ("industrial", "industrial"), ("telecom", "telecom"), ("heating", "district_heating")):
    _one(f"classify_{_name}", _domain)

# The labels, stated here by themselves.
_LABELS = """WHEN 'line' THEN 'Transmission or major distribution line' WHEN 'minor_line' THEN 'Minor distribution line' WHEN 'cable' THEN 'Power cable' WHEN 'substation' THEN 'Substation' WHEN 'transformer' THEN 'Transformer' WHEN 'plant' THEN 'Power plant'
WHEN 'generator' THEN 'Generator' WHEN 'tower' THEN 'Power tower' WHEN 'pole' THEN 'Power pole' WHEN 'portal' THEN 'Power portal' WHEN 'utility_pole' THEN 'Utility pole' WHEN 'switch' THEN 'Switch' WHEN 'terminal' THEN 'Terminal' WHEN 'converter' THEN 'Converter'
WHEN 'compensator' THEN 'Compensator' WHEN 'busbar' THEN 'Busbar' WHEN 'bay' THEN 'Bay' ELSE 'Other power feature'"""


@query("classify_power", f"SELECT id, category, CASE category {_LABELS} END AS label FROM (SELECT id, {CASES['power']} AS category {_J})", *NODES)
def classify_power(t):
    return features(t).select("id", c.power_category(F.col("tags")).alias("category")).withColumn("label", c.power_label(F.col("category")))


@query("road_class", f"SELECT id, CASE WHEN highway IN ('motorway','trunk','primary') THEN 'major' ELSE 'secondary' END AS road_class {_J} WHERE highway IN ('motorway','trunk','primary','secondary','tertiary')", *NODES)
def road_class(t):
    f = features(t).where(c.category("transport", F.col("tags")) == "roads")
    return f.select("id", c.road_class(F.col("tags")).alias("road_class"))


#: The layer of a domain, a category and ``p`` (1: point).
LAYER_SQL = "CASE WHEN domain = 'power' THEN CASE WHEN p = 0 THEN 'power.lines' ELSE 'power.assets' END WHEN domain = 'emergency' THEN 'emergency.facilities' ELSE concat(domain, '.', category) END"
ALL_SQL = " UNION ALL ".join(f"SELECT id, '{d}' AS domain, {CASES[d]} AS category {_J}" + (f" WHERE {ASKS[d]}" if d == "power" else "") for d in CASES)


@query("classify_all", f"SELECT * FROM ({ALL_SQL}) WHERE category IS NOT NULL", *NODES)
def classify_all(t):
    return c.classify_all(features(t)).select("id", "domain", "category")


@query("profile_candidates", " UNION ALL ".join(f"SELECT id, '{d}' AS domain {_J} WHERE {ASKS[d]}" for d in ASKS), *NODES)
def profile_candidates(t):
    """Tag sets meet the profile table on (key, value); objects follow by their set, so no object is exploded."""
    p = c.profile_rows(t.spark)
    wanted = t("tag_kv").join(p, (t("tag_kv").k == p.k) & ((t("tag_kv").v == p.v) | (p.v == "*"))).select("tag_id", "domain").distinct()
    return t("geo_node").join(wanted, "tag_id").select("id", "domain")


_REJECT = " UNION ALL ".join(f"SELECT id, '{d}' AS domain {_J} WHERE ({ASKS[d]}) AND ({CASES[d]}) IS NULL" for d in c.STRICT)


@query("classification_rejects", _REJECT, *NODES)
def classification_rejects(t):
    tags = F.col("tags")
    miss = F.array_compact(F.array(*[F.when(c.asks(d, tags) & c.category(d, tags).isNull(), d) for d in c.STRICT]))
    return features(t).select("id", F.explode(miss).alias("domain"))


_EXPECTED = "SELECT * FROM (VALUES " + ", ".join(f"('{d}','{k}')" for d, k in c.EXPECTED) + ") AS e(domain, category)"


@query("missing_required_categories", f"SELECT e.domain, e.category FROM ({_EXPECTED}) e WHERE NOT EXISTS (SELECT 1 FROM ({ALL_SQL}) a WHERE a.domain = e.domain AND a.category = e.category)", *NODES)
def missing_required_categories(t):
    expected = t.spark.createDataFrame(c.EXPECTED, "domain string, category string")
    seen = c.classify_all(features(t)).select("domain", "category").distinct()
    return expected.join(seen, ["domain", "category"], "left_anti")


_KEPT = "('power','voltage','name','substance','man_made','amenity')"


@query("tag_allowlist", f"SELECT n.id, string_agg(concat(k, '=', v), ',' ORDER BY k) AS tags FROM geo_node n JOIN tag_kv t ON n.tag_id = t.tag_id WHERE k IN {_KEPT} GROUP BY n.id", "geo_node", "tag_kv")
def tag_allowlist(t):
    return features(t).select("id", tag_text(only(F.col("tags"), ["power", "voltage", "name", "substance", "man_made", "amenity"])).alias("tags")).where("tags <> ''")


_STYLE = """CASE WHEN voltage IS NULL THEN 'missing' WHEN voltage = 'unknown' THEN 'unparseable' WHEN voltage LIKE '%;%' THEN 'multiple_voltage' WHEN v < 1000 THEN 'low_voltage' WHEN v < 35000 THEN 'medium_voltage' WHEN v < 150000 THEN 'high_voltage' WHEN v < 300000 THEN 'extra_high_voltage' ELSE 'ultra_high_voltage' END"""
_BUCKET = "CASE WHEN v IS NULL THEN 'unknown' WHEN v < 1000 THEN 'low' WHEN v < 35000 THEN 'medium' WHEN v < 150000 THEN 'high_110' WHEN v < 300000 THEN 'high_220' ELSE 'high_400' END"
_VOLT = f"(SELECT id, voltage, list_max(list_transform(string_split(voltage, ';'), lambda x: TRY_CAST(x AS BIGINT))) AS v {_J})"


@query("voltage_style", f"SELECT id, {_STYLE} AS state, {_BUCKET} AS bucket FROM {_VOLT}", *NODES)
def voltage_styles(t):
    return features(t).select("id", voltage_style(F.col("tags")["voltage"]).alias("s")).select("id", "s.state", "s.bucket")


@query("voltage_label", f"SELECT id, CASE voltage WHEN '400000' THEN '400 kV' WHEN '220000' THEN '220 kV' WHEN '110000;220000' THEN '110/220 kV' WHEN '60000' THEN '60 kV' WHEN '15000' THEN '15 kV' WHEN '900' THEN '0.9 kV' WHEN '400' THEN '0.4 kV' ELSE coalesce(voltage, 'voltage unknown') END AS label FROM {_VOLT}", *NODES)
def voltage_labels(t):
    return features(t).select("id", voltage_label(F.col("tags")["voltage"]).alias("label"))


@query("feature_attributes", "SELECT n.id, k AS name, v AS value FROM geo_node n JOIN tag_kv t ON n.tag_id = t.tag_id UNION ALL SELECT id, 'dup_count', CAST(dup_count AS VARCHAR) FROM geo_node UNION ALL SELECT id, 'operator', 'null' FROM geo_node", "geo_node", "tag_kv")
def feature_attributes(t):
    """Every property of an object as a row; nulls show as text."""
    f = features(t).withColumn("operator", F.lit(None).cast("string"))
    own = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(F.col(n).cast("string"), F.lit("null")).alias("value")) for n in ("dup_count", "operator")])
    tags = F.transform(F.map_entries("tags"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    return f.select("id", F.explode(F.concat(tags, own)).alias("p")).select("id", "p.name", "p.value")
