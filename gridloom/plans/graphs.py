"""Queries of hierarchies, nested relations and the validity of rings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.tags import tag_maps
from gridloom.operators import hierarchy, validity
from gridloom.operators import ways as ops
from gridloom.plans.areas import _store
from gridloom.plans.geometry import lines
from gridloom.plans.views import VIEWS, query

# units as deep as the logarithm of their number, some below a cycle of two, some below a parent that is not there; unit 5 is a root of another kind
VIEWS["unit_link"] = """SELECT c_custkey AS id, CASE WHEN c_custkey < 5 THEN 'top' ELSE 'unit' END AS kind, CASE WHEN c_custkey <= 5 THEN CAST(NULL AS BIGINT) WHEN c_custkey % 97 = 0 THEN c_custkey + 1 WHEN c_custkey % 97 = 1 THEN c_custkey - 1
 WHEN c_custkey % 89 = 3 THEN c_custkey + 100000000 ELSE CAST(floor(CAST(c_custkey AS DOUBLE) / 2e0) AS BIGINT) END AS parent_id FROM {customer}"""
# circuits of customers: ways, nodes, and circuits of other customers, some of which hold each other
VIEWS["relation_member"] = """SELECT o_custkey AS relation_id, 'way' AS type, o_orderkey AS ref FROM {orders} WHERE o_orderkey % 7 < 2
 UNION ALL SELECT o_custkey, 'node', o_orderkey * 10 + 1 FROM {orders} WHERE o_orderkey % 7 = 2
 UNION ALL SELECT c_custkey, 'relation', CAST(floor(CAST(c_custkey AS DOUBLE) / 3e0) AS BIGINT) FROM {customer} WHERE c_custkey % 3 = 0 AND c_custkey % 50 <> 7
 UNION ALL SELECT c_custkey, 'relation', c_custkey + 1 FROM {customer} WHERE c_custkey % 50 = 7 UNION ALL SELECT c_custkey, 'relation', c_custkey - 1 FROM {customer} WHERE c_custkey % 50 = 8"""

_CLIMB = """RECURSIVE up AS (SELECT id, id AS node, parent_id, CAST(0 AS BIGINT) AS depth FROM unit_link UNION ALL SELECT up.id, p.id, p.parent_id, depth + 1 FROM up JOIN unit_link p ON p.id = up.parent_id WHERE depth < 70),
fin AS (SELECT id, node, depth, parent_id FROM up u WHERE parent_id IS NULL OR NOT EXISTS (SELECT 1 FROM unit_link p WHERE p.id = u.parent_id)),
res AS (SELECT l.id, CASE WHEN f.parent_id IS NULL THEN f.node END AS root, CASE WHEN f.id IS NOT NULL AND f.parent_id IS NULL THEN f.depth END AS depth, CASE WHEN f.id IS NULL THEN 'cycle' WHEN f.parent_id IS NOT NULL THEN 'missing_parent' WHEN k.kind <> 'top' THEN 'kind' END AS problem
 FROM unit_link l LEFT JOIN fin f ON f.id = l.id LEFT JOIN unit_link k ON k.id = f.node)"""


@query("unit_hierarchy", f"WITH {_CLIMB} SELECT id, root, depth, problem FROM res", "unit_link")
def unit_hierarchy(t):
    """Units with the root that they belong to, their depth, or what is wrong above them."""
    return hierarchy.climb(t("unit_link"), _store(t), "top")


_PICK = "SELECT DISTINCT o_custkey AS request_id, CAST(o_orderkey % 1000 + CASE WHEN o_orderkey % 113 = 0 THEN 900000000 ELSE 0 END AS BIGINT) AS unit FROM orders WHERE o_orderkey % 1000 > 0"


@query("selection_roots", f"""WITH {_CLIMB}, s AS ({_PICK}), g AS (SELECT request_id, count(DISTINCT root) AS n_roots, min(root) AS root, bool_or(res.id IS NULL) AS unknown, min(problem) AS own FROM s LEFT JOIN res ON res.id = s.unit GROUP BY request_id),
p AS (SELECT *, CASE WHEN unknown THEN 'unknown_unit' WHEN own IS NOT NULL THEN own WHEN n_roots > 1 THEN 'several_roots' END AS problem FROM g) SELECT request_id, n_roots, CASE WHEN problem IS NULL THEN root END AS root, problem FROM p""", "unit_link")
def selection_roots(t):
    """Selections of units, with the one root of all of them or the reason why there is none."""
    unit = F.col("o_orderkey") % 1000 + F.when(F.col("o_orderkey") % 113 == 0, 900_000_000).otherwise(0)
    s = t("orders").where("o_orderkey % 1000 > 0").select(F.col("o_custkey").alias("request_id"), unit.cast("long").alias("unit"))
    return hierarchy.selection_roots(s, hierarchy.climb(t("unit_link"), _store(t), "top"))


_NESTED = """RECURSIVE pair AS (SELECT DISTINCT relation_id, relation_id AS inner_id FROM relation_member UNION SELECT pair.relation_id, m.ref FROM pair JOIN relation_member m ON m.type = 'relation' AND m.relation_id = pair.inner_id),
held AS (SELECT m.type, m.ref, pair.relation_id FROM pair JOIN relation_member m ON m.relation_id = pair.inner_id AND m.type <> 'relation'),
found AS (SELECT * FROM held UNION SELECT 'relation', inner_id, relation_id FROM pair WHERE relation_id <> inner_id UNION SELECT 'node', n.id, h.relation_id FROM held h JOIN geo_node n ON h.type = 'way' AND n.way_id = h.ref
 UNION SELECT 'relation', m.ref, pair.relation_id FROM pair JOIN relation_member m ON m.type = 'relation' AND m.relation_id = pair.inner_id WHERE m.ref <> pair.relation_id)"""


@query("nested_member_index", f"WITH {_NESTED} SELECT type, ref, count(*) AS n_relations, min(relation_id) AS first_relation, max(relation_id) AS last_relation FROM found GROUP BY type, ref", "relation_member", "geo_node")
def nested_member_index(t):
    """Objects of all kinds with the relations that hold them at any depth, nodes of member ways among them."""
    found = hierarchy.member_index(t("relation_member"), t("geo_node").select("way_id", F.col("id").alias("node_id")), _store(t))
    return found.groupBy("type", "ref").agg(F.count("*").alias("n_relations"), F.min("relation_id").alias("first_relation"), F.max("relation_id").alias("last_relation"))


@query("way_fallback", """WITH w AS (SELECT way_id, count(*) AS n, any_value(way_id % 2 = 0) AS closed FROM geo_node GROUP BY way_id HAVING count(*) >= 2),
p AS (SELECT way_id, row_number() OVER (PARTITION BY way_id ORDER BY seq) AS k, lon, lat FROM geo_node),
sd AS (SELECT a.way_id, a.k, a.lon AS ax, a.lat AS ay, b.lon AS bx, b.lat AS by_, n + CASE WHEN closed THEN 0 ELSE -1 END AS sides, closed FROM p a JOIN w USING (way_id) JOIN p b ON b.way_id = a.way_id AND b.k = CASE WHEN a.k = n AND closed THEN 1 ELSE a.k + 1 END),
x AS (SELECT DISTINCT p.way_id FROM sd p JOIN sd q ON p.way_id = q.way_id AND q.k > p.k + 1 AND NOT (p.closed AND p.k = 1 AND q.k = p.sides) WHERE ((p.bx - p.ax) * (q.ay - p.ay) - (p.by_ - p.ay) * (q.ax - p.ax) > 0) <> ((p.bx - p.ax) * (q.by_ - p.ay) - (p.by_ - p.ay) * (q.bx - p.ax) > 0)
 AND ((q.bx - q.ax) * (p.ay - q.ay) - (q.by_ - q.ay) * (p.ax - q.ax) > 0) <> ((q.bx - q.ax) * (p.by_ - q.ay) - (q.by_ - q.ay) * (p.bx - q.ax) > 0))
SELECT w.way_id, CASE WHEN closed AND n >= 3 AND coalesce(g.landuse, g.amenity, g.emergency, g.healthcare, g.industrial, g.building) IS NOT NULL THEN 'Polygon' ELSE 'LineString' END AS wanted,
 CASE WHEN closed AND n >= 3 AND coalesce(g.landuse, g.amenity, g.emergency, g.healthcare, g.industrial, g.building) IS NOT NULL AND x.way_id IS NULL THEN 'Polygon' ELSE 'LineString' END AS kind FROM w JOIN tag_wide g ON g.tag_id = CAST(w.way_id % 90 AS INT) LEFT JOIN x ON x.way_id = w.way_id""", "geo_node", "tag_wide")
def way_fallback(t):
    """Ways that their tags make polygons, and what is left of that: rings that cross themselves are lines."""
    w = lines(t).withColumn("tag_id", (F.col("way_id") % 90).cast("int")).join(tag_maps(t("tag_kv")), "tag_id")
    w = w.withColumn("line", F.when(F.col("way_id") % 2 == 0, F.concat("line", F.slice("line", 1, 1))).otherwise(F.col("line"))).select("way_id", "line", ops.geometry_kind(F.col("line"), F.col("tags")).alias("wanted"))
    return validity.with_crossing(w, ["way_id"]).select("way_id", "wanted", validity.kind_or_line(F.col("wanted")).alias("kind"))


# roles as given, blank or absent; some objects are not delivered, some ways without their line
_ROLE = "CASE ref % 3 WHEN 0 THEN '' WHEN 1 THEN 'line' END"
_ENDS = "(SELECT way_id, first(id ORDER BY seq) AS first_node, last(id ORDER BY seq) AS last_node, count(*) AS n_nodes FROM geo_node GROUP BY way_id)"


@query("circuit_evidence", f"""WITH m AS (SELECT relation_id, type, ref, {_ROLE} AS role FROM relation_member), w AS {_ENDS},
d AS (SELECT 'node' AS type, id AS ref, 'Point' AS gtype FROM geo_node WHERE id % 3 <> 0 UNION ALL SELECT 'way', way_id, CASE WHEN n_nodes >= 2 AND way_id % 4 <> 0 THEN 'LineString' END FROM w WHERE way_id % 5 <> 0 UNION ALL SELECT 'relation', c_custkey, NULL FROM customer WHERE c_custkey % 2 = 0)
SELECT relation_id, concat(m.type, '/', CAST(m.ref AS VARCHAR)) AS source_id, CASE WHEN role = 'line' THEN 'line' ELSE 'member' END AS role, CASE WHEN m.type = 'way' AND n_nodes >= 2 THEN concat('node/', CAST(first_node AS VARCHAR)) END AS "start",
 CASE WHEN m.type = 'way' AND n_nodes >= 2 THEN concat('node/', CAST(last_node AS VARCHAR)) END AS "end", coalesce(gtype, '') = 'LineString' AS has_line, m.type = 'way' AND coalesce(gtype, '') <> 'LineString' AS lacks_line
FROM m JOIN d ON d.type = m.type AND d.ref = m.ref LEFT JOIN w ON w.way_id = m.ref AND m.type = 'way'""", "relation_member", "geo_node")
def circuit_evidence(t):
    """Members of circuits that are delivered: nodes, ways with their end nodes, and relations."""
    from gridloom.operators.circuits import circuit_evidence as evidence

    n = t("geo_node")
    ways = n.groupBy("way_id").agg(F.min(F.struct("seq", "id"))["id"].alias("first_node"), F.max(F.struct("seq", "id"))["id"].alias("last_node"), F.count("*").alias("n_nodes"))
    there = n.where("id % 3 <> 0").select(F.lit("node").alias("type"), F.col("id").alias("ref"), F.lit("Point").alias("gtype"))
    there = there.unionByName(ways.where("way_id % 5 <> 0").select(F.lit("way").alias("type"), F.col("way_id").alias("ref"), F.when((F.col("n_nodes") >= 2) & (F.col("way_id") % 4 != 0), "LineString").alias("gtype")))
    there = there.unionByName(t("customer").where("c_custkey % 2 = 0").select(F.lit("relation").alias("type"), F.col("c_custkey").alias("ref"), F.lit(None).cast("string").alias("gtype")))
    return evidence(t("relation_member").withColumn("role", F.expr(_ROLE)), there, ways)
