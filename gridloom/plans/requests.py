"""Queries of requests: their identity and the reuse of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.canonical import json_identity
from gridloom.operators import requests as r
from gridloom.plans.areas import _store
from gridloom.plans.views import VIEWS, query

# requests of users as JSON whose keys come in three orders, with numbers and blanks written in different ways (braces doubled, since views name each other in braces); a tenth of them fails
VIEWS["request_log"] = """SELECT event_id AS id, user_id, ts, event_id % 10 <> 0 AS ok, CASE event_id % 3
 WHEN 0 THEN concat('{{"profiles": ["power", "water"], "aoi": {{"type": "circle", "center": {{"lon": ', user_id % 25, '.50, "lat": 50.0}}, "user": ', user_id, '}}}}')
 WHEN 1 THEN concat('{{"aoi":{{"user":', user_id, ',"center":{{"lat":50,"lon":', user_id % 25, '.5}},"type":"circle"}},"profiles":["power","water"]}}')
 ELSE concat(' {{"aoi" : {{"center" : {{"lon" : ', user_id % 25, '.5, "lat" : 50.00}}, "user" : ', user_id, ', "type" : "circle"}}, "profiles" : ["power" , "water"]}} ') END AS request FROM {events}"""

_ID = """concat('aoi_', substr(sha256(concat('{"aoi":{"center":{"lat":50,"lon":', user_id % 25, '.5},"type":"circle","user":', user_id, '},"profiles":["power","water"]}')), 1, 16))"""


@query("canonical_identity", f"SELECT id, {_ID} AS request_id FROM request_log", "request_log")
def canonical_identity(t):
    """The identity of each request, the same for all ways to write it."""
    return t("request_log").select("id", json_identity(F.col("request"), "aoi_").alias("request_id"))


@query("served_requests", """WITH RECURSIVE d AS (SELECT id, user_id, ts, ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS k FROM request_log),
run AS (SELECT id, user_id, ts, ok, k FROM d WHERE k = 1 UNION ALL SELECT n.id, n.user_id, n.ts, n.ok, n.k FROM (SELECT run.user_id AS u, min(d.k) AS k FROM run JOIN d ON d.user_id = run.user_id AND d.k > run.k AND (NOT run.ok OR d.ts > run.ts + INTERVAL 24 HOUR) GROUP BY run.user_id, run.k) x JOIN d n ON n.user_id = x.u AND n.k = x.k)
SELECT d.id, r.id IS NULL AS served, max_by(run.id, run.k) AS run FROM d JOIN run ON run.user_id = d.user_id AND run.k <= d.k LEFT JOIN (SELECT id FROM run) r ON r.id = d.id GROUP BY d.id, r.id""", "request_log")
def served_requests(t):
    """Requests that the result of an earlier one of the same identity serves for 24 hours."""
    log = t("request_log").select(json_identity(F.col("request")).alias("key"), F.col("ts").cast("timestamp").alias("ts"), "id", "ok")
    return r.reuse(log, _store(t))
