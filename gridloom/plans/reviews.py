"""Queries of reviews and measurements."""

from pyspark.sql import functions as F

from gridloom.operators import reviews as r
from gridloom.plans.views import query

_FOLD = """f AS (SELECT issue_id, min({'ts': ts, 'e': event_id, 's': status, 'n': note}) AS f FROM review_update WHERE expected IS NULL GROUP BY 1), u AS (SELECT r.*, f.f FROM review_update r LEFT JOIN f ON f.issue_id = r.issue_id),
g AS (SELECT issue_id, min({'ts': ts, 'e': event_id, 's': status, 'n': note}) AS g FROM u WHERE (ts, event_id) > (f.ts, f.e) AND f.s = 'acknowledged' AND expected = f.ts AND status IN ('resolved','accepted','ignored') GROUP BY 1),
v AS (SELECT u.*, g.g, coalesce((ts, event_id) = (f.ts, f.e), false) OR coalesce((ts, event_id) = (g.ts, g.e), false) AS taken, CASE WHEN (ts, event_id) >= (g.ts, g.e) THEN g.ts WHEN (ts, event_id) >= (f.ts, f.e) THEN f.ts END AS known FROM u LEFT JOIN g ON g.issue_id = u.issue_id),
r AS (SELECT issue_id, any_value(f) AS f, any_value(g) AS g, count(*) FILTER (WHERE taken) AS n_accepted, count(*) FILTER (WHERE NOT taken AND expected IS DISTINCT FROM known) AS n_conflict, count(*) FILTER (WHERE NOT taken AND expected IS NOT DISTINCT FROM known) AS n_invalid FROM v GROUP BY 1)"""


@query("review_fold", f"WITH {_FOLD} SELECT issue_id, coalesce(g.s, f.s, 'open') AS status, CASE WHEN g.n IS NOT NULL THEN nullif(g.n, '') ELSE nullif(f.n, '') END AS note, f.ts AS created_at, coalesce(g.ts, f.ts) AS updated_at, n_accepted, n_conflict, n_invalid FROM r", "review_update")
def review_fold(t):
    return r.fold_reviews(t("review_update"))


@query("reviewed_issues", f"WITH {_FOLD} SELECT i.issue_id, coalesce(g.s, f.s, 'open') AS status, CASE WHEN g.n IS NOT NULL THEN nullif(g.n, '') ELSE nullif(f.n, '') END AS note FROM (SELECT c_custkey AS issue_id FROM customer) i LEFT JOIN r ON r.issue_id = i.issue_id", "review_update")
def reviewed_issues(t):
    """Issues with their review; those without one are open."""
    i = t("customer").select(F.col("c_custkey").alias("issue_id"))
    return i.join(r.fold_reviews(t("review_update")).select("issue_id", "status", "note"), "issue_id", "left").select("issue_id", F.coalesce("status", F.lit("open")).alias("status"), "note")


# clocks that are up to two days off, in hours, so that many updates would record an earlier time than the one before
_CLOCK = "(SELECT user_id AS issue_id, event_id, ts + INTERVAL 1 HOUR * (event_id % 48) AS ts FROM events)"


@query("monotone_times", f"""WITH RECURSIVE d AS (SELECT issue_id, event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY issue_id ORDER BY event_id) AS k FROM {_CLOCK}),
f AS (SELECT issue_id, event_id, ms AS updated_ms, k FROM d WHERE k = 1 UNION ALL SELECT d.issue_id, d.event_id, greatest(d.ms, f.updated_ms + 1), d.k FROM f JOIN d ON d.issue_id = f.issue_id AND d.k = f.k + 1)
SELECT issue_id, event_id, updated_ms FROM f""")
def monotone_times(t):
    """The times that updates of an issue record, whatever their clocks say."""
    u = t("events").select(F.col("user_id").alias("issue_id"), "event_id", (F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 HOUR") * (F.col("event_id") % 48)).alias("ts"))
    return r.monotone_times(u, "issue_id")


@query("measurement_summary", "SELECT endpoint, count(*) AS n, round(min(duration_ms), 3) AS min_ms, round(max(duration_ms), 3) AS max_ms, round(avg(duration_ms), 3) AS mean_ms, quantile_disc(duration_ms, 0.5) AS p50_ms, quantile_disc(duration_ms, 0.95) AS p95_ms, quantile_disc(duration_ms, 0.99) AS p99_ms, CAST(sum(response_bytes) AS BIGINT) AS total_bytes, count(*) FILTER (WHERE status = 304) AS n_304 FROM measure_obs GROUP BY endpoint", "measure_obs")
def measurement_summary(t):
    return r.measurement_summary(t("measure_obs"))


@query("cache_hit_ratio", "SELECT endpoint, round(avg(CASE WHEN status = 304 THEN 1e0 ELSE 0e0 END), 6) AS hit_ratio FROM measure_obs GROUP BY endpoint", "measure_obs")
def cache_hit_ratio(t):
    return t("measure_obs").groupBy("endpoint").agg(F.round(F.avg(F.when(F.col("status") == 304, 1.0).otherwise(0.0)), 6).alias("hit_ratio"))
