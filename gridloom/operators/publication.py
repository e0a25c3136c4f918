"""Snapshots published domain by domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def publication_state(outcomes: DataFrame, requested: Column) -> DataFrame:
    """``snapshot_id, version, ready, failed, pending, state`` from outcomes (snapshot_id, domain, status, at) so far; ``requested`` is the list of domains asked for, a column of ``outcomes`` or a literal.

    The last outcome of a domain by (at, status) counts. ``version`` is how many domains became ready, in the order of which ``ready`` lists them; ``pending`` are those of the request without an outcome, in its order. The state is
    ``ready`` when all requested domains are ready, ``failed`` when none is and none is pending, ``pending`` when none is yet, else ``partial``. Outcomes of domains not asked for, and rows without snapshot or domain, play no part."""
    rows = outcomes.where("snapshot_id is not null and domain is not null").withColumn("requested", requested).where(F.array_contains("requested", F.col("domain")))
    last = rows.groupBy("snapshot_id", "domain").agg(F.max(F.struct("at", "status"))["status"].alias("status"), F.max("at").alias("at"), F.first("requested").alias("requested"))
    done = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.struct("at", "domain"))))
    g = last.groupBy("snapshot_id").agg(done("ready").alias("r"), done("failed").alias("f"), F.first("requested").alias("requested"))
    names = lambda c: F.transform(c, lambda x: x["domain"])
    g = g.select("snapshot_id", "requested", names("r").alias("ready"), names("f").alias("failed"))
    g = g.withColumn("pending", F.array_except("requested", F.concat("ready", "failed")))
    state = F.when(F.size("ready") == F.size(F.array_distinct("requested")), "ready").when(F.size("ready") > 0, "partial").when(F.size("pending") == 0, "failed").otherwise("pending")
    return g.select("snapshot_id", F.size("ready").cast("long").alias("version"), "ready", "failed", "pending", state.alias("state"))
