"""Snapshots, exports, circuits and administrative units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def snapshot_state(outcomes: DataFrame) -> DataFrame:
    """Per snapshot: partial if an outcome failed or waits, the earliest source date of what is ready, the endpoint if there is one only."""
    ready = F.col("status") == "ready"
    return outcomes.groupBy("snapshot_id").agg(
        F.when(F.bool_or(F.col("status").isin("failed", "pending_qualification")), "partial").otherwise("ready").alias("state"), F.min(F.when(ready, F.col("source_observed_at"))).alias("source_observed_at"),
        F.when(F.count_distinct("endpoint") == 1, F.first("endpoint")).alias("endpoint"), F.count("*").alias("n_domains"))


def acquisition_evidence(outcomes: DataFrame) -> DataFrame:
    """Rejected counts (never negative, null if a count is unknown) and the validation each status stands for."""
    lost = F.col("queried_feature_count") - F.col("accepted_feature_count")
    return outcomes.withColumn("rejected_feature_count", F.when(lost.isNotNull(), F.greatest(lost, F.lit(0)))).withColumn(
        "validation", F.when(F.col("status") == "ready", "passed").when(F.col("status") == "failed", "failed").otherwise("not_run"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def integrity(ready: DataFrame, manifests: DataFrame) -> DataFrame:
    """Ready outcomes (key, digest) against manifests: ok, missing or different."""
    m = manifests.select(F.col("key").alias("_k"), F.col("digest").alias("_d"))
    return ready.join(m, F.col("key") == F.col("_k"), "left").withColumn("integrity", F.when(F.col("_k").isNull(), "missing").when(F.col("digest").eqNullSafe(F.col("_d")), "ok").otherwise("different")).drop("_k", "_d")


PRESENTATION_VERSION = "map_presentation/v1"


def presentation_problem() -> Column:
    """The first reason not to show a presentation (version, parent_digest, layers: sorted ids) of a manifest (digest, public: sorted ids), else "current"."""
    return (F.when(F.col("version").isNull(), "missing").when(F.col("version") != PRESENTATION_VERSION, "unsupported_version").when(F.col("parent_digest") != F.col("digest"), "stale")
            .when(F.coalesce(F.size("layers"), F.lit(0)) <= 0, "no_layers").when(F.col("layers") != F.col("public"), "layers_differ").otherwise("current"))


def signature(outcomes: DataFrame) -> DataFrame:
    """``snapshot_id, checksum``: a digest over the outcomes (domain, status, digest) of each snapshot, of which there are as many as domains."""
    line = F.concat_ws(":", "domain", "status", F.coalesce("digest", F.lit("")))
    return outcomes.groupBy("snapshot_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ","), 256).alias("checksum"))


def refresh_digests(outcomes: DataFrame, signed: DataFrame, news: DataFrame) -> DataFrame:
    """``snapshot_id, result, checksum``: new digests (snapshot_id, domain, new) replace those of ready outcomes and the snapshot is signed again. A snapshot whose
    checksum does not match its outcomes is refused and keeps it; one without a ready outcome to renew stays as it is."""
    now = signature(outcomes).withColumnRenamed("checksum", "own")
    o = outcomes.join(news, ["snapshot_id", "domain"], "left").withColumn("hit", (F.col("status") == "ready") & F.col("new").isNotNull())
    after = signature(o.withColumn("digest", F.when(F.col("hit"), F.col("new")).otherwise(F.col("digest")))).withColumnRenamed("checksum", "renewed")
    touched = o.groupBy("snapshot_id").agg(F.bool_or("hit").alias("touched"))
    d = signed.join(now, "snapshot_id").join(after, "snapshot_id").join(touched, "snapshot_id")
    result = F.when(F.col("checksum") != F.col("own"), "refused").when(F.col("touched"), "updated").otherwise("unchanged")
    return d.select("snapshot_id", result.alias("result"), F.when(result == "updated", F.col("renewed")).otherwise(F.col("checksum")).alias("checksum"))


#: States of a snapshot of the very area, the one that counts first.
STATE_RANK = ("ready", "running", "queued", "failed", "partial")


def availability(requests: DataFrame, snapshots: DataFrame, cell: float = 0.25) -> DataFrame:
    """``aoi_id, state`` of each request (aoi_id and box): that of a snapshot of the same area, else partial coverage if the box of any snapshot meets it, else not_prepared."""
    rank = F.coalesce(*[F.when(F.col("state") == s, F.lit(i)) for i, s in enumerate(STATE_RANK)])
    exact = snapshots.groupBy("aoi_id").agg(F.min(rank).alias("rank"))
    # other snapshots matter only to areas without one of their own
    asked = requests.join(exact, "aoi_id", "left")
    known = F.when(F.col("rank") == len(STATE_RANK) - 1, "partial_coverage").otherwise(F.element_at(F.lit(list(STATE_RANK)), F.col("rank") + 1))
    met = meeting_boxes(asked.where("rank is null").select(*BOX), snapshots.select(*BOX), cell / 4).withColumn("near", F.lit(True))
    d = asked.join(met, list(BOX), "left")
    return d.select("aoi_id", F.when(F.col("rank").isNotNull(), known).when(F.col("near"), "partial_coverage").otherwise("not_prepared").alias("state"))


BOX = ("min_lon", "min_lat", "max_lon", "max_lat")


def meeting_boxes(boxes: DataFrame, others: DataFrame, cell: float) -> DataFrame:
    """The different ones of ``boxes`` (:data:`BOX`) that meet any of ``others``, borders included.

    Boxes are laid out by cells. The cells strictly between those of a box's sides are inner ones: whatever reaches into one meets the box. So a box that reaches an inner cell of another, or has any other in an inner cell of its own, is
    settled by different cells alone; only what is left meets the others box by box, and where many others lie there are inner cells."""
    at = lambda c: F.floor(F.col(c) / cell).cast("int")
    span = lambda lo, hi: F.explode(F.sequence(at(lo), at(hi)))
    spread = lambda d: d.select(*BOX).where("min_lon <= max_lon and min_lat <= max_lat").distinct().withColumn("ci", span("min_lon", "max_lon")).withColumn("cj", span("min_lat", "max_lat"))
    inner = (F.col("ci") > at("min_lon")) & (F.col("ci") < at("max_lon")) & (F.col("cj") > at("min_lat")) & (F.col("cj") < at("max_lat"))
    mine, theirs = spread(boxes).withColumn("inner", inner), spread(others).withColumn("inner", inner)
    cells = theirs.groupBy("ci", "cj").agg(F.max("inner").alias("filled"))
    sure = mine.join(cells, ["ci", "cj"]).where("inner or filled").select(*BOX).distinct()
    there = theirs.select("ci", "cj", *[F.col(c).alias("o_" + c) for c in BOX])
    meets = (F.col("min_lon") <= F.col("o_max_lon")) & (F.col("max_lon") >= F.col("o_min_lon")) & (F.col("min_lat") <= F.col("o_max_lat")) & (F.col("max_lat") >= F.col("o_min_lat"))
    rest = mine.join(sure, list(BOX), "left_anti").join(there, ["ci", "cj"]).where(meets).select(*BOX).distinct()
    return sure.unionByName(rest)


def delivered_members(members: DataFrame, ways: DataFrame) -> DataFrame:
    """Members of relations that are delivered, with their role and the ends of their way as evidence."""
    role = F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit("member"))
    return members.withColumn("role", role).join(ways, "way_id")


def reverse_index(members: DataFrame) -> DataFrame:
    """Relations of each member."""
    return members.groupBy("way_id").agg(F.array_sort(F.collect_set("relation_id")).alias("relations"))


def merge_attributes(base: DataFrame, evidence: DataFrame, key: str = "id") -> DataFrame:
    """Tags of ``evidence`` over those of ``base``: keys of both take the evidence's value."""
    e = evidence.select(F.col(key).alias("_k"), F.col("tags").alias("_t"))
    over = F.coalesce(F.col("_t"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter("tags", lambda k, v: ~F.array_contains(F.map_keys(over), k))
    return base.join(e, F.col(key) == F.col("_k"), "left").withColumn("tags", F.map_concat(kept, over)).drop("_k", "_t")


def top_units(units: DataFrame, levels: int = 3) -> DataFrame:
    """``id, root``: the unit reached by climbing ``parent_id`` at most ``levels`` times; a unit that is still below something then has no root."""
    up = units.select(F.col("id").alias("_i"), F.col("parent_id").alias("_p"))
    d = units.select("id", F.col("id").alias("at"), "parent_id")
    for _ in range(levels):
        d = d.join(up, F.col("parent_id") == F.col("_i"), "left").select("id", F.coalesce("_i", "at").alias("at"), F.when(F.col("_i").isNotNull(), F.col("_p")).otherwise(F.lit(None)).alias("parent_id"))
    return d.select("id", F.when(F.col("parent_id").isNull(), F.col("at")).alias("root"))


def touching(units: DataFrame, gap: float = 0.001) -> DataFrame:
    """Pairs (a, b), a < b, of units whose boxes are closer than ``gap``, found by the cells their boxes cover."""
    cell = 0.25
    span = lambda lo, hi: F.sequence(F.floor((F.col(lo) - gap) / cell).cast("int"), F.floor((F.col(hi) + gap) / cell).cast("int"))
    u = units.withColumn("ci", F.explode(span("min_lon", "max_lon"))).withColumn("cj", F.explode(span("min_lat", "max_lat")))
    l, r = u.select("ci", "cj", *[F.col(c).alias("l_" + c) for c in units.columns]), u.select("ci", "cj", *[F.col(c).alias("r_" + c) for c in units.columns])
    away = lambda axis: F.greatest(F.col(f"l_min_{axis}") - F.col(f"r_max_{axis}"), F.col(f"r_min_{axis}") - F.col(f"l_max_{axis}"), F.lit(0.0))
    near = l.join(r, ["ci", "cj"]).where("l_id < r_id").where(F.hypot(away("lon"), away("lat")) < gap)
    return near.select(F.col("l_id").alias("a"), F.col("r_id").alias("b")).distinct()


def contiguous(selection: DataFrame, edges: DataFrame, limit: int = 3, whole: DataFrame | None = None) -> DataFrame:
    """Per selection (request_id, unit): is it one connected set of ``limit`` units at most, without one of the ``whole`` (unit) ones? Least labels spread ``limit`` - 1 times, which suffices for that many."""
    both = edges.union(edges.select("b", "a")).toDF("a", "b")
    d = selection.select("request_id", "unit", F.col("unit").alias("label"))
    for _ in range(limit - 1):
        near = d.join(both, d.unit == both.a).select("request_id", F.col("b").alias("unit"), "label")
        own = d.select("request_id", "unit")
        d = d.unionByName(near.join(own, ["request_id", "unit"], "left_semi")).groupBy("request_id", "unit").agg(F.min("label").alias("label"))
    g = d.groupBy("request_id").agg(F.count("*").alias("n_units"), F.count_distinct("label").alias("parts"))
    if whole is not None:
        g = g.join(selection.join(whole, "unit", "left_semi").select("request_id").distinct().withColumn("whole", F.lit(True)), "request_id", "left")
    else:
        g = g.withColumn("whole", F.lit(None).cast("boolean"))
    return g.withColumn("code", F.when(F.col("whole"), "whole_unit").when(F.col("n_units") > limit, "too_many").when(F.col("parts") > 1, "not_contiguous").otherwise("ready")).drop("whole")


def running(rows: DataFrame, by: str, order: list[str], *counts) -> DataFrame:
    """Sums so far in each group, in order of ``order``, whose first column is a time. A group is dealt by day: the sums of its days are a small table that says with what a day begins, and a window inside the day gives
    the rest, so a group that holds most rows is as many tasks as it has days."""
    day = F.date_trunc("day", order[0])
    d = rows.withColumn("_day", day).withColumns({f"_c_{name}": c for name, c in counts})
    sums = d.groupBy(by, "_day").agg(*[F.sum(f"_c_{name}").alias(f"_s_{name}") for name, _ in counts])
    before = W.partitionBy(by).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(F.col(by).alias("_by"), F.col("_day").alias("_on"), *[F.coalesce(F.sum(f"_s_{name}").over(before), F.lit(0)).alias(f"_b_{name}") for name, _ in counts])
    inside = W.partitionBy(by, "_day").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumns({name: F.sum(f"_c_{name}").over(inside) for name, _ in counts}).join(starts, F.col(by).eqNullSafe(F.col("_by")) & F.col("_day").eqNullSafe(F.col("_on")))
    return d.select(*rows.columns, *[(F.col(name) + F.col(f"_b_{name}")).alias(name) for name, _ in counts])


def previous_time(rows: DataFrame, by: list[str], time: str, tie: str) -> DataFrame:
    """``rows`` with ``previous``, the time of the row before in its group. Dealt by day like :func:`running`: the first row of a day looks at the last time of the days before."""
    d = rows.withColumn("_day", F.date_trunc("day", time))
    last = d.groupBy(*by, "_day").agg(F.max(time).alias("_last"))
    before = F.lag("_last").over(W.partitionBy(*by).orderBy("_day"))
    starts = last.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_day").alias("_on"), before.alias("_before"))
    on = F.col("_day").eqNullSafe(F.col("_on"))
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    own = F.lag(time).over(W.partitionBy(*by, "_day").orderBy(time, tie))
    return d.withColumn("_own", own).join(starts, on).select(*rows.columns, F.coalesce("_own", "_before").alias("previous"))
