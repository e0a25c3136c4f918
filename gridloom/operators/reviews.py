"""Reviews of issues and measurements of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FINAL = ("resolved", "accepted", "ignored")
#: What each state may become.
MOVES = {"open": ("acknowledged", *FINAL), "acknowledged": FINAL, "resolved": (), "accepted": (), "ignored": ()}


def fold_reviews(updates: DataFrame) -> DataFrame:
    """The state of each issue after its updates (ts, event_id, status, note, expected) in order of (ts, event_id): ``issue_id, status, note, created_at, updated_at`` and counts.

    ``expected`` is the time of the last change that the writer knew of, null for none. An update that expects another one than there is is a conflict; one that the state does not allow is invalid. An
    absent note keeps the one that is there, an empty one clears it. No fold in order is needed: the first update that expects nothing opens the review; if it acknowledges, the first final one that expects it closes
    it; and the time of an update against these two says what became of it. Both are minima that combine before the shuffle."""
    at, row = F.struct("ts", "event_id"), F.struct("ts", "event_id", "status", "note")
    first = updates.where("expected is null").groupBy("issue_id").agg(F.min(row).alias("f"))
    u = updates.join(first, "issue_id", "left")
    after = at > F.struct("f.ts", "f.event_id")
    closing = after & (F.col("f.status") == "acknowledged") & (F.col("expected") == F.col("f.ts")) & F.col("status").isin(*FINAL)
    second = u.where(closing).groupBy("issue_id").agg(F.min(row).alias("g"))
    v = u.join(second, "issue_id", "left")
    opened, closed = F.col("f").isNotNull() & (at >= F.struct("f.ts", "f.event_id")), F.col("g").isNotNull() & (at >= F.struct("g.ts", "g.event_id"))
    taken = (F.col("f").isNotNull() & (at == F.struct("f.ts", "f.event_id"))) | (F.col("g").isNotNull() & (at == F.struct("g.ts", "g.event_id")))
    known = F.when(closed, F.col("g.ts")).when(opened, F.col("f.ts"))
    conflict = ~taken & ~F.col("expected").eqNullSafe(known)
    n = v.groupBy("issue_id").agg(F.first("f").alias("f"), F.first("g").alias("g"), F.count_if(taken).alias("n_accepted"), F.count_if(conflict).alias("n_conflict"), F.count_if(~taken & ~conflict).alias("n_invalid"))
    note = F.when(F.col("g.note").isNotNull(), F.nullif(F.col("g.note"), F.lit(""))).otherwise(F.nullif(F.col("f.note"), F.lit("")))
    return n.select("issue_id", F.coalesce("g.status", "f.status", F.lit("open")).alias("status"), note.alias("note"), F.col("f.ts").alias("created_at"), F.coalesce("g.ts", "f.ts").alias("updated_at"), "n_accepted", "n_conflict", "n_invalid")


#: Consecutive event numbers that are one part of a key's updates.
STRETCH = 65_536


def monotone_times(updates: DataFrame, key: str, stretch: int = STRETCH) -> DataFrame:
    """``key, event_id, updated_ms``: the time each update of a key records, in whole milliseconds: its own (ts), but at least one more than that of the update before it in order of event_id, so clocks that go back or stand still never
    give two updates one time.

    Less its place in the order, a time is a running maximum, so no fold is needed: places and maxima are found inside stretches of event numbers and carried over them by one row for each stretch; a key with a third of all updates is many
    tasks. An update without a time records the least one allowed, 1 where it is the first. Event numbers are unique; updates without a key are one key."""
    ms = F.coalesce(F.floor(F.unix_micros("ts") / 1000), F.lit(0)).cast("long")
    d = updates.select(F.col(key).alias("key"), "event_id", F.greatest(ms, F.lit(1)).alias("ms")).withColumn("part", F.floor(F.col("event_id") / stretch))
    inner, parts = W.partitionBy("key", "part").orderBy("event_id"), W.partitionBy("key").orderBy("part")
    d = d.withColumn("j", F.row_number().over(inner)).withColumn("lead", F.max(F.col("ms") - F.col("j")).over(inner.rowsBetween(W.unboundedPreceding, W.currentRow)))
    p = d.groupBy("key", "part").agg(F.count("*").alias("n"), F.max("lead").alias("top"))
    earlier = parts.rowsBetween(W.unboundedPreceding, -1)
    p = p.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("carried", F.max(F.col("top") - F.col("offset")).over(earlier))
    p = p.select(F.col("key").alias("k"), F.col("part").alias("q"), "offset", "carried")
    d = d.join(p, F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("q")))
    return d.select(F.col("key").alias(key), "event_id", (F.col("offset") + F.col("j") + F.greatest(F.col("lead") - F.col("offset"), "carried")).alias("updated_ms"))


#: Ranges of durations in which ranks are looked for.
RANGES = 1024


def measurement_summary(samples: DataFrame) -> DataFrame:
    """Per endpoint: spread of durations with nearest-rank percentiles, bytes and the share of unchanged answers.

    Ranks are exact without a task that holds an endpoint's durations: counts of its ranges (RANGES rows an endpoint) tell in which range a rank lies, and only the
    distinct values of those ranges are put in order."""
    d = samples.select("endpoint", F.col("duration_ms").cast("double").alias("v"), "response_bytes", "status")
    known = d.groupBy("endpoint").agg(
        F.count("*").alias("n"), F.count("v").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.sum("response_bytes").alias("total_bytes"), F.count_if(F.col("status") == 304).alias("n_304"))
    bin_ = F.least(F.floor((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * RANGES), F.lit(RANGES - 1))
    placed = d.where("v is not null").join(known.select(F.col("endpoint").alias("e2"), "lo", "hi", "k"), F.col("endpoint").eqNullSafe(F.col("e2"))).select("endpoint", "v", "k", F.coalesce(bin_, F.lit(0)).alias("b"))
    before = lambda order, *by: F.sum("c").over(W.partitionBy("endpoint", *by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)) - F.col("c")
    ranges = placed.groupBy("endpoint", "b", "k").agg(F.count("*").alias("c")).withColumn("below", before("b"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("p"), F.greatest(F.lit(1), F.ceil(F.col("k") * share)).cast("long").alias("rank")) for name, share in (("p50_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99))]))
    ranges = ranges.withColumn("w", wanted).where((F.col("below") < F.col("w.rank")) & (F.col("w.rank") <= F.col("below") + F.col("c"))).select(F.col("endpoint").alias("e2"), F.col("b").alias("b2"), "w.p", (F.col("w.rank") - F.col("below")).alias("rank"))
    values = placed.join(ranges.select("e2", "b2").distinct(), F.col("endpoint").eqNullSafe(F.col("e2")) & (F.col("b") == F.col("b2")), "left_semi").groupBy("endpoint", "b", "v").agg(F.count("*").alias("c"))
    values = values.withColumn("below", before("v", "b"))
    found = values.join(ranges, F.col("endpoint").eqNullSafe(F.col("e2")) & (F.col("b") == F.col("b2")) & (F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("below") + F.col("c")))
    ranks = found.groupBy(F.col("endpoint").alias("e3")).agg(*[F.max(F.when(F.col("p") == p, F.col("v"))).alias(p) for p in ("p50_ms", "p95_ms", "p99_ms")])
    both = known.join(ranks, F.col("endpoint").eqNullSafe(F.col("e3")), "left")
    return both.select("endpoint", "n", F.round("lo", 3).alias("min_ms"), F.round("hi", 3).alias("max_ms"), F.round("mean", 3).alias("mean_ms"), "p50_ms", "p95_ms", "p99_ms", "total_bytes", "n_304")
