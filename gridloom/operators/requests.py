"""Which requests a log of them would have been served from earlier results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

HOUR = 3_600_000_000


def _next_run(rows: DataFrame, span: int) -> DataFrame:
    """``id, next``: the request that would run next if this one ran: the first later than its span, or the very next if it failed. Requests and the places looked for are sorted together inside cells of one span, so no key
    is one task; an empty rest of a cell is answered by the first request of the next cell that has one."""
    none = F.lit(None).cast("struct<t:bigint,id:bigint>")
    points = rows.select("key", F.col("t").alias("at"), F.lit(0).alias("late"), "id", F.lit(0).alias("kind"), F.struct("t", "id").alias("row"))
    places = rows.select("key", F.when(F.col("ok"), F.col("t") + span).otherwise(F.col("t")).alias("at"), F.col("ok").cast("int").alias("late"), "id", F.lit(1).alias("kind"), none.alias("row"))
    both = points.unionByName(places).withColumn("cell", F.floor(F.col("at") / span))
    back = W.partitionBy("key", "cell").orderBy(*[F.col(c).desc() for c in ("at", "late", "id", "kind")]).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("after", F.last("row", ignorenulls=True).over(back)).where("kind = 1")
    cells = both.groupBy("key", "cell").agg(F.min("row").alias("first"))
    beyond = cells.withColumn("beyond", F.last("first", ignorenulls=True).over(W.partitionBy("key").orderBy(F.col("cell").desc()).rowsBetween(W.unboundedPreceding, -1)))
    return found.join(beyond, ["key", "cell"]).select("id", F.coalesce("after", "beyond")["id"].alias("next")).where("next is not null")


def _runs(rows: DataFrame, span: int, store, max_rounds: int) -> DataFrame:
    """Ids of the requests that run: those that following ``next`` from the first request of each key reaches. Each round doubles the steps."""
    jump = store(_next_run(rows, span), "jump")
    reached = store(rows.groupBy("key").agg(F.min(F.struct("t", "id"))["id"].alias("id")).select("id"), "reached")
    for k in range(max_rounds):
        new = store(reached.join(jump, "id").select(F.col("next").alias("id")), f"new{k}")
        if new.isEmpty():
            return reached
        reached = reached.unionByName(new)
        jump = store(jump.join(jump.select(F.col("id").alias("next"), F.col("next").alias("far")), "next").select("id", F.col("far").alias("next")), f"jump{k}")
    raise RuntimeError(f"a key has more than 2^{max_rounds} runs")


def reuse(log: DataFrame, store, hours: int = 24, max_rounds: int = 60) -> DataFrame:
    """``id, served, run``: whether the result of an earlier request of the same ``key`` serves a request, and the request that ran for it (itself if not served).

    ``log`` has key, ts, id (unique) and ok. A result serves for ``hours`` from the request that made it, its last moment included; serving does not prolong that. The result of a request that is not ok (or null) serves none,
    so the next one runs. Requests of the same moment are in order of id. A request without key or time runs for itself alone. ``store`` writes a table and reads it back."""
    span = hours * HOUR
    base = log.select("key", F.unix_micros("ts").alias("t"), "id", F.coalesce("ok", F.lit(False)).alias("ok"))
    rows = store(base.where("key is not null and t is not null"), "log")
    runs = _runs(rows, span, store, max_rounds).select(F.col("id").alias("ran"))
    marked = rows.join(runs, F.col("id") == F.col("ran"), "left").withColumns({"cell": F.floor(F.col("t") / span), "mark": F.when(F.col("ran").isNotNull(), F.struct("t", "id"))})
    here = F.last("mark", ignorenulls=True).over(W.partitionBy("key", "cell").orderBy("t", "id").rowsBetween(W.unboundedPreceding, W.currentRow))
    before = F.last("top", ignorenulls=True).over(W.partitionBy("key").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    cells = marked.groupBy("key", "cell").agg(F.max("mark").alias("top")).withColumn("before", before).drop("top")
    run = F.coalesce("here", "before")["id"]
    told = marked.withColumn("here", here).join(cells, ["key", "cell"]).select("id", F.col("ran").isNull().alias("served"), run.alias("run"))
    return told.unionByName(base.where("key is null or t is null").select("id", F.lit(False).alias("served"), F.col("id").alias("run")))
