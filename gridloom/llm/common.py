"""Helpers shared by the operators of this subpackage: tables, prefix sums, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: For bytes.translate: A-Z to a-z, all else unchanged.
ASCII_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and the
    master is local (tests on one machine) it is a temporary folder, removed when the process ends; on a cluster an unset folder is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        path = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, path, True)
        _own_dir[app] = f"file://{path}"
    return _own_dir[app]


def _folder(spark: SparkSession, path: str):
    """The file system and the Hadoop path of a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a Parquet table in the shared folder; the table, read back, and its folder. It outlives any executor and is removed when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    files, at = _folder(spark, path.rsplit("/", 1)[0])
    files.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a stored table."""
    return stored(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stored table that nothing reads any more."""
    files, at = _folder(spark, path)
    files.delete(at, True)


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows that are in order of ``keys`` (numbers), each whole, though it may lie over several batches."""
    rest: list[pd.DataFrame] = []
    last = None
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[keys].to_numpy()
        cut = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
        for lo, hi in zip(cut, cut[1:]):
            if rest and last != tuple(k[lo]):
                yield pd.concat(rest) if len(rest) > 1 else rest[0]
                rest = []
            last = tuple(k[lo])
            rest.append(pdf.iloc[lo:hi])
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c):
    return F.translate(c, UPPER, UPPER.lower())


def prefix_sum(df: DataFrame, part: list[str], order: list[str], weight: str, out: str, spread: str, buckets: int) -> DataFrame:
    """Exclusive running sum of ``weight`` in each ``part``, without one task per part.

    ``spread`` is a column of type LONG that is uniform over all 64-bit values (a hash); the order
    is (spread, order...). Rows fall into ``buckets`` ranges of ``spread``; the sums of the ranges
    (a small table) give each range's start, and a window inside each range gives the rest, so a part that
    holds most rows is still dealt over ``buckets`` tasks."""
    step = 2**64 // buckets + 1
    bucket = F.floor(F.col(spread) / F.lit(float(step))).cast("long")
    d = df.withColumn("_b", bucket)
    sums = d.groupBy(*part, "_b").agg(F.sum(weight).alias("_w"))
    before = W.partitionBy(*part).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(part)], F.col("_b").alias("_pb"),
                         F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*part, "_b").orderBy(spread, *order).rowsBetween(W.unboundedPreceding, -1)
    on = [d[p].eqNullSafe(starts[f"_p{i}"]) for i, p in enumerate(part)] + [F.col("_b") == F.col("_pb")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = d.withColumn("_in", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(starts, cond)
    return joined.withColumn(out, F.col("_start") + F.col("_in")).drop("_b", "_pb", "_in", "_start", *[f"_p{i}" for i in range(len(part))])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the least node reachable.

    Alternating large-star and small-star steps over the edge table. Every step is a grouped minimum
    (combined before the shuffle) and a join, written to the shared folder; nothing but
    one row of counts reaches the driver. Self links and null ends are ignored."""

    def signature(e):
        r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        return r[0], r[1]

    spark = edges.sparkSession
    e, held = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col("a") != F.col("b")).distinct(), "edges")
    last = signature(e)
    for _ in range(max_rounds if last[0] else 0):
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large, between = stored(large.distinct(), "large")
        discard(spark, held)
        small_low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(small_low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(small_low.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a != b").distinct()
        e, held = stored(small, "small")
        discard(spark, between)
        now = signature(e)
        if now == last:
            break
        last = now
    else:
        if last[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    own = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return own.union(e.select("b", "b").distinct())
