"""K-d tree sharding with DataFrame functions only.

The rows of a node are cut at a weighted median (or another quantile, where the leaves do not halve) along its widest dimension of text metadata, and its parts again, until each
leaf is one shard. All nodes of a level are cut together: grouped histograms (combined before the shuffle) narrow the range that holds each cut. Nodes are rows of small
tables beside the data, one for each node of a level, so neither plans nor the driver grow with the tree. A row's coordinate along a dimension is a 62-bit
integer: the scaled dimension first, then, to tell ties apart, a hash of the text and a hash of the row (for rows that repeat, with their number). So rows of equal text lie together and
stay in one shard, unless their group is so large that this would unbalance the shards; then the group itself is cut, be it of one row many times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.llm.common import discard, materialize, prefix_sum, stored, table

BINS = 2048
#: A cut moves to the edge of a group of equal texts if this changes a part by no more than this share of a leaf.
GROUP_TOLERANCE = 0.1
_DIM, _GROUP, _ROW = 16, 17, 29


def text_dimensions(text, size):
    """Metadata of a text: bytes (logarithmic), bytes per code point, mean length of a line (logarithmic)."""
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return [F.log2(size.cast("double")), F.octet_length(text) / F.greatest(F.length(text), F.lit(1)), F.log2(F.length(text) / lines + 1)]


def coordinate(x, lo: float, hi: float, text_hash, row_hash):
    """Dimension (scaled to lo..hi), group and row in one sortable number."""
    cells = 1 << _DIM
    part = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * cells), F.lit(cells - 1)) if hi > lo else F.lit(0)
    return F.shiftleft(part.cast("long"), _GROUP + _ROW) + F.shiftleft(F.shiftrightunsigned(text_hash, 64 - _GROUP), _ROW) + F.shiftrightunsigned(row_hash, 64 - _ROW)


def _beside(d: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``nodes`` with their node's numbers and ``key``, the coordinate along its dimension. The planner knows the size of the stored
    table of nodes and broadcasts it while it is small; a larger one has so many nodes that a shuffle by node spreads the rows."""
    both = d.join(nodes.withColumnRenamed("slot", "node"), F.col("slot") == F.col("node"))
    return both.withColumn("key", F.element_at(F.array(*keys), F.col("dim") + 1))


def _narrow(d: DataFrame, nodes: DataFrame, keys: list[str], weight: str, wide) -> DataFrame:
    """``nodes`` with lo..hi narrowed to the bin that holds their goal, until none is ``wide``; ``before`` is the weight below lo.

    A round makes one histogram of at most BINS bins for each node; its running sums are over those bins, never over rows."""
    while not nodes.where(wide).isEmpty():
        rows = _beside(d, nodes.where(wide).select("slot", "dim", "lo", "hi", "before", "goal"), keys).where("key between lo and hi")
        rows = rows.withColumn("b", F.expr(f"(key - lo) div ((hi - lo) div {BINS} + 1)"))
        bins = rows.groupBy("node", "before", "goal", "b").agg(F.sum(weight).alias("w"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        run = F.coalesce(F.sum("w").over(W.partitionBy("node").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        best = bins.withColumn("below", F.col("before") + run).where("below <= goal").groupBy("node").agg(F.max(F.struct("b", "lo", "hi", "below")).alias("x"))
        both = nodes.join(best, F.col("slot") == F.col("node"), "left")
        nodes = materialize(both.withColumns({"lo": F.coalesce("x.lo", "lo"), "hi": F.coalesce("x.hi", "hi"), "before": F.coalesce("x.below", "before")}).drop("x", "node"), "narrowed")
    return nodes


def _cuts(d: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``slot, dim, cut`` of each node that has more than one leaf: rows up to ``cut`` along dimension ``dim`` go left."""
    ends = [f(k).alias(f"{f.__name__}{i}") for i, k in enumerate(keys) for f in (F.min, F.max)]
    stat = d.where("n > 1").groupBy("slot", "n").agg(F.sum(weight).alias("w"), *ends)
    part = lambda c: F.shiftright(c, _GROUP + _ROW)
    wide = F.array_max(F.array(*[F.struct((part(f"max{i}") - part(f"min{i}")).alias("x"), F.lit(-i).alias("i")) for i in range(len(keys))]))
    at = lambda f: F.element_at(F.array(*[f"{f}{i}" for i in range(len(keys))]), F.col("dim") + 1)
    nodes = stat.withColumn("dim", -wide["i"]).select("slot", "dim", at("min").alias("lo"), at("max").alias("hi"), F.lit(0).cast("long").alias("before"),
                                                      F.expr("w * (n div 2) / n").alias("goal"), (F.col("w") / F.col("n")).alias("leaf"))
    group = lambda c: F.shiftright(c, _ROW)
    nodes = _narrow(d, materialize(nodes, "nodes"), keys, weight, group("lo") != group("hi"))
    # the weight before and of the one group that holds each cut
    rows = _beside(d, nodes.select("slot", "dim", group("lo").alias("g")), keys)
    mine = group("key") == F.col("g")
    edge = rows.groupBy("node").agg(F.coalesce(F.sum(F.when(group("key") < F.col("g"), F.col(weight))), F.lit(0)).alias("a"), F.sum(F.when(mine, F.col(weight))).alias("w"),
                                    F.min(F.when(mine, F.col("key"))).alias("lo"), F.max(F.when(mine, F.col("key"))).alias("hi"))
    nodes = nodes.select("slot", "dim", "goal", "leaf").join(edge, F.col("slot") == F.col("node")).withColumnRenamed("a", "before")
    left, right = F.col("goal") - F.col("before"), F.col("before") + F.col("w") - F.col("goal")
    whole = (F.least(left, right) <= GROUP_TOLERANCE * F.col("leaf")) | (F.col("lo") == F.col("hi"))
    side = F.shiftleft(group("lo") + F.when(left < right, 0).otherwise(1), _ROW) - 1
    nodes = materialize(nodes.withColumn("cut", F.when(whole, side)).select("slot", "dim", "lo", "hi", "before", "goal", "cut"), "groups")
    nodes = _narrow(d, nodes, keys, weight, F.col("cut").isNull() & (F.col("lo") != F.col("hi")))
    return nodes.select("slot", "dim", F.coalesce("cut", "hi").alias("cut"))


def kd_tree_shards(rows: DataFrame, keys: list[str], weight: str, leaves: int) -> DataFrame:
    """``rows`` with a column ``shard`` (0 to leaves - 1). ``keys`` are columns made by :func:`coordinate`, ``weight`` is a whole number above 0.

    Any number of leaves will do. An empty table keeps no row and no cut. With fewer rows than leaves some shards stay empty. Only ties of a whole coordinate are not parted; coordinates that end with a row's number have none but by chance."""
    if leaves < 1:
        raise ValueError("at least one leaf")
    spark = rows.sparkSession
    d = rows.withColumns({"slot": F.lit(1).cast("long"), "first": F.lit(0).cast("long"), "n": F.lit(leaves).cast("long")})
    held = None
    for level in range((leaves - 1).bit_length()):
        cuts = materialize(_cuts(d, keys, weight), "cuts").withColumnRenamed("slot", "node")
        both = d.join(cuts, F.col("slot") == F.col("node"), "left")
        right = F.element_at(F.array(*keys), F.col("dim") + 1) > F.col("cut")
        half, known = F.expr("n div 2"), F.col("cut").isNotNull()
        moved = both.withColumns({
            "slot": F.when(known, 2 * F.col("slot") + right.cast("long")).otherwise(F.col("slot")),
            "first": F.when(known & right, F.col("first") + half).otherwise(F.col("first")),
            "n": F.when(known, F.when(right, F.col("n") - half).otherwise(half)).otherwise(F.col("n")),
        }).drop("node", "dim", "cut")
        d, path = stored(moved, f"level{level}")
        if held:
            discard(spark, held)
        held = path
    return d.withColumnRenamed("first", "shard").drop("slot", "n")


def shard_documents(docs: DataFrame, leaves: int | None = 24, id_col: str = "doc_id", text_col: str = "text", target_bytes: int = 512 << 20) -> DataFrame:
    """``id, size, text_crc32, shard, slot`` for every row of ``docs``.

    ``size`` is the bytes of the text plus 8 (null: none); a null text counts as empty, its crc is 0. ``leaves`` None takes as many shards as ``target_bytes`` asks for.
    Shards differ by little in bytes, given the sizes of single rows; one very long text may outweigh a shard's share. ``slot`` numbers the rows of a shard from 0 without gaps. Null ids
    stay null; they and repeated rows are kept as rows, and the law holds for them too: rows that repeat are told apart by a number, so that their group can be cut. An empty table gives an empty result; other columns play no part."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"))
    rows = rows.select("id", (F.octet_length("t") + F.lit(8)).cast("long").alias("size"), F.crc32(F.encode("t", "UTF-8")).alias("text_crc32"), F.xxhash64("id", "t").alias("spread"),
                       F.xxhash64("t", F.lit("group")).alias("h"), "t")
    dims = text_dimensions(F.col("t"), F.col("size"))
    meta, held = stored(rows.select("id", "size", "text_crc32", "spread", "h", F.monotonically_increasing_id().alias("m"), *[x.alias(f"x{i}") for i, x in enumerate(dims)]), "meta")
    again = meta.groupBy(F.col("spread").alias("_s")).agg(F.count("*").alias("_c")).where("_c > 1")
    apart = F.when(F.col("_c").isNotNull(), F.xxhash64("spread", "m")).otherwise(F.col("spread"))
    rows = materialize(meta.join(again, F.col("spread") == F.col("_s"), "left").withColumn("spread", apart).drop("_s", "_c", "m"), "rows")
    discard(meta.sparkSession, held)
    ends = [f(f"x{i}") for i in range(len(dims)) for f in (F.min, F.max)]
    n, total, *ends = rows.agg(F.count("*"), F.sum("size"), *ends).first()
    if leaves is None:
        leaves = max(1, -(-(total or 0) // target_bytes))
    place = [coordinate(F.col(f"x{i}"), ends[2 * i] or 0.0, ends[2 * i + 1] or 0.0, F.col("h"), F.col("spread")).alias(f"key{i}") for i in range(len(dims))]
    keys = [f"key{i}" for i in range(len(dims))]
    placed = kd_tree_shards(rows.select("id", "size", "text_crc32", "spread", *place), keys, "size", leaves).drop(*keys).withColumn("one", F.lit(1).cast("long"))
    return prefix_sum(placed, ["shard"], ["id", "size"], "one", "slot", "spread", max(16, n // 50_000)).select("id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")


def op2_kd_sharding(spark, sf_dir: str) -> DataFrame:
    d = shard_documents(table(spark, sf_dir, "documents"), leaves=24)
    return d.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
