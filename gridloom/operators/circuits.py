"""Evidence of circuits: which of their members are there, whatever their type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("node", "way", "relation")


def circuit_evidence(members: DataFrame, delivered: DataFrame, ways: DataFrame) -> DataFrame:
    """``relation_id, source_id, role, start, end, has_line, lacks_line`` for each member (relation_id, type, ref, role) that is among ``delivered`` (type, ref, gtype; one row for an object).

    A blank role is "member". ``start`` and ``end`` name the end nodes of a way of two nodes at least (``ways``: way_id, first_node, last_node, n_nodes), delivered whole or not. ``has_line`` tells that the object has a line; a way without
    one is marked as lacking it. Members of other types, without a reference, or not delivered are left out, and with them relations that keep none; a member named twice stays twice. All joins are on the object's own number."""
    m = members.where(F.col("type").isin(*KINDS) & F.col("ref").isNotNull())
    there = delivered.select(F.col("type").alias("_t"), F.col("ref").alias("_r"), "gtype")
    d = m.join(there, (F.col("type") == F.col("_t")) & (F.col("ref") == F.col("_r")))
    ends = ways.where("n_nodes >= 2").select(F.lit("way").alias("_wt"), F.col("way_id").alias("_w"), "first_node", "last_node")
    d = d.join(ends, (F.col("type") == F.col("_wt")) & (F.col("ref") == F.col("_w")), "left")
    node = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("node/"), F.col(c).cast("string")))
    line = F.coalesce(F.col("gtype") == "LineString", F.lit(False))
    role = F.when(F.coalesce("role", F.lit("")) == "", "member").otherwise(F.col("role"))
    return d.select("relation_id", F.concat_ws("/", "type", F.col("ref").cast("string")).alias("source_id"), role.alias("role"), node("first_node").alias("start"), node("last_node").alias("end"), line.alias("has_line"), ((F.col("type") == "way") & ~line).alias("lacks_line"))
