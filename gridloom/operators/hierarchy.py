"""Trees of units and relations in relations, of any depth, by joins that double the distance looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def climb(units: DataFrame, store, top_kind: str | None = None, max_rounds: int = 60) -> DataFrame:
    """``id, root, depth, problem`` for each of ``units`` (id, parent_id, kind): the unit without a parent that climbing reaches, and the steps to it.

    ``problem`` is ``missing_parent`` where a unit on the way names a parent that is not there, ``cycle`` where the way comes back to itself, ``kind`` where the root is not of ``top_kind``, else null; the first two have no root.
    Every round doubles the steps of those units that have not arrived; with fewer units than steps what is left can only be on or below a cycle. ``store`` writes a table and reads it back. Ids are unique; null ids play no part."""
    u = units.where("id is not null").select("id", "parent_id", "kind")
    known = u.select(F.col("id").alias("_p"), F.lit(True).alias("there"))
    d = u.join(known, F.col("parent_id") == F.col("_p"), "left")
    lost = F.col("parent_id").isNotNull() & F.col("there").isNull()
    end = F.when(F.col("parent_id").isNull(), "root").when(lost, "missing_parent")
    d = store(d.select("id", F.when(end.isNull(), F.col("parent_id")).otherwise(F.col("id")).alias("at"), F.when(end.isNull(), 1).otherwise(0).cast("long").alias("depth"), end.alias("end")), "climb")
    total = d.count()
    for k in range(max_rounds):
        if 1 << k > total or d.where("end is null").isEmpty():
            break
        on = d.select(F.col("id").alias("_i"), F.col("at").alias("_at"), F.col("depth").alias("_depth"), F.col("end").alias("_end"))
        moved = d.where("end is null").join(on, F.col("at") == F.col("_i")).select("id", F.col("_at").alias("at"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_end").alias("end"))
        d = store(d.where("end is not null").unionByName(moved), f"climb{k}")
    kinds = u.select(F.col("id").alias("_r"), F.col("kind").alias("root_kind"))
    wrong = (F.col("root_kind") != top_kind) | F.col("root_kind").isNull() if top_kind else F.lit(False)
    d = d.join(kinds, (F.col("at") == F.col("_r")) & (F.col("end") == "root"), "left")
    problem = F.when(F.col("end").isNull(), "cycle").when(F.col("end") != "root", F.col("end")).when(wrong, "kind")
    return d.select("id", F.when(F.col("end") == "root", F.col("at")).alias("root"), F.when(F.col("end") == "root", F.col("depth")).alias("depth"), problem.alias("problem"))


def selection_roots(selection: DataFrame, climbed: DataFrame) -> DataFrame:
    """``request_id, n_roots, root, problem`` of selections (request_id, unit): the one root of their units; ``unknown_unit``, the first problem of a unit, or ``several_roots`` otherwise."""
    d = selection.select("request_id", "unit").distinct().join(climbed, F.col("unit") == F.col("id"), "left")
    g = d.groupBy("request_id").agg(F.count_distinct("root").alias("n_roots"), F.min("root").alias("root"), F.bool_or(F.col("id").isNull()).alias("unknown"), F.min("problem").alias("own"))
    problem = F.when(F.col("unknown"), "unknown_unit").otherwise(F.coalesce("own", F.when(F.col("n_roots") > 1, "several_roots")))
    return g.select("request_id", "n_roots", F.when(problem.isNull(), F.col("root")).alias("root"), problem.alias("problem"))


def nested_relations(members: DataFrame, store, max_rounds: int = 60) -> DataFrame:
    """``relation_id, inner``: each relation with itself and every relation below it, through relations that are members of relations (rows relation_id, type, ref), cycles included.

    A round joins the pairs found so far with themselves, so the depth covered doubles; it ends when a round finds no new pair."""
    direct = members.where("type = 'relation'").select("relation_id", F.col("ref").alias("inner"))
    own = members.select("relation_id").distinct().select("relation_id", F.col("relation_id").alias("inner"))
    pairs = store(own.unionByName(direct).distinct(), "pairs")
    count = pairs.count()
    for k in range(max_rounds):
        step = pairs.select(F.col("relation_id").alias("_r"), F.col("inner").alias("_i"))
        pairs = store(pairs.unionByName(pairs.join(step, F.col("inner") == F.col("_r")).select("relation_id", F.col("_i").alias("inner"))).distinct(), f"pairs{k}")
        now = pairs.count()
        if now == count:
            return pairs
        count = now
    raise RuntimeError(f"relations are nested deeper than 2^{max_rounds}")


def member_index(members: DataFrame, way_nodes: DataFrame, store) -> DataFrame:
    """``type, ref, relation_id``: all relations that hold an object, directly or through relations and, for nodes, through ways (way_id, node_id)."""
    pairs = nested_relations(members, store)
    held = pairs.join(members.where("type <> 'relation'").select(F.col("relation_id").alias("inner"), "type", "ref"), "inner").select("type", "ref", "relation_id")
    below = pairs.where("relation_id <> inner").select(F.lit("relation").alias("type"), F.col("inner").alias("ref"), "relation_id")
    nodes = held.where("type = 'way'").join(way_nodes, F.col("ref") == F.col("way_id")).select(F.lit("node").alias("type"), F.col("node_id").alias("ref"), "relation_id")
    return held.unionByName(below).unionByName(nodes).distinct()
