"""Simplification that keeps neighbours together: the border that two areas share is simplified once.

Rings are cut into arcs at the points where more or fewer than two border lines meet. An arc that two rings share has the same points in both, in either direction, so it is one row of the table of arcs. A simplified
arc replaces stretches of its line by chords. A chord is refused, and its stretch kept, if the region between the two holds a point of anything else, or if another arc has the same chord: what
crossed a chord would have a point in one of the two regions. So no accepted chords cross each other or a kept line, and no area changes sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.functions.polygons import _xy, kept_by_simplifying
from gridloom.operators.areas import points_in_areas, ring_edges


def _kept(tolerance: float):
    """A function of a line column: the positions (from 1) of the points that stay."""

    @F.pandas_udf("array<int>")
    def kept(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in lines:
            yield pd.Series([(np.flatnonzero(kept_by_simplifying(_xy(p), tolerance)) + 1).tolist() for p in s])

    return kept


def ring_arcs(vertices: DataFrame) -> DataFrame:
    """``area, ring, arc, points, back``: the arcs of rings (area, ring, k, x, y; open or closed) in order, with their points in the direction that both neighbours agree on; ``back`` where the ring runs the other way.

    A ring with fewer than two meeting points is cut at its least and its greatest point too."""
    edges, own_ring = ring_edges(vertices), W.partitionBy("area", "ring")
    ends = edges.select(F.col("ax").alias("x"), F.col("ay").alias("y"), F.struct("bx", "by").alias("to")).unionAll(edges.select("bx", "by", F.struct("ax", "ay")))
    meeting = ends.groupBy("x", "y").agg(F.count_distinct("to").alias("n")).where("n <> 2").select("x", "y", F.lit(True).alias("meet"))
    v = edges.select("area", "ring", "k", F.col("ax").alias("x"), F.col("ay").alias("y")).join(meeting, ["x", "y"], "left")
    p = F.struct("x", "y")
    few = F.count("meet").over(own_ring) < 2
    v = v.withColumn("meet", F.col("meet").isNotNull() | (few & ((p == F.min(p).over(own_ring)) | (p == F.max(p).over(own_ring)))))
    # places count from the ring's first meeting point
    v = v.withColumns({"pos": F.row_number().over(own_ring.orderBy("k")), "n": F.count("*").over(own_ring)})
    v = v.withColumn("pos", F.pmod(F.col("pos") - F.min(F.when(F.col("meet"), F.col("pos"))).over(own_ring), F.col("n")))
    v = v.withColumns({"arc": F.sum(F.col("meet").cast("int")).over(own_ring.orderBy("pos")), "arcs": F.sum(F.col("meet").cast("int")).over(own_ring)})
    own = F.struct("arc", "pos")
    ended = F.struct(F.when(F.col("arc") == 1, F.col("arcs")).otherwise(F.col("arc") - 1).alias("arc"), F.col("n").alias("pos"))
    each = v.select("area", "ring", "x", "y", F.explode(F.when(F.col("meet"), F.array(own, ended)).otherwise(F.array(own))).alias("at"))
    arcs = each.groupBy("area", "ring", F.col("at.arc").alias("arc")).agg(F.array_sort(F.collect_list(F.struct("at.pos", "x", "y"))).alias("p"))  # an arc is one value
    points = F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    arcs = arcs.select("area", "ring", "arc", points.alias("forth")).withColumn("points", F.least("forth", F.reverse("forth")))
    return arcs.select("area", "ring", "arc", "points", (F.col("points") != F.col("forth")).alias("back"))


def simplified_arcs(arcs: DataFrame, tolerance: float, store) -> DataFrame:
    """``id, points, kept``: each arc once (``id`` is its first edge), the points that stay after refused chords got their stretches back."""
    first = F.struct(F.element_at("points", 1).alias("a"), F.element_at("points", 2).alias("b"))
    one = arcs.select(first.alias("id"), "points").dropDuplicates(["id"])
    one = store(one.withColumn("kept", _kept(tolerance)(F.col("points"))), "arcs")
    chords = one.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("kept") - 1)))
    chords = chords.select("id", "points", F.element_at("kept", F.col("i")).alias("lo"), F.element_at("kept", F.col("i") + 1).alias("hi"))
    ends = F.array_sort(F.array(F.element_at("points", F.col("lo")), F.element_at("points", F.col("hi"))))
    double = chords.withColumn("ends", ends).groupBy("ends").agg(F.collect_set(F.struct("id", "lo", "hi")).alias("c")).where("size(c) > 1").select(F.explode("c").alias("c")).select("c.*")  # arcs between the same two points
    cut = chords.where("hi - lo > 1").withColumn("line", F.slice("points", F.col("lo"), F.col("hi") - F.col("lo") + 1)).select(F.struct("id", "lo", "hi").alias("area"), "line")
    vertices = cut.select("area", F.lit(0).alias("ring"), F.posexplode("line").alias("k", "p")).select("area", "ring", "k", "p.x", "p.y")
    spots = one.select(F.explode("points").alias("p")).select("p.x", "p.y").distinct()
    held = points_in_areas(spots, ring_edges(vertices), ["x", "y"]).join(vertices.select("area", "x", "y"), ["area", "x", "y"], "left_anti").select("area.*")
    refused = double.unionByName(held).distinct().groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("refused"))  # chords of one arc
    both = one.join(refused, "id", "left")
    back = lambda i: F.exists("refused", lambda r: i.between(r["lo"], r["hi"]))
    stays = lambda p, i: F.array_contains("kept", i + 1) | F.coalesce(back(i + 1), F.lit(False))
    return both.select("id", "points", F.filter("points", stays).alias("kept"))


def simplify_areas(vertices: DataFrame, tolerance: float, store) -> DataFrame:
    """``area, ring, points``: closed rings, simplified so that neighbours keep one border: no gap, no overlap, no crossing that was not there. Rings that do not share vertices are neighbours to no one. ``store`` writes a table and reads it back."""
    arcs = store(ring_arcs(vertices), "ring_arcs")
    done = simplified_arcs(arcs, tolerance, store)
    first = F.struct(F.element_at("points", 1).alias("a"), F.element_at("points", 2).alias("b"))
    both = arcs.select("area", "ring", "arc", "back", first.alias("id")).join(done.select("id", "kept"), "id")
    line = F.when(F.col("back"), F.reverse("kept")).otherwise(F.col("kept"))
    g = both.groupBy("area", "ring").agg(F.array_sort(F.collect_list(F.struct("arc", line.alias("p")))).alias("a"))  # a ring is one value of the result
    open_ = F.flatten(F.transform("a", lambda x: F.slice(x["p"], 1, F.size(x["p"]) - 1)))
    return g.select("area", "ring", F.concat(open_, F.slice(open_, 1, 1)).alias("points"))
