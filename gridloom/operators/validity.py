"""Validity of lines and rings of any length: sides meet by grid cells, never all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.areas import line_cells

#: Points of a line, at most, whose sides are compared in the line's own row.
SHORT = 32


def line_sides(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """``keys, k, n, closed, ax, ay, bx, by``: the sides of arrays of points (struct x, y), numbered from 1; repeated points make no side. ``closed`` where the last point is the first."""
    p = F.col(line)
    d = lines.where(F.size(p) >= 2).select(*keys, F.size(p).alias("n"), (F.element_at(p, 1) == F.element_at(p, -1)).alias("closed"), F.posexplode(F.arrays_zip(F.slice(p, F.lit(1), F.size(p) - 1).alias("a"), F.slice(p, F.lit(2), F.size(p) - 1).alias("b"))).alias("k", "s"))
    return d.select(*keys, (F.col("k") + 1).alias("k"), (F.col("n") - 1).alias("n"), "closed", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by")).where("ax <> bx or ay <> by")


def crossing_lines(sides: DataFrame, keys: list[str]) -> DataFrame:
    """The ``keys`` of lines (:func:`line_sides`) of which two sides that are not neighbours cross each other; ends that only touch a side are no crossing on one of its sides.

    Each side is dealt to the cells that it crosses of a grid as wide as its line's sides are on average, and sides are compared in a cell. So a ring of many short sides takes time in proportion to them."""
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    level = sides.groupBy(*keys).agg(F.floor(F.log2(F.greatest(F.avg(length), F.lit(1e-12)))).cast("int").alias("level"))
    laid = line_cells(sides.join(level, keys), ("ax", "ay", "bx", "by")).drop("level")
    other = laid.select(*keys, "cx", "cy", *[F.col(c).alias(f"o_{c}") for c in ("k", "ax", "ay", "bx", "by")])
    pair = laid.join(other, [*keys, "cx", "cy"]).where("o_k > k + 1 and not (closed and k = 1 and o_k = n)")
    x = {c: F.col(c) for c in ("ax", "ay", "bx", "by", "o_ax", "o_ay", "o_bx", "o_by")}
    turn = lambda px, py, qx, qy, rx, ry: (x[qx] - x[px]) * (x[ry] - x[py]) - (x[qy] - x[py]) * (x[rx] - x[px]) > 0
    cross = ((turn("ax", "ay", "bx", "by", "o_ax", "o_ay") != turn("ax", "ay", "bx", "by", "o_bx", "o_by")) & (turn("o_ax", "o_ay", "o_bx", "o_by", "ax", "ay") != turn("o_ax", "o_ay", "o_bx", "o_by", "bx", "by")))
    return pair.where(cross).select(*keys).distinct()


def _crosses(line: Column) -> Column:
    """Whether two sides of a short line cross, as :func:`crossing_lines` tells it."""
    n = F.size(line) - 1
    turn = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]) > 0
    at = lambda i: F.element_at(line, i)
    apart = lambda p, q: (p["x"] != q["x"]) | (p["y"] != q["y"])

    def cross(i, j):
        a, b, c, d = at(i), at(i + 1), at(j), at(j + 1)
        ends = (i == 1) & (j == n) & (at(F.lit(1)) == at(F.lit(-1)))
        return ~ends & apart(a, b) & apart(c, d) & (turn(a, b, c) != turn(a, b, d)) & (turn(c, d, a) != turn(c, d, b))

    pairs = lambda i: F.exists(F.sequence(i + 2, n), lambda j: cross(i, j))
    return F.when(n < 3, False).otherwise(F.exists(F.sequence(F.lit(1), n - 2), pairs))


def with_crossing(lines: DataFrame, keys: list[str], line: str = "line", name: str = "self_crossing") -> DataFrame:
    """``lines`` with a boolean column ``name``: whether two sides of the line cross. Short lines are told in their own row, others by cells."""
    short = F.size(line) <= SHORT
    found = crossing_lines(line_sides(lines.where(~short), keys, line), keys).select(*[F.col(c).alias(f"_c_{c}") for c in keys], F.lit(True).alias("_x"))
    on = F.lit(True)
    for c in keys:
        on = on & (F.col(c) == F.col(f"_c_{c}"))
    return lines.join(found, on, "left").withColumn(name, F.coalesce(F.when(short, _crosses(F.col(line))).otherwise(F.col("_x")), F.lit(False))).drop("_x", *[f"_c_{c}" for c in keys])


def kind_or_line(kind: Column, line: str = "line", crossing: str = "self_crossing") -> Column:
    """The geometry kind of a way: a polygon that is not valid (sides that cross, or fewer than three places) is taken as a line."""
    places = F.size(F.array_distinct(F.transform(F.col(line), lambda p: F.struct(p["x"], p["y"]))))
    return F.when((kind == "Polygon") & (F.col(crossing) | (places < 3)), "LineString").otherwise(kind)
