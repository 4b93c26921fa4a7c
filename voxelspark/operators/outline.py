"""Filled parts and outlines of masks, on runs.

The outside of a mask are the 4-connected parts of its complement that reach the border;
what is not outside is the mask with its holes, and what lies in them, filled. An
8-connected part without holes has one boundary. Its edges are the ends of its runs: the
boundary goes down at right ends and up at left ones, and from each end the runs touching
it above or below, and the run beside it, tell the next. So every end has one successor,
found by joins of neighbouring rows. Their order is found by pointer doubling within the
part's row: in a round every end learns how far the end after its successor is, so ends
of a part take as many rounds as their number has bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import polygon_area
from . import masks
from .rows import let

POINTS = "array<struct<x: int, y: int>>"


def fill_holes(runs: DataFrame, grid: DataFrame) -> DataFrame:
    """Pixels that the border can't be reached from by 4-connected steps beside the mask.
    ``grid`` has the images (v, z, h, w)."""
    beside = masks.components(masks.complement(runs, grid), diagonal=False).join(grid.select("v", "z", "h", "w"), ["v", "z"])
    border = (F.col("y") == 0) | (F.col("y") == F.col("h") - 1) | (F.col("x0") == 0) | (F.col("x1") == F.col("w") - 1)
    reached = F.max(border).over(Window.partitionBy("v", "z", "component"))
    outside = beside.withColumn("_out", reached).where("_out").select("v", "z", "y", "x0", "x1")
    return masks.complement(outside, grid)


def parts(runs: DataFrame, grid: DataFrame) -> DataFrame:
    """8-connected parts of the filled mask as runs (v, z, component, y, x0, x1)."""
    return masks.components(fill_holes(runs, grid), diagonal=True)


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))


def _lines(own: DataFrame) -> DataFrame:
    """(v, z, component, lines): each part's lines of pixels downwards, with their runs,
    numbered through the part. One shuffle, by part."""
    part = ["v", "z", "component"]
    i = (F.row_number().over(Window.partitionBy(*part).orderBy("y", "x0")) - 1).cast("int")
    line = own.withColumn("i", i).groupBy(*part, "y").agg(F.array_sort(F.collect_list(F.struct("x0", "x1", "i"))).alias("runs"))
    return line.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct("y", "runs"))).alias("lines"))


def _with_near(lines: str) -> Column:
    """The runs of all lines in order, each with its line's y, the last run that touches it
    below, the first that does above, and the runs beside it."""

    def near(r: Column, j: Column, line: Column, k: Column) -> Column:
        touching = lambda at: F.filter(F.get(lines, at)["runs"], lambda s: (s["x0"] <= r["x1"] + 1) & (s["x1"] >= r["x0"] - 1))
        below = F.get(F.reverse(touching(k + 1)), F.lit(0))
        above = F.get(F.when(k > 0, touching(k - 1)), F.lit(0))
        after, before = F.get(line["runs"], j + 1), F.get(line["runs"], j - 1)
        return F.struct(r["x0"].alias("x0"), r["x1"].alias("x1"), r["i"].alias("i"), line["y"].alias("y"), below.alias("down"), above.alias("up"), after.alias("after"), before.alias("before"))

    return F.flatten(F.transform(lines, lambda line, k: F.transform(line["runs"], lambda r, j: near(r, j, line, k))))


def _ends(runs: Column) -> Column:
    """The left (even) and right (odd) ends of a part's runs in order: node, the end that
    follows clockwise (next), and the corners from one to the other (points)."""
    end = lambda node, then, points: F.struct(node.cast("int").alias("node"), then.cast("int").alias("next"), points.alias("points"))
    left, right = (lambda r: 2 * r["i"]), (lambda r: 2 * r["i"] + 1)

    def of_run(r: Column) -> Column:
        x0, x1, y, down, up, after, before = (r[c] for c in ("x0", "x1", "y", "down", "up", "after", "before"))
        # From a right end down to the last run that touches below, or over it to the next run.
        over = after.isNotNull() & (after["x0"] <= down["x1"] + 1)
        going_down = F.when(down.isNull(), left(r)).when(over, left(after)).otherwise(right(down))
        more = F.when(over, F.array(_point(x1 + 1, y + 1), _point(after["x0"] - 1, y + 1))).when(down["x1"] > x1, F.array(_point(x1 + 1, y + 1))).when(down["x1"] < x1, F.array(_point(down["x1"] + 1, y)))
        down_points = F.concat(F.array(_point(x1, y)), F.coalesce(more, F.array().cast(POINTS)))
        # From a left end up to the first run that touches above, or under it to the run before.
        under = before.isNotNull() & (before["x1"] >= up["x0"] - 1)
        going_up = F.when(up.isNull(), right(r)).when(under, right(before)).otherwise(left(up))
        more = F.when(under, F.array(_point(x0 - 1, y - 1), _point(before["x1"] + 1, y - 1))).when(up["x0"] < x0, F.array(_point(x0 - 1, y - 1))).when(up["x0"] > x0, F.array(_point(up["x0"] - 1, y)))
        up_points = F.concat(F.array(_point(x0, y)), F.coalesce(more, F.array().cast(POINTS)))
        return F.array(end(left(r), going_up, up_points), end(right(r), going_down, down_points))

    return F.flatten(F.transform(runs, of_run))


def _in_order(ends: Column) -> Column:
    """The corners of ends (node, next, points; by node) from node 0 on, by pointer doubling."""
    # The chain is cut before node 0: its last end follows itself.
    start = F.transform(ends, lambda e: F.struct(F.when(e["next"] == 0, e["node"]).otherwise(e["next"]).alias("to"), F.when(e["next"] == 0, 0).otherwise(1).alias("far")))
    rounds = F.greatest(F.ceil(F.log2(F.size(ends).cast("double"))).cast("int"), F.lit(1))
    jump = lambda s, _: F.transform(s, lambda e: F.struct(F.get(s, e["to"])["to"].alias("to"), (e["far"] + F.get(s, e["to"])["far"]).alias("far")))
    ranked = F.aggregate(F.sequence(F.lit(1), rounds), start, jump)
    placed = F.array_sort(F.zip_with(ends, ranked, lambda e, r: F.struct((-r["far"]).alias("at"), e["points"].alias("points"))))
    return F.flatten(F.transform(placed, lambda e: e["points"]))


def _open(path: Column) -> Column:
    """A closed path without points that repeat the one before, the last before the first."""
    apart = F.filter(path, lambda q, i: (i == 0) | (q != F.get(path, F.greatest(i - 1, F.lit(0)))))
    last = lambda p: (F.size(p) > 1) & (F.get(p, F.size(p) - 1) == F.get(p, F.lit(0)))
    return let(apart, lambda p: F.slice(p, F.lit(1), F.size(p) - last(p).cast("int")))


def _corners(path: Column) -> Column:
    """A closed path without points on a straight stretch."""
    n = F.size(path)
    sign = lambda a, b, c: F.signum((b[c] - a[c]).cast("double"))
    turns = lambda a, p, b: (sign(a, p, "x") != sign(p, b, "x")) | (sign(a, p, "y") != sign(p, b, "y"))
    bent = F.filter(path, lambda p, i: turns(F.get(path, F.pmod(i - 1, n)), p, F.get(path, F.pmod(i + 1, n))))
    return F.when(n < 3, path).otherwise(bent)


def outlines(own: DataFrame, min_points: int = 1, min_area: float = 0) -> DataFrame:
    """(v, z, component, points, area, lines): the outline of each part (v, z, component, y,
    x0, x1) that has no holes, through the centres of its pixels, clockwise from its first
    pixel; those with too few points or too small an area are left out."""
    path = let(_ends(_with_near("lines")), lambda e: let(_in_order(e), lambda p: let(_open(p), _corners)))
    found = let(path, lambda p: F.struct(p.alias("points"), polygon_area(p).alias("area")))
    kept = F.filter(F.array(found), lambda x: (F.size(x["points"]) >= min_points) & (x["area"] >= min_area))
    # An explode of one element: what has been worked out is not worked out again to filter.
    return _lines(own).select("v", "z", "component", F.explode_outer(kept).alias("x"), "lines").where("x is not null").select("v", "z", "component", "x.points", "x.area", "lines")


def polygons(runs: DataFrame, grid: DataFrame, min_area: float) -> DataFrame:
    """(v, z, part, points): outer outlines of a mask with at least 3 points and this
    area, in the order of their first pixels. Holes and what lies in them have none."""
    place = F.row_number().over(Window.partitionBy("v", "z").orderBy("component")) - 1
    return outlines(parts(runs, grid), 3, min_area).select("v", "z", place.cast("int").alias("part"), "points")


def committed(runs: DataFrame, grid: DataFrame, min_area: float) -> DataFrame:
    """What a commit stores of a mask, as runs: parts with their holes filled, those whose
    outline is too small left out. An outline drawn again covers its part, no more."""
    lines = outlines(parts(runs, grid), 3, min_area).select("v", "z", F.explode("lines").alias("line"))
    return lines.select("v", "z", "line.y", F.explode("line.runs").alias("r")).select("v", "z", "y", "r.x0", "r.x1")
