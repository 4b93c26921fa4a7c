"""Column functions: names, colours, clicks, percentiles and polygons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DEFAULT_LABEL, DEFAULT_LAYER


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: the optimizer puts a column's expression
    where it is used, which within a lambda would be once an element."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def hex_to_rgb(color: Column) -> Column:
    """A struct r, g, b of ``#rrggbb``; anything else is red."""
    part = lambda at: F.conv(F.substring(color, at, 2), 16, 10).cast("int")
    ok = F.coalesce(color.rlike("^#[0-9a-fA-F]{6}$"), F.lit(False))
    pick = lambda at, other: F.when(ok, part(at)).otherwise(F.lit(other))
    return F.struct(pick(2, 255).alias("r"), pick(4, 0).alias("g"), pick(6, 0).alias("b"))


def normalize_name(name: Column, default: str) -> Column:
    """Trimmed; null or empty is the default."""
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(default))


def normalize_layer(name: Column) -> Column:
    return normalize_name(name, DEFAULT_LAYER)


def normalize_label(name: Column) -> Column:
    return normalize_name(name, DEFAULT_LABEL)


def label_filter(text: Column) -> Column:
    """The labels a comma list names, or null for no filter (empty, ``all``, only commas)."""
    names = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.lower(F.trim(text)).isin("", "all") | (F.size(names) == 0), None).otherwise(names)


def in_filter(label: Column, names: Column) -> Column:
    """Labels match exactly; no filter lets all through."""
    return names.isNull() | F.coalesce(F.array_contains(names, label), F.lit(False))


def viewport_to_pixel(cx: Column, cy: Column, ox: Column, oy: Column, vw: Column, vh: Column, w: Column, h: Column) -> Column:
    """The pixel under a click in a viewport at (ox, oy) of size vw x vh; null outside it."""
    inside = (cx >= ox) & (cy >= oy) & (cx < ox + vw) & (cy < oy + vh)
    at = lambda c, o, size, n: F.greatest(F.lit(0), F.least(n - 1, F.floor((c - o) / size * n))).cast("int")
    return F.when(inside, F.struct(at(cx, ox, vw, w).alias("x"), at(cy, oy, vh, h).alias("y")))


def percentile(values: Column, q: float) -> Column:
    """Of an array, interpolated between neighbours; null if it is empty. One row's work: no shuffle."""
    a = F.array_sort(values)
    at = (F.size(values) - 1) * q
    low = F.floor(at).cast("int")
    below, above = F.get(a, low).cast("double"), F.get(a, F.ceil(at).cast("int")).cast("double")
    return F.when(F.size(values) > 0, below + (above - below) * (at - low))


def _edges(points: Column, start: Column, step) -> Column:
    """Fold over the edges (i, j) of a closed polygon."""
    n = F.size(points)

    def each(acc: Column, i: Column) -> Column:
        j = F.when(i == 0, n - 1).otherwise(i - 1)
        return step(acc, F.get(points, i.cast("int")), F.get(points, j.cast("int")))

    return F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), start, each)


def polygon_area(points: Column) -> Column:
    """Shoelace area; 0 for fewer than 3 points."""
    twice = lambda own: _edges(own, F.lit(0.0), lambda acc, p, q: acc + (q["x"] * p["y"] - p["x"] * q["y"]).cast("double"))
    return let(points, lambda own: F.when(F.size(own) >= 3, F.abs(twice(own)) / 2).otherwise(F.lit(0.0)))


def point_in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Even-odd rule: left and top edges are inside, right and bottom ones are not."""

    def step(acc: Column, p: Column, q: Column) -> Column:
        crosses = (p["y"] > y) != (q["y"] > y)
        at = (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0)) + p["x"]
        return F.when(crosses & (x < at), ~acc).otherwise(acc)

    return F.coalesce(let(points, lambda own: (F.size(own) >= 3) & _edges(own, F.lit(False), step)), F.lit(False))
