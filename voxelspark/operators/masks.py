"""Masks as tables of horizontal runs (v, z, y, x0, x1), ends inclusive.

Union, intersection, morphology and rasterising are joins and windows on runs; pixels
are not exploded. ``shape`` arguments are columns or numbers of a slice's height and width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normalize_layer, point_in_polygon, polygon_area
from ..schema import ALL_LAYERS
from . import imaging

KEYS = ("v", "z")


def bbox(runs: DataFrame, *keys: str) -> DataFrame:
    """The inclusive box of each mask: keys, x1, y1, x2, y2. An empty mask has no row."""
    return runs.groupBy(*(keys or KEYS)).agg(F.min("x0").alias("x1"), F.min("y").alias("y1"), F.max("x1").alias("x2"), F.max("y").alias("y2"))


def bbox_to_runs(boxes: DataFrame, h: Column | int, w: Column | int) -> DataFrame:
    """Boxes clamped to the image, ends swapped if reversed, filled inclusively."""
    clamp = lambda c, n: F.least(F.greatest(F.col(c), F.lit(0)), n - F.lit(1))
    n_h, n_w = (F.lit(n) if isinstance(n, int) else n for n in (h, w))
    xs, ys = [[clamp(f"{a}{k}", n) for k in (1, 2)] for a, n in (("x", n_w), ("y", n_h))]
    rows = F.explode(F.sequence(F.least(*ys), F.greatest(*ys))).alias("y")
    rest = [c for c in boxes.columns if c not in ("x1", "y1", "x2", "y2")]
    return boxes.select(*rest, F.least(*xs).alias("x0"), F.greatest(*xs).alias("x1"), rows)


def sanitize_bbox(box: Column, h: Column, w: Column) -> Column:
    """A checked box as a struct: four whole numbers, clamped and ordered; null if it is
    anything else or has no width or height (a box of one pixel is rejected here)."""
    n = [F.get(box, k).try_cast("int") for k in range(4)]
    clamp = lambda c, size: F.least(F.greatest(c, F.lit(0)), size - 1)
    (xa, xb), (ya, yb) = [(clamp(n[k], size), clamp(n[k + 2], size)) for k, size in ((0, w), (1, h))]
    made = F.struct(F.least(xa, xb).alias("x1"), F.least(ya, yb).alias("y1"), F.greatest(xa, xb).alias("x2"), F.greatest(ya, yb).alias("y2"))
    whole = n[0].isNotNull() & n[1].isNotNull() & n[2].isNotNull() & n[3].isNotNull()
    return F.when((F.size(box) == 4) & whole & (xa != xb) & (ya != yb), made)


def union(runs: DataFrame, *keys: str) -> DataFrame:
    """Overlapping and touching runs of a row merged: gaps and islands."""
    keys = keys or KEYS
    order = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col("x0") > reach + 1), 1).otherwise(0)
    marked = runs.select(*keys, "y", "x0", "x1", begins.alias("_new"))
    islands = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "y", "_island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_island")


def intersect(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Pixels in both masks."""
    keys = keys or KEYS
    sides = [m.select(*keys, "y", "x0", "x1", F.lit(k).alias("side")) for k, m in enumerate((a, b))]
    return common(sides[0].unionByName(sides[1]), *keys)


def common(runs: DataFrame, *keys: str) -> DataFrame:
    """Pixels in the masks of both sides (``side``: 0 or 1). Merged runs of a side are apart,
    so of two that overlap the later one finds the other as the last before it: a window, no
    join. What is found are ends of merged runs and apart as well."""
    keys = keys or KEYS
    before = Window.partitionBy(*keys, "y").orderBy("x0", "side").rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.last(F.when(F.col("side") == k, F.col("x1")), ignorenulls=True).over(before) for k in (0, 1)]
    other = F.when(F.col("side") == 0, reach[1]).otherwise(reach[0])
    met = union(runs, *keys, "side").withColumn("_reach", other).where("_reach >= x0")
    return met.select(*keys, "y", "x0", F.least("x1", "_reach").alias("x1"))


def complement(runs: DataFrame, grid: DataFrame) -> DataFrame:
    """Pixels of each image of ``grid`` (v, z, h, w) in no run."""
    rows = grid.select("v", "z", "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    merged = union(runs).groupBy("v", "z", "y").agg(F.array_sort(F.collect_list(F.struct("x0", "x1"))).alias("own"))
    joined = rows.join(merged, ["v", "z", "y"], "left").withColumn("own", F.coalesce("own", F.array().cast("array<struct<x0:int,x1:int>>")))
    starts = F.concat(F.array(F.lit(0)), F.transform("own", lambda r: (r["x1"] + 1).cast("int")))
    ends = F.concat(F.transform("own", lambda r: (r["x0"] - 1).cast("int")), F.array((F.col("w") - 1).cast("int")))
    gaps = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("x0"), b.alias("x1"))), lambda r: r["x0"] <= r["x1"])
    return joined.select("v", "z", "y", F.explode(gaps).alias("r")).select("v", "z", "y", "r.x0", "r.x1")


def box_kernel(iterations: int = 1) -> list[tuple[int, int]]:
    """(dy, half width) rows of ``iterations`` 3 x 3 boxes, which is one larger box."""
    return [(dy, iterations) for dy in range(-iterations, iterations + 1)]


def ellipse_kernel(k: int) -> list[tuple[int, int]]:
    r = k // 2
    return [(dy, round(r * (1 - dy * dy / (r * r)) ** 0.5) if r else 0) for dy in range(-r, r + 1)]


def dilate(runs: DataFrame, grid: DataFrame, kernel: list[tuple[int, int]]) -> DataFrame:
    """Every run spread by the kernel's rows and clipped to its image."""
    rows = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(hw).alias("hw")) for dy, hw in kernel])).alias("k")
    spread = runs.join(grid.select("v", "z", "h", "w"), ["v", "z"]).select("v", "z", "h", "w", "y", "x0", "x1", rows)
    moved = spread.select("v", "z", "h", (F.col("y") + F.col("k.dy")).alias("y"), F.greatest(F.lit(0), F.col("x0") - F.col("k.hw")).alias("x0"), F.least(F.col("w") - 1, F.col("x1") + F.col("k.hw")).alias("x1"))
    return union(moved.where("y >= 0 and y < h").drop("h"))


def erode(runs: DataFrame, grid: DataFrame, kernel: list[tuple[int, int]]) -> DataFrame:
    """Pixels whose kernel lies in the mask; what is outside the image does not constrain."""
    return complement(dilate(complement(runs, grid), grid, kernel), grid)


def opened(runs: DataFrame, grid: DataFrame, kernel: list[tuple[int, int]]) -> DataFrame:
    return dilate(erode(runs, grid, kernel), grid, kernel)


def closed(runs: DataFrame, grid: DataFrame, kernel: list[tuple[int, int]]) -> DataFrame:
    return erode(dilate(runs, grid, kernel), grid, kernel)


def components(runs: DataFrame, diagonal: bool = True) -> DataFrame:
    """Adds ``component``: the least number of a run (in order of y, x0) it is connected
    to within its slice. A slice is one bounded image, so its runs are joined in a task."""
    reach = 1 if diagonal else 0

    def join_runs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x0"], ignore_index=True)
        parent = list(range(len(pdf)))

        def find(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        rows: dict[int, list[int]] = {}
        for k, y in enumerate(pdf["y"]):
            rows.setdefault(y, []).append(k)
        x0, x1 = pdf["x0"].tolist(), pdf["x1"].tolist()
        for y, own in rows.items():
            above, at = rows.get(y - 1, []), 0
            for k in own:
                while at < len(above) and x1[above[at]] + reach < x0[k]:
                    at += 1
                near = at
                while near < len(above) and x0[above[near]] <= x1[k] + reach:
                    a, b = find(k), find(above[near])
                    parent[max(a, b)] = min(a, b)
                    near += 1
        return pdf.assign(component=[find(k) for k in range(len(pdf))])[["v", "z", "y", "x0", "x1", "component"]]

    merged = union(runs)
    types = dict(merged.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in ("v", "z", "y", "x0", "x1")) + ", component long"
    return merged.select("v", "z", "y", "x0", "x1").groupBy("v", "z").applyInPandas(join_runs, schema)


#: Rows of pixels, counted an edge, that a task draws at once.
DRAWN = 1_000_000


def rasterize(overlays: DataFrame) -> DataFrame:
    """Runs of each polygon (keys and seq kept): pixels whose centre is inside by the
    even-odd rule or lies on an edge. Fewer than 3 points make none. A polygon is one row
    and is drawn in its task: no shuffle."""
    drawn = overlays.where(F.size("points") >= 3).select("v", "z", "seq", F.transform("points", lambda q: q["x"]).alias("xs"), F.transform("points", lambda q: q["y"]).alias("ys"))
    schema = ", ".join(f"{c} {kind}" for c, kind in drawn.dtypes[:3]) + ", y int, x0 bigint, x1 bigint"

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, (xs, ys) = batch.select(["v", "z", "seq"]), (batch.column(c) for c in ("xs", "ys"))
            sizes = pc.list_value_length(xs).to_numpy()
            whole = lambda c: pc.fill_null(c.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            known = pc.and_(xs.flatten().is_valid(), ys.flatten().is_valid()).to_numpy(zero_copy_only=False)
            for of, y, x0, x1 in imaging.polygon_runs(sizes, whole(xs), whole(ys), known, DRAWN):
                own = keys.take(pa.array(of))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(y, pa.int32()), pa.array(x0), pa.array(x1)], ["v", "z", "seq", "y", "x0", "x1"])

    return drawn.mapInArrow(draw, schema)


def keep_large(overlays: DataFrame, min_area: float) -> DataFrame:
    """Polygons of at least 3 points and this shoelace area."""
    return overlays.where((F.size("points") >= 3) & (polygon_area(F.col("points")) >= min_area))


def hit_test(points: DataFrame, overlays: DataFrame, layer: str = ALL_LAYERS) -> DataFrame:
    """For each point (v, z, point_id, x, y) the topmost overlay under it: its place in the
    slice's list, or -1, and its metadata. An equi-join on the slice, boxes first."""
    place = Window.partitionBy("v", "z").orderBy("seq")
    xs, ys = (F.transform("points", lambda q: q["x"]), F.transform("points", lambda q: q["y"]))
    listed = overlays.select("v", "z", "seq", "points", "label", "color", "layer", (F.row_number().over(place) - 1).cast("long").alias("idx"), F.array_min(xs).alias("bx1"), F.array_max(xs).alias("bx2"), F.array_min(ys).alias("by1"), F.array_max(ys).alias("by2"))
    if layer != ALL_LAYERS:
        listed = listed.where(normalize_layer(F.col("layer")) == layer)
    under = points.join(listed, ["v", "z"]).where("x between bx1 and bx2 and y between by1 and by2").where(point_in_polygon(F.col("x"), F.col("y"), F.col("points")))
    top = under.groupBy("v", "z", "point_id").agg(F.max_by(F.struct("idx", "label", "color", "layer"), "idx").alias("hit"))
    return points.join(top, ["v", "z", "point_id"], "left").select("v", "z", "point_id", F.coalesce("hit.idx", F.lit(-1)).cast("long").alias("idx"), "hit.label", "hit.color", "hit.layer")


def dense_volume(runs: DataFrame, volumes: DataFrame) -> DataFrame:
    """(v, z, h, w, rows): the mask, as runs, of every slice of every volume; slices without
    one are empty, runs of other slices and outside their image are left out."""
    from .rows import ROWS, gathered

    grid = volumes.select("v", "h", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("z_count").cast("long") - 1)).alias("z"))
    return grid.join(gathered(runs, grid).hint("merge"), ["v", "z"], "left").select("v", "z", "h", "w", F.coalesce("rows", F.array().cast(ROWS)).alias("rows"))


def densify_grid(runs: DataFrame, volumes: DataFrame) -> DataFrame:
    """Pixel counts of every slice of every volume; slices without a mask have 0, runs
    outside their volume are ignored."""
    grid = volumes.select("v", "h", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("z_count").cast("long") - 1)).alias("z"))
    fits = union(runs).withColumn("z", F.col("z").cast("long"))
    joined = grid.join(fits.hint("merge"), ["v", "z"], "left")
    ok = (F.col("y") >= 0) & (F.col("y") < F.col("h")) & (F.col("x0") >= 0) & (F.col("x1") < F.col("w"))
    return joined.groupBy("v", "z").agg(F.sum(F.when(ok, F.col("x1") - F.col("x0") + 1).otherwise(0)).cast("long").alias("pixels"))
