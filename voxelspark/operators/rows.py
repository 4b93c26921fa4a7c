"""Masks within a slice row: arrays of runs (y, x0, x1), ends inclusive, in order.

This is how a mask travels with its slice, into a model and out of it: a few numbers for
a row of pixels, and no shuffle to look at the pixels under it. ``gathered`` and
``exploded`` lead from tables of runs and back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import let
from . import masks

ROWS = "array<struct<y: int, x0: int, x1: int>>"


def run(y: Column, x0: Column, x1: Column) -> Column:
    return F.struct(y.cast("int").alias("y"), x0.cast("int").alias("x0"), x1.cast("int").alias("x1"))


def none() -> Column:
    return F.array().cast(ROWS)


def whole(h: Column, w: Column) -> Column:
    """Every pixel of an image."""
    return F.transform(F.sequence(F.lit(0), h - 1), lambda y: run(y, F.lit(0), w - 1))


def of_box(box: Column) -> Column:
    """The pixels of a box (x1, y1, x2, y2) that lies in its image; null of a null box."""
    return F.when(box.isNotNull(), F.transform(F.sequence(box["y1"], box["y2"]), lambda y: run(y, box["x1"], box["x2"])))


def lit(rows: Column, w: Column, on: Callable[[Column], Column]) -> Column:
    """The runs of those pixels of ``rows`` for which ``on`` (of a pixel's number) holds."""

    def within(r: Column) -> Column:
        at = lambda x: F.coalesce(on(r["y"] * w + x), F.lit(False))
        xs = F.sequence(r["x0"], r["x1"])
        starts = F.filter(xs, lambda x: at(x) & ((x == r["x0"]) | ~at(x - 1)))
        ends = F.filter(xs, lambda x: at(x) & ((x == r["x1"]) | ~at(x + 1)))
        return F.zip_with(starts, ends, lambda a, b: run(r["y"], a, b))

    return F.flatten(F.transform(rows, within))


def of_mask(mask: str, h: Column, w: Column) -> Column:
    """The runs of a row-major array of booleans."""
    return lit(whole(h, w), w, lambda p: F.get(mask, p.cast("int")))


def values(pixels: Column, w: Column, rows: Column) -> Column:
    """The values under a mask: a stretch of the pixel array for each run."""
    return F.flatten(F.transform(rows, lambda r: F.slice(pixels, r["y"] * w + r["x0"] + 1, r["x1"] - r["x0"] + 1)))


def size(rows: Column) -> Column:
    return F.aggregate(rows, F.lit(0).cast("long"), lambda n, r: n + r["x1"] - r["x0"] + 1)


def bounds(rows: Column) -> Column:
    """The inclusive box of a mask; null of an empty one."""
    of = lambda c: F.transform(rows, lambda r: r[c])
    box = F.struct(F.array_min(of("x0")).alias("x1"), F.array_min(of("y")).alias("y1"), F.array_max(of("x1")).alias("x2"), F.array_max(of("y")).alias("y2"))
    return F.when(F.size(rows) > 0, box)


def gathered(runs: DataFrame, grid: DataFrame) -> DataFrame:
    """(v, z, rows) of a table of runs: merged and cut to the images of ``grid`` (v, z, h, w).
    An empty mask has no row."""
    # An estimate of sizes takes no account of explodes, so what has been exploded is not broadcast.
    inside = runs.join(grid.select("v", "z", "h", "w").hint("merge"), ["v", "z"]).where("y >= 0 and y < h and x1 >= 0 and x0 < w")
    cut = inside.select("v", "z", "y", F.greatest("x0", F.lit(0)).alias("x0"), F.least("x1", F.col("w") - 1).alias("x1"))
    merged = masks.union(cut)
    return merged.groupBy("v", "z").agg(F.array_sort(F.collect_list(run(F.col("y"), F.col("x0"), F.col("x1")))).alias("rows"))


def exploded(df: DataFrame, rows: str = "rows", *keep: str) -> DataFrame:
    """A table of runs (v, z, keep, y, x0, x1)."""
    # Outer, as in ``pixels.voxels``: no filter is inferred on the array.
    return df.select("v", "z", *keep, F.explode_outer(rows).alias("_r")).where("_r is not null").select("v", "z", *keep, "_r.y", "_r.x0", "_r.x1")


def to_image(rows: Iterable | None, shape: tuple[int, int]) -> np.ndarray:
    """In a task: the mask as an array; what lies outside the image is left out."""
    out = np.zeros(shape, bool)
    for r in () if rows is None else rows:
        if 0 <= r["y"] < shape[0]:
            out[r["y"], max(0, r["x0"]) : max(0, r["x1"] + 1)] = True
    return out


def from_image(mask: np.ndarray) -> list[dict]:
    """In a task: the runs of a mask."""
    steps = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(steps == 1)
    x1 = np.nonzero(steps == -1)[1] - 1
    return [{"y": a, "x0": b, "x1": c} for a, b, c in zip(y.tolist(), x0.tolist(), x1.tolist(), strict=True)]


def to_images(rows: pa.ListArray, shape: tuple[int, int]) -> np.ndarray:
    """In a task: the masks of slices of one shape as a stack of arrays, as ``to_image`` does."""
    h, w = shape
    of = np.repeat(np.arange(len(rows)), pc.fill_null(pc.list_value_length(rows), 0).to_numpy())
    y, x0, x1 = (c.to_numpy().astype(np.int64) for c in rows.flatten().flatten())
    x0, x1 = np.maximum(x0, 0), np.minimum(x1, w - 1)
    own = (y >= 0) & (y < h) & (x0 <= x1)
    first, length = ((of * h + y) * w + x0)[own], (x1 - x0 + 1)[own]
    out = np.zeros(len(rows) * h * w, bool)
    out[np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())] = True
    return out.reshape(len(rows), h, w)


def from_images(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """In a task: the number of runs of each mask of a stack, and their y, x0 and x1."""
    n, h, w = masks.shape
    wide = np.zeros((n * h, w + 2), bool)
    wide[:, 1:-1] = masks.reshape(n * h, w)
    row, x = np.divmod(np.flatnonzero(wide[:, 1:] != wide[:, :-1]), w + 1)
    of, y = np.divmod(row[::2], h) if h else (row, row)
    return np.bincount(of, minlength=n), y, x[::2], x[1::2] - 1
