"""Seeds spread along z: nearest seeds by windows, smoothing by an ordered fold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import in_filter, normalize_label
from . import imaging, masks, rows

BOX = ("x1", "y1", "x2", "y2")


def seed_overlays(overlays: DataFrame, names: Column) -> DataFrame:
    """The committed overlays whose label passes the filter."""
    return overlays.where((F.col("status") == "committed") & in_filter(normalize_label(F.col("label")), names))


def seed_masks(overlays: DataFrame, runs: DataFrame, names: Column) -> DataFrame:
    """Union runs of the seed overlays, per slice. Whoever draws the runs anyway draws those of
    ``seed_overlays`` only and needs no join."""
    chosen = seed_overlays(overlays, names)
    return masks.union(runs.join(chosen.select("v", "z", "seq"), ["v", "z", "seq"], "left_semi"))


def merge_seeds(*runs: DataFrame) -> DataFrame:
    """Pixelwise maximum of several seed tables."""
    every = runs[0].select("v", "z", "y", "x0", "x1")
    for r in runs[1:]:
        every = every.unionByName(r.select("v", "z", "y", "x0", "x1"))
    return masks.union(every)


def interpolate_seeds(boxes: DataFrame, grid: DataFrame) -> DataFrame:
    """A box for every slice of ``grid`` (v, z) of a volume with seeds: its own, the one
    of the only side that has a seed, or both sides' mean by distance, rounded half to even."""
    own = F.struct(*BOX, F.col("z"))
    joined = grid.join(boxes.select("v", "z", own.alias("s")).hint("merge"), ["v", "z"], "left")
    return _interpolated(joined)


def _interpolated(slices: DataFrame, *keep: str) -> DataFrame:
    """Slices (v, z, keep, s: the own box with its z, or null) with the box that holds for each."""
    order = Window.partitionBy("v").orderBy("z")
    low = F.last("s", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first("s", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    near = slices.select("v", "z", *keep, F.col("s").isNotNull().alias("is_seed"), low.alias("lo"), high.alias("up"))
    t = (F.col("z") - F.col("lo.z")) / F.greatest(F.lit(1), F.col("up.z") - F.col("lo.z"))
    between = lambda c: F.bround(F.col(f"lo.{c}") + (F.col(f"up.{c}") - F.col(f"lo.{c}")) * t).cast("long")
    pick = lambda c: F.when(F.col("lo").isNull(), F.col(f"up.{c}").cast("long")).when(F.col("up").isNull(), F.col(f"lo.{c}").cast("long")).otherwise(between(c))
    return near.where("lo is not null or up is not null").select("v", "z", *keep, "is_seed", *[pick(c).alias(c) for c in BOX])


#: Pixels of the slices that a task smooths at once.
SMOOTHED = 2_000_000


def densify(seed_runs: DataFrame, volumes: DataFrame, parts: int | None = None) -> DataFrame:
    """(v, z, h, w, rows): the masks, as runs, of all slices of the seeded volumes, filled from
    seeds and then smoothed in order along z: a slice becomes the majority of the smoothed
    one before, itself and the one after, if that is not empty.

    The fold reads what it has just written, so the slices of a volume pass in order
    through one task. It takes and hands on runs and holds a piece of ``SMOOTHED`` pixels,
    whose volumes take each step along z together. ``parts`` is the number of partitions
    that volumes are dealt into, the session's if it is not given.
    """
    grid = volumes.select("v", "h", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("z_count").cast("long") - 1)).alias("z"))
    every = grid.join(rows.gathered(seed_runs, grid).hint("merge"), ["v", "z"], "left")
    dealt = every.repartition(parts, "v") if parts else every.repartition("v")
    boxes = _interpolated(dealt.withColumn("_box", rows.bounds(F.col("rows"))).withColumn("s", F.when(F.col("_box").isNotNull(), F.struct("_box.*", "z"))), "h", "w", "rows")
    filled = F.coalesce("rows", rows.of_box(F.struct(*[F.col(c).cast("int").alias(c) for c in BOX])))
    full = boxes.select(F.col("v").cast("long").alias("v"), "z", F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), filled.alias("rows"))
    return full.sortWithinPartitions("v", "z").mapInArrow(_smooth, f"v long, z long, h int, w int, rows {rows.ROWS}")


def _smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In a task: slices in order of v and z, smoothed. Of what has gone by it holds two slices:
    the last one that was handed on, if the one that waits is of its volume, and that one."""
    before, waits = None, None  # an image; (keys of a slice, its image as a stack of one)
    kind: list[pa.DataType] = []

    def out(keys: np.ndarray, images: np.ndarray) -> pa.RecordBatch:
        sizes, *runs = rows.from_images(images)
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in runs], fields=list(kind[0].value_type)), type=kind[0])
        return pa.RecordBatch.from_arrays([*[pa.array(keys[:, k].astype(t)) for k, t in enumerate((np.int64, np.int64, np.int32, np.int32))], lists], ["v", "z", "h", "w", "rows"])

    for batch in batches:
        kind[:] = [batch.schema.field("rows").type]
        table = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("v", "z", "h", "w")], axis=1)
        at = 0
        while at < len(table):
            # A piece: slices of one shape.
            h, w = table[at, 2:].tolist()
            piece = table[at : at + max(1, SMOOTHED // max(1, h * w))]
            other = np.flatnonzero((piece[:, 2:] != (h, w)).any(axis=1))
            piece = piece[: other[0]] if other.size else piece
            keys, images = piece, rows.to_images(batch.column("rows").slice(at, len(piece)), (h, w))
            at += len(piece)
            if waits is not None and (waits[0][0, [0, 2, 3]] == piece[0, [0, 2, 3]]).all():
                keys, images = np.concatenate([waits[0], piece]), np.concatenate([waits[1], images])
            elif waits is not None:
                yield out(*waits)
                before = None
            done = imaging.smoothed(images, keys[:, 0], before)
            if len(keys) > 1:
                yield out(keys[:-1], done[:-1])
                before = done[-2].copy() if keys[-2, 0] == keys[-1, 0] else None
            waits = (keys[-1:].copy(), images[-1:].copy())
    if waits is not None:
        yield out(*waits)


def resolve_prompt(overlays: DataFrame, selection: DataFrame, drafts: DataFrame) -> DataFrame:
    """(v, z, points) of each slice's prompt: a draft of 3 points or more, else the
    selected overlay, else the last one (also if the selection is out of range)."""
    slice_ = Window.partitionBy("v", "z")
    listed = overlays.select("v", "z", "points", (F.row_number().over(slice_.orderBy("seq")) - 1).alias("idx"), F.count("*").over(slice_).alias("n"))
    asked = F.when(F.col("selected_idx").between(0, F.col("n") - 1), F.col("selected_idx")).otherwise(F.col("n") - 1)
    chosen = listed.join(selection.select("v", "z", "selected_idx").hint("merge"), ["v", "z"], "left").where(F.col("idx") == asked).select("v", "z", F.col("points").alias("chosen"))
    draft = drafts.where(F.size("points") >= 3).select("v", "z", F.col("points").alias("draft"))
    every = chosen.join(draft.hint("merge"), ["v", "z"], "full")
    points = F.coalesce("draft", "chosen")
    return every.select("v", "z", points.alias("points")).where(F.size("points") >= 3)


def build_requests(prompts: DataFrame, seed_mode: str) -> DataFrame:
    """Model requests of prompts (v, z, points): the prompt's box, its slice and the seed mode.

    The box is that of ``masks.rasterize`` without a pixel drawn: an edge is drawn with its
    ends if both are known, and what is filled lies between edges. It is made in the
    prompt's row: no shuffle.
    """
    known = lambda p: p["x"].isNotNull() & p["y"].isNotNull()
    near = lambda i: known(F.get("points", (i % F.size("points")).cast("int")))
    ends = F.filter("points", lambda p, i: known(p) & (near(i + 1) | near(i + F.size("points") - 1)))
    of = lambda c: F.transform("_ends", lambda p: p[c].cast("long"))
    asked = prompts.where(F.size("points") >= 3).select("v", "z", ends.alias("_ends")).where(F.size("_ends") > 0)
    box = F.array(F.array_min(of("x")), F.array_min(of("y")), F.array_max(of("x")), F.array_max(of("y")))
    return asked.select("v", "z", box.alias("bbox"), F.col("z").alias("bbox_slice_index"), F.lit(seed_mode).alias("seed_mode"))
