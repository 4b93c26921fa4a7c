"""Segmentation of every slice: thresholds as column expressions, floods in batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import percentile
from ..schema import LevelSet, Watershed
from . import imaging, outline, rows
from .masks import ellipse_kernel, sanitize_bbox
from .pixels import histogram


def otsu(gray: DataFrame) -> DataFrame:
    """(v, z, t, n_fg, n): Otsu's threshold from a slice's histogram; ties take the lowest
    level, one level alone has threshold 0. Foreground is g > t."""
    group = Window.partitionBy("v", "z")
    order = group.orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("g").cast("long") * F.col("n")
    h = histogram(gray).select("*", F.sum("n").over(order).alias("w0"), F.sum(mass).over(order).alias("m0"), F.sum("n").over(group).alias("w"), F.sum(mass).over(group).alias("m"))
    spread = F.col("m") * F.col("w0") - F.col("w") * F.col("m0")
    w1 = F.col("w") - F.col("w0")
    score = F.when(w1 > 0, spread.cast("double") * spread.cast("double") / (F.col("w0") * w1).cast("double"))
    scored = h.withColumn("score", score)
    best = F.row_number().over(group.orderBy(F.col("score").desc_nulls_last(), "g"))
    top = scored.withColumn("best", best).where("best = 1")
    t = F.when(F.col("score").isNull(), 0).otherwise(F.col("g")).cast("int")
    fg = F.when(F.col("score").isNull(), F.when(F.col("g") > 0, F.col("w")).otherwise(0)).otherwise(w1).cast("long")
    return top.select("v", "z", t.alias("t"), fg.alias("n_fg"), F.col("w").cast("long").alias("n"))


def level_set_start(gray: DataFrame) -> DataFrame:
    """(v, z, n_fg, c1, c0): the first step of the two-region iteration, without blur."""
    total = F.aggregate("gray", F.lit(0).cast("long"), lambda s, g: s + g)
    n = F.size("gray")
    sums = gray.select("v", "z", "gray", total.alias("m"), n.alias("n"))
    inside = F.filter("gray", lambda g: g * F.col("n") > F.col("m"))
    own = sums.select("v", "z", "m", "n", F.size(inside).alias("n1"), F.aggregate(inside, F.lit(0).cast("long"), lambda s, g: s + g).alias("m1"))
    mean = lambda m, k: F.when(k > 0, m / k / 255)
    return own.select("v", "z", F.col("n1").cast("long").alias("n_fg"), mean(F.col("m1"), F.col("n1")).alias("c1"), mean(F.col("m") - F.col("m1"), F.col("n") - F.col("n1")).alias("c0"))


def prompt_bias(prompt: Column) -> Column:
    """What a prompt adds to the threshold; tumours are asked before organs."""
    p = F.lower(F.coalesce(prompt, F.lit("")))
    has = lambda *words: F.greatest(*[F.contains(p, F.lit(w)) for w in words])
    return F.when(has("tumor", "lesion"), -5).when(has("organ", "liver"), 5).otherwise(0)


def percentile_segment(gray: DataFrame, prompt: Column, q: float = 0.7) -> DataFrame:
    """Adds thr and mask (array of boolean): g >= percentile + the prompt's bias."""
    thr = gray.withColumn("thr", percentile(F.col("gray"), q) + prompt_bias(prompt))
    return thr.withColumn("mask", F.transform("gray", lambda g: g >= F.col("thr")))


def in_box(p: Column, w: Column, box: Column) -> Column:
    y, x = F.floor(p / w), p % w
    return (x >= box["x1"]) & (x <= box["x2"]) & (y >= box["y1"]) & (y <= box["y2"])


def roi_segment(gray: DataFrame, roi: Column, inside: float = 0.6, fallback: float = 0.7) -> DataFrame:
    """Adds thr and mask: within the box ``roi`` (null: none) against its own percentile,
    else the whole slice against the fallback's."""
    boxed = gray.withColumn("_roi", roi)
    values = F.filter(F.transform("gray", lambda g, p: F.when(in_box(p, F.col("w"), F.col("_roi")), g)), lambda g: g.isNotNull())
    boxed = boxed.withColumn("_in", F.when(F.col("_roi").isNotNull(), percentile(values, inside)))
    boxed = boxed.withColumn("thr", F.coalesce("_in", percentile(F.col("gray"), fallback)))
    mask = F.transform("gray", lambda g, p: (g >= F.col("thr")) & (F.col("_in").isNull() | in_box(p, F.col("w"), F.col("_roi"))))
    return boxed.withColumn("mask", mask).drop("_roi", "_in")


def admitted(seeds: DataFrame, volumes: DataFrame) -> DataFrame:
    """Seed volumes (v, z_count, h, w) whose shape is their volume's."""
    return seeds.join(volumes.select("v", "z_count", "h", "w"), ["v", "z_count", "h", "w"], "left_semi")


def hybrid_predict(gray: DataFrame, seeds: DataFrame, boxes: DataFrame) -> DataFrame:
    """Every slice by its seed's box, else its volume's box, else as a whole."""
    box = F.struct("x1", "y1", "x2", "y2")
    joined = gray.join(seeds.select("v", "z", box.alias("_seed")), ["v", "z"], "left").join(boxes.select("v", box.alias("_box")), "v", "left")
    return roi_segment(joined, F.coalesce("_seed", "_box")).drop("_seed", "_box")


def mask_segment(gray: DataFrame, roi: Column, inside: float = 0.6, fallback: float = 0.7) -> DataFrame:
    """Adds thr and rows (runs of the mask): within the mask ``roi`` (runs of the slice's
    image; null or empty: none) against its own percentile, else the whole slice
    against the fallback's. Values are taken from the slice a run at a time."""
    own = gray.withColumn("_roi", roi)
    own = own.withColumn("_values", rows.values(F.col("gray"), F.col("w"), F.coalesce("_roi", rows.none())))
    own = own.withColumn("_in", percentile(F.col("_values"), inside))
    own = own.withColumn("thr", F.coalesce("_in", percentile(F.col("gray"), fallback)))
    region = F.when(F.col("_in").isNotNull(), F.col("_roi")).otherwise(rows.whole(F.col("h"), F.col("w")))
    mask = rows.lit(region, F.col("w"), lambda p: F.get("gray", p.cast("int")) >= F.col("thr"))
    return own.withColumn("rows", mask).drop("_roi", "_values", "_in")


def seeded_predict(gray: DataFrame, seeds: DataFrame, boxes: DataFrame) -> DataFrame:
    """Every slice by its seed mask (runs v, z, y, x0, x1), else its volume's box (v, x1, y1,
    x2, y2: cut to the image; one without width or height counts for nothing), else as a
    whole: adds thr, rows and roi (``seed``, ``box`` or ``none``)."""
    own = rows.gathered(seeds, gray).withColumnRenamed("rows", "_seed")
    box = boxes.select("v", F.array("x1", "y1", "x2", "y2").alias("_box"))
    joined = gray.join(own, ["v", "z"], "left").join(box, "v", "left")
    joined = joined.withColumn("_box", sanitize_bbox(F.col("_box"), F.col("h"), F.col("w")))
    source = F.when(F.col("_seed").isNotNull(), "seed").when(F.col("_box").isNotNull(), "box").otherwise("none")
    return mask_segment(joined, F.coalesce("_seed", rows.of_box(F.col("_box")))).withColumn("roi", source).drop("_seed", "_box")


def _each_slice(gray: DataFrame, to_mask) -> DataFrame:
    """(v, z, h, w, rows): a mask computed from each slice; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [rows.from_image(to_mask(np.asarray(g, np.int64).reshape(h, w))) for h, w, g in zip(pdf["h"], pdf["w"], pdf["gray"], strict=True)]
            yield pdf[["v", "z", "h", "w"]].assign(rows=found)

    return gray.select("v", "z", "h", "w", "gray").mapInPandas(run, f"v long, z long, h int, w int, rows {rows.ROWS}")


def watershed_masks(gray: DataFrame, settings: Watershed = Watershed()) -> DataFrame:
    s = settings
    return _each_slice(gray, lambda g: imaging.watershed(g, s.fg_ratio, s.open_iterations, s.bg_dilate))


def level_set_masks(gray: DataFrame, settings: LevelSet = LevelSet()) -> DataFrame:
    s, kernel = settings, ellipse_kernel(settings.kernel)
    return _each_slice(gray, lambda g: imaging.level_set(g, s.iterations, kernel))


def watershed(gray: DataFrame, settings: Watershed = Watershed()) -> DataFrame:
    """Polygons of the marker watershed of each slice."""
    return outline.polygons(rows.exploded(watershed_masks(gray, settings)), gray.select("v", "z", "h", "w"), settings.min_area)


def level_set(gray: DataFrame, settings: LevelSet = LevelSet()) -> DataFrame:
    """Polygons of the two-region iteration of each slice."""
    return outline.polygons(rows.exploded(level_set_masks(gray, settings)), gray.select("v", "z", "h", "w"), settings.min_area)


def contours(masks: DataFrame, min_area: float) -> DataFrame:
    """Polygons of masks given as an array of 0 and 1 (or booleans) in ``mask``."""
    lit = masks.select("v", "z", "h", "w", F.transform("mask", lambda m: m.cast("boolean")).alias("mask"))
    packed = lit.select("v", "z", "h", "w", rows.of_mask("mask", F.col("h"), F.col("w")).alias("rows"))
    return outline.polygons(rows.exploded(packed), packed.select("v", "z", "h", "w"), min_area)


def above_otsu(gray: DataFrame) -> DataFrame:
    """(v, z, h, w, rows): the pixels above each slice's Otsu threshold."""
    joined = gray.join(otsu(gray).select("v", "z", "t"), ["v", "z"])
    on = lambda p: F.get("gray", p.cast("int")) > F.col("t")
    return joined.select("v", "z", "h", "w", rows.lit(rows.whole(F.col("h"), F.col("w")), F.col("w"), on).alias("rows"))


def blur(gray: DataFrame) -> DataFrame:
    """(v, z, h, w, values): a 5 x 5 binomial blur, mirrored at the border, rounded half up:
    two weighted shifts within the slice row."""

    def mirrored(i: Column, n: Column) -> Column:
        at = F.abs(i) % F.greatest(2 * n - 2, F.lit(1))
        return F.when(at >= n, 2 * n - 2 - at).otherwise(at).cast("int")

    weights = ((-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1))
    h, w = F.col("h"), F.col("w")
    y, x = (lambda p: F.floor(p / w).cast("int")), (lambda p: p % w)
    total = lambda of: of(*weights[0]) + of(*weights[1]) + of(*weights[2]) + of(*weights[3]) + of(*weights[4])
    across = gray.select("v", "z", "h", "w", F.transform("gray", lambda _, p: total(lambda d, k: F.get("gray", y(p) * w + mirrored(x(p) + d, w)).cast("long") * k)).alias("_a"))
    down = F.transform("_a", lambda _, p: F.floor((total(lambda d, k: F.get("_a", mirrored(y(p) + d, h) * w + x(p)) * k) + 128) / 256).cast("int"))
    return across.select("v", "z", "h", "w", down.alias("values"))


_LINES = "struct<out: array<array<double>>, one: array<double>, two: array<double>>"
#: Further than any pixel of an image.
FAR = 1e12


def _scan(values: str) -> Column:
    """One pass of a 5 x 5 chamfer over a row-major array, downwards: a fold over lines that
    takes least sums with the two lines before, and along a line by doubling strides."""
    # Weights of straight, diagonal and knight's steps.
    straight, diagonal, knight = 1.0, 1.4, 2.1969
    before = [("one", 0, straight), ("one", -1, diagonal), ("one", 1, diagonal), ("one", -2, knight), ("one", 2, knight), ("two", -1, knight), ("two", 1, knight)]
    lines = rows.let(F.col(values), lambda d: F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda y: F.slice(d, y * F.col("w") + 1, F.col("w"))))
    strides = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.col("w").cast("double"))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))

    def step(s: Column, line: Column) -> Column:
        reached = F.transform(line, lambda d, x: F.least(d, *[F.get(s[of], x + dx) + cost for of, dx, cost in before]))
        along = F.aggregate(strides, reached, lambda c, k: F.transform(c, lambda d, x: F.least(d, F.get(c, x - k) + k * straight)))
        return rows.let(along, lambda c: F.struct(F.concat(s["out"], F.array(c)).alias("out"), c.alias("one"), s["one"].alias("two"))).cast(_LINES)

    empty = F.array().cast("array<double>")
    start = F.struct(F.array().cast("array<array<double>>").alias("out"), empty.alias("one"), empty.alias("two")).cast(_LINES)
    return F.flatten(F.aggregate(lines, start, step, lambda s: s["out"]))


def distance(masks: DataFrame) -> DataFrame:
    """(v, z, h, w, values): each pixel's distance to the background of the mask (rows: runs)
    by a 5 x 5 chamfer, -1 everywhere if there is none. Two scans of the slice row."""
    n = F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)
    on = F.transform("rows", lambda r: F.struct((r["y"] * F.col("w") + r["x0"]).alias("a"), (r["y"] * F.col("w") + r["x1"]).alias("b")))
    # Stretches of background and of mask in turn.
    parts = F.aggregate(on, F.struct(F.array().cast("array<double>").alias("v"), F.lit(0).alias("at")).cast("struct<v: array<double>, at: int>"), lambda s, r: F.struct(F.concat(s["v"], F.array_repeat(F.lit(0.0), r["a"] - s["at"]), F.array_repeat(F.lit(FAR), r["b"] - r["a"] + 1)).alias("v"), (r["b"] + 1).alias("at")).cast("struct<v: array<double>, at: int>"))
    start = masks.select("v", "z", "h", "w", F.size(n).alias("_n"), parts.alias("_p"))
    start = start.select("v", "z", "h", "w", F.concat("_p.v", F.array_repeat(F.lit(0.0), F.col("_n") - F.col("_p.at"))).alias("_d"))
    down = start.select("v", "z", "h", "w", F.reverse(_scan("_d")).alias("_d"))
    up = down.select("v", "z", "h", "w", F.reverse(_scan("_d")).alias("_d"))
    return up.select("v", "z", "h", "w", F.transform("_d", lambda d: F.when(d >= FAR, -1.0).otherwise(d)).alias("values"))
