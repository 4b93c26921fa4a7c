"""Pixel operators: ranges, windows, thresholds, histograms and composites.

A slice's pixels stay in one row until a histogram or a voxel view is asked for, so
most operators here shuffle nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hex_to_rgb, normalize_layer
from ..schema import ALL_LAYERS, PREVIEW_RGB


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def intensity_range(slices: DataFrame) -> DataFrame:
    """(v, raw_min, raw_max) over finite values; an empty range is one wide."""
    own = F.filter("pixels", _finite)
    per = slices.select("v", F.array_min(own).cast("double").alias("lo"), F.array_max(own).cast("double").alias("hi"))
    both = per.groupBy("v").agg(F.coalesce(F.min("lo"), F.lit(0.0)).alias("raw_min"), F.max("hi").alias("hi"))
    return both.select("v", "raw_min", F.when(F.col("hi") > F.col("raw_min"), F.col("hi")).otherwise(F.col("raw_min") + 1).alias("raw_max"))


def window_bounds(ranges: DataFrame, settings: DataFrame) -> DataFrame:
    """Slider pairs (v, lo, hi: 0..1000) as window bounds: (v, raw_min, raw_max, win_min, win_max)."""
    low = F.least("lo", F.col("hi") - 1)
    high = F.greatest(F.col("hi"), low + 1)
    at = lambda s: F.col("raw_min") + s / 1000.0 * (F.col("raw_max") - F.col("raw_min"))
    return ranges.join(settings, "v").select("v", "raw_min", "raw_max", at(low).alias("win_min"), at(high).alias("win_max"))


def sanitize(x: Column, low: Column, high: Column) -> Column:
    """NaN and -inf are the range's minimum, inf its maximum."""
    return F.when(F.isnan(x) | x.isNull(), low).when(x == float("inf"), high).when(x == float("-inf"), low).otherwise(x)


def window_level(slices: DataFrame, windows: DataFrame) -> DataFrame:
    """Grey slices 0..255, truncated: (v, z, h, w, gray and further columns of ``slices``)."""
    joined = slices.join(windows.select("v", "raw_min", "raw_max", "win_min", "win_max"), "v")
    low, high = F.col("win_min"), F.col("win_max")

    def level(x: Column) -> Column:
        clean = sanitize(x.cast("double"), F.col("raw_min"), F.col("raw_max"))
        return ((F.least(F.greatest(clean, low), high) - low) / F.greatest(F.lit(1e-6), high - low) * 255).cast("int")

    return joined.withColumn("gray", F.transform("pixels", level)).drop("pixels", "raw_min", "raw_max", "win_min", "win_max")


def full_window(slices: DataFrame) -> DataFrame:
    """Grey slices with each volume's whole range as window."""
    ranges = intensity_range(slices)
    return window_level(slices, ranges.select("*", F.col("raw_min").alias("win_min"), F.col("raw_max").alias("win_max")))


def threshold_dim(gray: DataFrame, threshold: float) -> DataFrame:
    """Grey values up to the threshold (0..1) are halved; 0 changes nothing."""
    if threshold <= 0:
        return gray
    edge = int(threshold * 255)
    return gray.withColumn("gray", F.transform("gray", lambda g: F.when(g > edge, g).otherwise(F.floor(g / 2).cast("int"))))


def voxels(gray: DataFrame, values: str = "gray") -> DataFrame:
    """(v, z, y, x, g): the exploded view."""
    # From an inner explode the optimizer infers a filter on the array, which it works out
    # again below, where it may be once an element.
    rows = gray.select("v", "z", "w", F.posexplode_outer(values).alias("p", "g")).where("p is not null")
    return rows.select("v", "z", F.floor(F.col("p") / F.col("w")).cast("long").alias("y"), (F.col("p") % F.col("w")).cast("long").alias("x"), "g")


def histogram(gray: DataFrame) -> DataFrame:
    """(v, z, g, n): at most 256 rows a slice, summed before the shuffle."""
    return gray.select("v", "z", F.explode("gray").alias("g")).groupBy("v", "z", "g").agg(F.count("*").alias("n"))


def run_mask(runs: DataFrame) -> DataFrame:
    """(v, z, rows): a slice's runs in one array, to test pixels within a slice row."""
    return runs.groupBy("v", "z").agg(F.collect_list(F.struct("y", "x0", "x1")).alias("rows"))


def covered(p: Column, w: Column, rows: Column) -> Column:
    """Whether pixel number p lies in one of the runs."""
    y, x = F.floor(p / w), p % w
    return F.exists(rows, lambda r: (r["y"] == y) & (r["x0"] <= x) & (x <= r["x1"]))


def apply_prompt_mask(gray: DataFrame, runs: DataFrame) -> DataFrame:
    """Grey inside the slice's runs, 0 outside; slices without runs are unchanged."""
    joined = gray.join(run_mask(runs), ["v", "z"], "left")
    kept = F.transform("gray", lambda g, p: F.when(covered(p, F.col("w"), F.col("rows")), g).otherwise(F.lit(0)))
    return joined.withColumn("gray", F.when(F.col("rows").isNull(), F.col("gray")).otherwise(kept)).drop("rows")


def composite(gray: DataFrame, overlays: DataFrame, runs: DataFrame, opacity: float, layer: str = ALL_LAYERS) -> DataFrame:
    """(v, z, y, x, c_r, c_g, c_b): overlays drawn over grey in order, the last one on a pixel
    wins; previews come last in their own colour. Committed ones are filtered by layer."""
    # Explodes count for nothing where sizes are estimated: runs are not to be broadcast.
    return draw(gray, runs.join(shown(overlays, layer).hint("merge"), ["v", "z", "seq"]), opacity)


def shown(overlays: DataFrame, layer: str = ALL_LAYERS) -> DataFrame:
    """The overlays that are drawn, with their turn and colour."""
    listed = (F.col("status") == "preview") | F.lit(layer == ALL_LAYERS) | (normalize_layer(F.col("layer")) == layer)
    drawn = overlays.where((F.size("points") >= 3) & listed)
    preview = F.col("status") == "preview"
    rgb = hex_to_rgb(F.col("color"))
    color = F.struct(*[F.when(preview, F.lit(PREVIEW_RGB[k])).otherwise(rgb[c]).alias(c) for k, c in enumerate("rgb")])
    return drawn.withColumns({"turn": F.struct(preview.cast("int").alias("late"), "seq"), "color": color})


def draw(gray: DataFrame, runs: DataFrame, opacity: float) -> DataFrame:
    """(v, z, y, x, c_r, c_g, c_b): runs with turn and colour over grey, the last on a pixel
    wins. Runs are cut to their slice's image before they become pixels."""
    inside = runs.join(gray.select("v", "z", "h", "w").hint("merge"), ["v", "z"]).where("y >= 0 and y < h and x1 >= 0 and x0 < w")
    x = F.explode(F.sequence(F.greatest("x0", F.lit(0)), F.least("x1", F.col("w") - 1))).alias("x")
    top = inside.select("v", "z", "y", "turn", "color", x).groupBy("v", "z", "y", "x").agg(F.max_by("color", "turn").alias("color"))
    alpha = int(255 * opacity)
    base = voxels(gray).join(top.hint("merge"), ["v", "z", "y", "x"], "left")
    blend = lambda c: F.when(F.col("color").isNull(), F.col("g")).otherwise(F.floor((F.col(f"color.{c}") * alpha + F.col("g") * (255 - alpha) + 127) / 255).cast("int"))
    return base.select("v", "z", "y", "x", *[blend(c).alias(f"c_{c}") for c in "rgb"])
