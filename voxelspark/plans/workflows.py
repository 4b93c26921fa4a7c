"""Whole runs composed of the operators: segment, preview or commit, accept, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import label_filter
from ..operators import annotate, masks, models, outline, propagate, rows, segment
from ..schema import DEFAULT_COLOR, DEFAULT_LABEL, DEFAULT_LAYER


def as_overlays(polygons: DataFrame, label: str = DEFAULT_LABEL, color: str = DEFAULT_COLOR, layer: str = DEFAULT_LAYER) -> DataFrame:
    """Polygons (v, z, part, points) as overlay rows with one template."""
    return polygons.select("v", "z", F.col("part").cast("long").alias("seq"), "points", F.lit(label).alias("label"), F.lit(color).alias("color"), F.lit(layer).alias("layer"), F.lit("preview").alias("status"))


def preview_run(existing: DataFrame, gray: DataFrame, polygons: DataFrame, scope: Column | None = None) -> DataFrame:
    """Previews of the slices in scope replaced by these polygons; slices without any lose theirs."""
    processed = (gray if scope is None else gray.where(scope)).select("v", "z").distinct().withColumn("_done", F.lit(True))
    new = as_overlays(polygons).select(*existing.columns).withColumn("_new", F.lit(True))
    # Each table is used once: what it takes to make it is done once.
    both = existing.withColumn("_new", F.lit(False)).unionByName(new).join(processed, ["v", "z"], "left")
    last = F.max(F.when(~F.col("_new"), F.col("seq"))).over(Window.partitionBy("v", "z"))
    stays = F.when(F.col("_new"), F.col("_done").isNotNull()).otherwise((F.col("status") != "preview") | F.col("_done").isNull())
    seq = F.when(F.col("_new"), F.col("seq") + F.coalesce("_last", F.lit(-1)) + 1).otherwise(F.col("seq"))
    return both.withColumn("_last", last).where(stays).withColumn("seq", seq).select(*existing.columns)


def commit_run(existing: DataFrame, polygons: DataFrame, label: str = DEFAULT_LABEL, color: str = "", layer: str = DEFAULT_LAYER) -> tuple[DataFrame, DataFrame]:
    """The overlays with these polygons committed, and the number of slices they are on, by volume."""
    slices = polygons.groupBy("v").agg(F.count_distinct("z").alias("slices"))
    return annotate.commit(existing, polygons, label, color, layer), slices


def mask_polygons(found: DataFrame, gray: DataFrame, min_area: float) -> DataFrame:
    """Polygons of model results (v, z, mask)."""
    return outline.polygons(rows.exploded(found, "mask"), gray.select("v", "z", "h", "w"), min_area)


def seeded_volume_run(gray: DataFrame, overlays: DataFrame, runs: DataFrame, volumes: DataFrame, predictor: models.Predictor, labels: str = "", text_stride: int = 0, min_area: float = 20, declared: DataFrame | None = None, boxes: DataFrame | None = None) -> DataFrame:
    """Polygons of a volume model guided by seeds: committed masks of the labels, with
    those of every ``text_stride``-th slice if asked, spread over all slices, each the
    region its slice is looked at in. Volumes without seeds are not run. With ``declared``
    (v, z_count, h, w of the seeds) seeds of another shape than their volume's are
    refused, and the volume goes on with its box (``boxes``: v, x1, y1, x2, y2) or as a whole."""
    own = propagate.seed_masks(overlays, runs, label_filter(F.lit(labels)))
    if text_stride:
        own = propagate.merge_seeds(own, rows.exploded(models.text_seeds(gray, text_stride, models.PercentilePredictor())))
    asked = gray.join(own.select("v").distinct(), "v", "left_semi")
    if declared is not None:
        own = own.join(segment.admitted(declared, volumes).select("v"), "v", "left_semi")
    if boxes is None:
        boxes = gray.sparkSession.createDataFrame([], "v long, x1 int, y1 int, x2 int, y2 int")
    dense = rows.exploded(propagate.densify(own, volumes))
    return mask_polygons(models.predict_volumes(models.roi_request(asked, dense, boxes), predictor), gray, min_area)


def prompted_slice_run(gray: DataFrame, seeds: DataFrame, drawn: DataFrame, predictor: models.Predictor, promptable: bool = False, min_area: float = 20) -> tuple[DataFrame, DataFrame]:
    """Polygons of a slice model run with prompts (see ``models.prompted_request``), and
    the result rows with their messages."""
    found = models.predict_slices(models.prompted_request(gray, seeds, drawn, promptable), predictor)
    return mask_polygons(found, gray, min_area), found


def export_run(overlays: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What would be written of the volumes that have committed overlays, and the report of all."""
    report = annotate.export_summary(overlays)
    done = masks.union(runs.join(overlays.where("status = 'committed'").select("v", "z", "seq"), ["v", "z", "seq"], "left_semi"))
    return annotate.export_manifest(done.join(report.where("exportable").select("v"), "v", "left_semi")), report
