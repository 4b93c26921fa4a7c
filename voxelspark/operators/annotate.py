"""Annotation tables: commits, previews, selections, layers and labels.

An overlay's place in its slice's list is its rank by ``seq``; it is derived, never stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normalize_label, normalize_layer
from ..schema import ALL_LAYERS, DEFAULT_COLOR, DEFAULT_LABEL, DEFAULT_LAYER


def _place():
    return Window.partitionBy("v", "z").orderBy("seq")


def label_colors(overlays: DataFrame) -> DataFrame:
    """(label, color): the first colour seen of each label; the default label's is given."""
    spark = overlays.sparkSession
    seed = spark.createDataFrame([(DEFAULT_LABEL, DEFAULT_COLOR, -1)], "label string, color string, seq long")
    own = overlays.select(normalize_label(F.col("label")).alias("label"), F.nullif(F.trim("color"), F.lit("")).alias("color"), "seq").where("color is not null")
    return own.unionByName(seed).groupBy("label").agg(F.min_by("color", "seq").alias("color"))


def commit(existing: DataFrame, polygons: DataFrame, label: str, color: str, layer: str) -> DataFrame:
    """Polygons (v, z, part, points) appended as committed overlays with one template."""
    name = (label or "").strip() or DEFAULT_LABEL
    colors = label_colors(existing).withColumnsRenamed({"label": "_label", "color": "_color"})
    last = existing.groupBy("v", "z").agg(F.max("seq").alias("_last"))
    new = polygons.withColumn("_label", F.lit(name)).join(last, ["v", "z"], "left").join(colors, "_label", "left")
    own = F.coalesce(F.nullif(F.trim(F.lit(color)), F.lit("")), F.col("_color"), F.lit(DEFAULT_COLOR))
    rows = new.select("v", "z", (F.coalesce("_last", F.lit(-1)) + 1 + F.col("part")).cast("long").alias("seq"), "points", F.lit(name).alias("label"), own.alias("color"), normalize_layer(F.lit(layer)).alias("layer"), F.lit("committed").alias("status"))
    return existing.unionByName(rows, allowMissingColumns=True)


def commit_drawn(existing: DataFrame, drafts: DataFrame, label: str = DEFAULT_LABEL, color: str = "", layer: str = DEFAULT_LAYER) -> DataFrame:
    """Polygons drawn by hand (v, z, draft, points; ordered by draft) committed; the slices
    they are on lose their previews."""
    part = F.row_number().over(Window.partitionBy("v", "z").orderBy("draft")) - 1
    new = drafts.where(F.size("points") >= 3).select("v", "z", part.alias("part"), "points")
    drawn = new.select("v", "z").distinct()
    kept = existing.where("status = 'preview'").join(drawn, ["v", "z"], "left_anti").select(*existing.columns)
    return commit(existing.where("status <> 'preview'").unionByName(kept), new, label, color, layer)


def set_preview(existing: DataFrame, new: DataFrame, processed: DataFrame) -> DataFrame:
    """Previews of the processed slices (v, z) replaced by ``new``; those without any lose theirs."""
    kept = existing.where("status = 'preview'").join(processed.select("v", "z").distinct(), ["v", "z"], "left_anti")
    return existing.where("status <> 'preview'").unionByName(kept.select(*existing.columns)).unionByName(new.withColumn("status", F.lit("preview")).select(*existing.columns))


def accept(overlays: DataFrame, scope: Column | None = None) -> DataFrame:
    """Previews in scope become committed and stand after the committed ones, in order;
    adds the new place ``idx`` among the committed (null for previews left over)."""
    scope = F.lit(True) if scope is None else scope
    preview = F.col("status") == "preview"
    ranked = overlays.withColumn("_late", preview.cast("int")).withColumn("status", F.when(preview & scope, "committed").otherwise(F.col("status")))
    order = Window.partitionBy("v", "z", "status").orderBy("_late", "seq")
    return ranked.withColumn("idx", F.when(F.col("status") == "committed", F.row_number().over(order) - 1).cast("long")).drop("_late")


def reject(overlays: DataFrame, scope: Column | None = None) -> DataFrame:
    scope = F.lit(True) if scope is None else scope
    return overlays.where((F.col("status") != "preview") | ~scope)


def ranked(overlays: DataFrame) -> DataFrame:
    """Adds idx, the place in the slice's list, and n, the list's length."""
    group = Window.partitionBy("v", "z")
    return overlays.withColumn("idx", (F.row_number().over(_place()) - 1).cast("long")).withColumn("n", F.count("*").over(group).cast("long"))


def delete_selected(overlays: DataFrame, selection: DataFrame) -> DataFrame:
    """Without the selected overlay of each slice of ``selection`` (v, z, selected_idx);
    out of range or null is the last. Adds the new idx and the new selection."""
    joined = ranked(overlays).join(selection.withColumn("_asked", F.lit(True)), ["v", "z"], "left")
    sel = F.col("selected_idx")
    target = F.when(F.col("_asked"), F.when(sel.isNull() | (sel < 0) | (sel >= F.col("n")), F.col("n") - 1).otherwise(sel))
    kept = joined.withColumn("_target", target).where(F.col("_target").isNull() | (F.col("idx") != F.col("_target")))
    left = F.count("*").over(Window.partitionBy("v", "z"))
    out = kept.withColumn("idx", (F.row_number().over(_place()) - 1).cast("long")).withColumn("selection", F.when(F.col("_asked"), F.least(F.col("_target"), left - 1)).cast("long"))
    return out.drop("n", "_asked", "_target", "selected_idx")


def set_metadata(overlays: DataFrame, selection: DataFrame, label: str | None = None, color: str | None = None, layer: str | None = None) -> DataFrame:
    """Label, colour and layer (where given) of the selected overlays; a slice whose
    selection is missing or out of range is unchanged."""
    joined = ranked(overlays).join(selection, ["v", "z"], "left")
    hit = F.coalesce(F.col("idx") == F.col("selected_idx"), F.lit(False))
    for c, value in (("label", label), ("color", color), ("layer", layer)):
        if value is not None:
            joined = joined.withColumn(c, F.when(hit, F.lit(value)).otherwise(F.col(c)))
    return joined.drop("n", "selected_idx")


def overlay_stats(overlays: DataFrame) -> DataFrame:
    """Per volume: committed and preview overlays, and slices that have any of either."""
    done, preview = F.col("status") == "committed", F.col("status") == "preview"
    return overlays.groupBy("v").agg(
        F.count_if(done).alias("committed"),
        F.count_if(preview).alias("preview"),
        F.count_distinct(F.when(done, F.col("z"))).alias("committed_slices"),
        F.count_distinct(F.when(preview, F.col("z"))).alias("preview_slices"),
    )


def layer_options(overlays: DataFrame) -> DataFrame:
    """(pos, layer): All, then the layers of committed overlays and the default, sorted."""
    spark = overlays.sparkSession
    names = overlays.where("status = 'committed'").select(normalize_layer(F.col("layer")).alias("layer")).unionByName(spark.createDataFrame([(DEFAULT_LAYER,)], "layer string"))
    listed = names.groupBy().agg(F.sort_array(F.collect_set("layer")).alias("layers"))  # as many as there are layer names
    return listed.select(F.posexplode(F.concat(F.array(F.lit(ALL_LAYERS)), "layers")).alias("pos", "layer"))


def filter_layer(overlays: DataFrame, view: str) -> DataFrame:
    return overlays if view == ALL_LAYERS else overlays.where(normalize_layer(F.col("layer")) == view)


def draft_polygons(clicks: DataFrame) -> DataFrame:
    """Finished polygons of click logs (session, n, v, z, x, y, finish, cancel): points
    since the last finish or cancel, in order, kept if finished with 3 or more."""
    order = Window.partitionBy("session").orderBy("n")
    ends = (F.col("finish") | F.col("cancel")).cast("int")
    draft = F.coalesce(F.sum(ends).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    point = F.when(F.col("x").isNotNull(), F.struct("n", "x", "y"))
    grouped = clicks.withColumn("draft", draft).groupBy("session", "draft").agg(F.array_sort(F.collect_list(point)).alias("p"), F.max(F.col("finish") & ~F.col("cancel")).alias("finished"), F.max_by("z", "n").alias("z"))
    return grouped.where(F.col("finished") & (F.size("p") >= 3)).select("session", F.col("draft").cast("long").alias("draft"), "z", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points"))


def export_manifest(runs: DataFrame) -> DataFrame:
    """(v, z, file, pixels) of every slice that has a mask."""
    sizes = _pixels(runs)
    return sizes.select("v", "z", F.format_string("mask_%04d.png", "z").alias("file"), "pixels")


def _pixels(runs: DataFrame) -> DataFrame:
    from .masks import union

    return union(runs).groupBy("v", "z").agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("pixels"))


def export_summary(overlays: DataFrame) -> DataFrame:
    """Adds to the counts whether a volume can be exported and whether previews are left out."""
    return overlay_stats(overlays).select("v", "committed", "preview", (F.col("committed") > 0).alias("exportable"), (F.col("preview") > 0).alias("warn_preview"))
