"""Views over the given tables in the shapes the operators take.

One vector is one 8 x 8 slice and 50 ids in a row are a volume; one event is one
overlay, one click and one command. See FIXTURES.md.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, deleted when the driver ends; where the
    session names none, a local one if everything runs on this machine."""
    from pyarrow import fs

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{(root or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    store, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    store.create_dir(inner, recursive=True)
    atexit.register(_delete, store, inner)
    return path


def _delete(store, path: str) -> None:
    try:
        store.delete_dir(path)
    except OSError:
        pass  # the store is gone with the session


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    prompt = F.when(F.col("label") == 0, "tumor").when(F.col("label") == 1, "liver").otherwise("")
    return e.select(F.floor(F.col("vec_id") / 50).alias("v"), (F.col("vec_id") % 50).alias("z"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("embedding").alias("pixels"), "label", prompt.alias("prompt"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


#: Overlays that a task takes where slices are dealt out. Each makes some 14 runs.
SHARE = 25_000
#: Partitions up to which a shuffle writes rows to its files as they come; into more, a task holds
#: its rows to sort them (the default of spark.shuffle.sort.bypassMergeThreshold).
DIRECT = 200


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions that the events need, so that what a task sorts doesn't grow with the table."""
    needed = -(-_read(spark, sf_dir, "events").count() // SHARE)
    return max(needed, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Rows of events by slice, a slice in one of ``parts`` partitions. Windows, groups and joins
    by (v, z) then move nothing, and runs are made from overlays that have been moved.

    A scan's task may have any share of the table, as a row group isn't split. So more than
    ``DIRECT`` partitions are dealt from as many heaps, which no task holds whole."""
    n = parts(spark, sf_dir)
    if n > DIRECT:
        rows = rows.withColumn("_heap", F.hash("v", "z")).repartition(DIRECT, "_heap").drop("_heap")
    return rows.repartition(n, "v", "z")


def overlays(spark: SparkSession, sf_dir: str, triangles: bool = False, by_slice: bool = False) -> DataFrame:
    """(v, z, seq, x1, y1, x2, y2, points, label, color, layer, status); layer is raw."""
    e = _events(spark, sf_dir)
    i = F.col("event_id")
    base = e.select(
        F.col("user_id").alias("v"), (i % 32).alias("z"), i.alias("seq"), (F.col("k") % 40).cast("int").alias("x1"), (i % 37).cast("int").alias("y1"), "value", F.col("event_type").alias("label"),
        F.when(i % 11 == 0, "  ").otherwise(F.concat(F.lit("Layer "), (1 + i % 3).cast("string"))).alias("layer"),
        F.when(i % 7 == 0, "").when(i % 13 == 0, "red").otherwise(F.concat(F.lit("#"), F.lpad(F.lower(F.hex(i)), 6, "0"))).alias("color"),
        F.when(i % 5 == 0, "preview").otherwise("committed").alias("status"),
    )
    boxed = base.withColumn("x2", (F.col("x1") + 3 + F.col("seq") % 17).cast("int")).withColumn("y2", (F.col("y1") + 3 + F.floor("value").cast("int") % 20).cast("int"))
    boxed = dealt(spark, sf_dir, boxed.drop("value")) if by_slice else boxed
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    points = [at("x1", "y1"), at("x2", "y1"), *([] if triangles else [at("x2", "y2")]), at("x1", "y2")]
    return boxed.select("v", "z", "seq", "x1", "y1", "x2", "y2", F.array(*points).alias("points"), "label", "color", "layer", "status")


def rectangle_runs(overlays: DataFrame, *keep: str) -> DataFrame:
    """(v, z, seq, keep, y, x0, x1): what is to be left out is left out of ``overlays``."""
    return overlays.select("v", "z", "seq", *keep, F.explode(F.sequence("y1", "y2")).alias("y"), F.col("x1").alias("x0"), F.col("x2").alias("x1"))


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("v")).distinct().select("v", F.lit(32).alias("z_count"), F.lit(64).alias("h"), F.lit(64).alias("w"))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _events(spark, sf_dir).withColumn("n", F.row_number().over(order))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    n = lambda c, name: c.cast("int").alias(name)
    return _numbered(spark, sf_dir).select(F.col("user_id").alias("v"), (i % 32).alias("z"), "n", F.col("event_id").alias("point_id"), n(i * 7 % 900, "cx"), n(i * 13 % 700, "cy"), *[F.lit(x).alias(c) for c, x in (("ox", 100), ("oy", 50), ("vw", 640), ("vh", 512))], (i % 6 == 0).alias("finish"), (i % 29 == 0).alias("cancel"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of ``history.sessions``: what an event does goes by its type and ``event_id`` % 3,
    its slice by ``event_id`` % 4; an item's box is that of the event's overlay."""
    i, third = F.col("event_id"), F.col("event_id") % 3
    kind = (
        F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo")
        .when(F.col("event_type") == "click", F.when(third == 0, "preview").otherwise("add"))
        .when(F.col("event_type") == "purchase", F.when(third == 0, "delete").when(third == 1, "accept").otherwise("accept_all"))
        .otherwise(F.when(third == 0, "meta").when(third == 1, "hit").when(i % 5 == 0, "reject").otherwise("hit"))
    )
    e = _numbered(spark, sf_dir).withColumns({"kind": kind, "x1": (F.col("k") % 40).cast("int"), "y1": (i % 37).cast("int")})
    e = e.withColumns({"x2": (F.col("x1") + 20 + i % 17).cast("int"), "y2": (F.col("y1") + 20 + F.floor("value").cast("int") % 20).cast("int")})
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    points = F.array(at("x1", "y1"), at("x2", "y1"), at("x2", "y2"), at("x1", "y2"))
    item = lambda part: F.struct((i * 2 + part).alias("id"), points.alias("points"))
    # Every other preview has two items.
    items = F.when((F.col("kind") == "preview") & (i % 2 == 0), F.array(item(0), item(1))).when(F.col("kind").isin("add", "preview"), F.array(item(0)))
    layer = F.when((F.col("kind") == "hit") & (i % 2 == 0), F.lit(None)).otherwise(F.concat(F.lit("Layer "), (1 + i % 3).cast("string")))
    return e.select(F.col("user_id").alias("session"), "n", "kind", (i % 4).alias("z"), items.alias("items"), (i * 7 % 64).cast("int").alias("x"), (i * 13 % 64).cast("int").alias("y"), F.concat(F.lit("L"), (i % 10).cast("string")).alias("label"), F.lit("#ff0000").alias("color"), layer.alias("layer"))


def command_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("do")
    return _numbered(spark, sf_dir).select(F.col("user_id").alias("session"), "n", op.alias("op"), "event_id")
