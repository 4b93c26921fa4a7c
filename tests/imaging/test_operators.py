"""Operators on small inputs worked by hand or against slow twins."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.functions import scalars
from voxelspark.operators import annotate, history, imaging, masks, models, outline, pixels, propagate, rows, segment
from voxelspark.schema import LevelSet, Watershed

rng = np.random.default_rng(5)


def runs_of(spark, images):
    rows = [(0, z, y, x, x) for z, m in enumerate(images) for y, x in zip(*map(lambda a: a.tolist(), np.nonzero(m)))]
    return masks.union(spark.createDataFrame(rows or [(9, 9, 0, 0, 0)], "v long, z long, y int, x0 int, x1 int"))


def images_of(df, n, h, w):
    out = [np.zeros((h, w), bool) for _ in range(n)]
    for r in df.collect():
        if r.v == 0:
            out[r.z][r.y, r.x0 : r.x1 + 1] = True
    return out


def slices_of(spark, images):
    return spark.createDataFrame([(0, z, *i.shape, [float(x) for x in i.ravel()]) for z, i in enumerate(images)], "v long, z long, h int, w int, pixels array<float>")


def test_range_ignores_non_finite_and_is_never_empty(spark):
    df = spark.createDataFrame([(0, 0, 1, 3, [float("nan"), float("inf"), 2.0]), (1, 0, 1, 2, [7.0, 7.0]), (2, 0, 1, 1, [float("nan")])], "v long, z long, h int, w int, pixels array<float>")
    got = {r.v: (r.raw_min, r.raw_max) for r in pixels.intensity_range(df).collect()}
    assert got == {0: (2.0, 3.0), 1: (7.0, 8.0), 2: (0.0, 1.0)}
    assert {r.v: list(r.gray) for r in pixels.full_window(df).collect()} == {0: [0, 255, 0], 1: [0, 0], 2: [0]}


def test_otsu(spark):
    flat, two = np.full((8, 8), 7), np.repeat([[10] * 4 + [200] * 4], 8, 0)
    df = spark.createDataFrame([(0, z, [int(x) for x in i.ravel()]) for z, i in enumerate((flat, two))], "v long, z long, gray array<int>")
    assert sorted(map(tuple, segment.otsu(df).collect())) == [(0, 0, 0, 64, 64), (0, 1, 10, 32, 64)]
    for _ in range(20):
        g = rng.integers(0, 256, (6, 6))
        t = segment.otsu(spark.createDataFrame([(0, 0, [int(x) for x in g.ravel()])], "v long, z long, gray array<int>")).first().t if _ < 3 else imaging.otsu(g)
        assert t == imaging.otsu(g)


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.hex_to_rgb(F.lit("#0aFf10")).alias("a"), scalars.hex_to_rgb(F.lit("red")).alias("b"), scalars.hex_to_rgb(F.lit(None).cast("string")).alias("c"),
        scalars.normalize_layer(F.lit("  ")).alias("d"), scalars.label_filter(F.lit(" All ")).alias("e"), scalars.label_filter(F.lit("a, b ,,")).alias("f"),
    ).first()
    assert tuple(row.a) == (10, 255, 16) and tuple(row.b) == tuple(row.c) == (255, 0, 0)
    assert (row.d, row.e, row.f) == ("Layer 1", None, ["a", "b"])


def test_point_in_polygon(spark):
    square = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))])
    df = spark.createDataFrame([(0, 0), (0, 2), (2, 0), (4, 2), (2, 4), (3, 3)], "x int, y int")
    assert [r[0] for r in df.select(scalars.point_in_polygon(F.col("x"), F.col("y"), square)).collect()] == [True, True, True, False, False, True]


@pytest.mark.parametrize("op", ["dilate", "erode"])
@pytest.mark.parametrize("kernel", [masks.box_kernel(1), masks.box_kernel(2), masks.ellipse_kernel(3), masks.ellipse_kernel(5), masks.ellipse_kernel(1)])
def test_morphology(spark, op, kernel):
    h, w = 6, 7
    images = [rng.random((h, w)) < p for p in (0.3, 0.7, 0.95)] + [np.zeros((h, w), bool), np.ones((h, w), bool)]
    grid = spark.createDataFrame([(0, z, h, w) for z in range(len(images))], "v long, z long, h int, w int")
    got = images_of(getattr(masks, op)(runs_of(spark, images), grid, kernel), len(images), h, w)

    def brute(m):
        out = np.zeros_like(m)
        for y in range(h):
            for x in range(w):
                seen = [m[y + dy, x + dx] for dy, hw in kernel for dx in range(-hw, hw + 1) if 0 <= y + dy < h and 0 <= x + dx < w]
                out[y, x] = any(seen) if op == "dilate" else all(seen)
        return out

    for m, g in zip(images, got, strict=True):
        assert (g == brute(m)).all() and (getattr(imaging, op)(m, kernel) == brute(m)).all()


def test_components(spark):
    images = [rng.random((7, 7)) < p for p in (0.2, 0.4, 0.6)] + [np.eye(5, 7, dtype=bool)]
    for diagonal in (True, False):
        got = masks.components(runs_of(spark, images), diagonal).groupBy("z").agg(F.count_distinct("component").alias("n")).collect()
        assert {r.z: r.n for r in got} == {z: imaging.label(m, diagonal)[1] for z, m in enumerate(images)}


def test_outlines_fill_holes_and_drop_lines():
    ring = np.ones((7, 7), bool)
    ring[1:6, 1:6] = False
    ring[3, 3] = True
    assert imaging.committed(ring, 1).all()
    line = np.zeros((3, 8), bool)
    line[1, 1:7] = True
    assert imaging.polygons(line, 1) == []
    box = np.zeros((6, 8), bool)
    box[1:4, 2:6] = True
    (p,) = imaging.polygons(box, 1)
    assert sorted(p) == [(2, 1), (2, 3), (5, 1), (5, 3)] and imaging.area(p) == 6
    for _ in range(200):
        m = rng.random((8, 8)) < 0.55
        assert (imaging.committed(m, 0) | ~imaging.dilate(imaging.erode(m, masks.box_kernel(1)), masks.box_kernel(1))).all()
        for q in imaging.outlines(m):
            assert all(m[y, x] for x, y in q)


def test_rasterize_equals_fill(spark):
    shapes = [[tuple(map(int, p)) for p in rng.integers(0, 12, (n, 2))] for n in (3, 4, 5, 6, 3, 4)]
    df = spark.createDataFrame([(0, k, k, [{"x": x, "y": y} for x, y in s]) for k, s in enumerate(shapes)], "v long, z long, seq long, points array<struct<x: int, y: int>>")
    for s, g in zip(shapes, images_of(masks.rasterize(df), len(shapes), 12, 12), strict=True):
        assert (g == imaging.fill(s, 12, 12)).all()


def test_chamfer_and_blur():
    m = np.ones((5, 5), bool)
    m[2, 2] = False
    d = imaging.chamfer(m)
    assert d[2, 2] == 0 and d[2, 3] == 1 and d[1, 1] == pytest.approx(1.4) and d[0, 1] == pytest.approx(2.1969)
    flat = np.full((4, 5), 9)
    assert (imaging.blur(flat) == 9).all()
    assert imaging.blur(np.array([[16]])).tolist() == [[16]]


def test_floods_find_a_bright_square(spark):
    g = np.full((24, 24), 10)
    g[6:18, 6:18] = 200
    df = spark.createDataFrame([(0, 0, 24, 24, [int(x) for x in g.ravel()])], "v long, z long, h int, w int, gray array<int>")
    for found in (segment.watershed(df, Watershed(min_area=4)), segment.level_set(df, LevelSet(min_area=4))):
        (row,) = found.collect()
        xs, ys = [p.x for p in row.points], [p.y for p in row.points]
        assert 4 <= min(xs) <= 8 and 15 <= max(xs) <= 19 and 4 <= min(ys) <= 8 and 15 <= max(ys) <= 19
    assert "Exchange" not in segment.watershed_masks(df)._jdf.queryExecution().executedPlan().toString()


def test_settings_are_clamped():
    assert Watershed(5, -1, 99, 0) == Watershed(0.95, 0, 30, 1)
    assert LevelSet(0, 4, 0) == LevelSet(1, 5, 1)


def test_interpolation_rounds_half_to_even(spark):
    boxes = spark.createDataFrame([(0, 0, 0, 0, 4, 4), (0, 2, 5, 1, 9, 7)], "v long, z long, x1 long, y1 long, x2 long, y2 long")
    grid = spark.createDataFrame([(0, z) for z in range(4)], "v long, z long")
    got = {r.z: (r.x1, r.y1, r.x2, r.y2, r.is_seed) for r in propagate.interpolate_seeds(boxes, grid).collect()}
    assert got[1] == (2, 0, 6, 6, False) and got[3] == (5, 1, 9, 7, False) and got[0][-1]


def test_densify_smooths_in_order(spark):
    stack = [(1, 1), (0, 1), (1, 1), (0, 1), (1, 1)]
    rows = [(0, z, 0, x, x) for z, s in enumerate(stack) for x, on in enumerate(s) if on]
    runs = spark.createDataFrame(rows, "v long, z long, y int, x0 int, x1 int")
    got = propagate.densify(runs, spark.createDataFrame([(0, 5, 1, 2)], "v long, z_count int, h int, w int"))
    assert [[(r.y, r.x0, r.x1) for r in row.rows] for row in got.orderBy("z").collect()] == [[(0, 0, 1)]] * 5


def test_undo_redo(spark):
    ops = ["undo", "do", "do", "undo", "redo", "redo", "undo", "do", "undo", "undo", "undo", "redo"]
    log = spark.createDataFrame([(1, k, op, 100 + k) for k, op in enumerate(ops)] + [(2, 0, "undo", 1)], "session long, n int, op string, event_id long")
    assert sorted(map(tuple, history.replay(log).collect())) == [(1, 1, 101)]


LOG = "session long, n int, op string, event_id long"


def _streamed(spark, folder, idle=None, until=None) -> dict:
    """What the rows of all batches leave a session: (live, late, closed)."""
    from voxelspark.streaming.history import replay_stream

    def left() -> dict:
        rows = spark.read.schema("session long, live array<long>, late long, closed boolean, batch long").parquet(str(folder / "out")).orderBy("batch").collect()
        return {r.session: (list(r.live), r.late, r.closed) for r in rows}

    (folder / "out").mkdir(exist_ok=True)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(folder / "log"))
    keep = lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("append").parquet(str(folder / "out"))
    q = replay_stream(stream, idle).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(folder / "state")).start()
    if until is None:
        q.processAllAvailable()
    end = time.monotonic() + 60
    while until and not until(left()) and q.isActive and time.monotonic() < end:
        time.sleep(1)
    q.stop()
    return left()


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    ops = rng.choice(["do", "do", "undo", "redo"], 60).tolist()
    rows = [(k % 3, k, op, k) for k, op in enumerate(ops)]
    got: dict = {}
    for part in range(3):  # a new query from the checkpoint each time
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        got = _streamed(spark, tmp_path)
    batch: dict = {s: [] for s in range(3)}
    for s, _, e in sorted(map(tuple, history.replay(spark.createDataFrame(rows, LOG)).collect())):
        batch[s].append(e)
    assert {s: live for s, (live, *_) in got.items()} == batch
    spark.createDataFrame([(0, 5, "do", 999)], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    assert _streamed(spark, tmp_path)[0] == (batch[0], 1, False)


def test_stream_drops_idle_sessions(spark, tmp_path):
    spark.createDataFrame([(7, 1, "do", 1), (7, 2, "do", 2)], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    assert _streamed(spark, tmp_path, 500, lambda got: got.get(7, (0, 0, 0))[2])[7] == ([], 0, True)
    spark.createDataFrame([(7, 1, "do", 3)], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    assert _streamed(spark, tmp_path, 60_000, lambda got: not got[7][2])[7] == ([3], 0, False)


def _session(spark, *lines):
    """The end of one session: z -> (selected, ids, labels, previews)."""
    box = [{"x": 0, "y": 0}, {"x": 10, "y": 0}, {"x": 10, "y": 10}, {"x": 0, "y": 10}]
    rows = [(1, n, kind, z, [{"id": i, "points": box} for i in ids], x, 5, f"L{n}", "red", None) for n, (kind, z, ids, x) in enumerate(lines)]
    schema = "session long, n int, kind string, z long, items array<struct<id: long, points: array<struct<x: int, y: int>>>>, x int, y int, label string, color string, layer string"
    return {r.z: (r.selected, [o.id for o in r.overlays], [o.label for o in r.overlays], r.previews) for r in history.sessions(spark.createDataFrame(rows, schema)).collect()}


def test_sessions(spark):
    add, undo, redo = (lambda i, z=0: ("add", z, [i], 0)), ("undo", 0, [], 0), ("redo", 0, [], 0)
    at = lambda kind, x=5: (kind, 0, [], x)
    show = lambda *ids, z=0: ("preview", z, [*ids], 0)
    # A hit takes the topmost or none; a delete clamps; undo puts back place and selection.
    assert _session(spark, add(1), add(2), at("hit"))[0] == (1, [1, 2], ["L0", "L1"], [])
    assert _session(spark, add(1), add(2), at("hit", 50), at("delete"))[0] == (0, [1], ["L0"], [])
    assert _session(spark, add(1), at("delete"))[0] == (-1, [], [], [])
    assert _session(spark, add(1), add(2), at("hit", 50), at("delete"), undo)[0] == (-1, [1, 2], ["L0", "L1"], [])
    # An undone accept loses its preview, one of all accepts brings it back; redo clears even a new one.
    assert _session(spark, show(1, 2), at("accept"), undo)[0] == (-1, [], [], [])
    assert _session(spark, show(1, 2), show(3, z=1), at("accept_all"), undo) == {0: (-1, [], [], [1, 2]), 1: (-1, [], [], [3])}
    assert _session(spark, show(1), at("accept_all"), undo, show(4, z=2), redo) == {0: (0, [1], ["L0"], [])}
    # What finds nothing to do is no command: redo still works after it. A new command ends it.
    assert _session(spark, add(1), undo, at("delete"), at("meta"), at("accept"), redo)[0] == (0, [1], ["L0"], [])
    assert _session(spark, add(1), undo, add(2), redo)[0] == (0, [2], ["L2"], [])
    assert _session(spark, add(1), at("meta"), add(2), undo, undo)[0] == (0, [1], ["L0"], [])
    assert _session(spark, add(1), at("meta"), at("reject"), at("unknown"))[0] == (0, [1], ["L1"], [])
    assert _session(spark, undo, redo) == {}


def test_selection_rules(spark):
    o = spark.createDataFrame([(0, 0, k, "a", None, None, "committed") for k in (3, 5, 9)], "v long, z long, seq long, label string, color string, layer string, status string")
    sel = lambda k: spark.createDataFrame([(0, 0, k)], "v long, z long, selected_idx long")
    kept = lambda k: sorted(r.seq for r in annotate.delete_selected(o, sel(k)).collect())
    assert kept(0) == [5, 9] and kept(-1) == kept(7) == kept(None) == [3, 5]
    named = lambda k: [r.label for r in annotate.set_metadata(o, sel(k), label="b").orderBy("seq").collect()]
    assert named(1) == ["a", "b", "a"] and named(-1) == named(None) == ["a", "a", "a"]


def test_model_outputs():
    s = (2, 3)
    assert len(models.normalize(np.ones(s), s)) == 1 and len(models.normalize(np.ones((4, *s)), s)) == 4
    assert len(models.normalize(np.ones((*s, 1)), s)) == 1 and models.normalize(np.ones((3, 3)), s) == []
    assert len(models.normalize([{"mask": np.ones(s)}, np.zeros(s)], s)) == 2 and models.normalize(None, s) == []
    assert len(models.normalize(np.ones((5, 4, 2, 3)), (4, 2, 3))) == 1
    with pytest.raises(ValueError):
        models.normalize(np.ones(4), s)


def test_model_failures_are_messages(spark):
    class Broken:
        supports_volume = False

        def predict(self, image, prompt, request):
            raise RuntimeError("no weights")

    df = spark.createDataFrame([(0, 0, 1, 2, [1, 2])], "v long, z long, h int, w int, gray array<int>")
    slow = models.predict_slices(df, models.PercentilePredictor(needs_prompt=True)).first()
    assert (slow.ok, slow.masks) == (True, [])
    volume = models.predict_volumes(df, models.PercentilePredictor()).first()
    assert (volume.ok, volume.message) == (False, "volumes are not supported")


def test_hit_test_plan_has_no_nested_loop(spark):
    o = spark.createDataFrame([(0, 0, 1, [{"x": 0, "y": 0}, {"x": 4, "y": 0}, {"x": 0, "y": 4}], "a", "", None)], "v long, z long, seq long, points array<struct<x: int, y: int>>, label string, color string, layer string")
    p = spark.createDataFrame([(0, 0, 1, 1, 1), (0, 0, 2, 9, 9)], "v long, z long, point_id long, x int, y int")
    found = masks.hit_test(p, o)
    assert {r.point_id: r.idx for r in found.collect()} == {1: 0, 2: -1}
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def filled(m):
    labels, _ = imaging.label(np.pad(~m, 1, constant_values=True), False)
    return ~(labels == labels[0, 0])[1:-1, 1:-1]


def test_outlines_on_runs_equal_traced_ones(spark):
    h, w = 9, 11
    ring = np.zeros((h, w), bool)
    ring[1:8, 1:9] = True
    ring[2:7, 2:8] = False
    ring[4, 4] = True  # an island in the hole
    images = [rng.random((h, w)) < p for p in np.linspace(0.1, 0.9, 25)] + [ring, np.eye(h, w, dtype=bool), np.zeros((h, w), bool), np.ones((h, w), bool)]
    df = spark.createDataFrame([(0, z, h, w, [bool(x) for x in m.ravel()]) for z, m in enumerate(images)], "v long, z long, h int, w int, mask array<boolean>")
    grid, runs = df.select("v", "z", "h", "w"), runs_of(spark, images)
    found: dict = {}
    for r in segment.contours(df, 1).collect():
        found.setdefault(r.z, []).append((r.part, [(p.x, p.y) for p in r.points]))
    kept = images_of(outline.committed(runs, grid, 1), len(images), h, w)
    for z, m in enumerate(images):
        assert sorted(found.get(z, [])) == [*enumerate(imaging.polygons(filled(m), 1))]
        assert (kept[z] == imaging.committed(m, 1)).all()
    assert len(found[25]) == 1  # what lies in a hole has no outline of its own


def test_runs_within_a_slice_row(spark):
    images = [rng.random((5, 6)) < p for p in (0.0, 0.3, 0.6, 1.0)]
    df = spark.createDataFrame([(0, z, 5, 6, [bool(x) for x in m.ravel()], list(range(30))) for z, m in enumerate(images)], "v long, z long, h int, w int, mask array<boolean>, gray array<int>")
    packed = df.withColumn("rows", rows.of_mask("mask", F.col("h"), F.col("w")))
    for r in packed.select("z", "rows", rows.size(F.col("rows")).alias("n"), rows.values(F.col("gray"), F.col("w"), F.col("rows")).alias("values"), rows.bounds(F.col("rows")).alias("box")).collect():
        m = images[r.z]
        y, x = np.nonzero(m)
        assert [q.asDict() for q in r.rows] == rows.from_image(m) and (rows.to_image(r.rows, m.shape) == m).all()
        assert r.n == m.sum() and r["values"] == np.flatnonzero(m).tolist()
        assert (None if r.box is None else tuple(r.box)) == ((x.min(), y.min(), x.max(), y.max()) if m.any() else None)
    odd = spark.createDataFrame([(0, 1, 0, -3, 1), (0, 1, 0, 2, 9), (0, 1, 7, 0, 3), (0, 9, 0, 0, 1)], "v long, z long, y int, x0 int, x1 int")
    assert [(r.z, [tuple(q) for q in r.rows]) for r in rows.gathered(odd, df).collect()] == [(1, [(0, 0, 5)])]


def test_blur_and_distance_in_the_row_equal_their_twins(spark):
    for h, w in ((1, 1), (2, 2), (1, 7), (5, 3), (13, 17)):
        images = [rng.integers(0, 256, (h, w)) for _ in range(3)]
        gray = spark.createDataFrame([(0, z, h, w, [int(x) for x in g.ravel()]) for z, g in enumerate(images)], "v long, z long, h int, w int, gray array<int>")
        assert {r.z: r["values"] for r in segment.blur(gray).collect()} == {z: imaging.blur(g).ravel().tolist() for z, g in enumerate(images)}
        lit = [rng.random((h, w)) < p for p in (0.5, 0.97)] + [np.ones((h, w), bool), np.zeros((h, w), bool)]
        df = spark.createDataFrame([(0, z, h, w, [bool(x) for x in m.ravel()]) for z, m in enumerate(lit)], "v long, z long, h int, w int, mask array<boolean>")
        packed = df.select("v", "z", "h", "w", rows.of_mask("mask", F.col("h"), F.col("w")).alias("rows"))
        for r in segment.distance(packed).collect():
            assert np.allclose(r["values"], np.nan_to_num(imaging.chamfer(lit[r.z]), posinf=-1.0).ravel())


def test_a_large_slice_has_its_distance_soon(spark):
    import time

    n = 512
    df = spark.createDataFrame([(0, 0, n, n, [{"y": y, "x0": 2, "x1": n - 3} for y in range(2, n - 2)])], f"v long, z long, h int, w int, rows {rows.ROWS}")
    began = time.perf_counter()
    top = segment.distance(df).select(F.array_max("values")).first()[0]
    assert top == n / 2 - 2 and time.perf_counter() - began < 30
