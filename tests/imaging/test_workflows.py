"""Whole runs on one small volume."""

import numpy as np

from voxelspark.operators import annotate, masks, models, segment
from voxelspark.plans import workflows
from voxelspark.schema import Watershed

OVERLAY = "v long, z long, seq long, points array<struct<x: int, y: int>>, label string, color string, layer string, status string"


def volume(spark, n=4, size=24):
    rows = []
    for z in range(n):
        g = np.full((size, size), 0 if z == 2 else 10)
        if z != 2:
            g[6:18, 6 + z : 18 + z] = 200
        rows.append((0, z, size, size, [int(x) for x in g.ravel()]))
    return spark.createDataFrame(rows, "v long, z long, h int, w int, gray array<int>")


def square(x, y, k):
    return [{"x": x, "y": y}, {"x": x + k, "y": y}, {"x": x + k, "y": y + k}, {"x": x, "y": y + k}]


def test_preview_replaces_and_clears_then_commits(spark):
    gray = volume(spark)
    existing = spark.createDataFrame([(0, 2, 0, square(1, 1, 3), "a", "#00ff00", "Layer 1", "preview"), (0, 0, 5, square(1, 1, 3), "a", "#00ff00", "Layer 1", "committed")], OVERLAY)
    found = segment.watershed(gray, Watershed(min_area=4))
    shown = workflows.preview_run(existing, gray, found)
    assert sorted((r.z, r.seq, r.status) for r in shown.collect()) == [(0, 5, "committed"), (0, 6, "preview"), (1, 0, "preview"), (3, 0, "preview")]
    accepted = annotate.accept(shown)
    assert sorted((r.z, r.idx) for r in accepted.collect()) == [(0, 0), (0, 1), (1, 0), (3, 0)]
    done, slices = workflows.commit_run(existing, found, label="a")
    assert slices.first().slices == 3 and {r.color for r in done.where("label = 'a'").collect()} == {"#00ff00"}


def test_seeded_volume_and_prompted_slices(spark):
    gray = volume(spark)
    overlays = spark.createDataFrame([(0, 0, 0, square(6, 6, 11), "organ", "", "Layer 1", "committed"), (0, 3, 1, square(9, 6, 11), "organ", "", "Layer 1", "committed"), (0, 1, 2, square(0, 0, 3), "other", "", "Layer 1", "committed")], OVERLAY)
    runs = masks.rasterize(overlays)
    volumes = spark.createDataFrame([(0, 4, 24, 24)], "v long, z_count int, h int, w int")
    for stride in (0, 3):
        found = workflows.seeded_volume_run(gray, overlays, runs, volumes, models.RoiPredictor(), "organ", stride)
        assert {r.z for r in found.collect()} >= {0, 1, 3}
    seeds = runs.where("seq < 2")
    drawn = spark.createDataFrame([], "v long, y int, x0 int, x1 int")
    polygons, found = workflows.prompted_slice_run(gray, seeds, drawn, models.RoiPredictor(), promptable=True)
    own = {r.z: r.points for r in polygons.collect()}
    assert {(p.x, p.y) for p in own[0]} == {(6, 6), (17, 6), (17, 17), (6, 17)}
    assert all(r.ok for r in found.collect())
    polygons, found = workflows.prompted_slice_run(gray, seeds.limit(0), drawn, models.RoiPredictor(), promptable=True)
    assert polygons.count() == 0 and {(r.ok, r.message) for r in found.collect()} == {(False, models.NEEDS_PROMPT)}
    files, report = workflows.export_run(overlays, runs)
    assert [(r.z, r.pixels) for r in files.orderBy("z").collect()] == [(0, 144), (1, 16), (3, 144)] and report.first().exportable


def test_refused_seeds_leave_the_box(spark):
    """Seeds of another shape are not used; their volume is run all the same, with its box."""
    gray = volume(spark)
    overlays = spark.createDataFrame([(0, 0, 0, square(8, 8, 5), "organ", "", "Layer 1", "committed")], OVERLAY)
    runs = masks.rasterize(overlays)
    volumes = spark.createDataFrame([(0, 4, 24, 24)], "v long, z_count int, h int, w int")
    declared = spark.createDataFrame([(0, 4, 24, 12)], "v long, z_count int, h int, w int")
    boxes = spark.createDataFrame([(0, 2, 6, 20, 17)], "v long, x1 int, y1 int, x2 int, y2 int")
    run = lambda **more: {r.z: {(p.x, p.y) for p in r.points} for r in workflows.seeded_volume_run(gray, overlays, runs, volumes, models.RoiPredictor(), "organ", **more).where("z = 0").collect()}
    assert run()[0] == {(8, 8), (13, 8), (13, 13), (8, 13)}
    assert run(declared=declared, boxes=boxes)[0] == {(6, 6), (17, 6), (17, 17), (6, 17)}
    assert run(declared=volumes, boxes=boxes)[0] == run()[0]


def test_seed_masks_are_not_their_boxes(spark):
    g = [10 * x for x in range(8)] * 8
    df = spark.createDataFrame([(0, 0, 8, 8, g), (0, 1, 8, 8, g)], "v long, z long, h int, w int, gray array<int>")
    seeds = spark.createDataFrame([(0, 0, y, 0, y) for y in range(5)] + [(0, 0, 9, 0, 3), (0, 1, 0, 20, 30)], "v long, z long, y int, x0 int, x1 int")
    none = spark.createDataFrame([], "v long, x1 int, y1 int, x2 int, y2 int")
    got = {r.z: r for r in segment.seeded_predict(df, seeds, none).collect()}
    inside = [10 * x for y in range(5) for x in range(y + 1)]
    thr = float(np.percentile(inside, 60))
    assert got[0].roi == "seed" and got[0].thr == thr and got[1].roi == "none" and got[1].thr == float(np.percentile(g, 70))
    assert {(r.y, x) for r in got[0].rows for x in range(r.x0, r.x1 + 1)} == {(y, x) for y in range(5) for x in range(y + 1) if 10 * x >= thr}


def test_a_prompt_mask_hides_and_cuts(spark):
    class Seen:
        supports_volume = False

        def predict(self, image, prompt, request):
            assert request["bbox"] == [1, 0, 2, 1] and request["seed_mode"] == "2d" and image.tolist() == [[0, 5, 0], [0, 5, 5], [0, 0, 0]]
            return [np.ones((3, 3)), np.eye(3)]

    df = spark.createDataFrame([(0, 0, 3, 3, [5] * 9)], "v long, z long, h int, w int, gray array<int>")
    drawn = spark.createDataFrame([(0, 0, 1, 1), (0, 1, 1, 2)], "v long, y int, x0 int, x1 int")
    asked = models.prompted_request(df, spark.createDataFrame([], "v long, z long, y int, x0 int, x1 int"), drawn, True)
    (row,) = models.predict_slices(asked, Seen()).collect()
    flat = lambda m: [(r.y, r.x0, r.x1) for r in m]
    assert row.message == "" and [flat(m) for m in row.masks] == [[(0, 1, 1), (1, 1, 2)], [(1, 1, 1)]] and flat(row.mask) == [(0, 1, 1), (1, 1, 2)]
