"""What a task holds doesn't grow with the table, and what is exploded is not broadcast."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelspark.operators import imaging, masks, pixels, propagate, rows
from voxelspark.plans.queries import QUERIES
from voxelspark.sources import tables

DATA = "/root/testdata/sf0.001"


def plan(df, capsys) -> list[str]:
    capsys.readouterr()
    df.explain()
    return [line for line in capsys.readouterr().out.split("\n") if "- " in line]


def under_broadcast(lines: list[str]) -> list[str]:
    """The lines of a plan that stand below a broadcast."""
    depth = lambda line: line.index("- ")
    found, top = [], None
    for line in lines:
        top = None if top is not None and depth(line) <= top else top
        if top is not None:
            found.append(line)
        elif "BroadcastExchange" in line:
            top = depth(line)
    return found


def runs_table(spark, rows):
    return spark.createDataFrame(rows, "v long, z long, y int, x0 int, x1 int")


@pytest.mark.parametrize("name", ["overlay_composite", "dense_grid", "dense_volume", "densify"])
def test_exploded_runs_are_not_broadcast(spark, capsys, name):
    assert not [line for line in under_broadcast(plan(QUERIES[name](spark, DATA), capsys)) if "explode(sequence" in line]


def test_drawn_runs_are_cut_to_the_image(spark):
    gray = spark.createDataFrame([(0, 0, 2, 3, [1] * 6), (0, 1, 2, 3, [1] * 6)], "v long, z long, h int, w int, gray array<int>")
    at = [{"x": 0, "y": 0}] * 3
    overlays = spark.createDataFrame([(0, 0, 1, at, "#0000ff", "Layer 1", "committed"), (0, 0, 2, at, "#ff0000", "Layer 1", "committed")], f"v long, z long, seq long, points {'array<struct<x: int, y: int>>'}, color string, layer string, status string")
    runs = spark.createDataFrame([(0, 0, 1, 0, -4, 1), (0, 0, 2, 0, 1, 900), (0, 0, 1, 5, 0, 2), (0, 0, 2, -1, 0, 2)], "v long, z long, seq long, y int, x0 int, x1 int")
    got = {(r.z, r.y, r.x): (r.c_r, r.c_b) for r in pixels.composite(gray, overlays, runs, 1.0).collect()}
    assert len(got) == 12 and {k: c for k, c in got.items() if c != (1, 1)} == {(0, 0, 0): (0, 255), (0, 0, 1): (255, 0), (0, 0, 2): (255, 0)}


@pytest.mark.parametrize("name", ["seed_merge", "dense_volume", "export_manifest", "mask_intersection", "seed_admission", "dense_grid", "mask_union", "seed_masks"])
def test_partitions_grow_with_the_table(spark, monkeypatch, name):
    whole = sorted(map(str, QUERIES[name](spark, DATA).collect()))
    monkeypatch.setattr(tables, "SHARE", 50, raising=False)
    df = QUERIES[name](spark, DATA)
    assert df.rdd.getNumPartitions() >= 20  # of 1,000 events; the session's are 4
    assert sorted(map(str, df.collect())) == whole


def test_common_pixels(spark):
    rng = np.random.default_rng(3)
    images = rng.random((2, 12, 6, 30)) < 0.6
    rows = lambda m: [(0, z, y, x, x + int(rng.integers(0, 2) and x < 29 and m[z, y, x + 1])) for z, y, x in zip(*map(lambda a: a.tolist(), np.nonzero(m)), strict=True)]
    got = masks.intersect(*[runs_table(spark, rows(m)) for m in images]).collect()
    out = np.zeros(images.shape[1:], int)
    for r in got:
        out[r.z, r.y, r.x0 : r.x1 + 1] += 1
        assert r.x0 == 0 or not out[r.z, r.y, r.x0 - 1]
    assert (out == (images[0] & images[1])).all()


def test_prompt_is_the_selected_or_the_last(spark):
    at = lambda k: [{"x": k, "y": k}] * 3
    overlays = spark.createDataFrame([(0, z, k, at(k)) for z in range(5) for k in (3, 5, 9)], "v long, z long, seq long, points array<struct<x: int, y: int>>")
    selection = spark.createDataFrame([(0, 0, 1), (0, 1, 3), (0, 2, -1), (0, 3, None)], "v long, z long, selected_idx long")
    drafts = spark.createDataFrame([(0, 4, at(7)), (1, 0, at(8)), (0, 0, at(8)[:2])], "v long, z long, points array<struct<x: int, y: int>>")
    got = {(r.v, r.z): r.points[0].x for r in propagate.resolve_prompt(overlays, selection, drafts).collect()}
    assert got == {(0, 0): 5, (0, 1): 9, (0, 2): 9, (0, 3): 9, (0, 4): 7, (1, 0): 8}


def test_polygons_are_drawn_without_a_shuffle(spark, capsys):
    assert not [line for line in plan(QUERIES["polygon_raster"](spark, DATA), capsys) if "Exchange" in line]
    rng = np.random.default_rng(4)
    shapes = [[(int(a), int(b)) for a, b in rng.integers(0, 14, (n, 2))] for n in rng.integers(3, 9, 60)]
    x, y = (np.array([p[k] for s in shapes for p in s]) for k in (0, 1))
    out = np.zeros((60, 14, 14), bool)
    for piece in imaging.polygon_runs(np.array([len(s) for s in shapes]), x, y, np.ones(x.size, bool), 40):
        for k, row, a, b in zip(*piece, strict=True):
            assert not out[k, row, max(0, a - 1) : b + 2].any()  # merged
            out[k, row, a : b + 1] = True
    assert all((m == imaging.fill(s, 14, 14)).all() for m, s in zip(out, shapes, strict=True))


def test_an_edge_to_an_unknown_point_is_none(spark):
    df = spark.createDataFrame([(0, 0, 1, [(0, 0), (4, 0), (None, 3)]), (0, 1, 2, [(0, 0), (1, 1)]), (0, 2, 3, None)], "v long, z long, seq long, points array<struct<x: int, y: int>>")
    assert [tuple(r) for r in masks.rasterize(df).collect()] == [(0, 0, 1, 0, 0, 4)]


def test_points_are_worked_out_once_for_an_area(spark, capsys):
    (filter_,) = [line for line in plan(QUERIES["min_area_filter"](spark, DATA), capsys) if " Filter " in line]
    assert filter_.count("get_json_object") <= 6


def test_previews_take_what_they_replace_once(spark, capsys):
    lines = plan(QUERIES["watershed_preview"](spark, DATA), capsys)
    assert len([line for line in lines if " MapInPandas " in line]) == 2  # a watershed and a level set


def test_smoothing_takes_the_slices_of_a_piece_together(spark, monkeypatch):
    rng = np.random.default_rng(5)
    kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("y", "x0", "x1")]))
    shapes = [(3, 5), (1, 2), (1, 2), (4, 4), (3, 5), (3, 5), (3, 5)]
    volumes = [rng.random((n, *s)) < share for s, n, share in zip(shapes, (6, 1, 5, 2, 9, 3, 12), (0.5, 1, 0.3, 0.6, 0.6, 0, 0.4), strict=True)]
    slices = [(v, z, *m.shape, m) for v, stack in enumerate(volumes) for z, m in enumerate(stack)]
    expected = []
    for stack in volumes:
        out = stack.copy()
        for z in range(1, len(stack) - 1):
            most = out[z - 1].astype(int) + stack[z] + stack[z + 1] > 1
            out[z] = most if most.any() else stack[z]
        expected += list(out)
    for at_once, batch in ((1, 1), (1, 7), (31, 4), (70, 50), (1000, 3), (1000, 50)):
        monkeypatch.setattr(propagate, "SMOOTHED", at_once)
        given = []
        for k in range(0, len(slices), batch):
            *keys, images = zip(*slices[k : k + batch], strict=True)
            lists = pa.array([rows.from_image(m) if m.any() else None for m in images], kind)
            given.append(pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in keys], lists], ["v", "z", "h", "w", "rows"]))
        got = [r for b in propagate._smooth(iter(given)) for r in b.to_pylist()]
        assert [(r["v"], r["z"], r["h"], r["w"], r["rows"]) for r in got] == [(*s[:4], rows.from_image(m)) for s, m in zip(slices, expected, strict=True)]


def test_densify_merges_once_and_deals_volumes(spark, monkeypatch, capsys):
    lines = plan(QUERIES["densify"](spark, DATA), capsys)
    assert len([line for line in lines if " Window " in line]) == 3 and not [line for line in lines if " MapInPandas " in line]
    monkeypatch.setattr(tables, "SHARE", 50)
    assert QUERIES["densify"](spark, DATA).rdd.getNumPartitions() >= 20


@pytest.mark.parametrize("name", ["dense_grid", "seed_admission", "dense_volume", "seed_merge"])
def test_seeds_are_merged_once(spark, capsys, name):
    assert len([line for line in plan(QUERIES[name](spark, DATA), capsys) if " Window " in line]) == 2


def test_the_box_of_a_prompt_is_that_of_its_drawing(spark, capsys):
    rng = np.random.default_rng(6)
    point = lambda: None if rng.random() < 0.05 else tuple(None if rng.random() < 0.15 else int(c) for c in rng.integers(-9, 30, 2))
    shapes = [[point() for _ in range(n)] for n in rng.integers(0, 9, 300)] + [None, [(4, 4)] * 3, [(1, 2), (None, 3), (7, 9)]]
    prompts = spark.createDataFrame([(0, k, s) for k, s in enumerate(shapes)], "v long, z long, points array<struct<x: int, y: int>>")
    drawn = masks.bbox(masks.rasterize(prompts.withColumn("seq", F.lit(0).cast("long"))))
    got = propagate.build_requests(prompts, "3d")
    assert {r.z: r.bbox for r in got.collect()} == {r.z: [r.x1, r.y1, r.x2, r.y2] for r in drawn.collect()}
    assert not [line for line in plan(got, capsys) if "Exchange" in line or "Arrow" in line]


def test_prompts_stay_where_slices_are_dealt(spark, monkeypatch):
    whole = sorted(map(str, QUERIES["prompt_bbox"](spark, DATA).collect()))
    monkeypatch.setattr(tables, "SHARE", 50)
    df = QUERIES["prompt_bbox"](spark, DATA)
    assert df.rdd.getNumPartitions() >= 20
    assert sorted(map(str, df.collect())) == whole


@pytest.mark.parametrize("name", ["mask_union", "mask_intersection", "seed_merge", "dense_grid", "prompt_bbox", "export_manifest"])
def test_no_scan_is_sorted_for_a_shuffle(spark, monkeypatch, capsys, name):
    whole = sorted(map(str, QUERIES[name](spark, DATA).collect()))
    monkeypatch.setattr(tables, "SHARE", 50)
    monkeypatch.setattr(tables, "DIRECT", 5, raising=False)
    df = QUERIES[name](spark, DATA)
    shuffles = [line for line in plan(df, capsys) if "Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" in line]
    dealt = [k for k, line in enumerate(shuffles) if "(v#" in line and ", 20)" in line]
    assert dealt and all("(_heap#" in shuffles[k + 1] and ", 5)" in shuffles[k + 1] for k in dealt)  # a heap before each
    assert sorted(map(str, df.collect())) == whole
