"""Volume files in and masks out."""

import gzip
import struct
import zlib

import numpy as np
import pytest

from voxelspark.sources import files, volumes


def nifti(values: np.ndarray, slope: float = 2.0, inter: float = -1.0) -> bytes:
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, values.ndim, *values.shape, *[1] * (7 - values.ndim))
    struct.pack_into("<2h", head, 70, 4, 16)
    struct.pack_into("<3f", head, 108, 352.0, slope, inter)
    return bytes(head) + values.astype("<i2").tobytes(order="F")


def test_read_volumes(spark, tmp_path):
    a = np.arange(5 * 4 * 3).reshape(5, 4, 3, 1)
    (tmp_path / "a.nii").write_bytes(nifti(a))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(nifti(a[..., 0].transpose(2, 0, 1), 0, 0)))
    (tmp_path / "c.nii").write_bytes(b"nothing of the kind")
    (tmp_path / "d.nii").write_bytes(nifti(np.zeros((3, 4))))
    got = volumes.read_volumes(spark, str(tmp_path)).collect()
    bad = {r.path.rsplit("/")[-1]: r.error for r in got if r.error}
    assert set(bad) == {"c.nii", "d.nii"}
    for name, scale, axis in (("a.nii", lambda x: x * 2 - 1, 2), ("b.nii.gz", lambda x: x, 0)):
        own = sorted((r for r in got if r.path.endswith(name)), key=lambda r: r.z)
        assert len(own) == 3 and {(r.h, r.w, r.axis, r.z_count) for r in own} == {(5, 4, axis, 3)}
        assert np.allclose([r.pixels for r in own], scale(np.moveaxis(a[..., 0], 2, 0).reshape(3, -1)))


def test_masks_round_trip(spark, tmp_path):
    runs = spark.createDataFrame([(7, 1, 2, 0, 1), (7, 1, 2, 1, 3), (7, 9, 0, 0, 0)], "v long, z long, y int, x0 int, x1 int")
    vols = spark.createDataFrame([(7, 2, 3, 4, 1), (8, 2, 3, 4, 0)], "v long, z_count int, h int, w int, axis int")
    volumes.write_files(volumes.mask_files(runs, vols), str(tmp_path), "concat('mask_', v, '.nii')").collect()
    got = {r.path.rsplit("/")[-1] + str(r.z): r.pixels for r in volumes.read_volumes(spark, str(tmp_path)).collect()}
    assert len(got) == 4 and sum(got["mask_7.nii1"]) == 4 and sum(got["mask_7.nii0"]) == 0 and sum(map(sum, got.values())) == 4


def test_a_mask_keeps_its_volumes_header(spark, tmp_path):
    raw = bytearray(nifti(np.ones((3, 5, 1, 4))))
    affine = [0.0, -2.0, 0.5, 10.0, 1.5, 0.0, 0.0, -7.0, 0.0, 0.0, 3.0, 4.0]
    struct.pack_into("<8f", raw, 76, -1.0, 1.5, 2.0, 9.0, 3.0, 1.0, 1.0, 1.0)
    struct.pack_into("<2h", raw, 252, 1, 2)
    struct.pack_into("<12f", raw, 280, *affine)
    (tmp_path / "a.nii").write_bytes(bytes(raw))
    slices = volumes.read_volumes(spark, str(tmp_path / "a.nii"))
    vols = slices.where("z = 0").selectExpr("7L v", "z_count", "h", "w", "axis", "header")
    runs = spark.createDataFrame([(7, 1, 2, 0, 1)], "v long, z long, y int, x0 int, x1 int")
    made = bytes(volumes.mask_files(runs, vols).first().content)
    values, head = volumes.decode(made)
    assert struct.unpack_from("<12f", head, 280) == tuple(affine) and struct.unpack_from("<2h", head, 252) == (1, 2)
    assert struct.unpack_from("<4f", head, 76) == (-1.0, 1.5, 2.0, 3.0)
    assert values.shape == (3, 5, 4) and values.sum() == 2


def test_images(spark, tmp_path):
    runs = spark.createDataFrame([(7, 1, 2, 0, 1)], "v long, z long, y int, x0 int, x1 int")
    vols = spark.createDataFrame([(7, 2, 3, 4)], "v long, z_count int, h int, w int")
    wrote = volumes.write_files(volumes.slice_images(runs, vols), str(tmp_path), "concat(v, '/', file)").collect()
    assert [r.file for r in wrote] == ["7/mask_0001.png"]
    data = (tmp_path / "7/mask_0001.png").read_bytes()
    at = data.index(b"IDAT")
    raw = zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]])
    assert raw == b"\0" + bytes(4) + b"\0" + bytes(4) + b"\0" + b"\xff\xff\0\0"


def _volume(axis: int) -> np.ndarray:
    shape = [9, 7]
    shape.insert(axis, 5)
    return np.random.default_rng(axis).standard_normal(shape).astype("<f4")


@pytest.mark.parametrize("axis", [0, 1, 2])
@pytest.mark.parametrize("packed", [False, True])
def test_data_source_reads_as_the_decoder(spark, tmp_path, axis, packed):
    x = _volume(axis)
    data = volumes.head(list(x.shape), x.dtype) + x.tobytes(order="F")
    (tmp_path / ("a.nii.gz" if packed else "a.nii")).write_bytes(gzip.compress(data) if packed else data)
    (tmp_path / "b.nii").write_bytes(b"no volume")
    (tmp_path / "c.nii").write_bytes(data[:-30])
    files.register(spark)
    got = spark.read.format("volume_slices").option("bytes", 400).load(str(tmp_path))
    whole = np.moveaxis(x, axis, 0)
    mine = {r.z: r for r in got.where("error is null and path not like '%c.nii'").collect()}
    assert sorted(mine) == [*range(5)] and all(r.axis == axis and r.z_count == 5 for r in mine.values())
    assert all(np.array_equal(np.array(r.pixels, "f4").reshape(r.h, r.w), whole[z]) for z, r in mine.items())
    assert got.where("error is not null and path like '%b.nii'").count() == 1
    some = got.where("z >= 1 and z < 4 and z in (0, 1, 3) and path like '%a.nii%'")
    assert sorted(r.z for r in some.collect()) == [1, 3]


@pytest.mark.parametrize("axis", [0, 1, 2])
def test_data_source_writes_whole_files(spark, tmp_path, axis):
    x = np.moveaxis(_volume(axis), axis, 0)
    # Slice 3 is missing.
    rows = [("d/one.nii", z, 9, 7, axis, 5, x[z].ravel().tolist()) for z in (4, 0, 2, 1)]
    df = spark.createDataFrame(rows, "file string, z int, h int, w int, axis int, z_count int, pixels array<float>")
    files.write(df, str(tmp_path / "out"))
    got = {r.z: np.array(r.pixels, "f4").reshape(9, 7) for r in files.read(spark, str(tmp_path / "out")).collect()}
    assert sorted(got) == [*range(5)] and not got[3].any() and all(np.array_equal(got[z], x[z]) for z in (0, 1, 2, 4))
    with pytest.raises(Exception, match="slice 0 after 0"):
        files.write(df.union(df), str(tmp_path / "bad"))
    assert not [p for p in (tmp_path / "bad").rglob("*") if p.is_file()]


def test_short_last_volume_is_read_back_as_given(spark, tmp_path):
    from voxelspark.plans.queries import QUERIES

    spark.createDataFrame([(k, [float(k), -1e-8], k % 3) for k in range(7)], "vec_id long, embedding array<float>, label int").selectExpr("vec_id", "array_repeat(embedding, 32) e", "label").selectExpr("vec_id", "flatten(e) embedding", "label").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["volume_files"](spark, str(tmp_path)).collect()
    assert {(r.v, r.z, r.z_count) for r in got} == {(k // 5, k % 5, 5) for k in range(7)} and len(got) == 7 * 64
    assert {str(r.i) for r in got if r.x % 2} == {"-0.0"}
