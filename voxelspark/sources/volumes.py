"""Reading volume files as slices and writing masks back.

Files are read through Spark's ``binaryFile`` source, whatever store they are in, and
decoded in tasks: one file is one volume. The format is NIfTI-1, plain or gzipped.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# NIfTI-1 data types.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
SLICES = "path string, z long, h int, w int, axis int, z_count int, pixels array<float>, header binary, error string"


def layout(head: bytes) -> tuple[str, np.dtype, tuple[int, ...], int, float, float]:
    """Byte order, type, dimensions, where the values begin, slope and intercept."""
    order = next((o for o in "<>" if len(head) >= 348 and struct.unpack_from(o + "i", head)[0] == 348), None)
    if order is None:
        raise ValueError("not a NIfTI-1 file")
    dims = struct.unpack_from(order + "8h", head, 40)
    kind = struct.unpack_from(order + "h", head, 70)[0]
    offset, slope, inter = struct.unpack_from(order + "3f", head, 108)
    if kind not in TYPES:
        raise ValueError(f"data type {kind}")
    return order, np.dtype(order + TYPES[kind]), dims[1 : 1 + dims[0]], int(offset), slope, inter


def decode(data: bytes) -> tuple[np.ndarray, bytes]:
    """Scaled float32 values in file orientation, and the header."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    _, dtype, shape, offset, slope, inter = layout(data)
    values = np.frombuffer(data, dtype, int(np.prod(shape)), offset).reshape(shape, order="F").astype(np.float32)
    return (values * slope + inter if slope else values).astype(np.float32), data[:348]


def oriented(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Without dimensions of size 1, slices first: the first smallest dimension is z."""
    values = values.squeeze()
    if values.ndim != 3:
        raise ValueError(f"{values.ndim} dimensions, not 3")
    axis = int(np.argmin(values.shape))
    return np.moveaxis(values, axis, 0), axis


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """A row a slice, with its file's header; a file that can't be read is one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    values, header = decode(bytes(data))
                    volume, axis = oriented(values)
                    n, h, w = volume.shape
                    for at in range(0, n, 64):
                        part = volume[at : at + 64]
                        k = len(part)
                        yield pd.DataFrame({"path": [name] * k, "z": range(at, at + k), "h": h, "w": w, "axis": axis, "z_count": n, "pixels": [p.ravel().tolist() for p in part], "header": [header] * k, "error": None})
                except (ValueError, struct.error, OSError, EOFError, zlib.error) as e:
                    yield pd.DataFrame({"path": [name], "z": None, "h": None, "w": None, "axis": None, "z_count": None, "pixels": None, "header": None, "error": [str(e)]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, SLICES)


def volume_axis(dims):
    """Of an array of dimensions: which of them, without those of size 1, is z."""
    kept = F.filter(dims, lambda d: d > 1)
    return (F.array_position(kept, F.array_min(kept)) - 1).cast("int")


def head(shape: list[int], dtype: np.dtype, header: bytes | None = None) -> bytes:
    """The 352 bytes before the values. Of the volume's ``header``, if given, the affine,
    voxel sizes, units and texts are kept."""
    head, order = bytearray(352), "<"
    if header is None:
        struct.pack_into("<8f", head, 76, *[1.0] * 8)
    else:
        head[:348] = header
        order = "<" if struct.unpack_from("<i", header)[0] == 348 else ">"
        dims, sizes = struct.unpack_from(order + "8h", header, 40), struct.unpack_from(order + "8f", header, 76)
        # Dimensions of size 1 are gone from the mask.
        kept = [k for k in range(1, dims[0] + 1) if dims[k] > 1]
        if len(kept) == 3:
            struct.pack_into(order + "8f", head, 76, sizes[0], *(sizes[k] for k in kept), *[1.0] * 4)
        if order == ">" and dtype.itemsize > 1:
            raise ValueError("a header of the other byte order needs values of one byte")
    kind = next(k for k, t in TYPES.items() if t == dtype.str[1:])
    struct.pack_into(order + "i", head, 0, 348)
    struct.pack_into(order + "8h", head, 40, 3, *shape, 1, 1, 1, 1)
    struct.pack_into(order + "2h", head, 70, kind, 8 * dtype.itemsize)
    struct.pack_into(order + "3f", head, 108, 352.0, 1.0, 0.0)
    struct.pack_into(order + "2f", head, 124, 0.0, 0.0)  # no display range
    head[344:348] = b"n+1\0"
    return bytes(head)


def encode(mask: np.ndarray, axis: int, header: bytes | None = None) -> bytes:
    """A uint8 NIfTI-1 file of a mask (z, h, w), turned back to the file's orientation."""
    values = np.moveaxis(mask.astype(np.uint8), 0, axis)
    return head(list(values.shape), values.dtype, header) + values.tobytes(order="F")


def mask_files(runs: DataFrame, volumes: DataFrame) -> DataFrame:
    """(v, content): the encoded union mask of each volume (v, z_count, h, w, axis and, if
    known, its file's header)."""
    from ..operators.masks import union

    rows = union(runs).groupBy("v").agg(F.collect_list(F.struct("z", "y", "x0", "x1")).alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                mask = np.zeros((r.z_count, r.h, r.w), np.uint8)
                for q in r.rows if r.rows is not None else []:
                    if 0 <= q["z"] < r.z_count and 0 <= q["y"] < r.h:
                        mask[q["z"], q["y"], max(0, q["x0"]) : q["x1"] + 1] = 1
                out.append(encode(mask, r.axis, getattr(r, "header", None)))
            yield pd.DataFrame({"v": pdf["v"], "content": out})

    known = [c for c in ("header",) if c in volumes.columns]
    return volumes.join(rows, "v", "left").select("v", "z_count", "h", "w", "axis", "rows", *known).mapInPandas(run, "v long, content binary")


def png(mask: np.ndarray) -> bytes:
    """An 8-bit grey PNG of a mask, 0 and 255."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w = mask.shape
    raw = b"".join(b"\0" + row.tobytes() for row in (mask > 0).astype(np.uint8) * 255)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def slice_images(runs: DataFrame, volumes: DataFrame) -> DataFrame:
    """(v, z, file, content): a PNG of every slice that has a mask."""
    from ..operators.masks import union

    rows = union(runs).groupBy("v", "z").agg(F.collect_list(F.struct("y", "x0", "x1")).alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                mask = np.zeros((r.h, r.w), np.uint8)
                for q in r.rows:
                    mask[q["y"], q["x0"] : q["x1"] + 1] = 1
                out.append(png(mask))
            yield pd.DataFrame({"v": pdf["v"], "z": pdf["z"], "file": [f"mask_{z:04d}.png" for z in pdf["z"]], "content": out})

    return rows.join(volumes.select("v", "h", "w"), "v").select("v", "z", "h", "w", "rows").mapInPandas(run, "v long, z long, file string, content binary")


def write_files(files: DataFrame, path: str, name: str) -> DataFrame:
    """Write a row's ``content`` to ``path`` under ``name`` (a SQL expression of its
    columns); returns (file, bytes). Files are moved into place whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        for pdf in batches:
            for file, data in zip(pdf["_file"], pdf["content"], strict=True):
                target = f"{top}/{file}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                own = f"{target}.{uuid.uuid4().hex}"
                with store.open_output_stream(own) as out:
                    out.write(data)
                store.move(own, target)
            yield pd.DataFrame({"file": pdf["_file"], "bytes": pdf["content"].map(len)})

    return files.withColumn("_file", F.expr(name)).select("_file", "content").mapInPandas(run, "file string, bytes long")
