"""Volume files as a Spark data source, ``volume_slices``: read by file and range of slices,
written whole with commit and abort.

Reading: options ``path`` (a file or a folder) and ``bytes`` (how much a task reads, 64 MB).
Small files share a task; a plain file larger than that is shared by several, each of which
reads its header and only the bytes of its own slices if z is the file's last axis. Filters
on z reach the reader. Packed files and other axes are read by one task, packed ones as a
stream if z is the last axis; with another axis the task holds the volume.

Writing: rows file, z, h, w, axis, z_count, pixels and optionally header, brought together by
``write``. Slices that are missing are zero, one that is out of range or repeated is an
error. Tasks write under names of their own attempt; commit moves the files in place, abort
deletes them.
"""

from __future__ import annotations

import gzip
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from . import volumes

WRITTEN = "file string, z long, h int, w int, axis int, z_count int, pixels array<float>, header binary"


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


@dataclass
class Part(InputPartition):
    """Pieces (path, number, count): the file's slices cut in ``count`` ranges."""

    pieces: list[tuple[str, int, int]]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size, self.wanted = path, size, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of z with numbers are met by the reader; the others go back to Spark."""
        for f in filters:
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | In) and f.attribute == ("z",) and getattr(f, "value", ()) is not None:
                self.wanted.append(f)
            else:
                yield f

    def _has(self, z: int) -> bool:
        tests = {EqualTo: lambda v: z == v, GreaterThan: lambda v: z > v, GreaterThanOrEqual: lambda v: z >= v, LessThan: lambda v: z < v, LessThanOrEqual: lambda v: z <= v, In: lambda v: z in v}
        return all(tests[type(f)](f.value) for f in self.wanted)

    def partitions(self) -> list[Part]:
        from pyarrow import fs as pafs

        fs, top = open_fs(self.path)
        info = fs.get_file_info(top)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(top, recursive=True))
        parts, held = [Part([])], 0
        for f in sorted((f for f in files if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path):
            count = 1 if f.path.endswith(".gz") else max(1, -(-f.size // self.size))
            for k in range(count):
                if parts[-1].pieces and held + f.size / count > self.size:
                    parts.append(Part([]))
                    held = 0
                parts[-1].pieces.append((f.path, k, count))
                held += f.size / count
        return parts

    def read(self, part: Part) -> Iterator[tuple]:
        fs, _ = open_fs(self.path)
        for path, k, count in part.pieces:
            try:
                yield from self._slices(fs, path, k, count)
            except (ValueError, struct.error, OSError, EOFError, zlib.error) as e:
                if k == 0 and not self.wanted:
                    yield (path, None, None, None, None, None, None, None, str(e))

    def _slices(self, fs, path: str, k: int, count: int) -> Iterator[tuple]:
        with fs.open_input_file(path) as raw:
            packed = raw.read(2) == b"\x1f\x8b"
            raw.seek(0)
            with gzip.GzipFile(fileobj=raw) if packed else raw as f:
                head = f.read(348)
                order, dtype, shape, offset, slope, inter = volumes.layout(head)
                dims = [d for d in shape if d != 1]
                if len(dims) != 3:
                    raise ValueError(f"{len(dims)} dimensions, not 3")
                axis = int(np.argmin(dims))
                n, (h, w) = dims[axis], [d for a, d in enumerate(dims) if a != axis]
                mine = [z for z in range(n * k // count, n * (k + 1) // count) if self._has(z)]
                scaled = lambda x: (x.astype(np.float32) * slope + inter if slope else x).astype(np.float32)
                if axis == 2:
                    size = h * w * dtype.itemsize
                    for z in mine:
                        f.seek(offset + z * size)
                        data = f.read(size)
                        if len(data) < size:
                            raise ValueError("file ends early")
                        yield path, z, h, w, axis, n, scaled(np.frombuffer(data, dtype).reshape(h, w, order="F")).ravel().tolist(), head, None
                elif mine:
                    f.seek(offset)
                    values = np.frombuffer(f.read(n * h * w * dtype.itemsize), dtype, n * h * w).reshape(dims, order="F")
                    volume = np.moveaxis(values, axis, 0)
                    for z in mine:
                        yield path, z, h, w, axis, n, scaled(volume[z]).ravel().tolist(), head, None


class Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> Written:
        fs, top = open_fs(self.path)
        fs.create_dir(top, recursive=True)
        made, name, out, volume, last, first = [], None, None, None, -1, None

        def end() -> None:
            nonlocal out
            if out is not None:
                if volume is None:
                    out.write(b"\0" * (4 * first.h * first.w * (first.z_count - 1 - last)))
                else:
                    out.write(np.moveaxis(volume, 0, first.axis).tobytes(order="F"))
                out.close()
                out = None

        try:
            for r in rows:
                if r.file != name:
                    end()
                    name, last, first = r.file, -1, r
                    target = f"{top}/{name}"
                    fs.create_dir(target.rpartition("/")[0], recursive=True)
                    head, tail = target.rpartition("/")[::2]
                    made.append((f"{head}/_{uuid.uuid4().hex}", target))
                    out = fs.open_output_stream(made[-1][0])
                    shape = [r.h, r.w]
                    shape.insert(r.axis, r.z_count)
                    out.write(volumes.head(shape, np.dtype("<f4"), None if r.header is None else bytes(r.header)))
                    volume = None if r.axis == 2 else np.zeros((r.z_count, r.h, r.w), "<f4")
                if not last < r.z < r.z_count:
                    raise ValueError(f"{name}: slice {r.z} after {last} of {r.z_count}")
                pixels = np.asarray(r.pixels, "<f4").reshape(r.h, r.w)
                if volume is None:
                    out.write(b"\0" * (4 * r.h * r.w * (r.z - last - 1)))
                    out.write(pixels.tobytes(order="F"))
                else:
                    volume[r.z] = pixels
                last = r.z
            end()
        except BaseException:
            if out is not None:
                out.close()
            for own, _ in made:
                fs.delete_file(own)
            raise
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = open_fs(self.path)
        for m in messages:
            for own, target in m.files if m else []:
                fs.move(own, target)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = open_fs(self.path)
        for m in messages:
            for own, _ in m.files if m else []:
                fs.delete_file(own)


class VolumeSlices(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volume_slices"

    def schema(self) -> str:
        return volumes.SLICES

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("bytes", 64 << 20)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make ``volume_slices`` known to the session, its filters reaching the reader."""
    import sys

    from pyspark import cloudpickle

    for module in (sys.modules[__name__], volumes):
        cloudpickle.register_pickle_by_value(module)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VolumeSlices)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``volumes.SLICES``: a row a slice; a file that can't be read is one row with its error."""
    register(spark)
    return spark.read.format("volume_slices").load(path)


def write(slices: DataFrame, path: str) -> None:
    """Write volumes; ``slices`` has the columns of ``WRITTEN``, header optional."""
    register(slices.sparkSession)
    names = [f.strip().split(" ")[0] for f in WRITTEN.split(",")]
    kinds = dict(f.strip().split(" ", 1) for f in WRITTEN.split(","))
    rows = slices.selectExpr(*[f"cast({c if c in slices.columns else 'null'} as {kinds[c]}) {c}" for c in names])
    rows.repartition("file").sortWithinPartitions("file", "z").write.format("volume_slices").mode("append").save(path)
