"""What the text operators share: tables, the shared work folder and files in it.

Workers reach files only through the folder named by ``spark.checkpoint.dir``,
which every executor and the driver see. ``pyarrow.fs`` opens it whatever store
it is in.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: these bytes, as in ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a local one if
    everything runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (root or _local_root()).rstrip("/")


@cache
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run of an operator, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, inner = open_fs(path)
    fs.create_dir(inner, recursive=True)
    atexit.register(_delete, path)
    return path


def _delete(path: str) -> None:
    try:
        fs, inner = open_fs(path)
        fs.delete_dir(inner)
    except OSError:
        pass  # the store is gone with the session


def open_fs(uri: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


def write_file(uri: str, parts) -> int:
    """Write under a name of this attempt, then move: a task that is run again or
    twice leaves one whole file. Returns the bytes written."""
    fs, path = open_fs(uri)
    own, size = f"{path}.{uuid.uuid4().hex}", 0
    with fs.open_output_stream(own) as out:
        for part in parts:
            size += len(part)
            out.write(part)
    fs.move(own, path)
    return size


def mounted(uri: str) -> str:
    """The path of a file to memory-map; its folder must be mounted where workers run."""
    fs, path = open_fs(uri)
    if fs.type_name != "local":
        raise ValueError(f"{uri}: spark.checkpoint.dir must name a mounted folder (file://) for files that are memory-mapped")
    return path


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back."""
    path = f"{work_dir(spark, name)}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(text: Column) -> Column:
    """A text's UTF-8 bytes; null is empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def as_text(text: Column) -> Column:
    """A text that is valid UTF-8; null is empty."""
    return F.make_valid_utf8(F.coalesce(text, F.lit("")))


def remainder(key: Column, n: int) -> Column:
    """crc32(key as text) mod n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


class Bounded(dict):
    """A worker's cache of word results, emptied when it holds ``most`` entries: its
    size is bounded, and results don't depend on it."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def missing(self, used: set) -> list:
        """The words of ``used`` to work out now."""
        new = [w for w in used if w not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            return list(used)
        return new


def slices(texts: pa.Array, most: int = 6 << 20) -> Iterator[pa.Array]:
    """A column of texts in runs of about ``most`` bytes; a longer text is a run by itself."""
    import pyarrow.compute as pc

    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield texts.slice(at, end - at)
        at = end


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces data[start : start + length], one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.repeat(starts - ends + lengths, lengths) + np.arange(total)]


class Pieces:
    """A worker's token ids of pieces of text: each is worked out once for many uses.

    It is emptied when it holds ``most`` pieces, so its size is bounded; results don't
    depend on it. Only distinct pieces of a run of texts are looked at in Python.
    """

    def __init__(self, learn: Callable[[list[str]], list[bytes]], most: int):
        self.learn, self.most = learn, most
        self._empty()

    def _empty(self) -> None:
        self.at: dict[str, int] = {}
        self.data, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _places(self, pieces: list[str]) -> np.ndarray:
        out = [*map(self.at.get, pieces)]
        new = [x for x, at in zip(pieces, out, strict=True) if at is None]
        if len(self.at) + len(new) > self.most:
            self._empty()
            new = pieces
        if new:
            found = self.learn(new)
            lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
            self.starts = np.concatenate([self.starts, len(self.data) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.data = np.concatenate([self.data, np.frombuffer(b"".join(found), "<u4")])
            places = range(len(self.at), len(self.at) + len(new))
            self.at.update(zip(new, places, strict=True))
            if new is pieces:
                return np.array(places)
            out = np.array([-1 if at is None else at for at in out], np.int64)
            out[out < 0] = places
            return out
        return np.array(out, np.int64)

    def ids(self, cut: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts given as lists of pieces, and how many each text has."""
        coded = cut.flatten().dictionary_encode()
        w = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        sums = np.concatenate([[0], np.cumsum(self.lengths[w])])
        ends = np.cumsum(cut.value_lengths().to_numpy())
        return gather(self.data, self.starts[w], self.lengths[w]), np.diff(sums[ends], prepend=0)
