"""Lempel-Ziv fingerprints: how much of two texts a compressor would find alike.

A text's UTF-8 bytes are parsed into phrases, each the shortest stretch that is not a
phrase yet (LZ78). The phrases are hashed and the ``SIZE`` smallest hashes are the
fingerprint, a minimum-hash signature of the phrase set. Two fingerprints' likeness is
the share of the smallest hashes of both that both have: it estimates the Jaccard
similarity of the phrase sets, and is exact where both sets are no larger than ``SIZE``.

``beside`` compares every text with what follows it in order of id. Texts move once, to
ranges of ids; a range also gets the text that follows it. A task streams its rows in
order and holds one text and one parse, whatever the range.

Defined cases. A null text is empty and has the empty fingerprint, which is like
itself (1) and nothing else (0). A null id comes first; texts of one id stand in the order of
their hashes, so a repeated row follows its copy. A lone text follows itself. Whole texts of
any length are parsed, invalid UTF-8 is replaced. Further columns are not read. An
empty table has no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Hashes of a fingerprint; the error of a likeness is at most 1 / (2 sqrt(SIZE)).
SIZE = 128


def parse(data: bytes, phrases: set[bytes], start: int = 0) -> int:
    """Adds the phrases of ``data`` and returns where the unfinished last one begins.
    The first ``start`` bytes are known to begin a phrase."""
    add, begin = phrases.add, 0
    for end in range(start + 1, len(data) + 1):
        phrase = data[begin:end]
        if phrase not in phrases:
            add(phrase)
            begin = end
    return begin


def signature(phrases: set[bytes]) -> np.ndarray:
    """The smallest hashes of a phrase set, ascending."""
    x = np.fromiter(map(zlib.crc32, phrases), np.uint32, len(phrases))
    # A 32-bit finalizer that spreads the checksums.
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    if len(x) > 4 * SIZE:
        x = np.partition(x, 2 * SIZE)[: 2 * SIZE]
    least = np.unique(x)
    return least[:SIZE]


def fingerprint(text: str) -> np.ndarray:
    phrases: set[bytes] = set()
    parse(text.encode(), phrases)
    return signature(phrases)


def as_hex(signature: np.ndarray) -> str:
    """Eight digits a hash."""
    return signature.astype(">u4").tobytes().hex()


def from_hex(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the share of the smallest hashes of both that are in both."""
    both, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    if not len(both):
        return 1.0
    least = counts if max(len(a), len(b)) < SIZE else counts[:SIZE]
    return float((least == 2).sum() / len(least))


def fingerprints(text: Column) -> Column:
    """Fingerprints of a column of texts, as hexadecimal."""

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: as_hex(fingerprint(t)))

    return made(common.as_text(text))


class Parsed:
    """A text with its fingerprint and its parse up to the last quarter."""

    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        self.tail = self.n // 4
        head = text[: self.n - self.tail].encode()
        self.phrases: set[bytes] = set()
        begin = parse(head, self.phrases)
        self.open = head[begin:]
        self.signature = signature(self._with(text[self.n - self.tail :])) if self.tail else signature(self.phrases)

    def _with(self, tail: str) -> set[bytes]:
        phrases = self.phrases.copy()
        parse(self.open + tail.encode(), phrases, len(self.open))
        return phrases

    def edited(self, other: str) -> tuple[str, np.ndarray]:
        """The text with its last quarter replaced by as much of ``other``, and its fingerprint."""
        tail = other[: self.tail]
        return self.text[: self.n - self.tail] + tail, signature(self._with(tail)) if tail else signature(self.phrases)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order, then the row that follows it (``follows``)."""
    last: tuple[int | None, Parsed] | None = None
    for batch in batches:
        for texts in common.slices(batch.column("text")):
            rows, at = [], texts.offset - batch.column("text").offset
            ids, follows = (batch.column(c).slice(at, len(texts)).to_pylist() for c in ("doc_id", "follows"))
            for doc_id, after, text in zip(ids, follows, texts.to_pylist(), strict=True):
                if after and last is None:
                    continue  # a further copy of the row that follows
                here = Parsed(text)
                if last is not None:
                    own = last[1]
                    edited, signed = own.edited(text)
                    rows.append((last[0], own.n, hashlib.sha256(edited.encode()).hexdigest(), as_hex(own.signature), as_hex(signed), likeness(own.signature, signed), likeness(own.signature, here.signature)))
                last = None if after else (doc_id, here)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RESULT, strict=True)], schema=RESULT)


def _first_keys(spark: SparkSession, keys: DataFrame) -> list[tuple]:
    """The least key of each range of a partition's size: one row a partition reaches the driver."""
    ranged = keys.repartitionByRange(common.partitions(spark), *keys.columns)
    least = ranged.groupBy(F.spark_partition_id().alias("_p")).agg(F.min(F.struct(*keys.columns)).alias("k")).collect()
    return sorted(tuple(r.k) for r in least)


def beside(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint, that of its edited text, and their likeness to each other
    and to the fingerprint of the next text: the columns of ``RESULT``."""
    own = docs.select(F.col(key).cast("long").alias("doc_id"), common.as_text(F.col(text)).alias("text"))
    order = [F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64("text").alias("h")]
    firsts = _first_keys(spark, own.select(*order))
    n = len(firsts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows to their ranges; a range's first also to the range before, to follow it."""
        from bisect import bisect_right

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("known", "id", "h")), strict=True))
            ranges = [bisect_right(firsts, k) - 1 for k in keys]
            lead = [k for k, r in enumerate(ranges) if firsts[r] == keys[k]]
            take = pa.array([*range(len(keys)), *lead], pa.int64())
            to = [*ranges, *((ranges[k] - 1) % n for k in lead)]
            rows = batch.take(take)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(to, pa.int32()), pa.array([False] * len(keys) + [True] * len(lead))], names=[*rows.schema.names, "range", "follows"])

    dealt = own.select("*", *order).mapInArrow(deal, "doc_id long, text string, known boolean, id long, h long, range int, follows boolean")
    placed = dealt.repartitionById(max(n, 1), "range").sortWithinPartitions("range", "follows", "known", "id", "h")
    return placed.select("doc_id", "text", "follows").mapInArrow(_compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op12_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, compared with the edited text's and the next one's."""
    common.workers_import(spark)
    return beside(spark, common.table(spark, sf_dir, "documents"))
