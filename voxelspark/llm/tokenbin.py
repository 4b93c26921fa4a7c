"""Token ids in seekable zstandard files.

A shard holds the documents of one range of ids in ascending order. Its bytes are

* one zstandard frame per document: the token ids, little-endian unsigned 32-bit;
* one skippable frame (magic 0x184D2A50): per document its id (int64) and a byte
  that is 1 if the id is null;
* the seek table of the public zstandard seekable format, a skippable frame
  (magic 0x184D2A5E): per frame compressed size, decompressed size and the low 32
  bits of the XXH64 of the content, then frame count, descriptor byte and magic.

So ``zstd -d`` yields the plain ids of the shard, and a reader fetches the table,
seeks to the frames of the documents it wants and decompresses only these.

Null texts are empty, a null id sorts first, equal ids keep all their rows (ordered
by the text's hash), and an empty table makes no documents.
"""

from __future__ import annotations

import io
import itertools
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

# Fixed values of the zstandard seekable format.
INDEX_MAGIC, TABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80

MANIFEST = "shard int, path string, docs long, tokens long, bytes long"


class Encoder:
    """Whole texts to token ids with a tokenizers file.

    ASCII white space always ends a token of this vocabulary, and so does the place between
    a letter and ASCII punctuation other than the apostrophe. A text's ids are those of the
    pieces between such places in turn, and each distinct piece is encoded once for all its
    uses. ASCII letters are lowered first, as the vocabulary's own normaliser does. Pieces
    of plain letters or punctuation alone need neither normaliser nor pattern and go to the
    library without; all others go to it as they are. A text that contains an added token
    goes to the library whole. New pieces go there many in one text, with a control
    character between them.
    """

    BETWEEN = "\x01"
    #: Lower-case letters that no normaliser changes, and ASCII punctuation.
    LETTERS, MARKS = "[a-z\u00df-\u00f6\u00f8-\u00ff]", r"[!-&(-/:-@\[-`{-~]"
    PLAIN = re.compile(f"{LETTERS}+|{MARKS}+").fullmatch

    def __init__(self, path: str, end: int | None, most: int = 1_000_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = b"" if end is None else struct.pack("<I", end)
        self.words = common.Pieces(self._learn, most)
        self.mark = self.tokenizer.encode(self.BETWEEN, add_special_tokens=False).ids

    def _library(self, tokenizer, words: list[str]) -> list[bytes]:
        """The ids of words without the control character."""
        out = []
        blocks = [words[at : at + 500] for at in range(0, len(words), 500)]
        for e in tokenizer.encode_batch_fast([f" {self.BETWEEN} ".join(block) for block in blocks], add_special_tokens=False):
            a = np.array(e.ids, "<u4")
            data, cuts = a.tobytes(), (np.flatnonzero(a == self.mark[0]) * 4).tolist()
            out += [data[i:j] for i, j in zip([0, *(c + 4 for c in cuts)], [*cuts, len(data)], strict=True)]
        return out

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> list[bytes]:
        if len(self.mark) != 1:
            return self.whole(new)
        plain = [w for w in new if self.PLAIN(w)]
        found = dict(zip(plain, self._library(self.bare, plain), strict=True))
        odd = [w for w in new if self.BETWEEN in w]
        found |= zip(odd, self.whole(odd), strict=True)
        others = [w for w in new if w not in found]
        found |= zip(others, self._library(self.tokenizer, others), strict=True)
        return [found[w] for w in new]

    def texts(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, the end id included, as little-endian bytes."""
        import pyarrow.compute as pc

        low = pc.ascii_lower(texts)
        apart = [k for t in self.added for k in np.flatnonzero(pc.match_substring(low, t.lower()).to_numpy(zero_copy_only=False))]
        found = dict(zip(apart, self.whole([texts[k].as_py() for k in apart]), strict=True))
        pieces = pc.ascii_split_whitespace(pc.replace_substring_regex(low, f"({self.LETTERS})({self.MARKS})", r"\1 \2"))
        ids, counts = self.words.ids(pieces)
        data, ends = memoryview(ids.tobytes()), (np.cumsum(counts) * 4).tolist()
        for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
            yield (found[k] if k in found else bytes(data[a:b])) + self.end


_ENCODERS: dict = {}


def encoder(path: str, end: int | None) -> Encoder:
    """One per worker process, so its words serve all its tasks."""
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = Encoder(path, end)
    return _ENCODERS[path, end]


def frames(docs: Iterable[tuple[int | None, bytes]], level: int, seen: list[int]) -> Iterator[bytes]:
    """The bytes of a shard, piece by piece; seen gets [documents, bytes of ids]."""
    import xxhash
    import zstandard

    press = zstandard.ZstdCompressor(level=level)
    table, ids, nulls = io.BytesIO(), io.BytesIO(), io.BytesIO()
    for doc_id, data in docs:
        frame = press.compress(data)
        table.write(struct.pack("<III", len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        ids.write(struct.pack("<q", doc_id or 0))
        nulls.write(b"\1" if doc_id is None else b"\0")
        seen[0] += 1
        seen[1] += len(data)
        yield frame
    index = ids.getvalue() + nulls.getvalue()
    yield struct.pack("<II", INDEX_MAGIC, len(index)) + index
    table.write(struct.pack("<III", len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
    body = table.getvalue() + struct.pack("<IBI", seen[0] + 1, CHECKSUMS, SEEKABLE_MAGIC)
    yield struct.pack("<II", TABLE_MAGIC, len(body)) + body


class Shard:
    """A reader that opens a shard by its trailing table."""

    def __init__(self, uri: str):
        import zstandard

        fs, path = common.open_fs(uri)
        self.file = fs.open_input_file(path)
        self.unpack = zstandard.ZstdDecompressor()
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUMS:
            raise ValueError(f"{uri}: no seek table")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.sizes, self.lengths, self.sums = (table[:-1, k].astype(np.int64) for k in range(3))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        index = self._at(int(self.starts[-1]) + 8, 9 * (n - 1))
        self.ids = np.frombuffer(index, "<i8", n - 1)
        self.nulls = np.frombuffer(index, np.uint8, n - 1, 8 * (n - 1)).astype(bool)

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def __len__(self) -> int:
        return len(self.ids)

    def document(self, k: int) -> bytes:
        """The id bytes of the k-th document; only its frame is read."""
        import xxhash

        data = self.unpack.decompress(self._at(int(self.starts[k]), int(self.sizes[k])), max_output_size=int(self.lengths[k]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"document {k}: checksum differs")
        return data

    def find(self, doc_id: int) -> list[int]:
        """Positions of the documents with this id."""
        first = int(self.nulls.sum())
        lo, hi = np.searchsorted(self.ids[first:], [doc_id, doc_id + 1])
        return list(range(first + int(lo), first + int(hi)))


def write(docs: DataFrame, path: str, tokenizer: str, end: int | None = None, doc_id: str = "doc_id", text: str = "text", level: int = 3) -> DataFrame:
    """Encode ``docs`` into shards in the folder ``path``; the manifest, a row a shard.

    One range shuffle of the texts orders the documents; each task then streams its
    range through the tokenizer into one file.
    """
    spark = docs.sparkSession
    common.workers_import(spark)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, seen = TaskContext.get().partitionId(), [0, 0]
        encode = encoder(tokenizer, end)

        def rows() -> Iterator[tuple[int | None, bytes]]:
            for b in batches:
                ids = iter(b.column(0).to_pylist())
                for part in common.slices(b.column(1)):
                    yield from zip(itertools.islice(ids, len(part)), encode.texts(part), strict=True)

        source = rows()
        first = next(source, None)
        if first is None:
            return
        name = f"{path}/shard-{number:06d}.zst"
        size = common.write_file(name, frames(itertools.chain([first], source), level, seen))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int32()), "path": [name], "docs": [seen[0]], "tokens": [seen[1] // 4], "bytes": [size]})

    data = docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.as_text(F.col(text)).alias("text"), F.monotonically_increasing_id().alias("row"))
    # Equal rows may go to several ranges: which of them comes first makes no difference.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    ordered = data.repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order).drop("row")
    return common.stored(spark, ordered.mapInArrow(shard, MANIFEST), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary) of every document of the shards."""
    common.workers_import(manifest.sparkSession)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                shard = Shard(path)
                starts = start + np.concatenate([[0], np.cumsum(shard.lengths // 4)])
                for at in range(0, len(shard), 512):
                    k = range(at, min(at + 512, len(shard)))
                    s = slice(k.start, k.stop)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.ids[s], mask=shard.nulls[s]), "start": starts[s], "n_tokens": shard.lengths[s] // 4, "ids": pa.array([shard.document(x) for x in k], pa.large_binary()).cast(pa.binary())})

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    placed = manifest.select("shard", "path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))
    return placed.repartition(common.partitions(manifest.sparkSession)).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write the shards, read them back: digests of what was read."""
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    manifest = write(docs, common.work_dir(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), end=2)
    return read(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
