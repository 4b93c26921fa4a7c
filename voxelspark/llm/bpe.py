"""Byte-level BPE with a sentencepiece model that is written, not trained.

``model`` serialises a rank file as a sentencepiece BPE model: every token becomes a
piece, its bytes mapped one to one to code points U+0100..U+01FF, its score the
negative rank, with identity normalisation. sentencepiece then merges the pair of best
score, leftmost first: the merge order of the ranks. Piece numbers equal ranks.

Texts are cut into pre-tokens by a pattern, each is encoded by itself, and decoding
maps pieces back to bytes. A token that its own merges never reach is taken whole where
it is a whole pre-token, as rank encoders do; the model finds these tokens itself.

Null texts are empty and have no ids; bytes that are no UTF-8 are read as U+FFFD. Ids of
any other text decode to its bytes. Texts are whole however long, a row comes out for each
row (repeated ones and null ids too), and further columns, whatever their names, are not
looked at. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Where byte 0 goes; no piece then holds a character that sentencepiece treats apart.
BASE = 0x100


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    if sorted(ranks) != [*range(len(ranks))]:
        raise ValueError("ranks have gaps")
    return [ranks[k] for k in range(len(ranks))]


def mapped(data: bytes) -> str:
    return "".join([chr(BASE + b) for b in data])


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A field of a protocol buffer."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model: piece k is token k, the last piece is unknown."""
    # Field numbers and types of sentencepiece's model format.
    unknown, bpe = 2, 2
    pieces = [_field(1, _field(1, mapped(t).encode()) + _field(2, -float(k))) for k, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


def newer_letters(pattern: str) -> list[str]:
    """Characters that are letters or numbers to the module that splits here and are none to
    tiktoken, whose tables are older. Which these are is asked, not listed: a letter makes
    one pre-token with the letter before it, and that pair has a rank in a probe."""
    import unicodedata

    import regex
    import tiktoken

    none = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
    asked = regex.findall(r"[\p{L}\p{N}]", none)
    pairs = [(x + c).encode() for c in asked for x in "a1"]
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)} | {p: 256 + k for k, p in enumerate(pairs)}, special_tokens={})
    return [c for c in asked if all(len(probe.encode_ordinary(x + c)) > 1 for x in "a1")]


class Codec:
    """Encodes and decodes with the model of one rank file.

    In a text whose white space is single characters between others, every space starts a
    pre-token of the pattern, every other white space is one, and one ends between a letter
    and ASCII punctuation other than the apostrophe. So such a text may be cut there and
    each distinct part encoded once. Other texts are cut by the pattern itself.
    """

    #: Before a part that stands as it is; a part without it follows a space.
    AS_IS = "\x02"
    SPACES = r" \t-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    LETTER, MARK = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]", r"[!-&(-/:-@\[-`{-~]"

    def __init__(self, path: str, pattern: str, most: int = 200_000):
        import regex
        import sentencepiece

        tokens = read_ranks(path)
        self.sp = sentencepiece.SentencePieceProcessor()
        self.sp.LoadFromSerializedProto(model(tokens))
        self.pattern, self.newer = regex.compile(pattern).findall, frozenset(newer_letters(pattern))
        self.mask = str.maketrans(dict.fromkeys(self.newer, "\ue000"))
        table = [bytes(ord(c) - BASE for c in self.sp.IdToPiece(k)) for k in range(len(tokens))]
        self.lengths = np.fromiter(map(len, table), np.int64, len(table))
        self.starts, self.bytes = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(table), np.uint8)
        self.letters = str.maketrans({b: mapped(bytes([b])) for b in range(256)})
        found = self.sp.encode([mapped(t) for t in tokens], num_threads=1)
        self.whole = {t: k for k, (t, ids) in enumerate(zip(tokens, found, strict=True)) if ids != [k]}
        self.parts = common.Pieces(self._learn, most)

    def split(self, text: str) -> list[str]:
        """Pre-tokens by the pattern. Letters and numbers of a newer Unicode than the
        reference's count as other characters, of which one stands in for them here."""
        if text.isascii() or self.newer.isdisjoint(text):
            return self.pattern(text)
        ends = np.cumsum([*map(len, self.pattern(text.translate(self.mask)))]).tolist()
        return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        """The ids of pre-tokens."""
        raw = [p.encode() for p in pieces]
        found = self.sp.encode([r.decode("latin-1").translate(self.letters) for r in raw], num_threads=1)
        return [[self.whole[r]] if r in self.whole else ids for r, ids in zip(raw, found, strict=True)]

    def _learn(self, parts: list[str]) -> list[bytes]:
        """The ids of parts of texts, each cut by the pattern in turn."""
        cut = [self.split(p[1:] if p[:1] == self.AS_IS else " " + p) for p in parts]
        flat, at, out = self._ids([x for pieces in cut for x in pieces]), 0, []
        for pieces in cut:
            out.append(np.array([i for found in flat[at : at + len(pieces)] for i in found], "<u4").tobytes())
            at += len(pieces)
        return out

    def cut(self, texts: pa.Array) -> pa.ListArray:
        """Each text's parts."""
        import pyarrow.compute as pc

        own = pc.or_(pc.match_substring_regex(texts, f"(?s)^[{self.SPACES}]|[{self.SPACES}]{{2}}|[{self.SPACES}]$"), pc.match_substring(texts, self.AS_IS))
        apart = np.flatnonzero(own.to_numpy(zero_copy_only=False))
        plain = pc.replace_substring_regex(texts, rf"([{self.SPACES[1:]}])", f" {self.AS_IS}\\1 {self.AS_IS}")
        plain = pc.replace_substring_regex(plain, f"({self.LETTER})({self.MARK})", f"\\1 {self.AS_IS}\\2")
        found = pc.split_pattern(pc.binary_join_element_wise(self.AS_IS, plain, ""), " ")
        if not len(apart):
            return found
        pieces = pa.array([[self.AS_IS + p for p in self.split(texts[k].as_py())] for k in apart.tolist()], found.type)
        place = np.arange(len(texts))
        place[apart] = len(texts) + np.arange(len(apart))
        return pa.concat_arrays([found, pieces]).take(pa.array(place))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, counts = self.parts.ids(self.cut(texts))
        data, ends = memoryview(ids.astype("<u4").tobytes()), (np.cumsum(counts) * 4).tolist()
        return [bytes(data[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def decode(self, ids: bytes) -> bytes:
        k = np.frombuffer(ids, "<u4").astype(np.int64)
        return common.gather(self.bytes, self.starts[k], self.lengths[k]).tobytes()


_CODECS: dict = {}


def codec(path: str, pattern: str) -> Codec:
    """One per worker process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit); with ``decoded``
    also the bytes that the ids decode to. No shuffle."""
    common.workers_import(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            at = 0
            for part in common.slices(b.column(1)):
                ids = own.encode(part)
                columns = {"doc_id": b.column(0).slice(at, len(part)), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
                if decoded:
                    columns["decoded"] = pa.array(map(own.decode, ids), pa.binary())
                yield pa.RecordBatch.from_pydict(columns)
                at += len(part)

    schema = "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.as_text(F.col(text)).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds the decoded bytes to the columns doc_id, n_tokens and ids."""
    common.workers_import(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                data = pa.array([own.decode(x or b"") for x in part.column("ids").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, data], [*part.schema.names, "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of both."""
    import public_tokenizers as P

    args = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    both = encode(common.table(spark, sf_dir, "documents"), *args, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


