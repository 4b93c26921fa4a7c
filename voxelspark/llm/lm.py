"""An interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped.

A token is a word, then one end for each text; a start is only ever a context. The model
is a set of files in the shared folder, sorted by key and cut by ranges of it:

* vocabulary: hashes of the words in order, and their counts. A word's id is its place;
* pairs: the keys ``id of the context << 32 | id of the token`` in order and their
  counts, and for each context of the range its total and how many of its followers were
  seen once, twice and more often;
* continuations: for each id the number of contexts it followed.

Tasks count in numpy and hand on packed blocks, one for each range, so a frequent word
or pair is summed before it is shuffled. Scoring workers map the files and look up whole
batches of sorted keys; nothing is loaded whole. The order is 2.

Null and empty texts have the end alone. Repeated rows count each time. With nothing to
learn from, every token has probability 1 / (V + 1) = 1. Learning and scoring take
whole texts; no count is capped or pruned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

END = b""  # no word is empty
FLUSH = 4_000_000


def word_hash(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word)


def pack(a: np.ndarray) -> bytes:
    """A sorted array as compressed differences."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.diff(a, prepend=a.dtype.type(0)).tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint64), dtype=np.uint64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their counts added up."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and more, from how many keys have the counts 1 to 4."""
    out = [0.5, 1.0, 1.5]  # where the counts of counts are too few to tell
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
    for k in range(3):
        if n[k] and n[k + 1]:
            out[k] = min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.1), k + 1)
    return out[0], out[1], out[2]


def _cuts(parts: int) -> np.ndarray:
    """Where ranges of hashes begin, and the last hash."""
    return np.array([(1 << 64) * p // parts for p in range(parts)] + [(1 << 64) - 1], np.uint64)


@dataclass(frozen=True)
class Model:
    """Where the files are and what holds for all of them."""

    path: str
    parts: int
    vocab: tuple[int, ...]  # words in each range
    pairs: tuple[int, ...]
    tokens: int
    pair_counts: tuple[int, ...]  # how many pairs were seen 1, 2, 3, 4 times
    cont_counts: tuple[int, ...]
    cont_total: int
    cont_more: tuple[int, ...]  # ids with 1, 2 and more contexts

    @property
    def size(self) -> int:
        return sum(self.vocab)

    def contexts(self, p: int) -> tuple[int, int]:
        """Ids of contexts in range p; the last id is the start."""
        n = self.size + 1
        return n * p // self.parts, n * (p + 1) // self.parts


class Words:
    """The vocabulary of a worker: ids of words, -1 for one never seen."""

    def __init__(self, m: Model):
        self.model, self.cache, self.files = m, common.Bounded(), {}
        self.starts = np.concatenate([[0], np.cumsum(m.vocab)]).astype(np.int64)
        self.cuts = _cuts(m.parts)

    def part(self, p: int) -> np.memmap:
        if p not in self.files:
            self.files[p] = np.memmap(common.mounted(f"{self.model.path}/vocab-{p:06d}"), np.uint64, "r", shape=(2, self.model.vocab[p]))
        return self.files[p]

    def find(self, words: list[bytes]) -> np.ndarray:
        h = np.array([word_hash(w) for w in words], np.uint64)
        order = np.argsort(h)
        h, out = h[order], np.full(len(words), -1, np.int64)
        at = np.searchsorted(h, self.cuts[:-1]).tolist() + [len(h)]
        for p in range(self.model.parts):
            if at[p] < at[p + 1] and self.model.vocab[p]:
                own, asked = self.part(p)[0], h[at[p] : at[p + 1]]
                k = np.minimum(np.searchsorted(own, asked), len(own) - 1)
                out[order[at[p] : at[p + 1]]] = np.where(own[k] == asked, self.starts[p] + k, -1)
        return out

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text's tokens, the end included."""
        cut = [[*t.lower().split(), END] for t in texts]
        used = {w for words in cut for w in words}
        if new := self.cache.missing(used):
            self.cache.update(zip(new, self.find(new).tolist(), strict=True))
        get = self.cache.__getitem__
        return [np.fromiter(map(get, words), np.int64, len(words)) for words in cut]

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """How often each id was seen; 0 for -1."""
        out = np.zeros(len(ids), np.int64)
        p = np.searchsorted(self.starts, ids, side="right") - 1
        for q in np.unique(p[ids >= 0]).tolist():
            here = (p == q) & (ids >= 0)
            out[here] = self.part(q)[1][ids[here] - self.starts[q]].astype(np.int64)
        return out


def _vocabulary(docs: DataFrame, path: str, parts: int) -> list:
    """Write the vocabulary; (part, words, tokens) of each range that has any."""
    cuts = _cuts(parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(seen: Counter) -> pa.RecordBatch:
            h = np.array([word_hash(w) for w in seen], np.uint64)
            p = np.searchsorted(cuts[1:-1], h, side="right").astype(np.int32)
            return pa.RecordBatch.from_pydict({"p": p, "h": h.view(np.int64), "n": np.array([*seen.values()], np.int64)})

        seen: Counter = Counter()
        for b in batches:
            for data in b.column(0).to_pylist():
                seen.update(data.lower().split())
                seen[END] += 1
                if len(seen) > 400_000:
                    yield out(seen)
                    seen = Counter()
        if seen:
            yield out(seen)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("h").to_numpy().view(np.uint64), b.column("n").to_numpy(), b.column("p")[0].as_py()) for b in batches if b.num_rows]
        if got:
            h, n = summed(np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]))
            p = got[0][2]
            common.write_file(f"{path}/vocab-{p:06d}", [h.tobytes(), n.astype(np.uint64).tobytes()])
            yield pa.RecordBatch.from_pydict({"p": pa.array([p], pa.int32()), "words": [len(h)], "tokens": [int(n.sum())]})

    dealt = docs.mapInArrow(count, "p int, h long, n long")
    return common.stored(docs.sparkSession, dealt.repartitionById(parts, F.col("p")).mapInArrow(write, "p int, words long, tokens long"), "vocabulary").collect()  # a row a range


BLOCK = "p int, n long, keys binary, counts binary"


def _blocks(keys: np.ndarray, counts: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
    """Sorted keys in one block for each range."""
    at = np.concatenate([np.searchsorted(keys, cuts[:-1]), [len(keys)]])
    some = [p for p in range(len(cuts) - 1) if at[p] < at[p + 1]]
    return pa.RecordBatch.from_pydict({
        "p": pa.array(some, pa.int32()),
        "n": pa.array([int(at[p + 1] - at[p]) for p in some], pa.int64()),
        "keys": pa.array([pack(keys[at[p] : at[p + 1]]) for p in some], pa.binary()),
        "counts": pa.array([_small(counts[at[p] : at[p + 1]]) for p in some], pa.binary()),
    })


def _small(counts: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(counts.astype(np.uint64).tobytes())


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[int, np.ndarray, np.ndarray] | None:
    """The blocks of a range added up."""
    import zstandard

    keys, counts, p = [], [], None
    for b in batches:
        for q, _, k, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
            p = q
            keys.append(unpack(k))
            counts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(c), np.uint64).astype(np.int64))
    return None if p is None else (p, *summed(np.concatenate(keys), np.concatenate(counts)))


def _id_cuts(n: int, parts: int, shift: int) -> np.ndarray:
    return np.array([(n * p // parts) << shift for p in range(parts + 1)], np.uint64)


def _times(counts: np.ndarray) -> list[int]:
    return [int(np.count_nonzero(counts == k)) for k in (1, 2, 3, 4)] + [int(np.count_nonzero(counts >= 3))]


def build(docs: DataFrame, text: str = "text") -> Model:
    """Count all texts of ``docs`` and write the model's files."""
    spark = docs.sparkSession
    common.workers_import(spark)
    path, parts = common.work_dir(spark, "lm"), common.partitions(spark)
    data = docs.select(common.as_bytes(F.col(text)).alias("text"))
    found = {r.p: r for r in _vocabulary(data, path, parts)}
    vocab = tuple(found[p].words if p in found else 0 for p in range(parts))
    model = Model(path, parts, vocab, (), sum(r.tokens for r in found.values()), (), (), 0, ())
    size = model.size
    if not size:
        return Model(path, parts, vocab, (0,) * parts, 0, (0,) * 5, (0,) * 5, 0, (0,) * 3)
    pair_cuts, id_cuts = _id_cuts(size + 1, parts, 32), _id_cuts(size + 1, parts, 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, n = Words(model), [], 0

        def out() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return _blocks(keys, counts, pair_cuts)

        for b in batches:
            for at in range(0, b.num_rows, 512):
                for ids in words.ids(b.column(0).slice(at, 512).to_pylist()):
                    before = np.concatenate([[size], ids[:-1]])
                    held.append((before << 32 | ids).astype(np.uint64))
                    n += len(ids)
                if n >= FLUSH:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (got := _gathered(batches)):
            return
        p, keys, counts = got
        lo, hi = model.contexts(p)
        of = (keys >> np.uint64(32)).astype(np.int64) - lo
        stats = [np.bincount(of, counts, hi - lo), *(np.bincount(of[x], minlength=hi - lo) for x in (counts == 1, counts == 2, counts >= 3))]
        common.write_file(f"{path}/pairs-{p:06d}", [keys.tobytes(), counts.astype(np.uint64).tobytes(), *(x.astype(np.uint64).tobytes() for x in stats)])
        ids, contexts = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
        blocks = _blocks(ids, contexts, id_cuts)
        extra = {"part": pa.array([p] * blocks.num_rows, pa.int32()), "size": pa.array([len(keys)] * blocks.num_rows, pa.int64()), "times": pa.array([_times(counts)] * blocks.num_rows, pa.list_(pa.int64()))}
        yield pa.RecordBatch.from_arrays([*blocks.columns, *extra.values()], [*blocks.schema.names, *extra])

    def continuations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (got := _gathered(batches)):
            return
        p, ids, counts = got
        lo, hi = model.contexts(p)
        all_ids = np.zeros(hi - lo, np.uint64)
        all_ids[ids.astype(np.int64) - lo] = counts.astype(np.uint64)
        common.write_file(f"{path}/conts-{p:06d}", [all_ids.tobytes()])
        yield pa.RecordBatch.from_pydict({"p": pa.array([p], pa.int32()), "total": [int(counts.sum())], "times": pa.array([_times(counts)], pa.list_(pa.int64()))})

    blocks = data.mapInArrow(count, BLOCK).repartitionById(parts, F.col("p")).mapInArrow(pairs, f"{BLOCK}, part int, size long, times array<long>")
    blocks = common.stored(spark, blocks, "pairs")
    pair_rows = {r.part: r for r in blocks.select("part", "size", "times").distinct().collect()}  # a row a range
    conts = common.stored(spark, blocks.select("p", "n", "keys", "counts").repartitionById(parts, F.col("p")).mapInArrow(continuations, "p int, total long, times array<long>"), "conts").collect()  # a row a range
    total = lambda rows: tuple(int(sum(r.times[k] for r in rows)) for k in range(5))
    cont = total(conts)
    return Model(path, parts, vocab, tuple(pair_rows[p].size if p in pair_rows else 0 for p in range(parts)), model.tokens, total(pair_rows.values()), cont, sum(r.total for r in conts), (cont[0], cont[1], cont[4]))


class Scorer:
    """Looks texts up in the files of a model."""

    def __init__(self, m: Model):
        self.m, self.words, self.files = m, Words(m), {}
        self.d, self.d1 = np.array([0, *discounts(list(m.pair_counts[:4]))]), np.array([0, *discounts(list(m.cont_counts[:4]))])
        self.left = float(np.dot(self.d1[1:], m.cont_more)) / m.cont_total / (m.size + 1) if m.cont_total else 1 / (m.size + 1)
        self.edges = np.array([m.contexts(p)[0] for p in range(m.parts)])

    def pairs(self, p: int) -> tuple[np.ndarray, ...]:
        if ("pairs", p) not in self.files:
            n, (lo, hi) = self.m.pairs[p], self.m.contexts(p)
            if not n:  # the range has no context, so no file
                none = np.zeros(0, np.uint64)
                return none, none, np.zeros((4, hi - lo), np.uint64)
            data = np.memmap(common.mounted(f"{self.m.path}/pairs-{p:06d}"), np.uint64, "r")
            self.files["pairs", p] = data[:n], data[n : 2 * n], data[2 * n :].reshape(4, hi - lo)
        return self.files["pairs", p]

    def conts(self, p: int) -> np.ndarray:
        if ("conts", p) not in self.files:
            self.files["conts", p] = np.memmap(common.mounted(f"{self.m.path}/conts-{p:06d}"), np.uint64, "r")
        return self.files["conts", p]

    def lower(self, ids: np.ndarray) -> np.ndarray:
        """Probabilities by continuations, whatever the context."""
        a = np.zeros(len(ids), np.int64)
        p = np.searchsorted(self.edges, ids, side="right") - 1
        for q in np.unique(p[ids >= 0]).tolist():
            here = (p == q) & (ids >= 0)
            a[here] = self.conts(q)[ids[here] - self.edges[q]].astype(np.int64)
        return np.maximum(a - self.d1[np.minimum(a, 3)], 0) / max(self.m.cont_total, 1) + self.left

    def probabilities(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of each token after its context; -1 is a word never seen."""
        order = np.lexsort((ids, before))
        b, w = before[order], ids[order]
        first = np.concatenate([[True], (b[1:] != b[:-1]) | (w[1:] != w[:-1])])
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(first) - 1
        b, w = b[first], w[first]
        low, known = self.lower(w), b >= 0
        out = low.copy()
        p = np.searchsorted(self.edges, b, side="right") - 1
        for q in np.unique(p[known]).tolist():
            here = np.flatnonzero((p == q) & known)
            own, times, stats = self.pairs(q)
            at = b[here] - self.edges[q]
            total, n1, n2, n3 = (stats[k][at].astype(np.float64) for k in range(4))
            asked = (b[here] << 32 | np.maximum(w[here], 0)).astype(np.uint64)
            c = np.zeros(len(here), np.int64)
            if len(own):
                k = np.minimum(np.searchsorted(own, asked), len(own) - 1)
                c = np.where((own[k] == asked) & (w[here] >= 0), times[k].astype(np.int64), 0)
            seen = total > 0
            total = np.maximum(total, 1)
            back_off = (self.d[1] * n1 + self.d[2] * n2 + self.d[3] * n3) / total
            out[here] = np.where(seen, np.maximum(c - self.d[np.minimum(c, 3)], 0) / total + back_off * low[here], low[here])
        return out[back]

    def texts(self, texts: list[bytes]) -> list[np.ndarray]:
        """Tokens, known tokens, base and model log10 probabilities of each text."""
        ids = self.words.ids(texts)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])[:-1]]).astype(np.int64)
        now = np.concatenate(ids)
        before = np.concatenate([[0], now[:-1]])
        before[starts] = self.m.size
        count = self.words.counts(now)
        base = np.log10((count + 0.1) / (self.m.tokens + 0.1 * (self.m.size + 1)))
        model = np.log10(self.probabilities(before, now))
        return [np.array([len(x) for x in ids]), *(np.add.reduceat(x, starts) for x in ((count > 0).astype(np.int64), base, model))]


def score(text: Column, model: Model) -> Column:
    """A struct: n_tokens, n_known, base_score, score (log10 probabilities of whole texts)."""

    @F.arrow_udf("struct<n_tokens: long, n_known: long, base_score: double, score: double>")
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Scorer(model)
        for a in it:
            parts = [own.texts(a.slice(at, 1000).to_pylist()) for at in range(0, len(a), 1000)]
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
            yield pa.StructArray.from_arrays([pa.array(c) for c in cols], ["n_tokens", "n_known", "base_score", "score"])

    return run(common.as_bytes(text))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; a tenth of the ids is held out of training."""
    docs = common.table(spark, sf_dir, "documents")
    held = common.remainder(F.col("doc_id"), 10) == 0
    model = build(docs.where(~held))
    out = docs.select("doc_id", held.alias("held_out"), score(F.col("text"), model).alias("s"))
    return out.select("doc_id", "held_out", "s.n_tokens", "s.n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "s.base_score", "s.score", (F.pow(F.lit(10.0), -F.col("s.score") / F.col("s.n_tokens"))).alias("perplexity"))
