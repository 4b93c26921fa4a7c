"""A quality classifier of averaged subword embeddings.

A text's words and their character n-grams are hashed to buckets; each bucket has a
learned vector, a document is the mean of its vectors, and a softmax over the classes
follows. Two marks are hashed like words: one for every word equal to the word before it
(the word pairs that matter whatever the word is), and one that every text has ``prior``
times, which draws the mean of a few words to that of all texts. Training is stochastic
gradient descent in numpy, in one task, on a bounded sample of labelled rows
(``per_class`` ids of each class, the first in the order of their hash; whole texts, at
most 8 bytes for each bucket of each row). All texts are scored whole.

The mean and the output layer are both linear, so a bucket's vector can be folded into
one number before scoring and a word's buckets into one sum: a text costs one look-up a
word, and no join.

Null and empty texts score by the mark of all texts alone. Ids with contradicting labels
teach nothing; of rows that repeat an id one teaches, the least in the order of its
features, and each is scored. A row of a null id is scored and teaches nothing. Without labels of both
classes every score is 0.5. Further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17
    dims: int = 16
    sizes: tuple[int, ...] = (3, 4, 5)
    epochs: int = 8
    rate: float = 1.0
    per_class: int = 1500
    seed: int = 7
    #: How often a text has the mark of all texts, and how often a repeated word its mark.
    prior: int = 40
    again: int = 10


def features(words: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of their character n-grams, marks at both ends included;
    and for each bucket the place of its word in ``words``."""
    import zlib

    code = np.frombuffer(b"".join((b"\n", b"\n".join(words), b"\n")).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    mark = code == 10
    word = np.cumsum(mark) - 1
    found, owner = [np.array([zlib.crc32(w) for w in words], np.uint32)], [np.arange(len(words))]
    h = np.zeros(len(code), np.uint32)
    inner = np.zeros(len(code), bool)  # a mark inside the n-gram
    for k in range(max(s.sizes)):
        n = len(code) - k
        if n <= 0:
            break
        h, inner = h[:n] * np.uint32(0x01000193) + code[k:] + np.uint32(1), inner[:n]
        if k >= 2:
            inner = inner | mark[k - 1 : k - 1 + n]
        if k + 1 in s.sizes:
            ok = ~inner & ~(mark[:n] & mark[k:]) if k < 2 else ~inner
            x = h[ok] * np.uint32(0x9E3779B1) + np.uint32(k)
            found.append(x ^ (x >> np.uint32(15)))
            owner.append(word[:n][ok])
    return (np.concatenate(found) % np.uint32(s.buckets)).astype(np.int64), np.concatenate(owner)


def marks(s: Settings) -> tuple[int, int]:
    """Buckets of the marks: of all texts, of a word equal to the one before."""
    import zlib

    return zlib.crc32(b" text") % s.buckets, zlib.crc32(b" again") % s.buckets  # no word has a space


def repeats(words: list[bytes]) -> int:
    return sum(map(eq, words, words[1:]))


def counted(data: bytes, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and their shares of its features."""
    words = data.split()
    total = np.zeros(s.buckets)
    if words:
        times = Counter(words)
        bucket, owner = features(list(times), s)
        total += np.bincount(bucket, np.array([*times.values()], float)[owner], s.buckets)
    every, again = marks(s)
    total[every] += s.prior
    total[again] += s.again * repeats(words)
    some = np.flatnonzero(total)
    return some, (total[some] / total[some].sum()).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> tuple[np.ndarray, float]:
    """(number of each bucket, bias): the log odds of class 1 are their mean plus the bias."""
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dims, 1 / s.dims, (s.buckets, s.dims)).astype(np.float32)
    out, bias = np.zeros((s.dims, 2), np.float32), np.zeros(2, np.float32)
    if len({y for *_, y in rows}) < 2:
        return np.zeros(s.buckets, np.float32), 0.0
    steps = s.epochs * len(rows)
    for step in range(steps):
        if step % len(rows) == 0:
            order = rng.permutation(len(rows))
        bucket, share, y = rows[order[step % len(rows)]]
        rate = s.rate * (1 - step / steps)
        own = vectors[bucket]
        mean = share @ own
        z = mean @ out + bias
        p = np.exp(z - z.max())
        g = p / p.sum()
        g[y] -= 1
        back = out @ g
        out -= rate * np.outer(mean, g)
        bias -= 0.1 * rate * g
        # The gradient is share * back. Shares are small, so each step is scaled by one over
        # their root (a diagonal preconditioner): rare and common buckets move alike.
        vectors[bucket] = own - rate * np.outer(np.sqrt(share), back)
    return vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


@dataclass(frozen=True)
class Model:
    """What scoring needs: a number for each bucket and the bias."""

    weights: np.ndarray
    bias: float
    settings: Settings

    def scores(self, texts: list[bytes], cache: common.Bounded) -> list[float]:
        """Probabilities of class 1. The cache holds for a word the sum of its buckets'
        numbers and their count, as the two parts of a complex number."""
        cut = [t.split() for t in texts]
        used = {w for words in cut for w in words}
        if new := cache.missing(used):
            for at in range(0, len(new), 50_000):
                part = new[at : at + 50_000]
                bucket, owner = features(part, self.settings)
                total = np.bincount(owner, self.weights[bucket], len(part)) + 1j * np.bincount(owner, minlength=len(part))
                cache.update(zip(part, total.tolist(), strict=True))
        s, (every, again) = self.settings, marks(self.settings)
        found = np.array([sum(map(cache.__getitem__, words), 0j) for words in cut], complex)
        twice = s.again * np.array([repeats(words) for words in cut], float)
        total = found.real + s.prior * self.weights[every] + twice * self.weights[again]
        z = total / (found.imag + s.prior + twice) + self.bias
        return (1 / (1 + np.exp(-np.clip(z, -500, 500)))).tolist()


def train(docs: DataFrame, labels: DataFrame, label: str, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learn ``label`` (0 or 1) from the rows of ``labels`` that ``docs`` has."""
    spark, s = docs.sparkSession, settings
    common.workers_import(spark)
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id")).where("doc_id is not null")
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2").drop("y2").join(ids, "doc_id", "left_semi")
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.per_class) for y in (0, 1)]
    sample = common.stored(spark, chosen[0].unionByName(chosen[1]), "sample")  # 2 * per_class ids at most
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.as_bytes(F.col(text)).alias("text")).join(F.broadcast(sample), "doc_id")

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "y")), strict=True):
                bucket, share = counted(data, s)
                yield pa.RecordBatch.from_pydict({"doc_id": [i], "y": pa.array([y], pa.int32()), "bucket": pa.array([bucket.astype("<i4").tobytes()]), "share": pa.array([share.tobytes()])})

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "y", "bucket", "share")), strict=True))
        weights, bias = fit([(np.frombuffer(k, "<i4"), np.frombuffer(v, np.float32), y) for _, y, k, v in got], s)
        yield pa.RecordBatch.from_pydict({"weights": pa.array([weights.astype("<f4").tobytes()]), "bias": [bias]})

    each = rows.mapInArrow(shares, "doc_id long, y int, bucket binary, share binary")
    # Rows of one id are reduced to one before they are shuffled.
    once = each.groupBy("doc_id").agg(F.min(F.struct("y", "bucket", "share")).alias("row")).select("doc_id", "row.*")
    made = once.repartition(1).mapInArrow(learn, "weights binary, bias double")
    got = made.first()  # one row: 4 bytes a bucket
    return Model(np.frombuffer(bytes(got.weights), "<f4") if got else np.zeros(s.buckets, np.float32), got.bias if got else 0.0, s)


def score(text: Column, model: Model) -> Column:
    """The probability of class 1 of each whole text."""

    @F.arrow_udf("double")
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = common.Bounded()
        for a in it:
            parts = [model.scores(a.slice(at, 256).to_pylist(), cache) for at in range(0, len(a), 256)]
            yield pa.array([x for p in parts for x in p], pa.float64())

    return run(common.as_bytes(text))


def learnable(labels: DataFrame) -> DataFrame:
    """Labels that may teach: the others are held out."""
    return labels.where(common.remainder(F.col("doc_id"), 3) != 1)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; a third of the ids is held out of training."""
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, learnable(common.table(spark, sf_dir, "labels")), "quality")
    out = docs.select("doc_id", (common.remainder(F.col("doc_id"), 3) == 1).alias("held_out"), score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
