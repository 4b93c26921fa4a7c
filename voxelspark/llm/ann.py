"""Approximate nearest neighbours with a permutation index.

Equal vectors are one vector with several ids throughout, so copies take no place from
others. ``pivots`` vectors, drawn by the hash of their ids, are the pivots (at most 256
rows). Directions are taken from the pivots' mean, so a common offset or components of one
sign don't make all permutations alike; a query's inner products differ from those with the
shifted vectors by a constant. A vector is represented by its ``length`` nearest pivots in order. Blocks
of vectors post these permutations in inverted files: for each pivot, the vectors that
have it and its place in them. A query reads the files of its own pivots only and ranks
the block's vectors by the footrule distance of the permutations (a pivot outside counts
as at the end), weighed with the vectors' lengths, on which inner products depend; the
first ``share`` of the block is reranked by exact inner products in double precision, and
each query's best over all blocks are its neighbours. A ``share`` of 1 is an exact search.

How much must be reranked depends on the vectors: one block of them, drawn by hash, is
searched exactly for ``trials`` of its own vectors, and ``share`` is raised to what finds
``recall`` of their neighbours. Pivots and this block are the only samples.

Every vector is indexed. Queries meet the blocks of vectors as blocks of their own; a
block's size is bounded, whatever the table's; the work grows with queries times vectors.
The defaults find 0.9 and more of the true neighbours on spheres of 64 and 256 dimensions, of
Gaussian vectors of 768, of non-negative vectors, with a common offset and with lengths
that differ by lognormal factors (tested).

Vectors that are null, zero, of another length than most, or that have null or
non-finite components take no part, nor do rows without an id. If an id repeats, its
least vector by hash is the query, none of its rows is its candidate, and each row is a
candidate to others. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Settings:
    pivots: int = 256
    length: int = 96
    share: float = 0.07
    #: A block reranks so many at least.
    least: int = 200
    #: Part of the neighbours of ``trials`` vectors of a sampled block that ``share`` must find.
    recall: float = 0.95
    trials: int = 128
    block: int = 8192
    queries: int = 512


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, v: array of double) of the rows that take part, and their dimensions."""
    v = F.col("v")
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = own.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    most = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return own.where(F.size("v") == (most.n if most else 0)), most.n if most else 0


def permutations(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The numbers of each row's nearest pivots (of length 1), nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :length].astype(np.uint8)


class Block:
    """The inverted files of a block of vectors."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, x: np.ndarray, order: np.ndarray, pivots: int, middle: np.ndarray):
        # Vector i has counts[i] of the ids, from starts[i] on.
        self.ids, self.counts, self.starts, self.x = ids, counts, np.cumsum(counts) - counts, x
        self.norms = np.linalg.norm(x - middle, axis=1).astype(np.float32)
        # files[p, i]: how far before the end of vector i's permutation pivot p stands, 0 if it isn't there.
        self.files = np.zeros((pivots, len(x)), np.uint8)
        rows = np.arange(len(x))
        for k in range(order.shape[1]):
            self.files[order[:, k], rows] = order.shape[1] - k

    def rank(self, order: np.ndarray) -> np.ndarray:
        """How near each vector is by footrule distance and length.

        With places a and b before the end, the distance is a constant less twice the
        sum of min(a, b) over the pivots of the query. What it is nearer than on average
        grows with the cosine, and an inner product with the vector's length: so vectors
        of one length are ranked by the distance alone.
        """
        shared = np.zeros(len(self.x), np.uint16)
        for k, pivot in enumerate(order):
            shared += np.minimum(self.files[pivot], len(order) - k)
        return (shared - shared.mean(dtype=np.float64)).astype(np.float32) * self.norms

    def near(self, order: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` vectors of the highest rank."""
        if count >= len(self.x):
            return np.arange(len(self.x))
        rank = self.rank(order)
        edge = np.partition(rank, len(rank) - count)[len(rank) - count]
        return np.flatnonzero(rank >= edge)  # ties at the edge stay

    def needed(self, order: np.ndarray, k: int, recall: float) -> float:
        """The share of the block that must be reranked for ``recall`` of the k neighbours
        of its first vectors, whose permutations as queries are ``order``."""
        at = []
        for i, own in enumerate(order):
            score = self.x @ self.x[i]
            score[i] = -np.inf
            true = np.argsort(-score, kind="stable")[: min(k, len(score) - 1)]
            rank = np.sort(self.rank(own))
            at.append(len(rank) - np.searchsorted(rank, self.rank(own)[true]))
        at = np.concatenate(at) if at else np.zeros(0)
        return float(np.quantile(at, recall, method="higher")) / len(self.x) if len(at) else 0.0

    def best(self, query: int, q: np.ndarray, order: np.ndarray, k: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
        some = self.near(order, max(s.least, int(np.ceil(s.share * len(self.x)))))
        n = self.counts[some]
        ids = self.ids[np.repeat(self.starts[some] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        score = np.repeat(self.x[some] @ q, n)[ids != query]
        ids = ids[ids != query]
        first = np.lexsort((ids, -score))[:k]
        return ids[first], score[first]


def distinct(own: DataFrame, k: int) -> DataFrame:
    """vec_id, ids, v of each distinct vector: of its rows' ids those that can be among k
    neighbours of any query. A query's own rows are at most k of the first 2 k then."""
    each = Window.partitionBy("v", "vec_id").orderBy("vec_id")
    all_of = Window.partitionBy("v").orderBy("vec_id")
    few = own.withColumn("_n", F.row_number().over(each)).where(F.col("_n") <= k)
    few = few.withColumn("_n", F.row_number().over(all_of)).where(F.col("_n") <= 2 * k)
    return few.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.collect_list("vec_id").alias("ids")).select("vec_id", "ids", "v")


def search(vectors: DataFrame, is_query: Column, k: int = 20, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row of ``vectors`` for which
    ``is_query`` (of vec_id) holds."""
    s, spark = settings, vectors.sparkSession
    common.workers_import(spark)
    own, dims = usable(vectors)
    vectors = common.stored(spark, distinct(own, k), "vectors")
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(s.pivots).collect()  # pivots rows at most
    pivots = np.array([r.v for r in chosen], np.float64).reshape(len(chosen), dims)
    middle = pivots.mean(axis=0) if len(pivots) else np.zeros(dims)
    # Of length 1: a permutation is of directions.
    pivots = pivots - middle
    pivots = (pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), np.finfo(np.float64).tiny)).astype(np.float32)
    length = min(s.length, len(pivots))
    none = np.zeros(dims)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = [b.column("v").flatten().to_numpy().reshape(-1, dims) for b in batches if b.num_rows]
        if x:
            x = np.concatenate(x)
            each = np.arange(len(x))
            block = Block(each, np.ones(len(x), np.int64), x, permutations((x - middle).astype(np.float32), pivots, length), len(pivots), middle)
            yield pa.RecordBatch.from_pydict({"share": [block.needed(permutations(x[: s.trials].astype(np.float32), pivots, length), k, s.recall)]})

    drawn = vectors.orderBy(F.xxhash64("vec_id", F.lit("block")), "vec_id").limit(s.block).select("v")
    found_share = drawn.coalesce(1).mapInArrow(measured, "share double").first()  # one number
    share = max(s.share, found_share.share if found_share else 0.0)
    s = replace(s, share=min(1.0, share))

    def packed(batches: Iterator[pa.RecordBatch], origin: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The rows (ids, v) of a partition as one block, numbered as the partition."""
        from pyspark import TaskContext

        parts = [(b.column("ids").flatten().to_numpy(), b.column("ids").value_lengths().to_numpy().astype(np.int64), b.column("v").flatten().to_numpy().reshape(-1, dims)) for b in batches if b.num_rows]
        if parts:
            ids, counts, x = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = permutations((x - origin).astype(np.float32), pivots, length)
            yield pa.RecordBatch.from_pydict({"block": pa.array([TaskContext.get().partitionId()], pa.int32()), "ids": pa.array([ids.tobytes()]), "n": pa.array([counts.tobytes()]), "x": pa.array([x.tobytes()]), "p": pa.array([order.tobytes()])})

    def blocks(rows: DataFrame, size: int, origin: np.ndarray) -> tuple[DataFrame, int]:
        """Dealt in turn, so blocks are of like size."""
        count = max(1, -(-rows.count() // size))
        return rows.select("ids", "v").repartition(count).mapInArrow(lambda batches: packed(batches, origin), "block int, ids binary, n binary, x binary, p binary"), count

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = lambda r, end: (np.frombuffer(r["ids" + end], np.int64), np.frombuffer(r["n" + end], np.int64), np.frombuffer(r["x" + end], np.float64).reshape(-1, dims), np.frombuffer(r["p" + end], np.uint8).reshape(-1, length))
        for b in batches:
            for k_row in range(b.num_rows):
                row = b.slice(k_row, 1).to_pylist()[0]
                block = Block(*arrays(row, ""), len(pivots), middle)
                found = [(q, *block.best(q, x, p, k, s)) for q, _, x, p in zip(*arrays(row, "_q"), strict=True)]
                sizes = [len(i) for _, i, _ in found]
                yield pa.RecordBatch.from_pydict({"query_id": np.repeat(np.array([q for q, *_ in found], np.int64), sizes), "vec_id": np.concatenate([i for _, i, _ in found]), "score": np.concatenate([x for *_, x in found])})

    data, count = blocks(vectors, s.block, middle)
    asked = own.where(is_query).withColumn("_n", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.xxhash64("v")))).where("_n = 1").select(F.array("vec_id").alias("ids"), "v")
    queries, _ = blocks(asked, s.queries, none)
    # A stated query set against all rows, in blocks: each block of queries goes to every block of vectors.
    sent = queries.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("block"), *[F.col(c).alias(f"{c}_q") for c in ("ids", "n", "x", "p")])
    found = data.join(sent, "block").select("ids", "n", "x", "p", "ids_q", "n_q", "x_q", "p_q").repartition(common.partitions(spark)).mapInArrow(meet, "query_id long, vec_id long, score double")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
