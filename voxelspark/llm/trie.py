"""Prefix trie of conversations by vertical bitmaps.

A shard is a run of neighbouring conversation ids. Its index has, for every position and
turn, the bitset of the shard's conversations with that turn there. From the root down
a node's bitset is intersected with the postings of the next position: each result that
is not empty is a child, its popcount the members, and what no posting takes are the
conversations that end. Only postings of turns that some member has next are tried, so
a shard costs an intersection a node.

Nodes of all shards meet by a 128-bit digest of their turns, summed before the shuffle.
What a subtree adds up comes from two shares of a shard's own tree: members times code
points, which add up over shards, and each distinct node once, counted where its
smallest conversation lives. So no join follows the depth of the trie, and the root, whose
children may be as many as the conversations, is never one task's key. End lists travel
as rows of a shard; the digest of a list reads them in order and holds none.

Defined cases. Rows without a conversation id belong to none and are left out. Turns of
equal number stand in the order of their digests; repeated rows are turns of their own.
Null role and text are empty. The turns of one conversation, 24 bytes each, are one
task's; texts are hashed where they are read and never move. Further columns are not
read. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A shard has at most so many conversations, and starts no other beyond so many turns.
CONVERSATIONS, TURNS = 2048, 1 << 16
#: The longest borrowed head is a turn less.
HEADS = 6

PATH = "array<struct<key: binary, chars: bigint>>"
LOCAL = "shard long, at int, up int, node binary, parent binary, depth long, chars long, first long, n long, ends binary"
SUMS = "node binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def turn_key(role: Column, text: Column) -> Column:
    """16 bytes that tell turns apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32))


def conversations(table: DataFrame) -> DataFrame:
    """(conv_id, turns: key and chars in order) of a table of turns."""
    rows = table.where("conv_id is not null").select("conv_id", "turn", turn_key(F.col("role"), F.col("text")).alias("key"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "chars"))).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda x: F.struct(x["key"].alias("key"), x["chars"].alias("chars"))).alias("turns"))


def regrafted(convs: DataFrame) -> DataFrame:
    """Conversations that begin with the first turns of their hundred's first one: as many
    as the remainder of their id's crc32 says, in place of as many of their own. The
    hundred of a negative id ends at it, as SQL's remainder has it."""
    h = common.remainder(F.col("conv_id"), HEADS).cast("int")
    heads = convs.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    joined = convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(heads, "base", "left")
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    head = F.slice(F.coalesce("head", F.array().cast(PATH)), F.lit(1), F.col("h"))
    return joined.select("conv_id", F.concat(head, own).alias("turns"))


def intersected(ids: list[int], keys: list[list[bytes]], chars: list[list[int]]) -> Iterator[tuple]:
    """The rows of ``LOCAL`` of one shard, parents before children. ``ids`` ascend."""
    index: list[dict[bytes, int]] = []
    last: dict[int, int] = {}
    for i, path in enumerate(keys):
        bit = 1 << i
        for _ in range(len(index), len(path)):
            index.append({})
        for postings, key in zip(index, path, strict=False):
            postings[key] = postings.get(key, 0) | bit
        last[len(path)] = last.get(len(path), 0) | bit
    stack, at = [((1 << len(ids)) - 1, 0, b"", None, -1)], 0
    while stack:
        members, depth, node, parent, up = stack.pop()
        first = (members & -members).bit_length() - 1
        ends = members & last.get(depth, 0)
        yield ids[0], at, up, node, parent, depth, chars[first][depth - 1] if depth else 0, ids[first], members.bit_count(), _listed(ends, ids) if ends else None
        rest = members ^ ends
        while rest:
            key = keys[(rest & -rest).bit_length() - 1][depth]
            child = rest & index[depth][key]
            stack.append((child, depth + 1, hashlib.blake2b(node + key, digest_size=16).digest(), node, at))
            rest ^= child
        at += 1


def _listed(bits: int, ids: list[int]) -> bytes:
    out = []
    while bits:
        low = bits & -bits
        out.append(ids[low.bit_length() - 1])
        bits ^= low
    return np.array(out, "<i8").tobytes()


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in ddl.split(", "))])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _schema(LOCAL)
    ids, keys, chars, held = [], [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        rows = []
        for row in intersected(ids, keys, chars):
            rows.append(row)
            if len(rows) == 20_000:
                yield _table(rows, schema)
                rows = []
        if rows:
            yield _table(rows, schema)

    for batch in batches:
        for i, k, c in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "keys", "chars")), strict=True):
            if len(ids) == CONVERSATIONS or held > TURNS:
                yield from flush()
                ids, keys, chars, held = [], [], [], 0
            ids.append(i)
            keys.append(k)
            chars.append(c)
            held += len(k)
    if ids:
        yield from flush()


def shard_nodes(paths: DataFrame) -> DataFrame:
    """The nodes of every shard of conversations (conv_id, turns), one row a conversation."""
    rows = paths.select("conv_id", F.col("turns.key").alias("keys"), F.col("turns.chars").alias("chars"))
    return rows.repartitionByRange(common.partitions(paths.sparkSession), "conv_id").sortWithinPartitions("conv_id").mapInArrow(_shards, LOCAL)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtree sums of the shards' own trees; a partition's rows stand by shard and place."""
    schema = _schema(SUMS)

    def flush(t: pa.Table) -> pa.RecordBatch:
        get = lambda c: t.column(c).to_numpy()
        up, conv = get("up"), get("conv_id")
        own = conv == get("first")
        saved = ((get("n") - own) * get("chars")).tolist()
        leaves = (own & (get("n_children") == 0)).astype(np.int64).tolist()
        for k in range(len(up) - 1, 0, -1):
            saved[up[k]] += saved[k]
            leaves[up[k]] += leaves[k]
        parent = pa.array(conv[up], mask=up < 0)
        columns = [t.column("node").combine_chunks(), t.column("depth").combine_chunks(), pa.array(conv), parent, *(t.column(c).combine_chunks() for c in ("n_convs", "n_children")), pa.array(leaves, pa.int64()), pa.array(saved, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("at").to_numpy() == 0).tolist()
        for lo, hi in zip([0, *starts], [*starts, len(batch)], strict=True):
            if lo in starts and held:
                yield flush(pa.Table.from_batches(held))
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield flush(pa.Table.from_batches(held))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's comma-joined ends; rows stand by node and shard."""
    schema = _schema("node binary, ends_sha256 string")
    node, own = None, None
    for batch in batches:
        rows = []
        for n, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            text = ",".join(map(str, np.frombuffer(ends, "<i8").tolist())).encode()
            if n != node:
                if own:
                    rows.append((node, own.hexdigest()))
                node, own = n, hashlib.sha256(text)
            else:
                own.update(b"," + text)
        if rows:
            yield _table(rows, schema)
    if own:
        yield _table([(node, own.hexdigest())], schema)


def trie(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turns), each with its smallest
    member, depth, parent's smallest member, counts, savings and the digest of its ends."""
    local = common.stored(spark, shard_nodes(paths), "trie-nodes")
    met = local.groupBy("node").agg(F.min("first").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("parent").alias("parent"))
    children = met.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    whole = met.drop("parent").join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    placed = local.drop("ends", "parent").join(whole, "node")
    summed = placed.repartition("shard").sortWithinPartitions("shard", "at").mapInArrow(_sums, SUMS)
    same = [F.max(c).alias(c) for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children")]
    nodes = summed.groupBy("node").agg(*same, F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ends = local.where("ends is not null").select("node", "shard", "ends").repartition("node").sortWithinPartitions("node", "shard").mapInArrow(_digests, "node binary, ends_sha256 string")
    return nodes.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, regrafted by their ids."""
    common.workers_import(spark)
    paths = regrafted(conversations(common.table(spark, sf_dir, "conversations")))
    return trie(spark, paths).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
