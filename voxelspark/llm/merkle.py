"""Merkle manifest of a table: a leaf a row, a tree a group, one root.

Where a row stands in its group comes from a bitmap index, not from a sort. Ids set bits
in words of 64; only words with a bit are kept. A word's directory entry counts the rows
before it, and ``bit_count`` below a row's own bit gives the rest. Entries are summed in
three steps of 2^20, so no window holds more than a million small rows, whatever the ids.

Slots are then filled into arrays of 256, keyed by their number, and an array is reduced
by two levels of 16 at once in its own row. A tree of n leaves takes log256(n) shuffles of
hashes; texts are hashed where they are read and never move. Paths go down the same way.

Defined cases. A null id stands before all others; a null group is a group, the first.
Rows that share group and id stand in the order of their hashes; equal rows are
counted, then laid out, so each has a slot and a proof of its own. Rows of one id that
differ are numbered in one window (ids are meant to be unique). Nulls and empty texts hash
differently. Texts of any length are one hash. Columns that are not asked for are not
read, whatever their names. An empty table has no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Nodes of a run; a block holds two levels of runs.
RUN = 16
BLOCK = RUN * RUN
_STEP = 20
#: The word of rows without an id, before that of any id.
_NO_ID = -(1 << 58)


def sha(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value of a leaf: ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return sha(*[field(v) for v in values])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Index


def addressed(df: DataFrame, group: Column, key: Column) -> DataFrame:
    """Adds s (the group as a text that is never null), word and bit of the id."""
    own = df.withColumn("s", F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))).withColumn("_key", key.cast("long"))
    word = F.coalesce(F.shiftright("_key", 6), F.lit(_NO_ID))
    bit = F.coalesce(F.col("_key").bitwiseAND(63), F.lit(0)).cast("int")
    return own.withColumn("word", word).withColumn("bit", bit).drop("_key")


def directory(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(s, word, bits, n, before, total): the bitmap words of each group with how many of
    the group's rows the word has, stand before it, and are there in all."""
    words = rows.groupBy("s", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"), F.count("*").alias("n"))
    words = common.stored(spark, words.withColumn("chunk", F.shiftright("word", _STEP)), "merkle-words")

    def before(df: DataFrame, key: str, at: str, name: str) -> DataFrame:
        order = Window.partitionBy("s", key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum("n").over(order), F.lit(0)))

    chunks = words.groupBy("s", "chunk").agg(F.sum("n").alias("n")).withColumn("part", F.shiftright("chunk", _STEP))
    parts = chunks.groupBy("s", "part").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("s")
    high = parts.select("s", "part", F.coalesce(F.sum("n").over(top.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b2"), F.sum("n").over(top).alias("total"))
    mid = before(chunks, "part", "chunk", "b1").drop("n").join(high, ["s", "part"])
    low = before(words, "chunk", "word", "b0").join(mid, ["s", "chunk"])
    return low.select("s", "word", "bits", "n", (F.col("b0") + F.col("b1") + F.col("b2")).alias("before"), "total")


def ranked(rows: DataFrame, index: DataFrame, order: str, *values: str) -> DataFrame:
    """(s, slot, total, order, values): the place of every row in its group. A rank query
    is an equi-join with the word and a bit count; ``order`` tells rows of one id apart."""
    at = rows.select("s", "word", "bit", order, *values).join(index, ["s", "word"])
    single = F.col("n") == F.bit_count("bits")
    below = F.bit_count(F.expr("bits & ~shiftleft(-1L, bit)"))
    alone = at.where(single).select("s", (F.col("before") + below).alias("slot"), "total", order, *values)
    same = at.where(~single).groupBy("s", "word", "before", "total", "bit", order, *values).agg(F.count("*").alias("m"))
    ids = same.groupBy("s", "word", "bit").agg(F.sum("m").alias("k"))
    lower = Window.partitionBy("s", "word").orderBy("bit").rowsBetween(Window.unboundedPreceding, -1)
    ids = ids.select("s", "word", "bit", F.coalesce(F.sum("k").over(lower), F.lit(0)).alias("ids_before"))
    within = Window.partitionBy("s", "word", "bit").orderBy(order, *values).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("before") + F.col("ids_before") + F.col("own_before")
    spread = same.withColumn("own_before", F.coalesce(F.sum("m").over(within), F.lit(0))).join(ids, ["s", "word", "bit"])
    copies = spread.select("s", F.explode(F.sequence(first, first + F.col("m") - 1)).alias("slot"), "total", order, *values)
    return alone.unionByName(copies)


def ordinals(spark: SparkSession, groups: DataFrame) -> DataFrame:
    """(s, slot, total) of distinct groups in bytewise order: ranges are sorted apart and
    placed by the sizes of those before (a number a partition)."""
    ordered = groups.repartitionByRange(common.partitions(spark), "s").sortWithinPartitions("s")
    numbered = common.stored(spark, ordered.withColumn("_id", F.monotonically_increasing_id()), "merkle-groups")
    part = F.shiftright("_id", 33)
    sizes = {r[0]: r[1] for r in numbered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    offsets = spark.createDataFrame(starts, "p long, start long")
    placed = numbered.withColumn("p", part).join(offsets, "p")
    return placed.select(*groups.columns, (F.col("start") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias("slot"), F.lit(total).cast("long").alias("total"))


# Trees


def _runs(nodes: Column) -> Column:
    """The next level: each run of 16 becomes its hash."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / RUN).cast("int")), lambda i: F.sha2(F.array_join(F.slice(nodes, i * RUN + 1, RUN), "").cast("binary"), 256))


def blocks(nodes: DataFrame, *values: str) -> DataFrame:
    """Nodes (s, slot, total, hash, values) as blocks (s, block, total, a0, a1, a2, top and
    an array a value): the nodes by slot, the levels above (null past the top)."""
    entry = F.struct("slot", "hash", *values)
    grouped = nodes.groupBy("s", F.floor(F.col("slot") / BLOCK).alias("block"), "total").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    arrays = grouped.select("s", "block", "total", F.col("e.hash").alias("a0"), *[F.col(f"e.{v}").alias(v) for v in values])
    first = arrays.withColumn("a1", F.when(F.col("total") > 1, _runs(F.col("a0"))))
    both = first.withColumn("a2", F.when(F.col("total") > RUN, _runs(F.col("a1"))))
    return both.withColumn("top", F.get(F.coalesce("a2", "a1", "a0"), 0))


@dataclass(frozen=True)
class Tree:
    """Levels of blocks from the leaves up, and the top (s, hash) of every group."""

    levels: list[DataFrame]
    tops: DataFrame


def tree(spark: SparkSession, nodes: DataFrame, *values: str) -> Tree:
    """Reduces nodes (s, slot, total, hash, values) of each group to one."""
    levels, done = [], []
    while True:
        here = common.stored(spark, blocks(nodes, *values), "merkle-blocks")
        levels.append(here)
        done.append(here.where(F.col("total") <= BLOCK).select("s", F.col("top").alias("hash")))
        if not here.where(F.col("total") > BLOCK).head(1):
            break
        nodes, values = here.where(F.col("total") > BLOCK).select("s", F.col("block").alias("slot"), F.ceil(F.col("total") / BLOCK).alias("total"), F.col("top").alias("hash")), ()
    tops = done[0]
    for d in done[1:]:
        tops = tops.unionByName(d)
    return Tree(levels, tops)


def _steps(i: Column) -> Column:
    """What stands left and right of node i of a block, level by level to the block's top."""
    run = F.floor(i / RUN).cast("int")
    join = lambda c, start, n: F.array_join(F.slice(c, start, n), "")
    step = lambda a, b: F.struct(a.alias("left"), b.alias("right"))
    first = step(join("a0", run * RUN + 1, i - run * RUN), join("a0", i + 2, run * RUN + RUN - 1 - i))
    second = step(join("a1", F.lit(1), run), join("a1", run + 2, F.lit(RUN)))
    return F.when(F.col("total") > RUN, F.array(first, second)).when(F.col("total") > 1, F.array(first)).otherwise(F.array().cast("array<struct<left: string, right: string>>"))


def paths(tree: Tree, above: DataFrame, *carried: str) -> DataFrame:
    """The leaf blocks with ``path``, the steps from their top to the root, and the columns
    that ``above`` (s, path, carried) has for each group. Level by level downwards; a
    group joins once, at its top, so a large group is no hot key."""
    below = None
    for level in reversed(tree.levels):
        here = level.where(F.col("total") <= BLOCK).join(above.select("s", "path", *carried), "s")
        if below is not None:
            here = here.unionByName(level.where(F.col("total") > BLOCK).join(below, ["s", "block"]))
        each = F.transform("a0", lambda _, i: F.struct((F.col("block") * BLOCK + i).alias("block"), F.concat(_steps(i), F.col("path")).alias("path")))
        below = here.select("s", F.explode(each).alias("x"), *carried).select("s", "x.*", *carried)
    return here


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf hash gives with its siblings."""
    return F.aggregate(path, start, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]).cast("binary"), 256))


def manifest(spark: SparkSession, docs: DataFrame, key: Column, group: Column, hashed: Column, claimed: Column | None = None) -> DataFrame:
    """(key, group, slot, leaf, subroot, root, path, claimed) of every row: ``hashed`` is a
    row's leaf, ``claimed`` a hash to be checked against the tree (default: the leaf)."""
    claimed = hashed if claimed is None else claimed
    rows = addressed(docs.select(key.cast("long").alias("key"), group.alias("group"), hashed.alias("hash"), F.nullif(claimed, hashed).alias("claimed")), F.col("group"), F.col("key"))
    index = directory(spark, addressed(docs.select(key.alias("key"), group.alias("group")), F.col("group"), F.col("key")))
    own = tree(spark, ranked(rows, index, "hash", "claimed", "key"), "claimed", "key")
    root = tree(spark, ordinals(spark, own.tops).withColumn("name", F.col("s")).withColumn("s", F.lit("")), "name")
    start = root.tops.select("s", F.array().cast("array<struct<left: string, right: string>>").alias("path"), F.col("hash").alias("root"))
    entry = lambda _, i: F.struct(F.get("name", i).alias("s"), F.get("a0", i).alias("subroot"), F.concat(_steps(i), F.col("path")).alias("path"))
    above = paths(root, start, "root").select("root", F.explode(F.transform("a0", entry)).alias("x")).select("x.*", "root")
    whole = paths(own, common.stored(spark, above, "merkle-above"), "subroot", "root")
    one = lambda h, i: F.struct(F.get("key", i).alias("key"), (F.col("block") * BLOCK + i).alias("slot"), h.alias("leaf"), F.concat(_steps(i), F.col("path")).alias("path"), F.coalesce(F.get("claimed", i), h).alias("claimed"))
    return whole.select(F.expr("nullif(substr(s, 2), if(s = '', '', null))").alias("group"), "subroot", "root", F.explode(F.transform("a0", one)).alias("x")).select("group", "subroot", "root", "x.*")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document."""
    docs = common.table(spark, sf_dir, "documents")
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = common.remainder(F.col("doc_id"), 5) == 0
    claimed = leaf(*values, F.when(changed, lower_ascii(F.col("text"))).otherwise(F.col("text")))
    tested = F.when(changed, claimed).otherwise(leaf(*values, F.col("text")))
    found = manifest(spark, docs, F.col("doc_id"), F.col("source"), leaf(*values, F.col("text")), tested)
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    folded = fold(F.col("claimed"), F.col("path"))
    out = found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
