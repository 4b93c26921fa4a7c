"""The trie against one made of prefixes by hand."""

import hashlib
import math
import random
import zlib

from voxelspark.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, shard long, n string"


def rebuilt(rows: list[tuple]) -> dict[int, list]:
    own: dict[int, list] = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + t[h:]
    return out


def expected(paths: dict[int, list]) -> list[tuple]:
    members: dict[tuple, list] = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(tuple(p[:d]), []).append(c)
    out = []
    for k, own in members.items():
        under = [x for x in members if x[: len(k)] == k]
        kids = [x for x in under if len(x) == len(k) + 1]
        leaves = [x for x in under if not any(y[: len(x)] == x and len(y) > len(x) for y in under)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x)
        ends = ",".join(str(c) for c in sorted(c for c in own if len(paths[c]) == len(k)))
        out.append((min(own), len(k), min(members[k[:-1]]) if k else None, len(own), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows: list[tuple]) -> list[tuple]:
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    made = trie.trie(spark, trie.regrafted(trie.conversations(df)))
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r) for r in made.select(*columns).collect()), key=str)


def test_random_conversations(spark):
    rng = random.Random(5)
    rows = []
    for c in rng.sample(range(-150, 700), 220):
        for turn in range(rng.randint(1, 9)):
            rows.append((c, turn, rng.choice(["user", "bot"]), rng.choice(["", "a", "é😀", "long " * rng.randint(1, 2)])))
    assert found(spark, rows) == expected(rebuilt(rows))


def test_shards_meet(spark):
    """Shards of few conversations: nodes, subtrees and end lists run over their bounds."""
    paths = {c: [("u", "hello")] * (1 + c % 3) + [("u", str(c % 5))] * (c % 2) for c in range(60)}
    rows = [(c, k, *t) for c, p in paths.items() for k, t in enumerate(p)]
    df = trie.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        made = trie.trie(spark, df).drop("node").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    order = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted((tuple(r[c] for c in order) for r in made), key=str) == expected(paths)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (0, None, None, None), (0, 0, "user", "a"), (0, 0, "user", "a"), (0, 2, "bot", "b"), (7, 1, None, "x"), (7, None, "user", None), (207, 3, "u", "t"), (300, 0, "user", "word " * 40_000)]
    rows += [(c, 0, "user", "same") for c in range(400, 520)]
    assert found(spark, rows) == expected(rebuilt(rows))
    assert found(spark, []) == []


def test_long_conversation(spark):
    rows = [(c, k, "u", f"{k // 2}") for c in (100, 101) for k in range(3000)]
    df = trie.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    made = trie.trie(spark, df)
    top = made.where("depth = 0").first()
    assert made.count() == 3001 and (top.n_convs, top.n_leaves, top.saved_tokens) == (2, 1, sum(len(f"{k // 2}") for k in range(3000)))
