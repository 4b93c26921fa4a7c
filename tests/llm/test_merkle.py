"""The manifest against a tree built by hand, on plain and on odd tables."""

import hashlib

from pyspark.sql import functions as F

from voxelspark.llm import merkle


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree: list[list[str]], k: int) -> list[tuple[str, str]]:
    out = []
    for level in tree[:-1]:
        at = k // 16 * 16
        out.append(("".join(level[at:k]), "".join(level[k + 1 : at + 16])))
        k //= 16
    return out


def expected(rows: list[tuple], leaf) -> dict:
    """{(group, slot): (leaf, subroot, root, path)} of rows (key, group, ...)."""
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: levels([x[2] for x in sorted(own)]) for g, own in groups.items()}
    names = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    top = levels([trees[g][-1][0] for g in names])
    return {(g, k): (h, t[-1][0], top[-1][0], siblings(t, k) + siblings(top, names.index(g))) for g, t in trees.items() for k, h in enumerate(t[0])}


def check(spark, rows: list[tuple], schema: str = "id long, grp string, text string") -> None:
    df = spark.createDataFrame(rows, schema).repartition(5)
    found = merkle.manifest(spark, df, F.col("id"), F.col("grp"), merkle.leaf(F.col("id"), F.col("grp"), F.col("text"))).collect()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    want = expected(rows, lambda r: sha(*[field(v) for v in r[:3]]))
    got = {(r.group, r.slot): (r.leaf, r.subroot, r.root, [(p.left, p.right) for p in r.path]) for r in found}
    assert len(found) == len(rows) and got == want
    for r in found:
        h = r.leaf
        for p in r.path:
            h = sha(p.left, h, p.right)
        assert h == r.root == r.subroot or h == r.root


def test_sizes_of_runs_and_blocks(spark):
    sizes = {"one": 1, "two": 2, "run": 16, "more": 17, "block": 256, "over": 257, "large": 700}
    rows = [(k * 7 + 3, g, f"{g} {k}") for g, n in sizes.items() for k in range(n)]
    check(spark, rows)


def test_many_groups_and_far_ids(spark):
    ids = [-(1 << 63), -1, 0, 63, 64, 1 << 20, 1 << 26, 1 << 40, (1 << 63) - 1]
    check(spark, [(i, f"g{k:03d}", "x") for k in range(300) for i in ids[: 1 + k % len(ids)]])


def test_nulls_repeats_and_ties(spark):
    rows = [(5, None, None), (5, None, ""), (5, "", ""), (None, "a", "x"), (None, "a", "x"), (None, "a", None), (3, "a", "x"), (3, "a", "x"), (3, "a", "y"), (70, "a", "x"), (2, "a", "long " * 50_000)]
    check(spark, rows + [(9, "same", "copy")] * 300 + [(8, "same", "copy")])


def test_empty_lone_and_clashing_columns(spark):
    schema = "id long, grp string, text string, s string, word long, slot long, total long, hash string, path string, root string"
    check(spark, [(1, "a", "x", "q", 1, 2, 3, "h", "p", "r"), (2, "a", "x", None, 9, 9, 9, "h", "p", "r")], schema)
    check(spark, [(1, None, None)])
    none = spark.createDataFrame([], "id long, grp string")
    assert merkle.manifest(spark, none, F.col("id"), F.col("grp"), merkle.leaf(F.col("id"))).count() == 0


def test_tampering_shows(spark):
    df = spark.createDataFrame([(k, "a", "Word" if k % 2 else "word") for k in range(40)], "id long, grp string, text string")
    hashed = merkle.leaf(F.col("id"), F.col("text"))
    found = merkle.manifest(spark, df, F.col("id"), F.col("grp"), hashed, merkle.leaf(F.col("id"), merkle.lower_ascii(F.col("text"))))
    verified = found.select("key", (merkle.fold(F.col("claimed"), F.col("path")) == F.col("root")).alias("ok")).collect()
    assert {r.key: r.ok for r in verified} == {k: k % 2 == 0 for k in range(40)}
