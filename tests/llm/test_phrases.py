"""Lempel-Ziv fingerprints against a parse by definition."""

import hashlib
import random

import numpy as np
import pytest

from voxelspark.llm import phrases


def plain(text: str) -> set[bytes]:
    data, found, begin = text.encode(), set(), 0
    for end in range(1, len(data) + 1):
        if data[begin:end] not in found:
            found.add(data[begin:end])
            begin = end
    return found


def expected(rows: list[tuple]) -> list[tuple]:
    rows = [(k, t or "") for k, t in rows]
    out = []
    for (k, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        one, two, three = (phrases.signature(plain(t)) for t in (text, edited, after))
        out.append((k, len(text), hashlib.sha256(edited.encode()).hexdigest(), phrases.as_hex(one), phrases.as_hex(two), phrases.likeness(one, two), phrases.likeness(one, three)))
    return out


def check(spark, rows: list[tuple], schema="doc_id long, text string, range int, follows string, h string, id string"):
    df = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], schema).repartition(3)
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[3], r[5], r[6])
    assert sorted((tuple(r) for r in phrases.beside(spark, df).collect()), key=key) == sorted(expected(rows), key=key)


def test_parse_in_two_parts_is_one_parse():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("abé😀 ") for _ in range(rng.randint(0, 60)))
        own = phrases.Parsed(text)
        assert as_set(own) <= plain(text) and (own.signature == phrases.signature(plain(text))).all()


def as_set(own: phrases.Parsed) -> set[bytes]:
    return own.phrases


@pytest.mark.parametrize("ranges", ["1", "4", "9"])
def test_order_and_edits(spark, ranges):
    rng = random.Random(7)
    rows = [(k * 3 - 40, "".join(rng.choice(["ab", "über ", "word ", "😀"]) for _ in range(rng.choice([0, 1, 2, 3, 5, 200])))) for k in range(60)]
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_odd_rows(spark):
    check(spark, [(None, "first of all"), (1, None), (2, ""), (3, "x"), (4, "x" * 100_000), (5, "long words " * 20_000)])
    check(spark, [(9, "a lone text follows itself")])
    check(spark, [])
    same = spark.createDataFrame([(7, "copy of a text with words")] * 50 + [(8, "another one")], "doc_id long, text string").repartition(4)
    found = phrases.beside(spark, same).collect()
    assert len(found) == 51 and sum(r.near_next == 1 for r in found) == 49 and len({r.fingerprint for r in found if r.doc_id == 7}) == 1


def test_likeness_tells_texts_apart(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(40)]
    near, far = [], []
    for a, b in zip(texts, texts[1:], strict=False):
        own = phrases.Parsed(a)
        near.append(phrases.likeness(own.signature, own.edited(b)[1]))
        far.append(phrases.likeness(own.signature, phrases.fingerprint(b)))
    assert min(near) > max(far) + 0.1
    # A likeness is close to the whole sets' Jaccard similarity.
    exact = [len(plain(a) & plain(b)) / len(plain(a) | plain(b)) for a, b in zip(texts, texts[1:], strict=False)]
    assert np.abs(np.array(far) - exact).mean() < 0.03


def test_column(spark):
    df = spark.createDataFrame([("a b c",), (None,)], "t string").select(phrases.fingerprints("t").alias("f"))
    assert [r.f for r in df.collect()] == [phrases.as_hex(phrases.fingerprint("a b c")), ""]
    assert (phrases.from_hex(phrases.as_hex(phrases.fingerprint("some text"))) == phrases.fingerprint("some text")).all()
