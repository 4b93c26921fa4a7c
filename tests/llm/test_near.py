"""The pipeline's near-duplicate stage against all pairs."""

import numpy as np

import pytest

import corpus_pipeline
from voxelspark.llm import common, near


def brute(texts):
    """Least id of each id's component; J >= 0.8 on whole sets of 5 words."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in texts.items()}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            a, b = sets[i], sets[j]
            if i < j and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def test_stage_drops_every_pair_at_0_8(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    texts, common_lines = {}, " ".join(words[:30])
    for family in range(12):
        base = [*rng.choice(words, 150)]
        for copy in range(8):
            own = base[:]
            for at in rng.choice(150, rng.integers(0, 5), replace=False):
                own[at] = f"edit{family}-{copy}-{at}"
            texts[len(texts)] = common_lines + " " + " ".join(own)
    texts |= {len(texts) + k: t for k, t in enumerate(["", None, "one two", "One  two", "word " * 50, "word " * 9])}
    want = brute(texts)
    rows = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in near.groups(rows).collect()}
    assert got == want
    kept = corpus_pipeline.near_duplicates(spark, rows, "")
    assert {r.doc_id for r in kept.collect()} == {i for i, r in want.items() if i == r}


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: own)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    own = None
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
    own = "file:///mnt/work/"
    assert common.shared_dir(Session) == "file:///mnt/work"
