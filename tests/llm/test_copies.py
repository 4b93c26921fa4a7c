"""Recall of the permutation index on whole blocks, with and without a hot vector."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelspark.llm import ann


@pytest.mark.parametrize(("hot", "spread"), [(0, 0.0), (8000, 0.0), (0, 1.0)])
def test_recall_on_blocks_with_copies(spark, hot, spread):
    rng = np.random.default_rng(7)
    n = 24_000
    x = rng.standard_normal((n, 64))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    x = (x * np.exp(rng.normal(0, spread, (n, 1)))).astype(np.float32)  # lengths may differ
    copies = rng.choice(n, hot, replace=False)
    x[copies] = x[0]
    rows = pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))})
    got = ann.search(spark.createDataFrame(rows), F.col("vec_id") % 400 == 1).toPandas()
    exact, share = x.astype(float), []
    for q in range(1, n, 400):
        s = exact @ exact[q]
        s[q] = -np.inf
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [*range(1, 21)] and q not in set(mine.vec_id)
        # Copies tie, so a score counts as found, not an id.
        share.append((mine.score.to_numpy() >= np.sort(s)[-20] - 1e-9).mean())
    assert np.mean(share) >= 0.9, np.mean(share)


def _spread(kind: str, rng) -> np.ndarray:
    n = 12_000
    if kind == "sphere":
        x = rng.standard_normal((n, 256))
        return x / np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "gaussian":
        return rng.standard_normal((n, 768))
    if kind == "positive":
        return np.abs(rng.standard_normal((n, 64)))
    return rng.standard_normal((n, 64)) + 3.0


@pytest.mark.parametrize("kind", ["sphere", "gaussian", "positive", "offset"])
def test_recall_on_hard_vectors(spark, kind):
    x = _spread(kind, np.random.default_rng(11)).astype(np.float32)
    n, d = x.shape
    rows = pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), d).cast(pa.list_(pa.float32()))})
    got = ann.search(spark.createDataFrame(rows), F.col("vec_id") % 200 == 0).toPandas()
    exact, share = x.astype(float), []
    for q in range(0, n, 200):
        s = exact @ exact[q]
        s[q] = -np.inf
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [*range(1, 21)]
        share.append(len({*np.argsort(-s)[:20]} & {*mine.vec_id}) / 20)
    assert np.mean(share) >= 0.9, np.mean(share)
