"""Nearest neighbours where a few vectors are very long."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wareknit.llm import neighbours


@pytest.mark.parametrize("times", [30, 300, 1e5])
def test_neighbours_beside_long_vectors(spark, times):
    n, rng = 3000, np.random.default_rng(7)
    x = rng.standard_normal((n, 24))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    x[[11, 503, 1999]] *= times
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hits, far, far_hits = 0, 0, 0
    for i, found in got.items():
        s = x.astype(np.float64) @ x[i].astype(np.float64)
        s[i] = -np.inf
        best = set(np.argsort(-s)[:20].tolist())
        hits += len(found & best)
        far, far_hits = far + len(best & {11, 503, 1999}), far_hits + len(found & best & {11, 503, 1999})
    print("times", times, "recall", hits / (20 * len(got)), "of the long ones", far_hits / far)
    assert len(got) == n // 50 and hits >= 0.95 * 20 * len(got) and far_hits >= 0.95 * far
