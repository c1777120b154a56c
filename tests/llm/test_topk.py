"""Tiled top-k search against all products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import topk as T

SCHEMA = "vec_id long, embedding array<double>, rid long, n int, score long"


def brute(rows, every=20, k=T.K, scale=64):
    usable = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for r, (i, q) in enumerate(usable):
        if i is None or i % every:
            continue
        scored = [(-max(-T.MOST, min(T.MOST, sum(a * b for a, b in zip(q, v)))), j is None, j or 0, j) for s, (j, v) in enumerate(usable) if s != r]
        out += [(i, n + 1, x[3], -x[0]) for n, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 7, 7, 7) for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in T.search(df, F.col("vec_id") % 20 == 0, **how).select("query_id", "rank", "vec_id", "score").collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"block": 3, "shard": 40, "fan": 2}, {"block": 1, "shard": 11, "fan": 3, "k": 5}])
def test_all_products(spark, how):
    rng = np.random.default_rng(1)
    rows = [(int(i) - 50, [float(x) for x in rng.normal(size=8).round(1)]) for i in rng.permutation(300)]
    assert found(spark, rows, **how) == brute(rows, k=how.get("k", T.K))


def test_odd_rows(spark):
    rows = [
        (0, [0.1, 0.2]), (0, [0.1, 0.2]), (0, [-1.0, 3.0]), (20, None), (40, [1.0, None]), (60, [float("nan"), 1.0]), (80, [float("inf"), 0.0]), (None, [5.0, 5.0]),
        (1, [0.1, 0.2]), (2, [0.1, 0.2]), (3, []), (100, []), (4, [0.5]), (5, [0.5, 0.5, 0.5]), (-20, [-0.001, 0.001]),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, k=3, shard=2, block=1, fan=2) == brute(rows, k=3)


def test_ties_of_a_hot_vector(spark):
    rows = [(i, [0.6, 0.8]) for i in range(400)] + [(400 + i, [0.8, 0.6]) for i in range(100)]
    assert found(spark, rows, shard=64) == brute(rows)


def test_large_components_are_exact(spark):
    rows = [(0, [1e6 + 0.5, -3.0]), (20, [2.0**40, 1.0]), (1, [2.0**40, -(2.0**40)]), (2, [1e300, 1.0]), (3, [1.0, 2.0]), (40, [-1e300, 0.0])]
    assert found(spark, rows) == brute(rows)


def test_nothing_to_find(spark):
    assert found(spark, []) == []
    assert found(spark, [(20, [1.0])]) == []
    assert found(spark, [(1, [1.0]), (2, [1.0])]) == []


def test_selection_by_sorting():
    rng = np.random.default_rng(3)
    for n, k in ((5, 20), (20, 20), (21, 20), (200, 7)):
        scores = rng.integers(-4, 5, (50, n))
        scores[rng.random((50, n)) < 0.1] = T.ABSENT
        for row, mask in zip(scores, T.selected(scores, k)):
            order = sorted((j for j in range(n) if row[j] != T.ABSENT), key=lambda j: (-row[j], j))
            assert sorted(order[:k]) == np.flatnonzero(mask).tolist()
