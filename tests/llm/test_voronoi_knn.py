"""The Voronoi kNN join against all pairs, with and without clusters."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrack.llm import voronoi_knn as V

FIELDS = "vec_id long, embedding array<double>"


def clipped(v):
    return max(-(1 << 63), min((1 << 63) - 1, v))


def plain(rows, is_query, k=5):
    """Multiset of (query id, its list of (score, id)) by brute force over unbounded integers."""
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(256 * x) for x in v)]
    out = []
    for a, (i, q) in enumerate(fine):
        if i is None or not is_query(i):
            continue
        others = [(-clipped(sum(x * y for x, y in zip(q, v, strict=True))), j is None, j or 0) for b, (j, v) in enumerate(fine) if b != a and len(v) == len(q)]
        out.append((i, [(-s, None if none else j) for s, none, j in sorted(others)[:k]]))
    return sorted(out, key=repr)


def joined(spark, rows, every, **how):
    rows = spark.createDataFrame(rows, FIELDS).selectExpr("*", "0 AS cell", "1 AS code", "2 AS row_no", "3 AS score").repartition(3)
    got: dict = {}
    for r in V.knn_join(rows, F.col("vec_id") % every == 0, **how).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    return got


def check(spark, rows, every, **how):
    got, want = joined(spark, rows, every, **how), plain(rows, lambda i: i % every == 0, how.get("k", 5))
    assert {q: [(s, i) for _, s, i in sorted(v)] for q, v in got.items()} == {q: v for q, v in want if v}


def vectors(n, dim, clusters=0, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    if clusters:
        x = 0.05 * x + rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)]
    return [(i, [float(v) for v in r]) for i, r in enumerate(x)]


@pytest.mark.parametrize("clusters", [0, 12])
def test_equals_all_pairs(spark, clusters):
    check(spark, vectors(500, 16, clusters), 10, pivots=20, group_bytes=600, slice_bytes=3000, slice_rows=40)


def test_bounds_cut_clustered_data(spark):
    """Groups of clustered queries get few of the rows."""
    rows = spark.createDataFrame(vectors(600, 16, 12), FIELDS)
    seen = {}
    real = V.plan_route

    def watch(asks, holds, pivots, *sizes):
        seen["route"] = route = real(asks, holds, pivots, *sizes)
        seen["share"] = sum(holds[d][0] for c in route.needs for d in holds if route.needs[c][d + 1]) / (len(route.needs) * sum(v[0] for v in holds.values()))
        return route

    V.plan_route = watch
    try:
        assert V.knn_join(rows, F.col("vec_id") % 10 == 0, pivots=24, group_bytes=600).count() == 300
    finally:
        V.plan_route = real
    assert seen["share"] < 0.4


def test_ties_copies_and_hot_vector(spark):
    rows = [(i, [0.5, 0.25, -1.0] if i % 3 else [float(i % 7), 1.0, 0.0]) for i in range(240)]
    check(spark, rows, 6, pivots=4, group_bytes=300, slice_bytes=900, slice_rows=20)


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(4)]) for i in range(40)]
    rows += [(40, None), (42, [1.0, None, 2.0, 3.0]), (44, [float("nan")] * 4), (46, [float("inf"), 0.0, 0.0, 0.0]), (48, []), (50, []), (52, [0.0] * 4), (54, [1.0, 2.0]), (56, [3.0, -1.0]), (58, [7.0] * 3),
             (None, [1.0, 1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0]), (60, [1e17, -3e15, 2e16, 1.0]), (62, [-1e17, 5.5e15, 1.0, 0.0]), (64, [1e300, 0.0, 0.0, 0.0]), (66, [1e307] * 4)]
    check(spark, rows, 2, pivots=6)
    check(spark, rows, 2, pivots=1, k=2)
    assert joined(spark, [], 2) == {} and joined(spark, [(1, [1.0])], 2) == {} and joined(spark, [(2, [1.0])], 2) == {}


def test_repeated_rows_are_rows(spark):
    rows = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0])], FIELDS)
    got = sorted(tuple(r) for r in V.knn_join(rows, F.col("vec_id") == 0).collect())
    assert got == [(0, 1, 1, 131072)] * 2 + [(0, 2, 0, 65536)] * 2
