"""Components against a plain search, over one batch and many, and how little moves for clustered edges."""

import random

from test_count_index import shuffled

from tallyrack.operators.graph import connected_components


def plain(edges):
    lead = {}

    def find(v):
        while lead.setdefault(v, v) != v:
            v = lead[v]
        return v

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        lead[high] = low
    return {v: find(v) for v in list(lead)}


def test_equals_plain_search_whatever_the_batches(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(70)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5, 5), (7000, 7000), (-(1 << 62), 1 << 62)] + [(2000, 2001 + i) for i in range(50)]
    rng.shuffle(edges)
    rows = spark.createDataFrame([*edges, (None, 9999), (3, None)], "src long, dst long")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for size in (2, 10000):
            spark.conf.set(key, size)
            assert {r["node"]: r["component"] for r in connected_components(rows.repartition(5)).collect()} == plain(edges)
    finally:
        spark.conf.set(key, before)
    assert connected_components(rows.where("false")).count() == 0


def test_clustered_edges_move_once(spark):
    edges = spark.range(0, 40000, 1, 2).selectExpr("id div 40 * 100 + id % 5 AS src", "-1 - id div 5 AS dst")
    before = shuffled(spark)
    assert connected_components(edges).select("component").distinct().count() == 1000
    assert shuffled(spark) - before < 40000  # 13,000 nodes; each of several rounds moved 80,000 edges
