"""Digest trees: the same for any order, unlike for any change, and the changed rows found again."""

import hashlib
from collections import Counter

import pytest

from tallyrack.operators.digests import changes, depth_for, tree, unlike

SCHEMA = "`k` int, `a``b` string, raw binary, deep array<string>"


def _rows(n):
    return [(i % 50 if i % 3 else None, None if i % 11 == 0 else f"text,{i % 40}:" * (i % 4), bytes([i % 256, 255]), ["x", None] if i % 2 else None) for i in range(n)]


def _root(t):
    return t.where("level = 0").first()


def test_any_order_and_partitioning(spark):
    rows = _rows(600)
    one = tree(spark.createDataFrame(rows, SCHEMA), depth=2)
    for other in (spark.createDataFrame(rows[::-1], SCHEMA).repartition(7), spark.createDataFrame(rows, SCHEMA).repartition(3, "k")):
        assert sorted(one.collect()) == sorted(tree(other, depth=2).collect())
        assert unlike(one, tree(other, depth=2)).count() == 0
    by_level = {r["level"]: r["n"] for r in one.groupBy("level").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert by_level == {0: 600, 1: 600, 2: 600}


def test_repeats_swaps_and_nulls_are_seen(spark):
    roots = set()
    tables = [[(1, "a"), (2, "b")], [(1, "b"), (2, "a")], [(1, "a"), (2, "b"), (2, "b")], [(1, "a"), (2, None)], [(1, "a"), (2, "null")], [(1, "a"), (2, "")], [(1, "a,1:b")], []]
    for rows in tables:
        roots.add(_root(tree(spark.createDataFrame(rows, "id int, v string")))["digest"])
    assert len(roots) == len(tables)
    empty = _root(tree(spark.createDataFrame([], "id int, v string"), depth=1))
    assert (empty["n"], empty["digest"]) == (0, hashlib.sha256(b"").hexdigest())


def test_changes_equal_a_count_of_all_rows(spark):
    rows = _rows(900)
    other = [r for i, r in enumerate(rows) if i not in (5, 77)] + [rows[0]] * 3 + [(7, "new", b"", None)]
    got = changes(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(other, SCHEMA), depth=2)
    plain = lambda r: (r[0], r[1], bytes(r[2]), None if r[3] is None else tuple(r[3]))
    a, b = Counter(map(plain, rows)), Counter(map(plain, other))
    assert {plain(r): (r["n_one"], r["n_other"]) for r in got.collect()} == {k: (a[k], b[k]) for k in a | b if a[k] != b[k]}
    assert changes(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows[::-1], SCHEMA)).count() == 0
    assert changes(spark.createDataFrame([], SCHEMA), spark.createDataFrame(rows[:1], SCHEMA)).count() == 1


def test_depth(spark):
    assert [depth_for(n) for n in (0, 256, 257, 4096, 4097, 10**12)] == [0, 0, 1, 1, 2, 8]
    with pytest.raises(ValueError):
        unlike(*(tree(spark.range(3).toDF("id"), depth=d) for d in (0, 1)))
