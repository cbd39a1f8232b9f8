"""Shard sets against plain slices of the rows, damage that is found, and reruns that write only what differs."""

import hashlib
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tallyrack.operators import shards


def _rows(n):
    return [(i // 3 if i % 5 else None, None if i % 7 == 3 else "" if i % 11 == 2 else f"zeile ß {i % 13}" * (i % 4 + 1)) for i in range(n)]


def _table(spark, rows, parts=5):
    return spark.createDataFrame(rows, "ord long, line string").repartition(parts)


def _plain(ordered, k):
    base, larger = divmod(len(ordered), k)
    at, out = 0, {}
    for shard in range(k):
        stop = at + base + (shard < larger)
        sums = [0] * 4
        for row in range(at, stop):
            text = ordered[row]
            d = hashlib.sha256(f"{row}{'null' if text is None else ':' + text}".encode()).hexdigest()
            sums = [s + int(d[16 * i:16 * i + 16], 16) for i, s in enumerate(sums)]
        size = sum(len((t or "").encode()) for t in ordered[at:stop])
        out[shard] = (at, stop, stop - at, size, hashlib.sha256(":".join(map(str, [stop - at, *sums])).encode()).hexdigest())
        at = stop
    return out


def _files(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(f"{path}/shards") for f in names if f.endswith(".parquet")}


def _status(spark, path):
    return {r["shard"]: r["status"] for r in shards.check(spark, path).collect()}


@pytest.mark.parametrize("n,k", [(97, 4), (3, 5), (0, 2), (40, 1)])
def test_manifest_equals_plain_slices(spark, tmp_path, n, k):
    path = str(tmp_path / "set")
    made = shards.write(_table(spark, _rows(n)), path, k, "ord", "line")
    ordered = [r["line"] for r in shards.rebuilt(spark, path).orderBy("row").collect()]
    assert sorted(ordered, key=repr) == sorted((t for _, t in _rows(n)), key=repr)
    assert {r["shard"]: tuple(r)[1:] for r in made.collect()} == _plain(ordered, k)
    assert set(_status(spark, path).values()) == {"ok"} and len(_status(spark, path)) == k
    assert shards.manifest_issues(made).where("size(issues) > 0").count() == 0


def test_rows_keep_the_order_whatever_the_partitions(spark):
    rows = [(None if i % 4 == 0 else i % 50, f"t{i % 9}") for i in range(300)]
    one, other = ({r["row"]: r["line"] for r in shards.placed(_table(spark, given, parts), 4, "ord", "line").collect()} for given, parts in ((rows, 1), (rows[::-1], 9)))
    assert one == other and sorted(one) == list(range(300))
    plain = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    groups = [(o, sorted(t for x, t in rows if x == o)) for o in dict.fromkeys(r[0] for r in plain)]
    at = 0
    for _, texts in groups:
        assert sorted(one[at + i] for i in range(len(texts))) == texts
        at += len(texts)


def test_a_rerun_writes_nothing_and_damage_is_mended_alone(spark, tmp_path):
    path = str(tmp_path / "set")
    table = _table(spark, [(i, f"line {i}") for i in range(200)])
    shards.write(table, path, 5, "ord", "line")
    first = _files(path)
    shards.write(table, path, 5, "ord", "line")
    assert _files(path) == first

    shutil.rmtree(f"{path}/shards/shard=1")
    for name in os.listdir(f"{path}/shards/shard=3"):
        if name.endswith(".parquet"):
            with open(f"{path}/shards/shard=3/{name}", "r+b") as f:
                f.truncate(20)
        else:
            os.remove(f"{path}/shards/shard=3/{name}")
    assert {s for s, v in _status(spark, path).items() if v != "ok"} == {1, 3}
    with pytest.raises(ValueError, match="differs"):
        shards.rebuilt(spark, path)
    shards.write(table, path, 5, "ord", "line")
    assert set(_status(spark, path).values()) == {"ok"}
    kept = {f for f in first if "shard=1/" not in f and "shard=3/" not in f}
    assert kept <= _files(path) and not (_files(path) - kept) & first

    changed = table.withColumn("line", F.when(F.col("ord") == 199, "line 998").otherwise(F.col("line")))
    before = _files(path)
    shards.write(changed, path, 5, "ord", "line")
    assert {f for f in before if "shard=4/" not in f} == {f for f in _files(path) if "shard=4/" not in f} and before != _files(path)
    assert {r["line"] for r in shards.rebuilt(spark, path).collect()} == {r["line"] for r in changed.collect()}

    shards.write(changed, path, 3, "ord", "line")
    assert sorted(_status(spark, path)) == [0, 1, 2] and shards.rebuilt(spark, path).count() == 200


def test_each_difference_has_its_status(spark):
    rows = shards.placed(_table(spark, [(i, f"{i:04d}") for i in range(80)]), 8, "ord", "line")
    kept = shards.manifest(rows, 8)
    edited = rows.where("NOT (shard = 1 AND row = 12) AND shard <> 2").selectExpr(
        "CASE WHEN shard = 3 THEN row + 1 WHEN shard = 6 AND row IN (61, 62) THEN 123 - row ELSE row END AS row",
        "CASE WHEN row = 44 THEN concat(line, '!') WHEN row = 55 THEN NULL WHEN row = 71 THEN '007l' ELSE line END AS line", "shard",
    ).unionByName(spark.createDataFrame([(0, "x", 9)], "row long, line string, shard int"))
    got = {r["shard"]: r["status"] for r in shards.reconciled(kept, edited).collect()}
    assert got == {0: "ok", 1: "records", 2: "missing", 3: "range", 4: "bytes", 5: "bytes", 6: "digest", 7: "digest", 9: "unexpected"}


def test_manifest_rules(spark):
    good = "a" * 64
    rows = [(0, 0, 4, 4, 9, good), (1, 4, 8, 4, 9, "A" * 64), (1, 4, 8, 4, 9, good), (3, 12, 15, 3, -1, good), (None, 15, 18, 4, None, None), (5, 18, 18, 0, 3, good)]
    kept = spark.createDataFrame(rows, "shard int, start long, stop long, records long, bytes long, digest string")
    got = [(r["shard"], set(r["issues"])) for r in shards.manifest_issues(kept).collect()]
    assert (0, set()) in got and (3, {"range", "bytes"}) in got and (None, {"shard", "range", "records", "bytes", "digest"}) in got
    assert sorted(sorted(i) for s, i in got if s == 1) == [["digest", "range", "shard"], ["range", "shard"]]
    assert (5, {"range", "bytes"}) in got
    with pytest.raises(ValueError):
        shards.write(kept, "unused", 0, "start", "digest")
