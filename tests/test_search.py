"""Budgets found in rounds, against the full grid."""

import math

from pyspark.sql import functions as F

from tallyrack.operators.search import preflight, search
from tallyrack.operators.wmc import count_text

LIMITS = [1, 2, 4, 8, 16, 32]
SCHEMA = "case_id string, text string, partition string, expected long, satisfiable boolean"


def _cases(n=24):
    rows = []
    for i in range(n):
        v = 2 + i % 5
        text = f"p cnf {v + 2} {v + 1}\n" + "".join(f"{1 + (i + j) % v} {-(1 + j)} {v + 1 + j % 2} 0\n" if 1 + (i + j) % v != 1 + j else f"{1 + j} {v + 2} 0\n" for j in range(v + 1) if j < v) + f"-{v + 1} {v + 2} 0\n"
        got = count_text("x", text)
        rows.append((f"c{i}", text, "development", int(got["num"]), got["satisfiable"]))
    return rows


def test_equals_the_full_grid_with_fewer_runs(spark):
    rows = _cases()
    got = {r["node_limit"]: r for r in search(spark.createDataFrame(rows, SCHEMA), LIMITS[::-1]).collect()}
    best, runs = None, 0
    for limit in LIMITS:
        done = [x["nodes"] for r in rows if (x := count_text(r[0], r[1], node_limit=limit))["status"] == "success"]
        g = got[limit]
        assert (g["completed"], g["nodes"] or 0, g["status"]) == (len(done), sum(done), "success")
        assert not done or math.isclose(g["mean_log_nodes"], sum(map(math.log1p, done)) / len(done))
        if best is None or len(done) > runs:
            best, runs = limit, len(done)
    assert [x for x in LIMITS if got[x]["chosen"]] == [best]
    assert sum(g["tried"] for g in got.values()) < len(rows) * len(LIMITS)


def test_a_mismatch_stops_the_search(spark):
    rows = _cases()
    rows[3] = (*rows[3][:3], rows[3][3] + 1, rows[3][4])
    got = search(spark.createDataFrame(rows, SCHEMA), LIMITS).collect()
    need = count_text("x", rows[3][1])["nodes"]
    assert {r["status"] for r in got} == {"mismatch"} and not any(r["chosen"] for r in got)
    stop = next(x for x in LIMITS if x >= need)
    assert all((r["tried"] > 0) == (r["node_limit"] <= stop) for r in got)


def test_preflight_runs_nothing(spark):
    good = _cases(2)
    for bad in (("c0", *good[0][1:]), ("t", good[0][1], "final_test", 1, True), ("n", good[0][1], None, 1, True), ("-", good[0][1], "development", -1, True), ("s", good[0][1], "development", 1, False), ("e", good[0][1], "development", None, None), (None, *good[0][1:])):
        cases = spark.createDataFrame([*good, bad], SCHEMA)
        assert preflight(cases).count() > 0
        got = search(cases, LIMITS, evaluate=lambda *_: 1 / 0).collect()
        assert {(r["status"], r["tried"], r["chosen"]) for r in got} == {("invalid_input", 0, False)}
    assert {r["status"] for r in search(cases.limit(0), LIMITS).collect()} == {"invalid_input"}


def test_nothing_done_has_no_choice(spark):
    never = lambda rows, limit: rows.select("case_id", F.lit(False).alias("done"), F.lit(limit).cast("long").alias("nodes"), F.lit(True).alias("agrees"))
    got = search(spark.createDataFrame(_cases(3), SCHEMA), [1, 2], never).collect()
    assert {(r["status"], r["completed"], r["tried"], r["chosen"]) for r in got} == {("no_baseline", 0, 3, False)}
