"""Formulas counted by cubes over many tasks, against one solver."""

import random
from fractions import Fraction

import pytest
from test_wmc import CASES

from tallyrack.operators.cubes import counted, split
from tallyrack.operators.wmc import Solver, count_text
from tallyrack.sources.dimacs import parse


def _random(seed: int, n: int, clauses: int, weighted: bool = True) -> str:
    rng = random.Random(seed)
    weights = [f"c p weight {s}{v} {t}/7 0" for v in range(1, n + 1, 2) for x in [rng.randint(0, 7)] for s, t in (("", x), ("-", 7 - x))] if weighted else []
    body = [" ".join(str(rng.choice((-1, 1)) * v) for v in rng.sample(range(1, n + 1), 3)) + " 0" for _ in range(clauses)]
    return "\n".join(["c t wmc", f"p cnf {n} {clauses}", *weights, *body]) + "\n"


@pytest.mark.parametrize("seed", range(5))
def test_cubes_share_out_the_models(seed):
    f = parse(_random(seed, 9, 20))
    cubes = split(f, [], 6)
    assert sum(Solver().solve(f, c)[0] for c in cubes) == Solver().solve(f)[0]
    again = [d for c in cubes for d in split(f, c, 3)]
    assert sum(Solver().solve(f, c)[0] for c in again) == Solver().solve(f)[0]


def test_beyond_one_task_and_odd_rows(spark):
    texts = {f"r{i}": _random(i, 24, 40 + 8 * i) for i in range(4)} | {"none": "p cnf 2 3\n1 2 0\n-1 0\n-2 0\n", "long": _random(9, 30, 45, False)} | {k: v[0] for k, v in CASES.items()}
    rows = [*texts.items(), ("null", None), ("bad", "p cnf 1 2\n1 0\n"), ("twice", "p cnf 1 0\n"), ("twice", "p cnf 2 0\n"), ("same", "p cnf 1 0\n"), ("same", "p cnf 1 0\n"), (None, "p cnf 1 0\n")]
    given = spark.createDataFrame(rows, "formula_id string, text string").selectExpr("*", "1 AS share", "2 AS lits")
    got = {r["formula_id"]: r for r in counted(given, node_budget=6, ways=5, rounds=30).collect()}
    assert set(got) == {*texts, "null", "bad", "twice", "same"}
    for name, text in texts.items():
        want = count_text(name, text)
        assert [got[name][c] for c in ("status", "satisfiable", "num", "den")] == [want[c] for c in ("status", "satisfiable", "num", "den")], name
    assert count_text("long", texts["long"], node_limit=6)["status"] == "resource_limit" and got["long"]["cubes"] > 20
    assert [got[x]["status"] for x in ("null", "bad", "twice", "same")] == ["parse_error", "parse_error", "invalid_input", "success"]
    assert Fraction(int(got["same"]["num"])) == 2 and got["twice"]["num"] is None


def test_rounds_end_with_a_status(spark):
    rows = spark.createDataFrame([("a", _random(3, 24, 50)), ("b", "p cnf 1 0\n")], "formula_id string, text string")
    got = {r["formula_id"]: (r["status"], r["num"]) for r in counted(rows, node_budget=2, ways=2, rounds=2).collect()}
    assert got == {"a": ("resource_limit", None), "b": ("success", "2")}
    assert counted(rows.limit(0)).count() == 0
