"""Weighted model counting: fixed values, malformed input, and agreement with enumeration."""

import itertools
import random
from fractions import Fraction

import pytest

from tallyrack.operators import wmc
from tallyrack.operators.wmc import Solver, count_text, exact_counts
from tallyrack.sources.dimacs import Formula, ParseError, parse, parse_weight

# fixed values: formula texts and their exact counts
CASES = {
    "weighted or": ("c t wmc\np cnf 2 1\nc p weight 1 1/3 0\nc p weight -1 2/3 0\nc p weight 2 3/4 0\nc p weight -2 1/4 0\n1 2 0\n", "5/6", True),
    "free variable": ("c t wmc\np cnf 2 1\nc p weight 1 1/3 0\nc p weight -1 2/3 0\n1 0\n", "2/3", True),
    "no clause": ("c t wmc\np cnf 1 0\n", "2", True),
    "contradiction": ("c t wmc\np cnf 1 2\n1 0\n-1 0\n", "0", False),
    "satisfiable zero": ("c t wmc\np cnf 1 1\nc p weight 1 0 0\nc p weight -1 1 0\n1 0\n", "0", True),
    "empty": ("p cnf 0 0\n", "1", True),
    "components": ("p cnf 4 2\n1 2 0\n3 4 0\n", "9", True),
    "tautologies": ("p cnf 2 2\n1 -1 0\n-2 2 0\n", "4", True),
    "many lines": ("p cnf 3 2\n1 -2\n0 2 3 0\n", "4", True),
    "empty clause": ("p cnf 1 1\n0\n", "0", False),
}


@pytest.mark.parametrize("name", CASES)
def test_fixed_counts(name):
    text, want, sat = CASES[name]
    row = count_text(name, text)
    assert (row["status"], Fraction(int(row["num"]), int(row["den"])), row["satisfiable"]) == ("success", Fraction(want), sat)


@pytest.mark.parametrize("text, status", [
    ("c t wmc\np cnf 1 0\nc p weight 1 1/5 0\nc p weight -1 3/5 0\n", "unsupported_input"), ("p cnf 1 2\n1 0\n", "parse_error"),
    ("c t wmc\np cnf 1 0\nc p show 1 0\n", "unsupported_input"), ("p cnf 1 1\n2 0\n", "parse_error"), ("1 0\n", "parse_error"), ("", "parse_error"),
])
def test_bad_input_is_a_status(text, status):
    row = count_text("x", text)
    assert row["status"] == status and row["num"] is None


def test_node_limit():
    row = count_text("x", "p cnf 3 4\n1 2 3 0\n-1 -2 0\n-1 -3 0\n-2 -3 0\n", node_limit=1)
    assert row["status"] == "resource_limit" and row["num"] is None


def test_weight_tokens():
    assert [parse_weight(t) for t in ("0.1", "1/3", "3e-5", "1.23e+4")] == [Fraction(1, 10), Fraction(1, 3), Fraction(3, 100000), Fraction(12300)]
    for bad in ("1/0", "NaN", "1.2.3", "", "1e9999"):
        with pytest.raises(ParseError):
            parse_weight(bad)


def test_random_formulas_equal_enumeration():
    rng = random.Random(5)
    for _ in range(120):
        n = rng.randint(1, 6)
        f = Formula(n, [tuple(sorted({rng.choice((-1, 1)) * rng.randint(1, n) for _ in range(rng.randint(1, 3))}, key=abs)) for _ in range(rng.randint(0, 7))], {v: (Fraction(rng.randint(0, 5), 5),) * 2 for v in range(1, n, 2)})
        f.weights = {v: (a, 1 - a) for v, (a, _) in f.weights.items()}
        want, sat = Fraction(0), False
        for world in itertools.product((False, True), repeat=n):
            if all(any(world[abs(x) - 1] == (x > 0) for x in c) for c in f.clauses):
                sat, m = True, Fraction(1)
                for v in range(1, n + 1):
                    m *= f.weight(v if world[v - 1] else -v)
                want += m
        for options in ({}, {"propagate": False}, {"components": False}, {"by_occurrence": False}):
            assert Solver(**options).solve(f) == (want, sat)


def test_spark_batch(spark):
    rows = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "formula_id string, text string")
    got = {r["formula_id"]: Fraction(int(r["num"]), int(r["den"])) for r in exact_counts(rows).collect()}
    assert got == {k: Fraction(v[1]) for k, v in CASES.items()}


def test_parse_keeps_order():
    assert parse("p cnf 3 1\n-2 3 1 -2 0\n").clauses == [(1, -2, 3)]


def test_variants_share_one_parse_and_equal_single_runs(monkeypatch):
    read, whole = [], wmc.parse
    monkeypatch.setattr(wmc, "parse", lambda t: read.append(t) or whole(t))
    variants = [{}, {"propagate": False}, {"components": False}, {"by_occurrence": False}, {"node_limit": 1}]
    for name, text in [*((k, v[0]) for k, v in CASES.items()), ("empty clause", "p cnf 2 2\n1 2 0\n0\n"), ("bad", "p cnf x\n"), ("null", None)]:
        read.clear()
        got = wmc.count_variants(name, text, variants)
        assert len(read) == 1
        assert got == [count_text(name, text, **v) for v in variants]


def test_whole_weights_are_counted_in_integers():
    """Only weights that are no integers cost fractions."""
    solver = Solver()
    assert solver.solve(parse("p cnf 3 2\n1 2 0\n-1 3 0\n")) == (Fraction(4), True)
    assert solver.weights and all(type(w) is int for w in solver.weights.values())
    f = parse("c t wmc\np cnf 2 1\nc p weight 1 0.5 0\nc p weight -1 0.5 0\n1 2 0\n")
    value, sat = Solver().solve(f)
    assert (value, sat) == (Fraction(3, 2), True) and type(value) is Fraction


def test_split_finds_the_same_components():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randint(1, 30)
        clauses = [tuple({rng.choice((-1, 1)) * rng.randint(1, n) for _ in range(rng.randint(1, 3))}) for _ in range(rng.randint(1, 15))]
        groups = []
        for c in clauses:
            own = {abs(x) for x in c}
            for g in [g for g in groups if g & own]:
                groups.remove(g)
                own |= g
            groups.append(own)
        parts = Solver._split(clauses)
        if len(groups) == 1:
            assert len(parts) == 1 and parts[0][0] == clauses
        else:
            assert sorted(map(sorted, groups)) == sorted(sorted(v) for _, v in parts)
            assert all(cs == [c for c in clauses if {abs(x) for x in c} <= v] for cs, v in parts)
