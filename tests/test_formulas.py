"""Statuses of formulas that are odd or large, near duplicates of formulas and rows, and the limit of clause tables."""

import pytest

from tallyrack.operators import audit, run, wmc
from tallyrack.sources import archive, dimacs


@pytest.mark.parametrize(("text", "status"), [
    (None, "parse_error"), ("", "parse_error"), ("c t wmc extra\np cnf 1 0\n", "parse_error"), ("c t\np cnf 1 0\n", "parse_error"), ("c t pwmc\np cnf 1 0\n", "unsupported_input"), ("c p\np cnf 1 0\n", "parse_error"), ("c p show 1 0\np cnf 1 0\n", "unsupported_input"),
    ("p cnf 1000001 0\n", "resource_limit"), ("p cnf 1 10000001\n", "resource_limit"), ("c t wmc\np cnf 1 1\n1 0\n", "success")])
def test_statuses(spark, text, status):
    assert wmc.count_text("f", text)["status"] == status
    stats = archive.audit_formulas(spark.createDataFrame([("f", text)], "formula_id string, text string")).first()
    assert stats["status"] == status


def test_parser_limits():
    for limits in ({"most_literals": 2}, {"most_bytes": 10}, {"most_line": 5}):
        with pytest.raises(dimacs.TooLarge):
            dimacs.parse("p cnf 3 1\n1 2 3 0\n", **limits)


def test_exact_counts_survive_a_null(spark):
    got = {r["formula_id"]: r["status"] for r in wmc.exact_counts(spark.createDataFrame([("a", None), ("b", "p cnf 1 0\n")], "formula_id string, text string")).collect()}
    assert got == {"a": "parse_error", "b": "success"}


def test_near_formulas(spark):
    clauses = [f"{i} {i + 1} 0" for i in range(1, 41)]
    texts = [(name, f"p cnf {v} {len(c)}\n" + "\n".join(c)) for name, v, c in (("a", 50, clauses), ("b", 50, clauses[:-1]), ("copy", 50, list(reversed(clauses))), ("other size", 51, clauses), ("far", 50, clauses[:20]))]
    stats = archive.audit_formulas(spark.createDataFrame([*texts, ("bad", "p")], "formula_id string, text string"))
    got = [tuple(r) for r in audit.near_formulas(stats).collect()]
    assert got == [(50, "a", "b", 2, 1, 39, 39 / 40)]


def test_near_duplicates_of_rows_with_repeated_ids(spark):
    rows = [(1, ["a", "b", "c"]), (2, ["a", "b", "d"])]
    for more, n in (([], 1), ([rows[0]], 2), ([(None, ["c", "b", "a", None, "a"])], 2)):
        got = audit.near_duplicates(spark.createDataFrame(rows + more, "id long, elements array<string>"), 50).drop("kind").collect()
        assert [tuple(r) for r in got] == [(1, 2, n, 1, 2, 0.5)]


def test_clause_tables_are_bounded(spark):
    literals = spark.createDataFrame([(1, 1, i) for i in range(1, 41)] + [(1, 2, 1), (1, 2, -2)], "formula_id int, clause_id int, lit int")
    got = {r["clause_id"]: r["table"] for r in run.clause_factors(literals).collect()}
    assert got == {1: None, 2: [1, 1, 0, 1]}
