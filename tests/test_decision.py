"""Decisions: unequal denominators, ties, cost and coverage rules."""

from tallyrack.operators.decision import certificate_status, decide, expected_risks, resource_cost
from tallyrack.operators.records import validate_ledger


def _run(spark, actions, losses, abstain=(9, 1)):
    state = spark.createDataFrame([("r", "a", 1), ("r", "b", 2)], "request_id string, state_id string, weight long")
    action = spark.createDataFrame([("r", *a) for a in actions], "request_id string, action_id string, priority int, cost_num long, cost_den long")
    loss = spark.createDataFrame([("r", *x) for x in losses], "request_id string, action_id string, state_id string, loss long")
    risks = expected_risks(state, action, loss, 1, 1)
    return {r["action_id"]: r["status"] for r in risks.collect()}, decide(risks, *abstain).first()


def test_unequal_denominators(spark):
    losses = [(x, s, 0) for x in "xyz" for s in "ab"]
    _, got = _run(spark, [("x", 1, 1, 3), ("y", 1, 2, 7), ("z", 1, 3, 10)], losses)
    assert got["action_id"] == "y"  # 2/7 is below 3/10 and 1/3


def test_ties_cost_and_coverage(spark):
    losses = [("x", "a", 1), ("x", "b", 1), ("y", "a", 1), ("y", "b", 1), ("w", "a", 0), ("w", "b", 0), ("v", "a", 0)]
    status, got = _run(spark, [("x", 2, 0, 1), ("y", 1, 0, 5), ("w", 0, 2, 1), ("v", 0, 0, 1)], losses)
    assert status == {"x": "admissible", "y": "admissible", "w": "too_costly", "v": "invalid_schema"} and got["action_id"] == "y"
    assert _run(spark, [("x", 2, 0, 1)], losses, (1, 1))[1]["decision"] == "abstain"


def test_certificate_gate_is_shut_on_nulls(spark):
    good = {"requires_certificate": True, "certificate_id": "c", "digest": "a" * 64, "valid_from": 1, "valid_to": 9, "subject": "x", "action_id": "x", "verified": True}
    names = list(good)
    rows = [good] + [good | {n: None} for n in names] + [good | {"requires_certificate": False, "verified": None}, good | {"valid_from": 6, "valid_to": 4}]
    df = spark.createDataFrame([(i, *[r[n] for n in names]) for i, r in enumerate(rows)], "i int, requires_certificate boolean, certificate_id string, digest string, valid_from long, valid_to long, subject string, action_id string, verified boolean")
    got = [r["certificate_status"] for r in certificate_status(df, 5).orderBy("i").collect()]
    assert got == ["accepted", "accepted", "missing", "invalid", "invalid", "invalid", "mismatch", "mismatch", "rejected", "not_required", "invalid"]


def test_ledger_has_one_status_a_row(spark):
    rows = [(1, 0, "e0", "independent", None, True), (1, 1, "e0", "independent", None, True), (1, 2, "e1", "exact_duplicate", "e0", True), (1, 3, "e2", "exact_duplicate", "e0", None), (1, 4, "e3", "independent", "e9", True), (1, 5, None, "independent", None, True), (1, 6, "e4", None, None, True)]
    df = spark.createDataFrame(rows, "model_id int, ordinal int, evidence_id string, dependence string, parent_id string, factor_key boolean")
    got = [(r["ordinal"], r["status"]) for r in validate_ledger(df).orderBy("ordinal").collect()]
    assert got == [(0, "success"), (1, "duplicate_id"), (2, "success"), (3, "invalid_schema"), (4, "invalid_schema"), (5, "invalid_schema"), (6, "unsupported_input")]


def test_resource_cost_is_reduced(spark):
    df = spark.createDataFrame([(300_000, 0), (0, 1 << 30), (0, 0), (600_000, 4 << 30), (7, 3)], "cpu_ms long, peak_bytes long")
    assert [(r["cost_num"], r["cost_den"]) for r in resource_cost(df).collect()] == [(1, 2), (1, 4), (0, 1), (1, 1), (7, 600_000)]
