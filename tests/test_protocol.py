"""The calibration protocol: every way to be shut out, and the report's parts."""

import dataclasses
import math

import pytest

from tallyrack.operators import calibration
from tallyrack.operators.protocol import Protocol, forecast_issues, protocol_issues, report

GOOD = Protocol("p", "1", "model", "build", "cal-1", "data", "1", "all", bins=4, least_subgroup=2, alpha_percent=50, exchangeable=True, basis="drawn at random")
SCHEMA = "observation_id string, partition string, partition_id string, p double, y boolean, subgroup string, shift boolean"
ROWS = [("a", 0.0, False, "x"), ("b", 0.3, True, "x"), ("c", 0.9, True, None), ("d", 1.0, None, ""), ("e", 0.6, False, "y")]


def _forecasts(spark, rows=ROWS):
    return spark.createDataFrame([(i, "calibration", "cal-1", p, y, g, False) for i, p, y, g in rows], SCHEMA)


def _ids(spark, fitting=("f1",), mine=tuple("abcde"), final=("t1",)):
    return {n: spark.createDataFrame([(x,) for x in v], "observation_id string") for n, v in (("fitting", fitting), ("calibration", mine), ("final_test", final))}


@pytest.mark.parametrize("change, issue", [
    ({"protocol_id": ""}, "metadata"), ({"model_id": "not valid"}, "metadata"), ({"selection_policy": None}, "metadata"), ({"evidence_kind": "guess"}, "evidence_kind"), ({"bins": 101}, "bins"), ({"least_subgroup": 0}, "limits"),
    ({"most_label_bytes": 1025}, "limits"), ({"most_observations": 4}, "too_many_observations"), ({"alpha_percent": 100}, "alpha"), ({"basis": ""}, "basis"),
])
def test_protocols_refused(spark, change, issue):
    assert [r["issue"] for r in protocol_issues(spark, dataclasses.replace(GOOD, **change), _ids(spark)).collect()] == [issue]


def test_ids_refused(spark):
    assert protocol_issues(spark, GOOD, _ids(spark)).count() == 0
    for bad in ({"fitting": ("a",)}, {"final": ("t1", "t1")}, {"final": ("not valid",)}, {"fitting": (None,)}):
        assert [r["issue"] for r in protocol_issues(spark, GOOD, _ids(spark, **bad)).collect()] == ["ids"]
    assert [r["issue"] for r in protocol_issues(spark, GOOD, _ids(spark, mine=())).collect()] == ["no_observations"]


def test_forecasts_refused(spark):
    base = _forecasts(spark).collect()
    extra = [("a", "calibration", "cal-1", 0.1, None, None, False), ("z", "final_test", "cal-1", float("nan"), None, "g" * 129, False), (None, "calibration", None, None, None, None, None)]
    got = {r["issue"]: r["n"] for r in forecast_issues(GOOD, spark.createDataFrame([*base[:4], *extra], SCHEMA), _ids(spark)["calibration"]).collect()}
    assert got == {"observation_id": 1, "partition": 2, "probability": 2, "subgroup": 1, "repeated": 1, "missing": 1, "unexpected": 2}
    shut = report(GOOD, spark.createDataFrame([*base, extra[1]], SCHEMA), _ids(spark)).collect()
    assert {r["section"] for r in shut} == {"issue"} and {r["item"] for r in shut} == {"partition", "probability", "subgroup", "unexpected"}


def test_report(spark):
    rows = _forecasts(spark)
    got = {(r["section"], r["item"], r["measure"]): r for r in report(GOOD, rows, _ids(spark)).collect()}
    value = lambda *k: got[k]["value"]
    assert math.isclose(value("score", "brier", "mean"), (0 + 0.49 + 0.01 + 0.36) / 4)
    assert [(value("bin", str(b), "n"), value("bin", str(b), "issued")) for b in range(4)] == [(1, 1), (1, 1), (1, 1), (1, 2)]
    assert (value("sharpness", "all", "n"), value("subgroup", "unspecified", "total"), value("subgroup", "y", "below_minimum")) == (5, 2, 1)
    assert value("risk_coverage", "4", "risk") == 0.5
    assert got["conformal", "status", "alpha_percent"]["note"] == "evaluated"
    assert value("conformal", "threshold", "threshold") == calibration.conformal_threshold(rows, 50).first()["threshold"]


def test_conformal_needs_grounds_and_outcomes(spark):
    open_ = report(dataclasses.replace(GOOD, exchangeable=False), _forecasts(spark), _ids(spark)).where("section = 'conformal'").collect()
    assert [r["note"] for r in open_] == ["unsupported_assumption"]
    none = report(GOOD, _forecasts(spark, [(i, p, None, g) for i, p, _, g in ROWS]), _ids(spark)).where("section IN ('conformal', 'score')").collect()
    assert [r["note"] for r in none] == ["no_outcomes"]
