"""Each evidence rule broken alone, and odd rows."""

from decimal import Decimal

import pytest

from tallyrack.operators.evidence import evidence_issues

SCHEMA = "model_id string, ordinal int, evidence_id string, source_id string, observed_at string, reference string, extractor string, partition string, semantics string, dependence string, scope array<string>, likelihood array<struct<num:decimal(38,0),den:decimal(38,0)>>, dependencies array<struct<evidence_id:string,relation:string>>, _own string, factor int"
GOOD = {"model_id": "m", "ordinal": 5, "evidence_id": "e5", "source_id": "s", "observed_at": "2024-02-29T10:00:00Z", "reference": "page 3", "extractor": "v1", "partition": "training", "semantics": "likelihood", "dependence": "independent",
        "scope": ["a", "b"], "likelihood": [(1, 3), (2, 3), (0, 1), (1, 1)], "dependencies": [], "_own": "x", "factor": 1}
FIRST = GOOD | {"ordinal": 1, "evidence_id": "e1"}
LATER = GOOD | {"ordinal": 9, "evidence_id": "e9"}
CASES = [
    ({}, []), ({"evidence_id": "-"}, ["evidence_id"]), ({"source_id": None}, ["source_id"]), ({"observed_at": "2023-02-29T10:00:00Z"}, ["observed_at"]), ({"observed_at": "2024-02-29 10:00:00"}, ["observed_at"]),
    ({"reference": ""}, ["reference"]), ({"reference": "x" * 1025}, ["reference"]), ({"extractor": "a\tb"}, ["extractor"]), ({"extractor": "x" * 129}, ["extractor"]), ({"partition": "final_test"}, ["partition"]), ({"partition": None}, ["partition"]),
    ({"semantics": "soft"}, ["semantics"]), ({"dependence": "some"}, ["dependence"]), ({"scope": ["a"]}, ["table_size"]), ({"scope": ["a", "a"]}, ["scope"]), ({"scope": ["a", "z"]}, ["scope"]), ({"scope": ["a", None]}, ["scope"]),
    ({"scope": [], "likelihood": [(1, 2)]}, []), ({"scope": None, "likelihood": None}, ["table_size"]), ({"likelihood": [(1, 3), (-2, 3), (0, 1), (1, 1)]}, ["likelihood"]), ({"likelihood": [(1, 0), (2, 3), (0, 1), None]}, ["likelihood"]),
    ({"likelihood": [(2**120, 1), (1, 1), (0, 1), (1, 1)]}, ["bits"]), ({"likelihood": [(2**120 - 1, 1), (1, 1), (0, 1), (1, 1)]}, []), ({"semantics": "hard_constraint"}, ["hard_values"]), ({"semantics": "hard_constraint", "likelihood": [(1, 1), (0, 1), (0, 1), (1, 1)]}, []),
    ({"evidence_id": "e1"}, ["evidence_id_repeated"]), ({"dependencies": [("e1", "unknown")]}, ["links"]), ({"dependence": "unknown"}, []), ({"dependence": "unknown", "dependencies": [("e1", "unknown")]}, []), ({"dependence": "unknown", "dependencies": [("e1", "correlated")]}, ["links"]),
    ({"dependence": "unknown", "dependencies": [("e1", "unknown"), ("e1", "unknown")]}, ["dependency_id"]), ({"dependence": "unknown", "dependencies": [("e9", "unknown")]}, ["parent"]), ({"dependence": "unknown", "dependencies": [("e5", "unknown")]}, ["parent"]),
    ({"dependence": "unknown", "dependencies": [(None, "unknown")]}, ["dependency_id", "parent"]), ({"dependence": "unknown", "dependencies": [("e1", "odd")]}, ["links", "relation"]),
    ({"dependence": "correlated"}, ["links"]), ({"dependence": "correlated", "dependencies": [("e1", "correlated")]}, []), ({"dependence": "exact_duplicate"}, ["links"]), ({"dependence": "exact_duplicate", "dependencies": [("e1", "exact_duplicate")]}, []),
    ({"dependence": "exact_duplicate", "dependencies": [("e1", "exact_duplicate")], "likelihood": [(1, 2)] * 4}, ["duplicate_factor"]), ({"dependence": "model_factor"}, ["links"]), ({"dependence": "model_factor", "semantics": "hard_constraint", "likelihood": [(1, 1)] * 4}, []),
    ({"model_id": "none"}, ["model", "scope"]), ({"model_id": None}, ["model"]), ({"ordinal": None}, ["ordinal"]), ({"model_id": "two"}, ["model", "scope"]),
]


@pytest.fixture(scope="module")
def judged(spark):
    """Every case in a model of its own, but for those about the model."""
    rows, models, facts = [], [("two", "training"), ("two", "final_test")], []
    for i, (change, _) in enumerate(CASES):
        for row in (FIRST, GOOD | change, LATER):
            row = dict(row)
            if "model_id" not in change:
                row["model_id"] = f"m{i}"
            elif row is FIRST or row["ordinal"] in (1, 9):
                continue
            row["source_id"] = row["source_id"] if "source_id" in change and row["ordinal"] == 5 else f"s{i}"
            row["likelihood"] = None if row["likelihood"] is None else [None if x is None else tuple(map(Decimal, x)) for x in row["likelihood"]]
            rows.append(tuple(row.values()))
        models.append((f"m{i}", "training"))
        facts += [(f"m{i}", "a"), (f"m{i}", "b"), (f"m{i}", "b")]
    return evidence_issues(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(models, "model_id string, partition string"), spark.createDataFrame(facts, "model_id string, fact_id string")).collect()


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rule(judged, i):
    change, want = CASES[i]
    mine = [r for r in judged if (r["model_id"] == change["model_id"] if "model_id" in change else r["model_id"] == f"m{i}" and r["ordinal"] not in (1, 9))]
    assert [(r["issues"], r["ok"]) for r in mine] == [(want, not want)]


def test_the_rest_is_sound(judged):
    assert all(r["ok"] for r in judged if r["ordinal"] in (1, 9))


def test_empty(spark):
    rows = spark.createDataFrame([], SCHEMA)
    assert evidence_issues(rows, rows.select("model_id", "partition"), rows.selectExpr("model_id", "evidence_id AS fact_id")).count() == 0
