"""Canonical JSON, archives, JSON lines and the audit of formulas."""

import io
import lzma
import tarfile
from fractions import Fraction

import pytest

from tallyrack.functions import canonical as C
from tallyrack.sources import archive


def test_canonical_round_trip():
    value = {"b": [1, -2, None, True, "é\n\"\\\u0001"], "a": {"z": 0, "é": 18446744073709551615}}
    text = C.encode(value)
    assert text.startswith('{"a":') and C.decode(text) == value and C.encode(C.decode(text)) == text
    for bad in ('{"b":1,"a":2}', "1.5", "1e3", '{"a":1,"a":1}', "[1, 2]", "NaN", "", "01", "18446744073709551616", "[" * 70 + "]" * 70):
        with pytest.raises(C.NotCanonical):
            C.decode(bad)


def test_rational_json():
    assert C.rational_from_json(C.rational_to_json(Fraction(-6, 4))) == Fraction(-3, 2)
    for bad in ({"$rational": ["2", "4"]}, {"$rational": ["1", "0"]}, {"$rational": ["+1", "2"]}, {"$rational": ["1"]}, 3):
        with pytest.raises(C.NotCanonical):
            C.rational_from_json(bad)


def test_archive_and_audit(spark, tmp_path):
    texts = {"a.cnf": "c r from  lab\np cnf 3 2\n1 -2 0\n2 3 0\n", "b.cnf.xz": "p cnf 3 2\n3 2 0\n-2 1 0\n", "bad.cnf": "p cnf 1 2\n1 0\n"}
    with tarfile.open(tmp_path / "x.tar", "w") as tar:
        for name, text in texts.items():
            data = lzma.compress(text.encode()) if name.endswith(".xz") else text.encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    members = archive.archive_members(spark, str(tmp_path / "x.tar"))
    assert {r["member"]: r["text"] for r in members.collect()} == texts
    stats = archive.audit_formulas(members.selectExpr("member AS formula_id", "text"))
    rows = {r["formula_id"]: r for r in stats.collect()}
    assert rows["bad.cnf"]["status"] == "parse_error" and rows["a.cnf"]["sources"] == ["from lab"]
    assert rows["a.cnf"]["canonical"] == rows["b.cnf.xz"]["canonical"] and rows["a.cnf"]["literals"] == 4
    total = archive.audit_rollup(stats).first()
    assert (total["formulas"], total["parsed"], total["distinct_canonical"]) == (3, 2, 1)
    small = archive.archive_members(spark, str(tmp_path / "x.tar"), most_bytes=20)
    assert "resource_limit" in {r["status"] for r in small.collect()}


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1}\n\n{"id": \n{"id": 2}\n')
    got = archive.json_lines(spark, str(tmp_path / "x.jsonl"), "id long")
    assert sorted(r["status"] for r in got.collect()) == ["blank_line", "parse_error", "success", "success"]
    assert sorted(r["record"]["id"] for r in got.where("status = 'success'").collect()) == [1, 2]
    row = archive.manifest(got).first()
    assert (row["rows"], row["good"]) == (4, 2)
