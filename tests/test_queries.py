"""Every registered core query against its SQL, and the entry points."""

import pytest
from conftest import SF, same_rows

from tallyrack.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df())


def test_canonical_json_equals_plain(spark):
    """Of the queries without SQL, this one; the others have their own tests below."""
    import json

    assert set(QUERIES) - set(SQL) == {"canonical_json", "normalize_surfaces", "search_budget"}
    got = {r["event_id"]: r["status"] for r in QUERIES["canonical_json"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id", "props").collect():
        try:
            value = json.loads(r["props"] or "")
            floats = lambda v: isinstance(v, float) or any(map(floats, v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()))  # noqa: B023, E731
            same = not floats(value) and json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")) == r["props"]
        except ValueError:
            same = False
        assert got[r["event_id"]] == ("success" if same else "parse_error")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_surfaces_and_identifiers_use_the_whole_text(spark, tmp_path):
    import unicodedata

    texts = [None, "", "  Ａ\tﬁne  STRAẞE \n", "Wort ß ﬀ " * 90, "a" * 40, "a" * 128, "a" * 129, "b" * 40 + " c", "x.y:z-1_"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' AS source")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["surface"] for r in QUERIES["normalize_surfaces"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()) for i, t in enumerate(texts)}
    okay = {r["doc_id"] for r in QUERIES["scalar_checks"](spark, str(tmp_path)).where("text_ok").collect()}
    assert okay == {4, 5, 8}


def test_search_budget_equals_the_full_grid(spark):
    from tallyrack.operators.wmc import exact_counts
    from tallyrack.plans.queries import _formula_texts

    texts = _formula_texts(spark, SF).cache()
    n = texts.count()
    got = {r["node_limit"]: r for r in QUERIES["search_budget"](spark, SF).collect()}
    most = -1
    for limit in sorted(got):
        done = [r["nodes"] for r in exact_counts(texts, node_limit=limit).where("status = 'success'").collect()]
        assert (got[limit]["completed"], got[limit]["nodes"] or 0) == (len(done), sum(done))
        if len(done) > most:
            best, most = limit, len(done)
    assert [x for x in got if got[x]["chosen"]] == [best] and sum(r["tried"] for r in got.values()) < n * len(got)
    texts.unpersist()
