"""The jobs: against their SQL, over growing input, after failures, and from the command line."""

import json
import re
import subprocess
import sys

import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F

from jobs import split_audit, word_index
from jobs.common import settings
from jobs.queries import QUERIES, SQL
from tallyrack.operators import count_index


@pytest.mark.parametrize("name", sorted(SQL))
def test_job_equals_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df())


@pytest.fixture
def growing(spark, tmp_path):
    """A folder that takes the documents in three steps; repeated rows and odd texts are in the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", F.lit(1).alias("part"), F.lit(2).alias("count"))
    odd = spark.createDataFrame([(1, None, "en"), (None, "one", None), (None, "A b a B a b", None), (7, "", "fr"), (7, " x\ty ", "fr"), (7, " x\ty ", "fr")], "doc_id long, text string, lang string").select("*", F.lit(1).alias("part"), F.lit(2).alias("count"))
    steps = [docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 = 1"), docs.where("doc_id % 3 = 2").unionByName(odd)]
    folder = str(tmp_path / "in")
    return folder, [lambda s=s: s.coalesce(1).write.mode("append").parquet(folder) for s in steps]


def index_of(spark, output):
    return word_index.index(spark, output).drop("upto").toPandas()


def test_word_index_takes_only_what_is_new(spark, growing, tmp_path):
    folder, steps = growing
    output, once = str(tmp_path / "out"), str(tmp_path / "once")
    for k, step in enumerate(steps):
        step()
        assert word_index.run(spark, folder, output)["batches"] == 1
        assert word_index.run(spark, folder, output) == {"batches": 0, "parts": []}
        assert spark.read.parquet(f"{output}/counts").select("batch").distinct().count() == k + 1
    assert word_index.run(spark, folder, once, settings("word_index") | {"files_per_batch": 2})["batches"] == 2
    same_rows(index_of(spark, output), index_of(spark, once))
    got = {(r["subject_key"], r["answer_key"]): (r["answer_surface"], r["count"]) for r in word_index.index(spark, output).where("relation_key = 'und'").collect()}
    assert got == {("a", "b"): ("b", 1), ("b", "a"): ("a", 1)}
    assert word_index.index(spark, output).where("relation_key = 'fr' AND subject_key = 'x' AND answer_key = 'y'").first()["count"] == 2


def test_word_index_survives_failures(spark, growing, tmp_path, monkeypatch):
    folder, steps = growing
    output, once = str(tmp_path / "out"), str(tmp_path / "once")
    steps[0]()
    word_index.take_new(spark, folder, output, settings("word_index"))  # stopped before the index
    assert len(word_index.run(spark, folder, output)["parts"]) == 16
    steps[1]()
    real = count_index.build
    monkeypatch.setattr(count_index, "build", lambda rows: real(rows).where(F.raise_error(F.lit("lost")).isNull()))  # stopped within a batch
    with pytest.raises(Exception, match="lost"):
        word_index.run(spark, folder, output)
    monkeypatch.undo()
    assert word_index.run(spark, folder, output)["batches"] == 1
    word_index.run(spark, folder, once)
    same_rows(index_of(spark, output), index_of(spark, once))


def test_jobs_on_no_rows(spark, tmp_path):
    empty = str(tmp_path / "in")
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(empty)
    assert word_index.run(spark, empty, str(tmp_path / "a"))["parts"] == [] and index_of(spark, str(tmp_path / "a")).empty
    assert split_audit.run(spark, empty, str(tmp_path / "b")) == {"public": 0, "held": 0, "excluded": 0, "clean": 0}
    assert split_audit.read(spark, str(tmp_path / "b")).count() == 0


def test_split_audit_reruns_and_grows(spark, growing, tmp_path):
    folder, steps = growing
    output = str(tmp_path / "out")
    steps[0]()
    first = split_audit.run(spark, folder, output)
    before = split_audit.read(spark, output).toPandas()
    assert split_audit.run(spark, folder, output) == first
    same_rows(split_audit.read(spark, output).toPandas(), before)
    steps[2]()
    assert split_audit.run(spark, folder, output)["held"] > first["held"]
    rows = split_audit.read(spark, output)
    assert rows.where("verdict = 'excluded'").count() == rows.where("n_identical + n_canonical + n_tags + n_near > 0").count()
    assert {r["verdict"]: r["rows"] for r in spark.read.parquet(f"{output}/summary").collect()} == {r["verdict"]: r["count"] for r in rows.groupBy("verdict").count().collect()}
    assert sorted(p.name for p in (tmp_path / "out" / "audit").glob("verdict=*")) == ["verdict=clean", "verdict=excluded"]


def test_command_line(spark, growing, tmp_path):
    folder, steps = growing
    steps[0]()
    (tmp_path / "my.json").write_text(json.dumps({"percent": 80}))
    done = subprocess.run([sys.executable, "-m", "jobs.split_audit", folder, str(tmp_path / "cli"), "--config", str(tmp_path / "my.json")], capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0 and "held-out rows of" in done.stderr
    assert spark.read.parquet(str(tmp_path / "cli" / "audit")).count() > 0


def test_pairs_of_one_file_are_made_by_many_tasks_and_once_a_record(spark, tmp_path):
    one = str(tmp_path / "in")
    spark.createDataFrame([(i, "A b a B a b", "en") for i in range(200)], "doc_id long, text string, lang string").coalesce(1).write.parquet(one)
    found = word_index.records(spark.read.parquet(one), settings("word_index"))
    assert found.select(F.spark_partition_id()).distinct().count() > 1
    rows = found.groupBy("ord.id", "subject_key").agg(F.count("*").alias("n"), F.first("ord.place").alias("place"), F.first("answer_surface").alias("surface")).collect()
    assert len(rows) == 400 and {(r["subject_key"], r["n"], r["place"], r["surface"]) for r in rows} == {("a", 1, 1, "b"), ("b", 1, 2, "a")}


def test_what_one_batch_alone_has_counted_moves_once(spark, growing, tmp_path, monkeypatch):
    """Its counts are ranked in the batch's own shuffle, in few packed rows; only a second batch has them summed."""
    folder, steps = growing
    output, merged, real = str(tmp_path / "out"), [], count_index.merge
    monkeypatch.setattr(count_index, "merge", lambda *given: merged.append(given) or real(*given))
    steps[0]()
    assert len(word_index.run(spark, folder, output)["parts"]) == 16 and not merged
    steps[2]()
    assert len(word_index.run(spark, folder, output)["parts"]) == 16 and len(merged) == 1
    packed = word_index._pairs(spark.read.parquet(folder), settings("word_index"))
    assert packed.count() < word_index._unpacked(packed).count()


def test_packed_pairs_keep_odd_ids_words_and_surfaces(spark):
    texts = [(-5, "The cat\tthe CAT\x00 É é", "en"), (None, " The\x0bcat the Cat ", "en"), (2**63 - 1, "tHe cAt", "en"), (7, "b A", "en"), (7, "x b a", "en"), (7, "B a b A", None), (1, "one", "en"), (1, None, "en"), (1, "", "en"), (-(2**63), "B a ß\x0c\x85x", "en")]
    want = {}
    for number, text, lang in texts:
        words, seen = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w], set()
        keys = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
        for place in range(1, len(words)):
            key = (keys[place - 1], lang or "und", keys[place])
            if key not in seen:
                seen.add(key)
                want.setdefault(key, []).append(((number is not None, number or 0, place), words[place]))
    found = count_index.build(word_index._unpacked(word_index._pairs(spark.createDataFrame(texts, "doc_id long, text string, lang string").coalesce(1), settings("word_index"))))
    got = {(r["subject_key"], r["relation_key"], r["answer_key"]): (r["ord"]["id"], r["ord"]["place"], r["answer_surface"], r["count"]) for r in found.collect()}
    plain = {k: ((None if not (least := min(v))[0][0] else least[0][1]), least[0][2], least[1], len(v)) for k, v in want.items()}
    assert got == plain and plain["the", "en", "cat"] == (None, 1, "cat", 3)
