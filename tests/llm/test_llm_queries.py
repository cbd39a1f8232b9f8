"""Training-data queries: SQL where there is some, plain versions elsewhere, all on whole tables."""

import collections
import glob
import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from conftest import SF, same_rows

from tallyrack.llm.queries import QUERIES, SQL

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df())


def test_op3_counts_and_quality(spark, docs):
    got = QUERIES["op3_hidden_markov"](spark, SF).toPandas().set_index("doc_id")
    tokens = {i: [*WORDS.findall(t.translate({c: c + 32 for c in range(65, 91)})), ""] for i, t in zip(docs.doc_id, docs.text, strict=True)}
    count = collections.Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(count.values()), len(count)
    for i, t in tokens.items():
        row = got.loc[i]
        assert (row.n_tokens, row.n_known, row.train_tokens, row.held_out) == (len(t), sum(w in count for w in t), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert math.isclose(row.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    assert (got.score < 0).all() and got[~got.held_out].score.sum() > got[~got.held_out].base_score.sum()


def test_op4_statistics(spark, docs):
    got = QUERIES["op4_quality_rules"](spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        w = WORDS.findall(t)
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        row = got.loc[i]
        assert tuple(row[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == want
        assert row.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (row.base_failed and row.kept)


def test_op4_kept_equals_plain(spark, docs):
    """The verdict, by walking the learned list in plain code over plain statistics."""
    import regex

    from tallyrack.llm import quality_rules as Q

    rules = Q.learn(Q.statistics(spark.read.parquet(f"{SF}/documents.parquet")), spark.read.parquet(f"{SF}/labels.parquet")).rules
    got = QUERIES["op4_quality_rules"](spark, SF).toPandas().set_index("doc_id")
    assert rules
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        w, row = WORDS.findall(t), got.loc[i]
        n, chars = max(1, len(w)), max(1, sum(map(len, w)))
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        value = {
            "f_words": len(w), "f_word_length": sum(map(len, w)) / n, "f_symbols": row.n_symbols / chars, "f_upper": len(regex.findall(r"\p{Lu}", t)) / chars,
            "f_marks": len(regex.findall(r"[^\p{L}\p{N}\s]", t)) / chars, "f_digits": len(regex.findall(r"\p{N}", t)) / chars, "f_dup_lines": row.n_dup_lines / max(1, len(lines)),
            "f_repeats": row.n_repeat_words / n, "f_distinct": len(set(w)) / n,
        }
        assert not set(value) ^ set(Q.FEATURES)
        rejected = any(all((value[c.feature] > c.at) == c.above for c in rule) for rule in rules)
        assert row.kept == (not row.base_failed and not rejected)


def test_op5_held_out_accuracy(spark, docs):
    got = QUERIES["op5_byte_gru"](spark, SF).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    held = got[got.held_out & (got.text.str.len() > 80)]
    assert (held.lang == held.lang_pred).mean() >= 0.9


def test_op6_equals_library(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = QUERIES["op6_wavelet_shards"](spark, SF).toPandas().sort_values("doc_id")
    for row, t in zip(got.itertuples(), docs.text, strict=True):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op8_equals_plain(spark, docs):
    got = QUERIES["op8_suffix_dedup"](spark, SF).toPandas().sort_values("doc_id")
    data = [t.encode() for t in docs.text]
    seen = collections.Counter(d[k : k + 200] for d in data for k in range(len(d) - 199))
    for row, d in zip(got.itertuples(), data, strict=True):
        gone = np.zeros(len(d), dtype=bool)
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
        kept = hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()
        assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == (len(d), int(gone.sum()), spans, kept)


def test_op9_equals_library(spark, docs):
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = QUERIES["op9_piece_codec"](spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids = lib.encode(t, add_bos=True, add_eos=True)
        row = got.loc[i]
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())


def test_pipeline_stages_keep_and_drop(spark, docs):
    """Every stage against a plain version on its own input."""
    import corpus_pipeline as C

    now = spark.read.parquet(f"{SF}/documents.parquet")
    names = now.columns
    for k, (name, stage) in enumerate(C.STAGES):
        after = stage(spark, now, SF).toPandas()
        before = now.toPandas()
        if k < 4:
            assert sorted(after.columns) == sorted(names)
        if k == 0:
            assert set(after.doc_id) <= set(before.doc_id) and all(len(WORDS.findall(t)) >= 10 for t in after.text)
        if k == 1:
            sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in ((i, WORDS.findall(t.lower())) for i, t in zip(before.doc_id, before.text, strict=True))}
            lead = {i: i for i in sets}
            ids = sorted(sets)
            for x, a in enumerate(ids):
                for b in ids[x + 1 :]:
                    both = len(sets[a] & sets[b])
                    if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                        la, lb = lead[a], lead[b]
                        lead = {i: min(la, lb) if v in (la, lb) else v for i, v in lead.items()}
            assert set(after.doc_id) == {i for i, v in lead.items() if i == v}
        if k == 2:
            assert list(sorted(after.doc_id)) == list(sorted(before.doc_id)) and (after.n_chars == after.text.str.len()).all()
        if k == 3:
            assert set(after.doc_id) <= set(before.doc_id)
        if k == 4:
            assert set(after.doc_id) == set(before.doc_id)
            text = dict(zip(before.doc_id, before.text, strict=True))
            assert all(text[i] == d for i, d in zip(after.doc_id, after.decoded, strict=True))
        now = spark.createDataFrame(after[names], now.schema) if k < 4 else now


def test_pipeline_writes_stages_that_equal_plain_ones(spark, docs):
    """Rows and texts of every stage that ``run`` wrote."""
    import duckdb

    import corpus_pipeline as C
    from tallyrack.sources.shared import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    old = set(glob.glob(f"{folder}/pipeline-stage*"))
    last = C.run(spark, SF).toPandas()
    new = sorted(set(glob.glob(f"{folder}/pipeline-stage*")) - old)
    assert len(new) == 5
    stages = [pd.read_parquet(p) for p in new]
    rows = lambda x: dict(zip(x.doc_id, x.text, strict=True))

    verdicts = QUERIES["op4_quality_rules"](spark, SF).toPandas()  # its statistics have a plain version above
    now = {i: t for i, t in rows(docs).items() if i in set(verdicts[verdicts.kept].doc_id)}
    assert rows(stages[0]) == now

    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in ((i, WORDS.findall(t.lower())) for i, t in now.items())}
    lead = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = a < b and len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                la, lb = lead[a], lead[b]
                lead = {i: min(la, lb) if v in (la, lb) else v for i, v in lead.items()}
    now = {i: t for i, t in now.items() if lead[i] == i}
    assert rows(stages[1]) == now

    seen = collections.Counter(d[k : k + 200] for d in map(str.encode, now.values()) for k in range(len(d) - 199))
    for i, t in now.items():
        d = t.encode()
        gone = np.zeros(len(d), dtype=bool)
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                gone[k : k + 200] = True
        now[i] = bytes(np.frombuffer(d, np.uint8)[~gone]).decode("utf-8", "ignore")
    assert rows(stages[2]) == now

    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": list(now), "text": list(now.values())}))
    con.register("benchmark", pd.read_parquet(f"{SF}/benchmark.parquet"))
    bad = {r[0] for r in con.execute(SQL["op1_template_decontam"]).fetchall()}
    now = {i: t for i, t in now.items() if i not in bad}
    assert rows(stages[3]) == now
    assert dict(zip(last.doc_id, last.decoded, strict=True)) == dict(zip(stages[4].doc_id, stages[4].decoded, strict=True)) == now
