"""Ranking by distinct questions: the same rows as query by query, without queries times candidates."""

from tallyrack.operators import count_index


def shuffled(spark):
    """Rows that the stages so far have written to shuffles."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    lists = spark._jvm.java.util.ArrayList
    stages = sc.statusStore().stageList(lists(), False, False, gateway.new_array(spark._jvm.double, 0), lists())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_equal_questions_meet_their_candidates_once(spark):
    answers = [(f"s{i % 3}", "r" if i % 4 else "q", f"a{i % 50:02}", f"A{i}", i % 7 + 1) for i in range(600)]
    rows = {}
    for s, r, a, surface, n in answers:
        rows[s, r, a] = max(rows.get((s, r, a), (0, "")), (n, surface))
    index = spark.createDataFrame([(*key, *v) for key, v in rows.items()], "subject_key string, relation_key string, answer_key string, count long, answer_surface string")
    asked = [(i, [f"s{i % 3}", f"s{(i + i % 2) % 3}"], "r") for i in range(300)] + [(0, ["s1", None], "q"), (1, [], "r"), (900, ["none"], "r"), (901, ["s1"], None), (902, ["s2", "s2"], "q")]
    queries = spark.createDataFrame(asked, "query_id long, subject_keys array<string>, relation_key string")
    before = shuffled(spark)
    got = {(r["query_id"], r["rank"]): (r["answer_key"], r["count"], r["answer_surface"], r["total"]) for r in count_index.ranked(index, queries, 3).collect()}
    assert shuffled(spark) - before < 5000  # 300 queries of some 40 candidates are 12,000
    pairs = {}
    for q, subjects, relation in asked:
        pairs.setdefault(q, set()).update((s, relation) for s in subjects if s and relation)
    want = {}
    for q, keys in pairs.items():
        best = {}
        for (s, r, a), v in rows.items():
            if (s, r) in keys:
                best[a] = max(best.get(a, (0, "")), v)
        for rank, (a, (n, surface)) in enumerate(sorted(best.items(), key=lambda x: (-x[1][0], x[0]))[:3], 1):
            want[q, rank] = (a, n, surface, sum(v[0] for v in best.values()))
    assert got == want
