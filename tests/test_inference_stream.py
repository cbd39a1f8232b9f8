"""Finite reasoning, belief marginals, calibration corner cases, and streams against batch forms."""

import math

from pyspark.sql import functions as F

from tallyrack.functions import scalars as S
from tallyrack.operators import calibration, finite, learning, monitor
from tallyrack.streaming import learner
from tallyrack.streaming.rocks import state_on_disk
from tallyrack.streaming.stateful import monitor_stream


def _domain(spark, name, values):
    return spark.createDataFrame(list(values.items()), f"{name} string, w_{name} long")


def test_conditional_mass(spark):
    x, y = _domain(spark, "x", {"A": 1, "B": 2}), _domain(spark, "y", {"no": 1, "yes": 1})
    allowed = spark.createDataFrame([("A", "no"), ("A", "yes"), ("B", "yes")], "x string, y string")
    row = finite.conditional_mass({"x": x, "y": y}, [allowed], F.col("x") == "A", F.col("y") == "yes").first()
    assert (int(row["numerator"]), int(row["denominator"]), row["status"]) == (1, 2, "success")
    none = finite.conditional_mass({"x": x}, [allowed.where("false").select("x")]).first()
    assert (none["status"], none["satisfiable"]) == ("inconsistent", False)
    zero = finite.conditional_mass({"x": _domain(spark, "x", {"0": 0, "1": 0})}, []).first()
    assert (zero["status"], zero["satisfiable"]) == ("zero_normalizer", True)
    apart = finite.conditional_mass({"x": x}, [], F.col("x") == "A", F.col("x") == "B").first()
    assert (int(apart["numerator"]), apart["status"]) == (0, "success")


def test_belief_clause(spark):
    rows = {r["fact"]: (int(r["mass_true"]), int(r["mass"])) for r in finite.belief_marginals(spark, [(4, 1), (3, 7)], [([0, 1], [0, 1, 1, 1])]).collect()}
    assert rows[0] == (10, 38)  # 5/19, out of 50


def test_infinite_log_score(spark):
    rows = spark.createDataFrame([("a", 0.0, True), ("b", 0.5, True), ("c", 0.5, None)], "observation_id string, p double, y boolean").withColumn("subgroup", F.lit("")).withColumn("shift", F.lit(False))
    log = calibration.proper_scores(rows).where("score = 'log'").first()
    assert math.isinf(log["mean"]) and log["se"] is None and log["n"] == 2
    assert calibration.subgroups(rows).first()["subgroup"] == "unspecified"
    assert math.isinf(calibration.conformal_threshold(rows, 5).first()["threshold"])
    assert {r["status"] for r in calibration.validate(rows.union(rows.limit(1))).collect()} == {"success", "duplicate"}


def test_scalar_predicates(spark):
    row = spark.range(1).select(
        S.valid_timestamp(F.lit("2024-02-29T23:59:60Z")).alias("a"), S.valid_timestamp(F.lit("2023-02-29T00:00:00Z")).alias("b"), S.valid_digest(F.lit("0" * 64)).alias("c"),
        S.parse_prompt(F.lit("x [SEP] y")).alias("d"), S.parse_prompt(F.lit("x [SEP] ")).alias("e"), S.format_duration(F.lit(3661)).alias("f"), S.normalize_text(F.lit("  Straße　Ａ ")).alias("g"),
        S.valid_identifier(F.lit(None).cast("string")).alias("h"), S.bit_width(F.lit(0)).alias("i"), S.bit_width(F.lit(8)).alias("j")).first()
    assert row["a"] and not row["b"] and row["c"] and tuple(row["d"]) == ("x", "y") and row["e"] is None
    assert (row["f"], row["g"], row["h"], row["i"], row["j"]) == ("01:01:01", "strasse a", False, 0, 4)


def _run_stream(spark, tmp_path, rows, build, name):
    path = str(tmp_path / name)
    rows.coalesce(1).write.parquet(path)
    with state_on_disk(spark):
        q = build(spark.readStream.schema(rows.schema).parquet(path)).writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    return spark.table(name)


def test_monitor_stream_equals_batch_until_alarm(spark, tmp_path):
    rows = spark.range(60).selectExpr("id % 2 AS stream_id", "id AS seq", "CAST(id AS DOUBLE) AS value", "'value' AS kind")
    batch = {(r["stream_id"], r["seq"]): r for r in monitor.cusum(rows, 10.0, 30.0, 20.0, 1.0).collect()}
    seen = _run_stream(spark, tmp_path, rows, lambda s: monitor_stream(s, 10.0, 30.0, 20.0, 1.0), "mon").collect()
    assert len(seen) == 60 and {r["status"] for r in seen} == {"accepted", "alarm", "frozen"}
    for r in seen:
        if r["status"] != "frozen":
            b = batch[r["stream_id"], r["seq"]]
            assert abs(b["w"] - r["w"]) < 1e-9 and b["alarm"] == r["alarm"]


def test_learner_stream_equals_batch(spark, tmp_path):
    rows = spark.range(80).selectExpr("id % 3 AS stream_id", "id AS seq", "CAST(id div 2 * 2 AS STRING) AS observation_id", "CASE WHEN id < 30 OR id % 9 = 0 THEN 'training' ELSE 'streaming' END AS partition",
                                      "concat('c', id % 4) AS context", "CASE WHEN id % 7 = 0 THEN 'non_result' WHEN id % 5 < 3 THEN 'completed' ELSE 'not_completed' END AS outcome")
    status = {(r["stream_id"], r["seq"]): r["status"] for r in learning.accept(rows).collect()}
    accepted = learning.accept(rows).where("status = 'accepted'").withColumn("y", (F.col("outcome") == "completed").cast("int"))
    batch = {(r["stream_id"], r["seq"]): r["p_mix"] for r in learning.mixture(learning.experts(accepted)).collect()}
    seen = _run_stream(spark, tmp_path, rows, learner.learned, "learn").collect()
    assert {(r["stream_id"], r["seq"]): r["status"] for r in seen} == status
    for r in seen:
        if r["status"] == "accepted":
            assert abs(batch[r["stream_id"], r["seq"]] - r["p_mix"]) < 1e-9


def test_streams_take_rows_in_order_whatever_their_arrival(spark, tmp_path):
    """More rows of a key than an Arrow batch, arriving backwards."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = spark.range(60).selectExpr("0 AS stream_id", "id AS seq", "CAST(id % 7 AS DOUBLE) AS value", "'value' AS kind")
        batch = {r["seq"]: r["w"] for r in monitor.cusum(rows, 1.0, 5.0, 3.0, 1e9).collect()}
        back = rows.orderBy(F.desc("seq"))
        seen = _run_stream(spark, tmp_path, back, lambda s: monitor_stream(s, 1.0, 5.0, 3.0, 1e9), "back").collect()
        assert len(seen) == 60 and all(abs(batch[r["seq"]] - r["w"]) < 1e-9 for r in seen)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_monitor_stream_holds_off_and_skips(spark, tmp_path):
    kinds = {5: "reset", 9: "reset", 12: "reset"}
    rows = spark.createDataFrame([(0, i, 50.0, kinds.get(i, "value")) for i in range(16)], "stream_id long, seq long, value double, kind string")
    seen = _run_stream(spark, tmp_path, rows, lambda s: monitor_stream(s, 10.0, 30.0, 20.0, 1.0, every=2, hold_off=3), "hold").orderBy("seq").collect()
    # each second value counts and alarms, three are held off, then a reset starts anew
    assert [r["status"] for r in seen] == ["skipped", "alarm", "frozen", "frozen", "frozen", "reset", "skipped", "alarm", "frozen", "reset_blocked", "frozen", "frozen", "reset", "skipped", "alarm", "frozen"]


def test_monitor_stream_leaves_out_what_is_no_number(spark, tmp_path):
    rows = spark.createDataFrame([(0, i, v, "value") for i, v in enumerate([None, float("nan"), float("inf"), 500.0, None])], "stream_id long, seq long, value double, kind string")
    seen = _run_stream(spark, tmp_path, rows, lambda s: monitor_stream(s, 10.0, 30.0, 20.0, 1.0), "odd").orderBy("seq").collect()
    assert [r["status"] for r in seen] == ["non_finite"] * 3 + ["alarm", "non_finite"] and seen[3]["w"] > 1


def test_learner_stream_scores_without_learning(spark, tmp_path):
    learn = [(0, 2 * i, f"o{i}", "training", "c", "completed" if i % 3 else "not_completed", "learn") for i in range(12)]
    score = [(0, 2 * i + 1, None, None, "c", None, "score") for i in range(12)]
    schema = "stream_id long, seq long, observation_id string, partition string, context string, outcome string, kind string"
    both = _run_stream(spark, tmp_path, spark.createDataFrame(learn + score, schema), learner.learned, "both").collect()
    only = {r["seq"]: r["p_mix"] for r in _run_stream(spark, tmp_path, spark.createDataFrame(learn, schema), learner.learned, "only").collect()}
    got = {r["seq"]: r for r in both}
    assert all(got[k]["p_mix"] == p for k, p in only.items()) and {got[k]["status"] for k in range(1, 24, 2)} == {"scored"}
    assert all(got[k]["p_mix"] == only[k + 1] for k in range(1, 22, 2))  # what the next row is predicted with


def test_partitions_apart(spark):
    ids = lambda *x: spark.createDataFrame([(v,) for v in x], "observation_id string")
    assert calibration.overlapping_ids({"fitting": ids("a", "b"), "calibration": ids("c"), "final": ids("d")}).count() == 0
    got = calibration.overlapping_ids({"fitting": ids("a", "b", "b"), "calibration": ids("c", "a"), "final": ids("d", "not valid", None)}).collect()
    assert {(r["observation_id"], r["n"], *r["partitions"]) for r in got} == {("a", 2, "calibration", "fitting"), ("b", 2, "fitting"), ("not valid", 1, "final"), (None, 1, "final")}


def test_subject_surfaces(spark):
    rows = spark.createDataFrame([("Straße [SEP] in", ["STRASSE", " Weg ", None, ""], ["weg", "Ａllee"]), ("no subject", None, ["x", "X"])], "prompt string, a array<string>, b array<string>")
    got = [r["s"] for r in rows.select(S.subject_surfaces(F.col("prompt"), F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [["Straße", "Weg", "Ａllee"], ["x"]]
