"""The controller as stream and batch, against a closed form and by its rules."""

import math

import pytest

from tallyrack.streaming import controller as C
from tallyrack.streaming.rocks import PROVIDER, state_on_disk

GRID = [(8, 2, 1.0), (64, 5, 2.0), (128, 5, 3.0)]


def row(seq, kind, partition="streaming", source="o", suite="p", success=True, nodes=20, scores=None, stream=0):
    return (stream, seq, kind, partition, source, suite, success, nodes, scores)


def searched(seq, scores=GRID, stream=0, **more):
    return row(seq, "search", "development", "suite", scores=scores, success=None, nodes=None, stream=stream, **more)


def batch(spark, rows, by=None, log_size=64):
    with state_on_disk(spark):
        return sorted(C.controlled(spark.createDataFrame(rows, C.ROWS), by, log_size).collect(), key=lambda r: (r["stream_id"], r["seq"] is not None, r["seq"]))


def test_search_selects_and_ties_prefer_the_lower_limit(spark):
    got = batch(spark, [searched(1), searched(2), searched(3, [(8, 6, 1.0), (128, 5, 3.0)]), searched(4, [(8, 5, 1.0), (128, 6, 3.0)])])
    assert [(r["decision"], r["node_limit"], r["version"]) for r in got] == [
        ("updated", 64, "baseline-64-run-1"), ("unchanged", 64, "baseline-64-run-1"), ("alarm_frozen", 128, "baseline"), ("alarm_frozen", 128, "baseline")]
    assert got[2]["event"] == "regression_rollback"  # 64 was not among the third suite's completed
    got = batch(spark, [searched(1), searched(2, [(8, 6, 1.0), (64, 5, 1.0), (128, 5, 3.0)]), searched(3, [(8, 6, 1.0), (128, 6, 3.0)]), searched(4, [(8, 6, 1.0), (128, 7, 3.0)])])
    assert [(r["decision"], r["version"]) for r in got] == [("updated", "baseline-64-run-1"), ("updated", "baseline-8-run-2"), ("unchanged", "baseline-8-run-2"), ("alarm_frozen", "baseline")]


def test_broken_suites_freeze_or_are_refused(spark):
    nan = float("nan")
    for scores in (None, [], [(8, 1, 1.0)], [(128, 0, 1.0)], [(128, None, 1.0)], [(128, 3, nan)], [(128, 3, None)]):
        got = batch(spark, [searched(1, scores)])
        assert (got[0]["decision"], got[0]["event"], got[0]["hold_off"]) == ("alarm_frozen", "invariant_rollback", 3)
    got = batch(spark, [row(1, "search", "final_test", scores=GRID), row(2, "search", None, scores=GRID), row(3, "search", "development", None, scores=GRID), row(4, "search", "development", "a b", scores=GRID), row(5, None), row(6, "other")])
    assert [r["decision"] for r in got] == ["rejected_partition"] * 2 + ["invalid_input"] * 4 and not any(r["frozen"] for r in got)


def test_only_streaming_rows_reach_the_detector(spark):
    rows = [searched(0)]
    for i in range(1, 40):
        rows.append(row(i, "observe", "streaming" if i % 3 else ("final_test", "training", None)[i // 3 % 3], nodes=10 + i % 7))
    by = C.Detector(every=2, threshold=1e9)
    got = batch(spark, rows, by)
    w, k = 0.0, 0
    for r, given in zip(got[1:], rows[1:], strict=True):
        if given[3] != "streaming":
            assert (r["decision"], r["event"], r["sampled"]) == ("rejected_partition", "partition_rejected", False)
        else:
            k += 1
            if k % 2 == 0:
                w = max(0.0, w + 0.5 / 0.0625 * (math.log1p(given[7]) - 3.0 - 0.25))
            assert r["sampled"] == (k % 2 == 0) and r["decision"] == "unchanged"
        assert math.isclose(r["cusum"], w, abs_tol=1e-12)


def test_alarm_rolls_back_and_holds_off(spark):
    rows = [row(0, "observe"), searched(1), row(2, "observe", nodes=120), row(3, "reset"), row(4, "observe", "training"), row(5, "observe", nodes=1), row(6, "observe", source=None), row(7, "observe", success=None), searched(8),
            row(9, "reset"), row(10, "observe"), row(11, "reset"), row(12, "reset"), row(13, "observe", nodes=20)]
    got = batch(spark, rows, C.Detector(threshold=1.0))
    assert [r["decision"] for r in got] == ["invalid_input", "updated", "alarm_frozen", "reset_blocked", "rejected_partition", "alarm_frozen", "invalid_input", "alarm_frozen", "alarm_frozen", "reset_blocked", "alarm_frozen", "reset", "reset_blocked", "unchanged"]
    assert [r["hold_off"] for r in got[2:12]] == [3, 3, 3, 2, 2, 1, 1, 1, 0, 0] and got[2]["event"] == "shift_alarm_rollback"
    assert [r["version"] for r in got[1:3]] == ["baseline-64-run-1", "baseline"] and got[11]["cusum"] == 0.0


@pytest.mark.parametrize("how", [{"success": False}, {"success": None}, {"nodes": 0}, {"nodes": 129}, {"nodes": None}, {"nodes": -1}])
def test_failed_invariants_freeze_for_good(spark, how):
    got = batch(spark, [searched(0), row(1, "observe"), row(2, "observe", **how), row(3, "observe")])
    assert got[2]["event"] == "invariant_rollback" and got[2]["frozen"] and not math.isnan(got[2]["cusum"]) and got[3]["decision"] == "alarm_frozen"


def test_values_that_are_not_finite_freeze(spark):
    got = batch(spark, [searched(0, [(128, 3, 1e308)]), row(1, "observe"), row(2, "observe")], C.Detector(sigma=1e-5))
    assert got[1]["event"] == "residual_observed"
    got = batch(spark, [searched(0, [(128, 3, -1e308)]), row(1, "observe"), row(2, "observe")], C.Detector(sigma=1e-5))
    assert got[1]["event"] == "invariant_rollback" and got[1]["frozen"] and got[1]["cusum"] == 0.0


def test_stream_in_pieces_equals_batch_and_the_log_is_capped(spark, tmp_path):
    rows = [searched(0, stream=s) for s in range(3)]
    rows += [row(i, "observe", ("streaming", "streaming", "final_test")[(i + s) % 3], f"o{i}", nodes=5 + i * (s + 1) % 100, stream=s) for i in range(1, 40) for s in range(3)]
    rows += [row(40, "reset", stream=s) for s in range(3)]
    data = spark.createDataFrame(rows, C.ROWS)
    folder, checkpoint, out = (str(tmp_path / n) for n in ("in", "checkpoint", "out"))
    for low, high in ((0, 10), (10, 25), (25, 99)):
        data.where(f"seq >= {low} AND seq < {high}").coalesce(1).write.mode("append").parquet(folder)
        with state_on_disk(spark):
            stream = C.controlled(spark.readStream.schema(data.schema).parquet(folder), log_size=5)
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == sorted(map(tuple, batch(spark, rows))) and len(got) == len(rows)
    events = {}
    for r in batch(spark, rows):
        if r["event"]:
            events.setdefault(r["stream_id"], []).append((r["event_no"], r["seq"], r["event"]))
    held = {}
    for r in C.event_log(spark, checkpoint).collect():
        held.setdefault(r["stream_id"], []).append((r["event_no"], r["seq"], r["event"]))
    assert {s: sorted(v) for s, v in held.items()} == {s: v[-5:] for s, v in events.items()}
    assert spark.conf.get(PROVIDER, "") != "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
