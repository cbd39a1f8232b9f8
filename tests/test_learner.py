"""Learner state: odd rows, limits, snapshots, restarts and refused snapshots."""

import pytest
from pyspark.sql import functions as F

from tallyrack.streaming import learner as L
from tallyrack.streaming.rocks import state_on_disk

ROWS = "stream_id long, seq long, observation_id string, partition string, context string, outcome string, kind string"


def batch(spark, rows, **limits):
    with state_on_disk(spark):
        return sorted(L.learned(spark.createDataFrame(rows, ROWS), **limits).collect(), key=lambda r: (r["stream_id"], r["seq"]))


def test_odd_rows_and_limits(spark):
    rows = [(0, 1, "a", "training", None, "completed", None), (0, 2, None, "training", "c", "completed", None), (0, 3, None, None, None, None, "score"), (0, 4, "a", "training", "c", "completed", None), (0, 5, "b", "training", "d", "completed", None),
            (0, 6, "b", "training", "c", "completed", None), (0, 7, "e", "training", "c", "completed", None), (0, 8, "f", "streaming", "c", None, None), (0, 9, "f", None, "c", "completed", None)]
    got = batch(spark, rows, most_ids=2, most_contexts=1)
    assert [r["status"] for r in got] == ["invalid_schema"] * 3 + ["accepted", "resource_limit", "accepted", "resource_limit", "non_result", "unauthorized"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(120).selectExpr("id % 3 AS stream_id", "id AS seq", "CAST(id div 6 * 6 + id % 3 AS STRING) AS observation_id", "CASE WHEN id < 40 OR id % 9 = 0 THEN 'training' ELSE 'streaming' END AS partition",
                                       "concat('c', id % 4) AS context", "CASE WHEN id % 7 = 0 THEN 'non_result' WHEN id % 5 < 3 THEN 'completed' ELSE 'not_completed' END AS outcome", "CASE WHEN id % 11 = 0 THEN 'score' END AS kind").cache()


def stream(spark, folder, out, checkpoint, initial=None):
    with state_on_disk(spark):
        found = L.learned(spark.readStream.schema(ROWS).parquet(folder), initial)
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@pytest.fixture(scope="module")
def half(spark, rows, tmp_path_factory):
    """The snapshot of a stream that saw the first 70 rows, in two runs, written as a table."""
    at = tmp_path_factory.mktemp("half")
    for low, high in ((0, 30), (30, 70)):
        rows.where(f"seq >= {low} AND seq < {high}").coalesce(1).write.mode("append").parquet(str(at / "in"))
        stream(spark, str(at / "in"), str(at / "out"), str(at / "checkpoint"))
    L.snapshot(spark, str(at / "checkpoint")).write.parquet(str(at / "snapshot"))
    return spark.read.parquet(str(at / "snapshot"))


def test_restart_elsewhere_equals_no_stop(spark, rows, half, tmp_path):
    rows.where("seq >= 70").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), L.restored(half))
    got = {(r["stream_id"], r["seq"]): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    with state_on_disk(spark):
        whole = {(r["stream_id"], r["seq"]): r for r in L.learned(rows).collect() if r["seq"] >= 70}
    assert got == whole and {r["status"] for r in whole.values()} >= {"accepted", "scored", "late_training", "duplicate", "non_result"}
    rows.coalesce(1).write.parquet(str(tmp_path / "all"))
    stream(spark, str(tmp_path / "all"), str(tmp_path / "out2"), str(tmp_path / "checkpoint2"))
    key = lambda c: sorted(map(repr, L.snapshot(spark, str(tmp_path / c)).collect()))
    assert key("checkpoint") == key("checkpoint2")


def changed(half, where, **columns):
    now = half
    for c, v in columns.items():
        now = now.withColumn(c, F.when(F.expr(f"stream_id = 1 AND {where}"), v).otherwise(F.col(c)))
    return now


@pytest.mark.parametrize(("fault", "broken"), [
    ("library", lambda h: changed(h, "key = 'library'", text=F.lit("other"))),
    ("scores", lambda h: changed(h, "kind = 'score' AND key = 'mixture'", number=F.lit(0.5))),
    ("scores", lambda h: changed(h, "kind = 'score' AND key = 'context'", number=F.lit(float("nan")))),
    ("scores", lambda h: h.where("NOT (stream_id = 1 AND kind = 'score' AND key = 'global')")),
    ("flags", lambda h: h.where("NOT (stream_id = 1 AND key = 'streaming')")),
    ("prev", lambda h: changed(h, "key = 'prev'", text=F.lit("start"))),
    ("prev", lambda h: changed(h, "key = 'prev'", text=F.lit(None))),
    ("streaming", lambda h: changed(h, "key = 'streaming'", text=F.lit("false"))),
    ("repeated_id", lambda h: h.unionByName(h.where("stream_id = 1 AND kind = 'id' AND seen = 1"))),
    ("id", lambda h: changed(h, "kind = 'id' AND seen = 1", key=F.lit("not valid"))),
    ("id_total", lambda h: h.where("NOT (stream_id = 1 AND kind = 'id' AND seen = 2)")),
    ("order", lambda h: changed(h, "kind = 'id' AND seen = 2", seen=F.lit(1))),
    ("partition", lambda h: changed(h, "kind = 'id' AND seen = 2", text=F.lit("final_test"))),
    ("late_training", lambda h: changed(h, "kind = 'id' AND seen = 1", text=F.lit("streaming"))),
    ("repeated_key", lambda h: h.unionByName(h.where("stream_id = 1 AND kind = 'context' AND key = 'c1'"))),
    ("counts", lambda h: changed(h, "kind = 'context' AND key = 'c1'", completed=F.col("seen") + 1)),
    ("context_total", lambda h: changed(h, "kind = 'context' AND key = 'c1'", seen=F.col("seen") + 1)),
    ("previous_total", lambda h: h.where("NOT (stream_id = 1 AND kind = 'previous' AND key = '1')")),
    ("previous", lambda h: changed(h, "kind = 'previous' AND key = '1'", key=F.lit("2"))),
    ("global", lambda h: h.where("NOT (stream_id = 1 AND kind = 'global')")),
    ("kind", lambda h: changed(h, "kind = 'context' AND key = 'c1'", kind=F.lit("other"))),
])
def test_broken_snapshots_are_refused(half, fault, broken):
    found = {r["stream_id"]: r["faults"].split(",") for r in L.faults(broken(half)).collect()}
    assert set(found) == {1} and fault in found[1]


def test_sound_snapshots_and_limits(half):
    assert L.faults(half).count() == 0
    assert {r["faults"] for r in L.faults(half, most_ids=1, most_contexts=1).collect()} == {"most_contexts,most_ids"}
    with pytest.raises(ValueError, match="stream 0: most_ids"):
        L.restored(half, most_ids=2)


class _Asked:
    """State that counts what is asked of it."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def getValueState(self, *_):
        return self.__class__()

    getMapState = getValueState

    def _call(self, f):
        self.calls += 1
        return f()

    def exists(self):
        return self._call(lambda: "v" in self.held)

    def get(self):
        return self._call(lambda: self.held["v"])

    def update(self, v):
        self._call(lambda: self.held.update(v=v))

    def containsKey(self, k):
        return self._call(lambda: k in self.held)

    def getValue(self, k):
        return self._call(lambda: self.held[k])

    def updateValue(self, k, v):
        self._call(lambda: self.held.update({k: v}))


def test_a_new_streams_state_is_not_asked_row_by_row(rows):
    """A batch asks once a key, a stream's first trigger only writes; later triggers still know the ids."""
    pdf = rows.where("stream_id = 1").toPandas()
    asked, results = [], []
    for keep in (False, True):
        one = L.Learner(1000, 1000, keep)
        one.init(_Asked())
        results.append([repr(r) for f in one.handleInputRows((1,), iter([pdf[:9], pdf[9:]]), None) for r in f.itertuples(index=False)])
        asked.append([x.calls for x in (one.sums, one.counts, one.ids)])
    assert results[0] == results[1] and len(results[0]) == len(pdf)
    assert asked[0] == [1, 0, 0] and asked[1] == [2, len(one.counts.held), len(one.ids.held)] and one.ids.held
    again = next(one.handleInputRows((1,), iter([pdf]), None))
    assert not (again["status"] == "accepted").any() and (again["status"] == "duplicate").any()


def test_a_batch_in_many_frames_equals_one(spark, rows):
    """One call takes all rows of a key, however many frames bring them."""
    key = lambda: sorted(map(repr, L.learned(rows).collect()))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with state_on_disk(spark):
        whole = key()
        spark.conf.set(name, "3")
        try:
            assert key() == whole
        finally:
            spark.conf.set(name, before)
