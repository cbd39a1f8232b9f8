"""CUSUM at the threshold, and on values that are no short decimals."""

import math
import random

from tallyrack.operators.monitor import cusum

ROWS = "stream_id long, seq long, value double"


def test_reaching_the_threshold_is_no_alarm(spark):
    rng, rows = random.Random(2), []
    for stream in range(60):
        steps = [rng.randrange(1, 700) for _ in range(12)]
        steps.append(9000 - sum(steps))  # in hundredths: 90.00 above the middle, so w is 2
        rows += [(stream, k, (5000 + x) / 100) for k, x in enumerate(steps)]
    got = cusum(spark.createDataFrame(rows, ROWS), 40.0, 60.0, 30.0, 2.0).where("seq = 12").collect()
    assert len(got) == 60 and all(abs(r["w"] - 2) < 1e-9 and not r["alarm"] for r in got)


def test_odd_values(spark):
    values = [None, 55.5, 1 / 3, -7.25, 1e300, 60.0, float("inf"), float("nan")]
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], ROWS)
    for before, after in ((40.0, 60.0), (60.0, 40.0)):
        got = [r["w"] for r in cusum(rows, before, after, 30.0, 2.0).orderBy("seq").collect()]
        total = low = 0.0
        for k, v in enumerate(values[1:6], 1):
            total += (after - before) / 900 * (v - 50)
            low = min(low, total)
            assert math.isclose(got[k], total - low, rel_tol=1e-9, abs_tol=1e-9)
        assert got[0] is None and len(got) == 8
