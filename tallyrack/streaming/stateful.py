"""The change monitor over any values as keyed streaming state (see ``controller`` and ``learner`` for the other two)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

MONITOR = "stream_id long, seq long, w double, alarm boolean, status string"
MONITOR_STATE = "total double, least double, frozen boolean, seen long, held long"


def _in_order(frames) -> pd.DataFrame:
    """All rows of a key in a trigger by seq: they come in several frames, in any order."""
    return pd.concat(list(frames)).sort_values("seq", kind="stable")


def monitor_stream(rows: DataFrame, before: float, after: float, sigma: float, threshold: float, every: int = 1, hold_off: int = 0) -> DataFrame:
    """rows: stream_id, seq, value, kind ('value' or 'reset').  CUSUM of each ``every``-th value until an alarm freezes the stream.

    The next ``hold_off`` values are only counted; a reset before they are used
    up, or without an alarm, is blocked, and one after starts anew.  Values that
    are null or not finite are ``non_finite`` and change nothing.
    """
    gain, middle = (after - before) / (sigma * sigma), (before + after) / 2

    def step(key, frames, state):
        total, least, frozen, seen, held = state.get if state.exists else (0.0, 0.0, False, 0, 0)
        out = []
        for seq, value, kind in _in_order(frames)[["seq", "value", "kind"]].itertuples(index=False):
            if kind == "reset":
                if not frozen or held:
                    out.append((key[0], seq, total - least, frozen, "reset_blocked"))
                    continue
                total, least, frozen, seen = 0.0, 0.0, False, 0
                out.append((key[0], seq, 0.0, False, "reset"))
            elif not np.isfinite(np.float64(np.nan if value is None else value)):
                out.append((key[0], seq, total - least, frozen, "non_finite"))
            elif frozen:
                held = max(0, held - 1)
                out.append((key[0], seq, total - least, True, "frozen"))
            else:
                seen += 1
                if seen % every:
                    out.append((key[0], seq, total - least, False, "skipped"))
                    continue
                total += gain * (value - middle)
                least = min(least, total)
                frozen = total - least > threshold
                held = hold_off if frozen else 0
                out.append((key[0], seq, total - least, frozen, "alarm" if frozen else "accepted"))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "w", "alarm", "status"])
        state.update((total, least, frozen, seen, held))

    return rows.groupBy("stream_id").applyInPandasWithState(step, MONITOR, MONITOR_STATE, "append", GroupStateTimeout.NoTimeout)
