"""The bounded controller: search results, monitored residuals and resets as keyed state.

Input rows: stream_id, seq, kind, partition, source_id, suite_id, success,
nodes, scores.

*   ``search`` rows carry the candidates' results on a development suite
    (``scores``: node_limit, completed, mean_log_nodes; see
    ``monitor.grid_search``; null: the evaluation failed).  The greatest number
    completed wins, ties prefer the lower limit.
*   ``observe`` rows carry one solver outcome.  Only those of the streaming
    partition reach the detector, count as samples or use up the hold-off.
*   ``reset`` rows start anew at the baseline once a freeze is held off.

A failed invariant, a residual or detector value that is not finite, a
regression of the active setting and an alarm freeze the controller and put the
baseline back.  Rejected rows leave the state as it is but for the event log,
which keeps the last ``log_size`` events of a stream.

State is typed: one row of values and a map of event slots, each written once a
trigger.  Rows of a key in one trigger are taken by seq and held together, so
``maxFilesPerTrigger`` bounds a trigger; rows that come in a later trigger are
taken then.  A null in any column is no valid value of it.  The same processor
runs over a batch and gives the same rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import asdict, dataclass, field, fields

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tallyrack.functions.scalars import IDENTIFIER

from .rocks import in_order, known

ROWS = "stream_id long, seq long, kind string, partition string, source_id string, suite_id string, success boolean, nodes long, scores array<struct<node_limit: bigint, completed: bigint, mean_log_nodes: double>>"
OUT = "stream_id long, seq long, decision string, frozen boolean, sampled boolean, residual double, cusum double, hold_off long, node_limit long, version string, event string, event_no long"
EVENT = "event_no long, seq long, event string, source_id string, from_version string, to_version string, residual double, cusum double"
VALUES = "frozen boolean, node_limit long, version string, versions long, samples long, hold_off long, cusum double, reference double, events long"


@dataclass(frozen=True)
class Detector:
    """One-sided Gaussian CUSUM of log1p(nodes) less the baseline's mean on the first suite."""

    before: float = 0.0
    after: float = 0.5
    sigma: float = 0.25
    threshold: float = 5.0
    every: int = 1
    hold_off: int = 3
    baseline: int = 128
    version: str = "baseline"


@dataclass
class Control:
    """The values of one stream."""

    frozen: bool
    node_limit: int
    version: str
    versions: int = 0
    samples: int = 0
    hold_off: int = 0
    cusum: float = 0.0
    reference: float | None = None
    events: int = 0
    log: list = field(default_factory=list)

    def note(self, seq, event: str, source, since: str, residual=None, cusum=None) -> str:
        self.events += 1
        self.log.append((self.events, seq, event, source, since, self.version, residual, cusum))
        return event

    def freeze(self, by: Detector, seq, event: str, source, residual=None, cusum=None) -> str:
        since, self.frozen, self.node_limit, self.version, self.hold_off = self.version, True, by.baseline, by.version, by.hold_off
        return self.note(seq, event, source, since, residual, cusum)


def valid_id(value) -> bool:
    return isinstance(value, str) and re.match(IDENTIFIER.replace(r"\z", r"\Z"), value) is not None


def search(now: Control, by: Detector, seq, row) -> tuple[str, str | None]:
    if now.frozen:
        return "alarm_frozen", None
    if row.partition != "development":
        return "rejected_partition", now.note(seq, "partition_rejected", None, now.version)
    if not valid_id(row.source_id) or not valid_id(row.suite_id):
        return "invalid_input", None
    scores = {} if row.scores is None else {s["node_limit"]: (s["completed"], s["mean_log_nodes"]) for s in row.scores}
    done = {limit: c for limit, (c, _) in scores.items()}
    if not done.get(by.baseline) or any(c is None or limit is None for limit, c in done.items()):
        return "alarm_frozen", now.freeze(by, seq, "invariant_rollback", row.source_id)
    if now.reference is None:
        mean = known(scores[by.baseline][1])
        if mean is None or not math.isfinite(mean):
            return "alarm_frozen", now.freeze(by, seq, "invariant_rollback", row.source_id)
        now.reference = mean
    if now.node_limit != by.baseline and done.get(now.node_limit, 0) < done[by.baseline]:
        return "alarm_frozen", now.freeze(by, seq, "regression_rollback", row.source_id)
    chosen = min(done, key=lambda limit: (-done[limit], limit))
    since = now.version
    if chosen == now.node_limit:
        return "unchanged", now.note(seq, "search_unchanged", row.source_id, since)
    now.node_limit = chosen
    now.versions += chosen != by.baseline
    now.version = by.version if chosen == by.baseline else f"{by.version}-{chosen}-run-{now.versions}"
    return "updated", now.note(seq, "search_updated", row.source_id, since)


def observe(now: Control, by: Detector, seq, row) -> tuple[str, str | None, bool, float | None]:
    if row.partition != "streaming":
        return "rejected_partition", now.note(seq, "partition_rejected", None, now.version), False, None
    if not valid_id(row.source_id) or not valid_id(row.suite_id):
        return "invalid_input", None, False, None
    if now.frozen:
        now.hold_off = max(0, now.hold_off - 1)
        return "alarm_frozen", None, False, None
    if now.reference is None:
        return "invalid_input", None, False, None
    nodes = known(row.nodes)
    if known(row.success) is not True and row.success != True or nodes is None or not 0 < nodes <= by.baseline:  # noqa: E712 - numpy booleans too
        return "alarm_frozen", now.freeze(by, seq, "invariant_rollback", row.source_id), False, None
    now.samples += 1
    if now.samples % by.every:
        return "unchanged", None, False, None
    residual = math.log1p(nodes) - now.reference
    with_row = max(0.0, now.cusum + (by.after - by.before) / (by.sigma * by.sigma) * (residual - (by.before + by.after) / 2))
    if not math.isfinite(residual) or not math.isfinite(with_row):
        return "alarm_frozen", now.freeze(by, seq, "invariant_rollback", row.source_id, residual), True, residual
    now.cusum = with_row
    if with_row > by.threshold:
        return "alarm_frozen", now.freeze(by, seq, "shift_alarm_rollback", row.source_id, residual, with_row), True, residual
    return "unchanged", now.note(seq, "residual_observed", row.source_id, now.version, residual, with_row), True, residual


def reset(now: Control, by: Detector, seq) -> tuple[str, str | None]:
    if not now.frozen or now.hold_off:
        return "reset_blocked", None
    since, now.frozen, now.node_limit, now.version, now.cusum, now.samples = now.version, False, by.baseline, by.version, 0.0, 0
    return "reset", now.note(seq, "reset", None, since)


class Controller(StatefulProcessor):
    def __init__(self, by: Detector, log_size: int):
        self.by, self.log_size = by, log_size

    def init(self, handle) -> None:
        self.values = handle.getValueState("values", VALUES)
        self.log = handle.getMapState("log", "slot long", EVENT)

    def handleInputRows(self, key, rows, timerValues):
        found = self.values.get() if self.values.exists() else (False, self.by.baseline, self.by.version)
        now, out = Control(*found), []
        for row in in_order(rows).itertuples(index=False):
            seq, sampled, residual = known(row.seq), False, None
            if row.kind == "observe":
                decision, event, sampled, residual = observe(now, self.by, seq, row)
            elif row.kind == "search":
                decision, event = search(now, self.by, seq, row)
            elif row.kind == "reset":
                decision, event = reset(now, self.by, seq)
            else:
                decision, event = "invalid_input", None
            out.append((key[0], seq, decision, now.frozen, sampled, residual, now.cusum, now.hold_off, now.node_limit, now.version, event, now.events if event else None))
        kept = asdict(now)
        self.values.update(tuple(kept[f.name] for f in fields(Control) if f.name != "log"))
        for event in now.log[-self.log_size :]:
            self.log.updateValue((event[0] % self.log_size,), event)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"seq": "Int64", "event_no": "Int64"})

    def close(self) -> None:
        pass


def controlled(rows: DataFrame, by: Detector | None = None, log_size: int = 64) -> DataFrame:
    """One row of OUT for each input row; ``rows`` may be a stream or a batch.  Run it inside ``rocks.state_on_disk``."""
    return rows.groupBy("stream_id").transformWithStateInPandas(Controller(by or Detector(), log_size), OUT, "append", "none")


def event_log(spark, checkpoint: str) -> DataFrame:
    """The events that a controlled stream's state still holds: stream_id and EVENT."""
    state = spark.read.format("statestore").option("stateVarName", "log").load(checkpoint)
    return state.selectExpr("key.stream_id", "user_map_value.*")
