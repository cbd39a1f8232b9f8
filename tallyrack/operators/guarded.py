"""The guarded decision: every check on a request, then certificates, then the least risk.

request: request_id, upstream_status, exactness, subject_sha256, total.
state: request_id, state_id, weight, unresolved; a request's weights must sum to its total.
action: request_id, action_id, label, output, claim_sha256, priority, cost_num,
cost_den, requires_certificate, property_id and, of its certificate,
certificate_id, digest, valid_from, valid_to, for_action, for_subject,
for_claim, for_property, verifier_id, verifier_version, verified.
loss: request_id, action_id, state_id, loss.

Numbers are whole and exact; what a check needs and is null fails it.  Checks
are counted per request by aggregates, so one broken row makes its request
``invalid`` and no other.  Rows of requests that are not in ``request`` are
left out; a repeated request is invalid.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrack.functions.scalars import valid_digest, valid_identifier
from tallyrack.operators import decision

#: Fixed value: the most states, and the most actions, of a request.
MOST = 256


@dataclass(frozen=True)
class Policy:
    """Costs and bounds as fractions of whole numbers."""

    resource: tuple[int, int] = (1, 1)
    abstain: tuple[int, int] = (1, 1)
    unresolved: tuple[int, int] = (0, 1)
    exact_only: bool = True
    verifier_id: str = ""
    verifier_version: str = ""
    now: int = 0

    def __post_init__(self):
        bad = any(d <= 0 or n < 0 for n, d in (self.resource, self.abstain, self.unresolved)) or self.unresolved[0] > self.unresolved[1]
        if bad:
            raise ValueError("policy: costs and bounds are fractions that are not negative, the unresolved share at most 1")


def verified(actions: DataFrame, verifiers: dict[str, Callable[[pd.DataFrame], pd.Series]]) -> DataFrame:
    """``actions`` with verified: what the property's verifier says, in Arrow batches.

    A verifier gets a frame of rows of its property and returns their verdicts.
    An exception, a missing verdict and a property without verifier are
    rejections; where a batch fails, its rows are asked one by one.
    """
    names = list(actions.columns)

    def asked(check, frame: pd.DataFrame) -> list[bool]:
        try:
            said = list(check(frame))
            if len(said) == len(frame):
                return [v is True or (v == True and not pd.isna(v)) for v in said]  # noqa: E712 - numpy booleans too
        except Exception:  # noqa: BLE001 - whatever it is, the certificate is not accepted
            pass
        return [False] if len(frame) == 1 else [v for i in range(len(frame)) for v in asked(check, frame.iloc[i : i + 1])]

    def run(frames):
        for frame in frames:
            frame["verified"] = False
            for name, check in verifiers.items():
                rows = (frame["property_id"] == name).to_numpy()
                if rows.any():
                    frame.loc[rows, "verified"] = asked(check, frame.loc[rows, names].reset_index(drop=True))
            yield frame

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in actions.schema) + ", verified boolean"
    return actions.mapInPandas(run, schema)


def _fails(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def request_faults(request: DataFrame, state: DataFrame, action: DataFrame, loss: DataFrame) -> DataFrame:
    """request_id, faults (joined by commas, empty if none), unresolved (weight)."""
    of_request = request.groupBy("request_id").agg(
        F.count("*").alias("requests"), F.max(_fails(F.col("exactness").isin("exact", "approximate"))).alias("exactness"), F.max("total").alias("total"), F.max(_fails(valid_digest(F.col("subject_sha256")))).alias("no_subject"))
    of_state = state.groupBy("request_id").agg(
        F.count("*").alias("states"), (F.count("*") != F.count_distinct("state_id")).alias("same_state"), F.max(_fails(valid_identifier(F.col("state_id")) & (F.col("weight") >= 0))).alias("bad_state"),
        F.sum("weight").alias("sum"), F.sum(F.when(F.coalesce("unresolved", F.lit(True)), F.col("weight")).otherwise(0)).alias("unresolved"))
    sound = valid_identifier(F.col("action_id")) & (F.col("cost_num") >= 0) & (F.col("cost_den") > 0) & (F.length("label") > 0) & F.col("output").isNotNull() & valid_digest(F.col("claim_sha256")) & F.col("priority").isNotNull()
    needs = F.coalesce("requires_certificate", F.lit(True))
    of_action = action.groupBy("request_id").agg(
        F.count("*").alias("actions"), (F.count("*") != F.count_distinct("action_id")).alias("same_action"), F.max(_fails(sound)).alias("bad_action"), (F.count("certificate_id") != F.count_distinct("certificate_id")).alias("same_certificate"),
        F.max(F.col("certificate_id").isNotNull() & _fails(valid_identifier(F.col("certificate_id")))).alias("bad_certificate"), F.max(needs & _fails(valid_identifier(F.col("property_id")))).alias("no_property"), F.max(needs).alias("certified"))
    pairs = loss.join(state.select("request_id", "state_id").distinct(), ["request_id", "state_id"], "left_semi").join(action.select("request_id", "action_id").distinct(), ["request_id", "action_id"], "left_semi")
    of_loss = loss.groupBy("request_id").agg(F.count("*").alias("losses"), F.max(_fails(F.col("loss") >= 0)).alias("bad_loss")).join(
        pairs.groupBy("request_id").agg(F.count_distinct("action_id", "state_id").alias("pairs")), "request_id", "left")
    rows = of_request
    for found in (of_state, of_action, of_loss):
        rows = rows.join(found, "request_id", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    rules = [
        (F.col("requests") > 1, "request"), (F.col("exactness"), "exactness"), ((count("states") > MOST) | (count("actions") > MOST), "size"), (no("same_state") | no("bad_state"), "state"), (_fails(F.col("sum") == F.col("total")) | _fails(F.col("sum") > 0), "distribution"),
        (no("same_action") | no("bad_action"), "action"), (no("same_certificate") | no("bad_certificate"), "certificate_id"), ((count("losses") != count("states") * count("actions")) | (count("pairs") != count("losses")) | no("bad_loss"), "loss"),
        (no("certified") & (no("no_subject") | no("no_property")), "binding"),
    ]
    faults = F.array_join(F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in rules]), lambda x: x.isNotNull()), ",")
    return rows.select("request_id", faults.alias("faults"), count("unresolved").alias("unresolved"))


def certificates(request: DataFrame, action: DataFrame, policy: Policy) -> DataFrame:
    """``action`` with certificate_status: too costly first, then the ordered checks of ``decision.certificate_status`` with every binding."""
    subjects = request.groupBy("request_id").agg(F.max("subject_sha256").alias("subject_sha256"))
    rows = action.join(subjects, "request_id")
    same = lambda a, b: F.coalesce(F.col(a) == b, F.lit(False))
    bound = same("for_action", F.col("action_id")) & same("for_subject", F.col("subject_sha256")) & same("for_claim", F.col("claim_sha256")) & same("for_property", F.col("property_id")) & same("verifier_id", F.lit(policy.verifier_id)) & same("verifier_version", F.lit(policy.verifier_version))
    rows = rows.withColumn("subject", F.when(bound, F.col("action_id")))
    checked = decision.certificate_status(rows, policy.now)
    return checked.withColumn("certificate_status", F.when(_fails(F.col("cost_num") <= F.col("cost_den")), "resource_limit").otherwise(F.col("certificate_status"))).drop("subject", "subject_sha256")


def decide(request: DataFrame, state: DataFrame, action: DataFrame, loss: DataFrame, policy: Policy) -> DataFrame:
    """One row for each request: status (selected, abstention, invalid), reason, action_id, best_num, best_den, unresolved."""
    faults = request_faults(request, state, action, loss)
    upstream = request.groupBy("request_id").agg(F.min(F.coalesce(F.col("upstream_status") == "success", F.lit(False))).alias("upstream"), F.min(F.coalesce(F.col("exactness") == "exact", F.lit(False))).alias("exact"), F.max("total").alias("total"))
    open_ = certificates(request, action, policy).where(F.col("certificate_status").isin("accepted", "not_required"))
    fine = faults.where("faults = ''").select("request_id")
    states, losses = state.join(fine, "request_id"), loss.join(fine, "request_id")
    risks = decision.expected_risks(states, open_.join(fine, "request_id"), losses, *policy.resource)
    best = decision.decide(risks, *policy.abstain).drop("decision").withColumn("known", F.lit(True))
    rows = faults.join(upstream, "request_id").join(best, "request_id", "left")
    over = F.col("unresolved") * policy.unresolved[1] > F.col("total") * policy.unresolved[0]
    reason = (F.when(~F.col("upstream"), "upstream").when(F.lit(policy.exact_only) & ~F.col("exact"), "not_exact").when(F.col("faults") != "", F.col("faults")).when(over, "unresolved")
              .when(F.col("known").isNull(), "no_admissible").when(F.col("action_id").isNull(), "risk").otherwise("least_risk"))
    gone = ~F.col("upstream") | (F.lit(policy.exact_only) & ~F.col("exact"))
    status = F.when(gone, "abstention").when(F.col("faults") != "", "invalid").when(reason == "least_risk", "selected").otherwise("abstention")
    ranked = status.isin("selected") | (reason == "risk")
    return rows.select("request_id", status.alias("status"), reason.alias("reason"), F.when(status == "selected", F.col("action_id")).alias("action_id"), F.when(ranked, F.col("best_num")).alias("best_num"), F.when(ranked, F.col("best_den")).alias("best_den"), F.col("unresolved").cast("long").alias("unresolved"))
