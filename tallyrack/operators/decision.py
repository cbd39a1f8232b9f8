"""Risk-minimising decisions with certificates and abstention, in exact integers.

state: request_id, state_id, weight (integer share of the request's total);
action: request_id, action_id, priority, cost_num, cost_den;
loss: request_id, action_id, state_id, loss (integer).
Risk = sum(weight * loss) / total + lambda * cost, compared by cross-multiplying.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def certificate_status(rows: DataFrame, now: int) -> DataFrame:
    """Ordered checks: missing, invalid, stale, mismatch, rejected, accepted.

    The gate is shut unless proved open: a check whose input is null fails, and
    a null requirement counts as one.
    """
    fails = lambda c: F.coalesce(c, F.lit(True))
    malformed = fails(~F.col("digest").rlike(r"\A[0-9a-f]{64}\z")) | fails(F.col("valid_from") > F.col("valid_to"))
    status = (F.when(~fails(F.col("requires_certificate")), "not_required").when(F.col("certificate_id").isNull(), "missing").when(malformed, "invalid")
              .when((F.col("valid_from") > now) | (F.col("valid_to") < now), "stale").when(fails(F.col("subject") != F.col("action_id")), "mismatch")
              .when(fails(~F.col("verified")), "rejected").otherwise("accepted"))
    return rows.withColumn("certificate_status", status)


def resource_cost(rows: DataFrame, cpu_budget_ms: int = 600_000, memory_budget: int = 4 << 30) -> DataFrame:
    """rows: cpu_ms, peak_bytes.  Adds cost_num / cost_den: the larger share of its budget, compared by cross-multiplying and reduced."""
    cpu, memory = F.col("cpu_ms").cast("decimal(38,0)") * memory_budget, F.col("peak_bytes").cast("decimal(38,0)") * cpu_budget_ms
    num, den = F.when(cpu > memory, F.col("cpu_ms")).otherwise(F.col("peak_bytes")), F.when(cpu > memory, F.lit(cpu_budget_ms)).otherwise(F.lit(memory_budget))
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    steps = F.sequence(F.lit(1), F.lit(64))  # Euclid needs fewer for such denominators
    gcd = F.aggregate(steps, pair(num.cast("long"), den.cast("long")), lambda p, _: F.when(p["b"] == 0, p).otherwise(pair(p["b"], p["a"] % p["b"])), lambda p: p["a"])
    rows = rows.withColumn("_gcd", gcd)
    return rows.withColumn("cost_num", F.floor(num / F.col("_gcd")).cast("long")).withColumn("cost_den", F.floor(den / F.col("_gcd")).cast("long")).drop("_gcd")


def expected_risks(state: DataFrame, action: DataFrame, loss: DataFrame, lambda_num: int, lambda_den: int) -> DataFrame:
    """risk_num / risk_den of every action that costs at most 1 and has a loss for every state."""
    total = state.groupBy("request_id").agg(F.sum("weight").alias("total"), F.count("*").alias("states"))
    summed = loss.join(state, ["request_id", "state_id"]).groupBy("request_id", "action_id").agg(F.sum(F.col("weight") * F.col("loss")).alias("mass"), F.count("*").alias("covered"))
    rows = action.join(summed, ["request_id", "action_id"], "left").join(total, "request_id")
    rows = rows.withColumn("status", F.when(F.col("cost_num") > F.col("cost_den"), "too_costly").when(F.coalesce("covered", F.lit(0)) < F.col("states"), "invalid_schema").otherwise("admissible"))
    num = F.col("mass") * F.col("cost_den") * lambda_den + F.col("total") * F.col("cost_num") * lambda_num
    return rows.select("request_id", "action_id", "priority", "status", num.cast("decimal(38,0)").alias("risk_num"), (F.col("total") * F.col("cost_den") * lambda_den).cast("decimal(38,0)").alias("risk_den"))


def decide(risks: DataFrame, abstain_num: int, abstain_den: int) -> DataFrame:
    """Least risk, then priority, then id; abstain if it is not below the abstention risk.

    Risks are compared by cross-multiplying, so any denominators may meet; a
    product past 38 digits raises.  A request has at most some hundred actions.
    """
    ok = risks.where("status = 'admissible'")
    actions = F.collect_list(F.struct("risk_num", "risk_den", "priority", "action_id"))

    def order(a, b):
        left, right = a["risk_num"] * b["risk_den"], b["risk_num"] * a["risk_den"]
        by = lambda x, y, rest: F.when(x < y, F.lit(-1)).when(x > y, F.lit(1)).otherwise(rest)
        return by(left, right, by(a["priority"], b["priority"], by(a["action_id"], b["action_id"], F.lit(0))))

    best = ok.groupBy("request_id").agg(F.get(F.array_sort(actions, order), F.lit(0)).alias("b"))
    abstains = F.col("b.risk_num") * abstain_den >= F.col("b.risk_den") * abstain_num
    return best.select("request_id", F.when(abstains, "abstain").otherwise("act").alias("decision"), F.when(~abstains, F.col("b.action_id")).alias("action_id"), F.col("b.risk_num").cast("long").alias("best_num"), F.col("b.risk_den").cast("long").alias("best_den"))
