"""Validators: belief definitions, identity bindings, finite tasks, features, detectors.  Each says what is wrong, and null never passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrack.functions.scalars import PARTITIONS, valid_identifier

#: most variables, clauses and literals of an eligible formula (fixed values)
FEATURE_CAPS = {"variables": 1_000_000, "clauses": 10_000_000, "literals": 100_000_000}


def _fails(condition: Column) -> Column:
    """True unless the condition is known to be false."""
    return F.coalesce(condition, F.lit(True))


def feature_status(rows: DataFrame, schema_id: str, version: int) -> DataFrame:
    """rows: schema_id, schema_version, eligible, variables, clauses, literals.  Adds status: schema, ineligible, missing, over_cap or ok; nothing is imputed."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in FEATURE_CAPS])
    over = reduce(lambda a, b: a | b, [F.col(c) > most for c, most in FEATURE_CAPS.items()])
    schema = _fails((F.col("schema_id") != schema_id) | (F.col("schema_version") != version))
    return rows.withColumn("status", F.when(schema, "schema").when(_fails(~F.col("eligible")), "ineligible").when(missing, "missing").when(over, "over_cap").otherwise("ok"))


def detector_valid(configs: DataFrame) -> DataFrame:
    """configs: before, after, sigma, threshold, every, hold_off.  Adds valid: finite, after above before, the others positive."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    numbers = [F.col(c).cast("double") for c in ("before", "after", "sigma", "threshold")]
    before, after, sigma, threshold = numbers
    derived = [after - before, (after + before) / 2, sigma * sigma]
    ok = reduce(lambda a, b: a & b, [finite(x) for x in numbers + derived]) & (after > before) & (sigma > 0) & (sigma * sigma > 0) & (threshold > 0) & (F.col("every") > 0) & (F.col("hold_off") > 0)
    return configs.withColumn("valid", F.coalesce(ok, F.lit(False)))


def identity_status(bindings: DataFrame, sizes: DataFrame) -> DataFrame:
    """bindings: run_id, variable, resolution, entity_id, candidates, required; sizes: run_id, variables.  One row a binding with status.

    A variable is bound once, within range; a resolved identity has an entity
    and no candidates, an unresolved one no entity and valid candidates; a
    required identity must be resolved: none is chosen among candidates.
    """
    times = bindings.groupBy("run_id", "variable").agg(F.count("*").alias("_times"))
    rows = bindings.join(sizes, "run_id", "left").join(times, ["run_id", "variable"], "left")
    range_bad = _fails((F.col("variable") < 1) | (F.col("variable") > F.col("variables")) | (F.col("_times") > 1))
    resolved, candidates = F.col("resolution") == "resolved", F.coalesce("candidates", F.array().cast("array<string>"))
    bad = F.when(resolved, ~valid_identifier(F.col("entity_id")) | (F.size(candidates) > 0)).when(F.col("resolution") == "unresolved", F.col("entity_id").isNotNull() | F.exists(candidates, lambda c: ~valid_identifier(c)))
    status = F.when(range_bad | _fails(bad), "invalid_schema").when(F.coalesce("required", F.lit(True)) & ~resolved, "unsupported_input").otherwise("success")
    return rows.withColumn("status", status).select(*bindings.columns, "status")


def belief_issues(models: DataFrame, facts: DataFrame, priors: DataFrame, schema_id: str, most_facts: int = 63) -> DataFrame:
    """models: model_id, schema_id, partition, semantics, max_facts; facts: model_id, fact_id, predicate; priors: model_id, fact_id, false_weight, true_weight.

    model_id, issue, n: how often each rule is broken; a sound model has no row.
    """
    model = [
        (~valid_identifier(F.col("model_id")), "model_id"), (_fails(F.col("schema_id") != schema_id), "schema"),
        (_fails(~F.col("partition").isin(*PARTITIONS) | (F.col("partition") == "not_applicable")), "partition"),
        (_fails(F.col("semantics") != "open_world"), "semantics"), (_fails((F.col("max_facts") < 1) | (F.col("max_facts") > most_facts)), "limits"),
    ]
    listed = lambda rows, rules: rows.select("model_id", F.explode(F.array(*[F.when(c, F.lit(m)) for c, m in rules])).alias("issue")).where("issue IS NOT NULL").groupBy("model_id", "issue").agg(F.count("*").alias("n"))
    ids = facts.groupBy("model_id", "fact_id").agg(F.count("*").alias("facts"))
    given = priors.groupBy("model_id", "fact_id").agg(F.count("*").alias("priors"))
    both = ids.join(given, ["model_id", "fact_id"], "full")
    repeated = [
        (F.col("facts") > 1, "fact_repeated"), (F.col("priors") > 1, "prior_repeated"), (F.col("facts").isNull(), "prior_undeclared"), (F.col("priors").isNull(), "prior_missing"),
    ]
    found = listed(models, model).union(listed(both, repeated))
    found = found.union(listed(facts, [(~valid_identifier(F.col("fact_id")), "fact_id"), (~valid_identifier(F.col("predicate")), "predicate")]))
    return found.union(listed(priors, [(_fails((F.col("false_weight") < 0) | (F.col("true_weight") < 0)), "prior_weight")]))


def finite_task_status(variables: DataFrame, values: DataFrame, references: DataFrame, most_values: int = 4096) -> DataFrame:
    """variables: task_id, variable; values: task_id, variable, value, weight; references: task_id, variable, value (of evidence, query or constraints).

    task_id, status, undeclared, outside: variables must be valid and named
    once, domains neither empty nor repeated, weights not negative, and every
    reference must name a declared variable and a value of its domain.
    """
    named = variables.groupBy("task_id", "variable").agg(F.count("*").alias("times"))
    domain = values.groupBy("task_id", "variable", "value").agg(F.count("*").alias("times"), F.min("weight").alias("least"), F.count("weight").alias("given"))
    domains = domain.groupBy("task_id", "variable").agg(F.count("*").alias("size"), F.max(_fails((F.col("times") > 1) | (F.col("value") == "") | (F.col("given") < F.col("times")) | (F.col("least") < 0))).alias("bad"))
    per = named.join(domains, ["task_id", "variable"], "left").groupBy("task_id").agg(
        F.sum(F.coalesce("size", F.lit(0))).alias("n_values"), F.max((F.col("times") > 1) | ~valid_identifier(F.col("variable")) | F.col("size").isNull() | F.coalesce("bad", F.lit(False))).alias("bad"))
    asked = references.select("task_id", "variable", "value").distinct()
    undeclared = asked.join(named, ["task_id", "variable"], "left_anti").groupBy("task_id").agg(F.count("*").alias("undeclared"))
    outside = asked.join(named, ["task_id", "variable"], "left_semi").join(domain, ["task_id", "variable", "value"], "left_anti").groupBy("task_id").agg(F.count("*").alias("outside"))
    rows = per.join(undeclared, "task_id", "left").join(outside, "task_id", "left").na.fill(0, ["undeclared", "outside"])
    status = F.when(F.col("bad") | (F.col("undeclared") + F.col("outside") > 0), "invalid_schema").when(F.col("n_values") > most_values, "resource_limit").otherwise("success")
    return rows.select("task_id", status.alias("status"), "undeclared", "outside")


def snapshot_issues(snapshot: DataFrame, ids: DataFrame) -> DataFrame:
    """snapshot: stream_id, kind (global, context, previous), key, seen, completed; ids: stream_id, observation_id.

    stream_id, issues: what a restore must refuse; a sound snapshot has no row.
    """
    keys = snapshot.groupBy("stream_id", "kind", "key").agg(F.count("*").alias("times"), F.sum("seen").alias("seen"), F.sum("completed").alias("completed"), F.max(_fails((F.col("completed") > F.col("seen")) | (F.col("seen") < 0) | (F.col("completed") < 0))).alias("bad"))
    total = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))
    per = keys.groupBy("stream_id").agg(
        F.max(F.col("times") > 1).alias("repeated"), F.max("bad").alias("bad"), F.count_if(F.col("kind") == "global").alias("globals"),
        *[total(k, c).alias(f"{k}_{c}") for k in ("global", "context", "previous") for c in ("seen", "completed")])
    accepted = ids.groupBy("stream_id").agg(F.count("*").alias("ids"), F.count_distinct("observation_id").alias("different"), F.max(~valid_identifier(F.col("observation_id"))).alias("bad_id"))
    rows = per.join(accepted, "stream_id", "full")
    apart = lambda kind: (F.col(f"{kind}_seen") != F.col("global_seen")) | (F.col(f"{kind}_completed") != F.col("global_completed"))
    rules = [
        (_fails(F.col("repeated")), "repeated_key"), (_fails(F.col("bad")), "counts"), (_fails(F.col("globals") != 1), "global"), (_fails(apart("context")), "context_total"), (_fails(apart("previous")), "previous_total"),
        (F.coalesce("ids", F.lit(0)) != F.coalesce("global_seen", F.lit(0)), "id_total"), (F.coalesce(F.col("ids") != F.col("different"), F.lit(False)), "repeated_id"), (F.coalesce("bad_id", F.lit(False)), "id"),
    ]
    issues = F.array_join(F.sort_array(F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in rules]), lambda x: x.isNotNull())), ",")
    return rows.select("stream_id", issues.alias("issues")).where("issues <> ''")
