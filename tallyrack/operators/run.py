"""End-to-end runs: formula in, decision and manifest out; and the belief view of a formula."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrack.operators.wmc import exact_counts


def run_formulas(formulas: DataFrame, build_id: str, wall_limit_nodes: int = 10_000_000) -> DataFrame:
    """formulas: formula_id, text, partition.  One manifest row per formula.

    The partition gate comes before anything that reads the text.  A result is
    emitted only when exact; the risk of emitting is 0 then and 1 otherwise, so
    other outcomes abstain.
    """
    gate = F.col("partition").isin("development", "final_test", "not_applicable")
    shut = formulas.where(~gate).select("formula_id", F.lit("unauthorized").alias("status"), F.lit(None).cast("string").alias("num"), F.lit(None).cast("string").alias("den"), F.lit(0).cast("long").alias("nodes"), F.lit(None).cast("string").alias("input_sha256"))
    solved = exact_counts(formulas.where(gate), node_limit=wall_limit_nodes).select("formula_id", "status", "num", "den", "nodes")
    digests = formulas.where(gate).select("formula_id", F.sha2("text", 256).alias("input_sha256"))
    rows = solved.join(digests, "formula_id").unionByName(shut)
    exact = F.col("status") == "success"
    rows = rows.select("*", F.when(exact, "act").otherwise("abstain").alias("decision"), F.when(exact, "exact").otherwise("not_applicable").alias("exactness"), F.lit(build_id).alias("build_id"))
    payload = F.concat_ws("|", "formula_id", "status", F.coalesce("num", F.lit("")), F.coalesce("den", F.lit("")), "decision", F.coalesce("input_sha256", F.lit("")), "build_id")
    return rows.withColumn("semantic_sha256", F.sha2(payload, 256))


def clause_factors(literals: DataFrame, most: int = 16) -> DataFrame:
    """literals: formula_id, clause_id, lit.  formula_id, clause_id, scope, table, duplicate_of.

    Each clause becomes a 0/1 table over its variables (by variable, negative
    first; the first is the lowest bit); a repeated clause points to its first.
    A clause over more than ``most`` variables has no table (null).
    """
    sets = literals.groupBy("formula_id", "clause_id").agg(F.array_sort(F.collect_set("lit"), lambda a, b: F.when(F.abs(a) != F.abs(b), F.abs(a) - F.abs(b)).otherwise(a - b)).alias("lits"))
    scope = F.array_distinct(F.transform("lits", lambda x: F.abs(x)))
    world = F.sequence(F.lit(0), F.pow(F.lit(2), F.least(F.size("scope"), F.lit(most))).cast("int") - 1)
    holds = lambda w: F.exists("lits", lambda x: F.floor(w / F.pow(F.lit(2), F.array_position("scope", F.abs(x)) - 1)).cast("int") % 2 == F.when(x > 0, 1).otherwise(0))
    rows = sets.withColumn("scope", scope).withColumn("table", F.when(F.size("scope") <= most, F.transform(world, lambda w: F.when(holds(w), 1).otherwise(0))))
    key = F.array_join(F.col("lits").cast("array<string>"), " ")
    first = rows.groupBy("formula_id", key.alias("key")).agg(F.min("clause_id").alias("first"))
    return rows.withColumn("key", key).join(first, ["formula_id", "key"]).select("formula_id", "clause_id", "scope", "table", F.when(F.col("first") != F.col("clause_id"), F.col("first")).alias("duplicate_of"))
