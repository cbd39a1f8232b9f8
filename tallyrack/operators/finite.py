"""Exact finite-domain conditional mass as joins and one aggregate.

Domains are small DataFrames (value, integer weight); constraints are relations
of allowed tuples.  Joining along constraints first keeps Catalyst from ever
building the full product where relations already restrict it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conditional_mass(domains: dict[str, DataFrame], allowed: list[DataFrame], evidence: Column | None = None, query: Column | None = None) -> DataFrame:
    """One row: numerator, denominator (decimal), satisfiable, status.

    domains: variable -> DataFrame(<variable>, w_<variable>); allowed: relations
    whose columns are variables.  An empty set of variables has one assignment.
    """
    evidence, query = evidence if evidence is not None else F.lit(True), query if query is not None else F.lit(True)
    rows, seen, left = None, set(), [r.distinct() for r in allowed]
    while left:  # a relation that shares a variable comes before one that shares none
        at = next((i for i, r in enumerate(left) if seen & set(r.columns)), 0)
        relation = left.pop(at)
        shared = [c for c in relation.columns if c in seen]
        rows = relation if rows is None else rows.join(relation, shared) if shared else rows.join(relation, F.lit(True))
        seen |= set(relation.columns)
    for name, domain in domains.items():
        rows = domain if rows is None else rows.join(domain, name) if name in seen else rows.join(domain, F.lit(True))
        seen.add(name)
    weight = reduce(lambda a, b: (a * b).cast("decimal(38,0)"), [F.col(f"w_{n}").cast("decimal(38,0)") for n in domains]) if domains else F.lit(1).cast("decimal(38,0)")
    zero = F.lit(0).cast("decimal(38,0)")
    got = rows.where(evidence).agg(F.coalesce(F.sum(F.when(query, weight)), zero).alias("numerator"), F.coalesce(F.sum(weight), zero).alias("denominator"), (F.count("*") > 0).alias("satisfiable"))
    status = F.when(~F.col("satisfiable"), "inconsistent").when(F.col("denominator") == 0, "zero_normalizer").otherwise("success")
    return got.withColumn("status", status)


def worlds(spark, bits: int) -> DataFrame:
    """All Boolean assignments of up to 24 facts as packed integers."""
    if bits > 24:
        raise ValueError("resource_limit: over 2**24 worlds")
    return spark.range(1 << bits).select(F.col("id").alias("world"))


def belief_marginals(spark, priors: list[tuple[int, int]], factors: list[tuple[list[int], list[int]]]) -> DataFrame:
    """fact, mass_true, mass (sum over worlds of prior x factors), one row per fact.

    priors: integer weights (false, true); factors: scope (first is the lowest
    bit) and integer table over the scope's bits.
    """
    bit = lambda i: F.shiftright("world", i).bitwiseAND(F.lit(1))
    terms = [F.when(bit(i) == 1, F.lit(w1)).otherwise(F.lit(w0)) for i, (w0, w1) in enumerate(priors)]
    for scope, table in factors:
        index = sum((bit(v) * (1 << k) for k, v in enumerate(scope)), F.lit(0))
        terms.append(F.get(F.array(*[F.lit(int(t)) for t in table]), index.cast("int")))
    mass = reduce(lambda a, b: (a * b).cast("decimal(38,0)"), [t.cast("decimal(38,0)") for t in terms])
    rows = worlds(spark, len(priors)).select("world", mass.alias("m"))
    facts = F.explode(F.array(*[F.struct(F.lit(i).alias("fact"), bit(i).alias("b")) for i in range(len(priors))])).alias("f")
    return rows.select(facts, "m").groupBy("f.fact").agg(F.sum(F.when(F.col("f.b") == 1, F.col("m")).otherwise(0)).cast("decimal(38,0)").alias("mass_true"), F.sum("m").cast("decimal(38,0)").alias("mass"))
