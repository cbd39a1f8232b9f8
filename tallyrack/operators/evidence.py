"""Rules for evidence before it enters a belief model: ids, times, tables, and how rows depend on earlier ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrack.functions.scalars import valid_identifier, valid_text, valid_timestamp

SEMANTICS = ("likelihood", "hard_constraint")
DEPENDENCE = ("independent", "model_factor", "exact_duplicate", "correlated", "unknown")
RELATIONS = ("exact_duplicate", "correlated", "unknown")
LINK = "array<struct<evidence_id:string,relation:string>>"
TABLE = "array<struct<num:decimal(38,0),den:decimal(38,0)>>"


def evidence_issues(evidence: DataFrame, models: DataFrame, facts: DataFrame, most_bits: int = 120, most_scope: int = 62) -> DataFrame:
    """model_id, ordinal, evidence_id, issues (sorted, without repeats) and ok of each row of ``evidence``.

    evidence: model_id, ordinal (the place in the model's ledger, not repeated),
    evidence_id, source_id, observed_at, reference, extractor, partition,
    semantics, dependence, scope (fact ids), likelihood (one fraction num/den
    in lowest terms per world of the scope), dependencies (evidence_id,
    relation); models: model_id, partition; facts: model_id, fact_id.

    Every row counts as part of the ledger, sound or not; a parent is the first
    row of its id and must come earlier.  Null arrays are empty, any other null
    breaks its rule; without a model or ordinal the rules that need other rows
    are not asked.  The factors of duplicates meet by SHA-256.  Facts and
    parents are joined on the exploded scopes and links, so a row moves once
    for each of them, and the verdicts come back as one row per evidence.
    """
    table = F.coalesce(F.col("likelihood").cast(TABLE), F.array().cast(TABLE))
    scope = F.coalesce(F.col("scope").cast("array<string>"), F.array().cast("array<string>"))
    links = F.coalesce(F.col("dependencies").cast(LINK), F.array().cast(LINK))
    rows = evidence.select("model_id", "ordinal", *[F.col(c).cast("string").alias(c) for c in ("evidence_id", "source_id", "observed_at", "reference", "extractor", "partition", "semantics", "dependence")], scope.alias("scope"), table.alias("table"), links.alias("links"))
    factor = F.sha2(F.to_json(F.struct("semantics", "scope", "table")), 256)
    rows = rows.withColumn("factor", factor)
    known = lambda c, names: F.coalesce(c.isin(*names), F.lit(False))
    fails = lambda c: F.coalesce(c, F.lit(True))
    hard, kind = F.col("semantics").eqNullSafe("hard_constraint"), F.col("dependence")
    other_links = lambda relation: F.exists("links", lambda x: ~x["relation"].eqNullSafe(relation))
    bound = F.lit(str(2**most_bits)).cast("decimal(38,0)")
    wrong_links = (
        F.when(kind == "independent", F.size("links") > 0)
        .when(kind == "exact_duplicate", (F.size("links") != 1) | other_links("exact_duplicate"))
        .when(kind == "model_factor", ~hard | (F.size("links") > 0))
        .when(kind == "correlated", (F.size("links") == 0) | other_links("correlated"))
        .when(kind == "unknown", other_links("unknown")))
    rules = [
        (F.col("ordinal").isNull(), "ordinal"), (~valid_identifier(F.col("evidence_id")), "evidence_id"), (~valid_identifier(F.col("source_id")), "source_id"),
        (~valid_timestamp(F.col("observed_at")), "observed_at"), (~valid_text(F.col("reference"), 1024), "reference"), (~valid_text(F.col("extractor"), 128), "extractor"),
        (~known(F.col("semantics"), SEMANTICS), "semantics"), (~known(kind, DEPENDENCE), "dependence"),
        ((F.size("scope") > most_scope) | (F.size("table") != F.pow(F.lit(2.0), F.size("scope"))), "table_size"),
        ((F.size(F.array_distinct("scope")) < F.size("scope")) | F.exists("scope", lambda x: ~valid_identifier(x)), "scope"),
        (F.exists("table", lambda x: fails((x["num"] < 0) | (x["den"] <= 0))), "likelihood"),
        (F.exists("table", lambda x: F.coalesce((F.abs(x["num"]) >= bound) | (x["den"] >= bound), F.lit(False))), "bits"),
        (hard & F.exists("table", lambda x: fails((x["num"] != 0) & (x["num"] != x["den"]))), "hard_values"),
        ((F.size(F.array_distinct(F.transform("links", lambda x: x["evidence_id"]))) < F.size("links")) | F.exists("links", lambda x: ~valid_identifier(x["evidence_id"])), "dependency_id"),
        (F.exists("links", lambda x: ~known(x["relation"], RELATIONS)), "relation"),
        (F.coalesce(wrong_links, F.lit(False)), "links"),
    ]
    own = F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in rules]), lambda x: x.isNotNull())

    belongs = models.groupBy("model_id").agg(F.min("partition").alias("_own"), F.max("partition").alias("_most"))
    first = rows.groupBy("model_id", "evidence_id").agg(F.min_by("factor", "ordinal").alias("_factor"), F.min("ordinal").alias("_first"))
    where = ["model_id", "ordinal"]
    declared = facts.select("model_id", F.col("fact_id").cast("string").alias("fact")).distinct()
    strange = rows.select(*where, F.explode("scope").alias("fact")).join(declared, ["model_id", "fact"], "left_anti").select(*where, F.lit("scope").alias("issue"))
    parent = first.select("model_id", F.col("evidence_id").alias("parent"), F.col("_first").alias("_at"), "_factor")
    asked = rows.select(*where, "dependence", "factor", F.size("links").alias("n"), F.explode("links").alias("x")).select(*where, "dependence", "factor", "n", F.col("x.evidence_id").alias("parent"), F.col("x.relation").alias("relation")).join(parent, ["model_id", "parent"], "left")
    late = F.coalesce(F.col("_at") >= F.col("ordinal"), F.lit(True))
    apart = (F.col("dependence") == "exact_duplicate") & (F.col("n") == 1) & (F.col("relation") == "exact_duplicate") & ~late & (F.col("factor") != F.col("_factor"))
    linked = asked.select(*where, F.explode(F.array(F.when(late, F.lit("parent")), F.when(apart, F.lit("duplicate_factor")))).alias("issue")).where("issue IS NOT NULL")
    again = rows.join(first, ["model_id", "evidence_id"]).where("ordinal > _first").select(*where, F.lit("evidence_id_repeated").alias("issue"))
    found = strange.unionByName(linked).unionByName(again).groupBy(*where).agg(F.collect_set("issue").alias("_found"))  # four names at most

    judged = rows.select(*where, "evidence_id", "partition", own.alias("_own_issues")).join(found, where, "left").join(belongs, "model_id", "left")
    placed = F.when(F.col("_own").isNull() | (F.col("_own") != F.col("_most")), F.array(F.lit("model"))).when(~F.col("partition").eqNullSafe(F.col("_own")), F.array(F.lit("partition"))).otherwise(F.array().cast("array<string>"))
    issues = F.sort_array(F.array_distinct(F.concat("_own_issues", F.coalesce("_found", F.array().cast("array<string>")), placed)))
    return judged.select(*where, "evidence_id", issues.alias("issues")).withColumn("ok", F.size("issues") == 0)
