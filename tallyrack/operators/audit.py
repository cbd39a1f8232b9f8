"""Corpus and benchmark audits: duplicates, leakage, roll-ups, attempt summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrack.operators import similarity


def exact_duplicates(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Digest groups with more than one row: digest, n, first_id."""
    return rows.groupBy(F.sha2(F.col(text_col), 256).alias("digest")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).where("n > 1")


def near_duplicates(rows: DataFrame, percent: int = 95) -> DataFrame:
    """rows: id, elements (array<string>) and, if given, kind; ids may repeat or be null.

    Pairs of classes of equal element sets, of one kind, whose Jaccard is at
    least ``percent``: kind, a, b (least ids, a first), n_a, n_b (rows), shared,
    jaccard.  Copies are one class, so they make no pairs among themselves.
    """
    kind = F.col("kind") if "kind" in rows.columns else F.lit(0)
    signed = rows.select("id", kind.alias("kind"), similarity.distinct_elements(F.col("elements")).alias("elements")).withColumn("set", similarity.set_digest(F.col("elements")))
    links = similarity.set_links(signed, signed, percent, once=True)
    least = signed.groupBy("kind", "set").agg(F.min("id").alias("id"))
    for side in ("left", "right"):
        name = least.select(F.col("kind").alias("k"), F.col("set").alias(f"{side}_set"), F.col("id").alias(f"{side}_id"))
        links = links.join(name, [f"{side}_set"]).where(F.col("k").eqNullSafe(F.col("kind"))).drop("k")
    swap = F.coalesce(F.col("left_id") > F.col("right_id"), F.col("left_id").isNull())
    pick = lambda c, first: F.when(swap == first, F.col(f"right_{c}")).otherwise(F.col(f"left_{c}"))
    return links.select("kind", pick("id", True).alias("a"), pick("id", False).alias("b"), pick("n", True).alias("n_a"), pick("n", False).alias("n_b"), "shared", "jaccard")


def near_formulas(stats: DataFrame, percent: int = 95) -> DataFrame:
    """stats: rows of ``archive.audit_formulas``.  Pairs of parsed formulas over equally many variables whose distinct clauses are alike (see ``near_duplicates``)."""
    parsed = stats.where("status = 'success'")
    return near_duplicates(parsed.select(F.col("formula_id").alias("id"), F.col("variables").alias("kind"), F.col("clause_hashes").alias("elements")), percent).withColumnRenamed("kind", "variables")


def leakage(public: DataFrame, held_out: DataFrame, reasons: dict[str, tuple[str, str]]) -> DataFrame:
    """public_id, held_id, reasons: a union of equi-joins, one per reason (column of either side)."""
    found = None
    for reason, (left, right) in reasons.items():
        one = public.select("public_id", F.explode(left).alias("k")).join(held_out.select("held_id", F.explode(right).alias("k")), "k").select("public_id", "held_id", F.lit(reason).alias("reason"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("public_id", "held_id").agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))


def numeric_stats(rows: DataFrame, group: str, value: str) -> DataFrame:
    """count, least, upper median (values[n div 2]), greatest, total of each group.

    Values are counted before they are ranked.
    """
    counted = rows.groupBy(group, value).agg(F.count("*").alias("c"))
    by = W.partitionBy(group)
    ranked = counted.select("*", F.sum("c").over(by.orderBy(value)).alias("upto"), F.sum("c").over(by).alias("n"))
    median = F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col(value)))
    return ranked.groupBy(group).agg(F.max("n").alias("n"), F.min(value).alias("least"), median.alias("upper_median"), F.max(value).alias("greatest"), F.sum(F.col(value) * F.col("c")).alias("total"))


def classify_attempts(attempts: DataFrame) -> DataFrame:
    """attempts: exit_code, timed_out, killed, output.  system_status; output of a failed run is never a result."""
    status = (F.when(F.col("timed_out"), "timeout").when(F.col("killed"), "memory_limit").when(~F.col("exit_code").isin(0, 10, 20), "error")
              .when(F.col("output").rlike(r"(?m)^s UNSATISFIABLE$"), "exact").when(F.col("output").rlike(r"(?m)^c s exact \S+ int [0-9]+$"), "exact").otherwise("no_result"))
    count = F.when(F.col("output").rlike(r"(?m)^s UNSATISFIABLE$"), F.lit("0")).otherwise(F.nullif(F.regexp_extract("output", r"(?m)^c s exact \S+ int ([0-9]+)$", 1), F.lit("")))
    return attempts.withColumn("system_status", status).withColumn("exact_count", F.when(F.col("system_status") == "exact", count))


def bench_summary(attempts: DataFrame) -> DataFrame:
    """Per system: runs, solved, true median and greatest wall time, greatest memory."""
    return attempts.groupBy("system").agg(
        F.count("*").alias("runs"), F.count_if(F.col("system_status") == "exact").alias("solved"), F.percentile("wall_ms", 0.5).alias("median_wall"),
        F.max("wall_ms").alias("longest"), F.max("peak_rss").alias("peak_rss"))


def status_histogram(attempts: DataFrame) -> DataFrame:
    """system, system_status, n."""
    return attempts.groupBy("system", "system_status").agg(F.count("*").alias("n"))


def compare_systems(attempts: DataFrame, baseline: str) -> DataFrame:
    """Per other system: both_completed, verified (equal exact counts), mismatched, and the share of verified among both.

    attempts: case_id, system, system_status, exact_count; one row for each case and system.
    """
    exact = attempts.where("system_status = 'exact'")
    base = exact.where(F.col("system") == baseline).select("case_id", F.col("exact_count").alias("base"))
    other = attempts.where(F.col("system") != baseline).join(base, "case_id", "left")
    both = (F.col("system_status") == "exact") & F.col("base").isNotNull()
    same = both & (F.col("exact_count") == F.col("base"))
    out = other.groupBy("system").agg(F.count("*").alias("runs"), F.count_if(both).alias("both_completed"), F.count_if(same).alias("verified"))
    return out.withColumn("mismatched", F.col("both_completed") - F.col("verified")).withColumn("share", F.when(F.col("both_completed") > 0, F.col("verified") / F.col("both_completed")))


def evaluation_gate(attempts: DataFrame, expected: int, baseline: str) -> DataFrame:
    """One row: records, complete (every expected case once in each system), mismatches, verified, passed."""
    per = attempts.groupBy("system", "case_id").agg(F.count("*").alias("n")).groupBy("system").agg(F.count("*").alias("cases"), F.max("n").alias("most"))
    whole = per.agg(F.coalesce(F.min((F.col("cases") == expected) & (F.col("most") == 1)), F.lit(False)).alias("complete"), F.coalesce(F.max("cases"), F.lit(0)).alias("records"))
    found = compare_systems(attempts, baseline).agg(F.coalesce(F.sum("mismatched"), F.lit(0)).alias("mismatches"), F.coalesce(F.sum("verified"), F.lit(0)).alias("verified"))
    rows = whole.join(found, F.lit(True))  # one row each
    return rows.select("records", "complete", "mismatches", "verified", (F.col("complete") & (F.col("mismatches") == 0) & (F.col("verified") > 0)).alias("passed"))


def origin_counts(sources: DataFrame) -> DataFrame:
    """sources: sources array<string>.  origin (first word of a record) and how many records name it."""
    first = sources.select(F.explode("sources").alias("record")).select(F.get(F.split(F.trim("record"), r"\s+"), F.lit(0)).alias("origin"))
    return first.where("origin <> ''").groupBy("origin").agg(F.count("*").alias("n"))


def invariance(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Whether all members of a group have one value."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), (F.countDistinct(value) == 1).alias("invariant"))
