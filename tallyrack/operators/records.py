"""Record envelopes: validation issues, lineage edges, evidence ledgers, job and resume helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrack.functions.scalars import PARTITIONS, valid_identifier


def validate_records(rows: DataFrame) -> DataFrame:
    """rows: record_id, status, exactness, partition, partition_id, has_result, n_errors, n_warnings, used, budget.  Adds issues (sorted) and ok."""
    ok_result = F.col("status").isin("success", "approximate")
    named = F.col("partition") != "not_applicable"
    rules = [
        (~valid_identifier(F.col("record_id")), "record_id"),
        (~F.col("partition").isin(*PARTITIONS), "partition"),
        (named & F.col("partition_id").isNull(), "partition_id_missing"),
        (ok_result & ~F.col("has_result"), "result_missing"),
        (~ok_result & F.col("has_result"), "result_forbidden"),
        (~ok_result & (F.col("n_errors") == 0), "error_missing"),
        ((F.col("status") == "success") & (F.col("n_errors") > 0), "error_forbidden"),
        ((F.col("status") == "approximate") & (F.col("n_warnings") == 0), "warning_missing"),
        (~ok_result & (F.col("exactness") != "not_applicable"), "exactness"),
        (F.col("budget").isNotNull() & (F.col("used") > F.col("budget")), "budget_exceeded"),
    ]
    issues = F.sort_array(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in rules]), lambda x: x.isNotNull()))
    return rows.withColumn("issues", issues).withColumn("ok", F.size("issues") == 0)


def lineage_edges(rows: DataFrame) -> DataFrame:
    """rows: record_id, lineage array<struct<kind,id,relation>>.  One row per edge, in order."""
    return rows.select("record_id", F.posexplode("lineage").alias("ord", "e")).select("record_id", "ord", "e.kind", "e.id", "e.relation")


def validate_ledger(evidence: DataFrame) -> DataFrame:
    """evidence: model_id, ordinal, evidence_id, dependence, parent_id (nullable), factor_key.

    One status a row.  A parent must be an earlier row of the model, the first
    of its id; an exact duplicate must have its parent's factor; correlated or
    unknown dependence is not supported.
    """
    nth = F.row_number().over(W.partitionBy("model_id", "evidence_id").orderBy("ordinal"))
    rows = evidence.withColumn("_nth", nth)
    parent = rows.where("_nth = 1").select("model_id", F.col("evidence_id").alias("parent_id"), F.col("ordinal").alias("parent_ordinal"), F.col("factor_key").alias("parent_factor"))
    rows = rows.join(parent, ["model_id", "parent_id"], "left")
    late = F.col("parent_id").isNotNull() & (F.col("parent_ordinal").isNull() | (F.col("parent_ordinal") >= F.col("ordinal")))
    status = (F.when(F.col("_nth") > 1, "duplicate_id").when(F.col("evidence_id").isNull() | late, "invalid_schema").when(F.coalesce(F.col("dependence").isin("correlated", "unknown"), F.lit(True)), "unsupported_input")
              .when((F.col("dependence") == "exact_duplicate") & F.col("parent_id").isNull(), "invalid_schema")
              .when((F.col("dependence") == "exact_duplicate") & ~F.col("factor_key").eqNullSafe(F.col("parent_factor")), "invalid_schema").otherwise("success"))
    return rows.select("model_id", "ordinal", "evidence_id", status.alias("status"))


def match_schema(rows: DataFrame, schema_id: str, version: int) -> DataFrame:
    """Rows of exactly this schema and version; nothing is migrated."""
    return rows.where((F.col("schema_id") == schema_id) & (F.col("schema_version") == version))


def parity_split(rows: DataFrame, name: str) -> DataFrame:
    """Adds number (the last digits of the name before an extension) and split: public if even, held_out if odd, none without a number."""
    number = F.nullif(F.regexp_extract(name, r"([0-9]+)[^0-9/]*$", 1), F.lit("")).cast("long")
    return rows.withColumn("number", number).withColumn("split", F.when(number % 2 == 0, "public").when(number % 2 == 1, "held_out"))


def remaining(planned: DataFrame, done: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """What is left to run: planned less finished less excluded."""
    return planned.join(done.select(key), key, "left_anti").join(excluded.select(key), key, "left_anti")


def set_difference_report(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """key, side ('missing' or 'unexpected')."""
    e, o = expected.select(key).distinct(), observed.select(key).distinct()
    return e.join(o, key, "left_anti").select(key, F.lit("missing").alias("side")).union(o.join(e, key, "left_anti").select(key, F.lit("unexpected").alias("side")))


def select_jobs(jobs: DataFrame, prefix: str) -> DataFrame:
    """Jobs whose name has the prefix, with their order: numeric suffix (none last), then name."""
    number = F.nullif(F.regexp_extract("name", r"([0-9]+)$", 1), F.lit("")).cast("long")
    return jobs.where(F.col("name").startswith(prefix)).withColumn("suffix", number)


def worker_summary(jobs: DataFrame, now: str) -> DataFrame:
    """One row: jobs by state and the longest running time in seconds."""
    running = F.col("state") == "in_progress"
    elapsed = F.greatest(F.lit(0).cast("long"), F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("started"))
    return jobs.agg(F.count("*").alias("total"), F.count_if(F.col("state") == "queued").alias("queued"), F.count_if(running).alias("running"), F.count_if(F.col("state") == "completed").alias("completed"), F.max(F.when(running, elapsed)).alias("longest_running"))


def state_changes(polls: DataFrame) -> DataFrame:
    """polls: job, seq, state.  Rows whose state differs from the poll before."""
    before = F.lag("state").over(W.partitionBy("job").orderBy("seq"))
    return polls.withColumn("before", before).where("before IS NULL OR before <> state")
