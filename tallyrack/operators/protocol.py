"""A calibration run under a frozen protocol: what shuts it out, and one report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrack.functions.scalars import valid_identifier
from tallyrack.operators import calibration
from tallyrack.sources.shared import written

KINDS = ("synthetic_fixture", "authorized_evaluation")
REPORT = ["section", "item", "measure", "value", "note"]


@dataclass(frozen=True)
class Protocol:
    """What is fixed before any outcome is read; ids of the partitions come as DataFrames."""

    protocol_id: str
    protocol_version: str
    model_id: str
    build_id: str
    partition_id: str
    dataset_id: str
    dataset_version: str
    selection_policy: str
    evidence_kind: str = "synthetic_fixture"
    bins: int = 10
    least_subgroup: int = 30
    most_observations: int = 1 << 40
    most_label_bytes: int = 128
    alpha_percent: int = 10
    exchangeable: bool = False
    basis: str = ""


def _table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "issue string, n long")


def protocol_issues(spark: SparkSession, protocol: Protocol, ids: dict[str, DataFrame]) -> DataFrame:
    """issue, n; empty for a sound protocol.  ids: observation_id of ``fitting``, ``calibration`` and ``final_test``, which must be valid and apart."""
    texts = ("protocol_id", "protocol_version", "dataset_id", "dataset_version", "selection_policy")
    names = [(getattr(protocol, c) or "",) for c in ("model_id", "build_id", "partition_id")]
    bad_names = spark.createDataFrame(names, "name string").where(~valid_identifier(F.col("name"))).count()
    count = ids["calibration"].count()
    found = [
        ("metadata", sum(not getattr(protocol, c) for c in texts) + bad_names), ("evidence_kind", int(protocol.evidence_kind not in KINDS)), ("no_observations", int(count == 0)), ("too_many_observations", int(count > protocol.most_observations)),
        ("bins", int(not 1 <= protocol.bins <= 100)), ("limits", int(min(protocol.least_subgroup, protocol.most_observations, protocol.most_label_bytes) < 1 or protocol.most_label_bytes > 1024)),
        ("alpha", int(not 0 < protocol.alpha_percent < 100)), ("basis", int(protocol.exchangeable and not protocol.basis)), ("ids", calibration.overlapping_ids(ids).count()),
    ]
    return _table(spark, [x for x in found if x[1]])


def forecast_issues(protocol: Protocol, forecasts: DataFrame, ids: DataFrame) -> DataFrame:
    """forecasts: observation_id, partition, partition_id, p, subgroup; ids: observation_id of the frozen partition.  issue, n.

    Each frozen id must have one forecast and no other id any; a null subgroup is allowed.
    """
    key = F.col("observation_id").cast("string").alias("observation_id")
    p = F.col("p").cast("double")
    fails = lambda c: F.coalesce(c, F.lit(True))
    own = {
        "observation_id": ~valid_identifier(F.col("observation_id").cast("string")), "partition": fails((F.col("partition") != "calibration") | (F.col("partition_id") != protocol.partition_id)),
        "probability": fails(F.isnan(p) | (p < 0) | (p > 1)), "subgroup": F.coalesce(F.octet_length("subgroup") > protocol.most_label_bytes, F.lit(False)),
    }
    counts = forecasts.agg(*[F.count_if(c).alias(n) for n, c in own.items()])
    met = forecasts.groupBy(key).agg(F.count("*").alias("n")).join(ids.select(key).distinct().withColumn("asked", F.lit(True)), "observation_id", "full")
    sets = met.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("asked").isNull()).alias("unexpected"))
    long = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("issue"), F.col(c).alias("n")) for c in df.columns])).alias("x")).select("x.*")
    return long(counts).unionByName(long(sets)).where("n > 0")


def _long(df: DataFrame, section: str, item: Column) -> DataFrame:
    """Every number of ``df`` but the item as a row of the report."""
    cells = [F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in df.columns if not c.startswith("_")]
    return df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), F.explode(F.array(*cells)).alias("x"), F.lit(None).cast("string").alias("note")).select("section", "item", "x.measure", "x.value", "note")


def report(protocol: Protocol, forecasts: DataFrame, ids: dict[str, DataFrame]) -> DataFrame:
    """section, item, measure, value, note: the whole report, or, where anything shuts it out, nothing but its issues.

    forecasts: observation_id, partition, partition_id, p, y, subgroup, shift.
    Sections: score, bin (counts of all forecasts as ``issued``), sharpness,
    subgroup, risk_coverage (item: the rank of a confidence's last row) and
    conformal, whose status is ``no_outcomes``, ``unsupported_assumption``
    (exchangeability isn't defended, so no threshold is given) or
    ``evaluated``; a threshold is infinite where its rank exceeds the outcomes.
    Nothing is scored before the protocol and all forecasts have passed.  The
    forecasts are written once; every section is an aggregate of that table.
    """
    spark = forecasts.sparkSession
    issues = protocol_issues(spark, protocol, ids).unionByName(forecast_issues(protocol, forecasts, ids["calibration"]))
    issues = written(issues.groupBy("issue").agg(F.sum("n").alias("n")), "protocol-issues")
    if issues.limit(1).count():
        return issues.select(F.lit("issue").alias("section"), F.col("issue").alias("item"), F.lit("n").alias("measure"), F.col("n").cast("double").alias("value"), F.lit(None).cast("string").alias("note"))
    rows = written(forecasts.select("observation_id", F.col("p").cast("double").alias("p"), "y", "subgroup", "shift"), "protocol-forecasts")
    bins = calibration.reliability(rows, protocol.bins).join(F.broadcast(calibration.histogram(rows, protocol.bins).select("bin", F.col("n").alias("issued"))), "bin", "left").withColumn("issued", F.coalesce("issued", F.lit(0)))  # a row per bin
    scores = calibration.proper_scores(rows).withColumnRenamed("score", "_item")
    groups = calibration.subgroups(rows, protocol.least_subgroup).withColumnRenamed("subgroup", "_item").withColumn("below_minimum", F.col("below_minimum").cast("int"))
    parts = [_long(scores, "score", F.col("_item")), _long(bins.withColumnRenamed("bin", "_item"), "bin", F.col("_item")), _long(calibration.sharpness(rows), "sharpness", F.lit("all")), _long(groups, "subgroup", F.col("_item"))]
    parts.append(_long(calibration.risk_coverage(rows).withColumn("_item", F.col("retained")), "risk_coverage", F.col("_item")))
    labelled = rows.where("y IS NOT NULL").limit(1).count()
    status = "no_outcomes" if not labelled else "evaluated" if protocol.exchangeable else "unsupported_assumption"
    if status == "evaluated":
        parts.append(_long(calibration.conformal_threshold(rows, protocol.alpha_percent), "conformal", F.lit("threshold")).withColumn("note", F.lit(protocol.basis)))
    parts.append(spark.createDataFrame([("conformal", "status", "alpha_percent", float(protocol.alpha_percent), status)], "section string, item string, measure string, value double, note string"))
    return reduce(DataFrame.unionByName, parts).select(*REPORT)
