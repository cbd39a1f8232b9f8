"""Calibration diagnostics of probability forecasts.

Forecasts: observation_id, p, y (boolean, null if missing), subgroup, shift.
Missing outcomes count in totals and sharpness, not in scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrack.functions.scalars import Z95, entropy, log_loss, prediction_set, valid_identifier, wilson
from tallyrack.sources.shared import written


def validate(forecasts: DataFrame) -> DataFrame:
    """Forecasts with status: invalid p or id, repeated id, else success."""
    again = F.row_number().over(W.partitionBy("observation_id").orderBy("p")) > 1
    bad = F.col("p").isNull() | F.isnan("p") | (F.col("p") < 0) | (F.col("p") > 1) | F.col("observation_id").isNull()
    return forecasts.withColumn("status", F.when(bad, "invalid_schema").when(again, "duplicate").otherwise("success"))


def overlapping_ids(partitions: dict[str, DataFrame]) -> DataFrame:
    """observation_id, n, partitions of ids that repeat within or across partitions, or are not valid; empty if all are apart."""
    every = None
    for name, rows in partitions.items():
        one = rows.select(F.col("observation_id").cast("string").alias("observation_id"), F.lit(name).alias("partition"))
        every = one if every is None else every.unionByName(one)
    found = every.groupBy("observation_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("partition")).alias("partitions"))
    return found.where((F.col("n") > 1) | ~valid_identifier(F.col("observation_id")))


def proper_scores(forecasts: DataFrame) -> DataFrame:
    """One row per score: mean, standard error and normal interval (from 0)."""
    y = F.col("y")
    rows = forecasts.where(y.isNotNull()).select(F.explode(F.map_from_arrays(
        F.array(F.lit("brier"), F.lit("log")), F.array((F.col("p") - y.cast("int")) ** 2, log_loss(F.col("p"), y)))).alias("score", "v"))
    unbounded = F.max("v") == float("inf")
    se = F.when((F.count("v") > 1) & ~unbounded, F.stddev_samp("v") / F.sqrt(F.count("v")))
    mean = F.when(unbounded, F.lit(float("inf"))).otherwise(F.avg("v"))
    out = rows.groupBy("score").agg(F.count("v").alias("n"), mean.alias("mean"), se.alias("se"))
    return out.withColumn("low", F.greatest(F.lit(0.0), F.col("mean") - Z95 * F.col("se"))).withColumn("high", F.col("mean") + Z95 * F.col("se"))


def _bin(bins: int):
    return F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")


def reliability(forecasts: DataFrame, bins: int = 10) -> DataFrame:
    """Every bin with count, mean p, rate and Wilson bounds; empty bins stay."""
    got = forecasts.where("y IS NOT NULL").groupBy(_bin(bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.count_if("y").alias("hits"))
    rows = forecasts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(got), "bin", "left")  # a row per bin
    n, hits = F.coalesce("n", F.lit(0)), F.coalesce("hits", F.lit(0))
    low, high = wilson(hits, n)
    return rows.select("bin", n.alias("n"), "mean_p", F.when(n > 0, hits / n).alias("rate"), low.alias("low"), high.alias("high"))


def sharpness(forecasts: DataFrame) -> DataFrame:
    p = F.col("p")
    return forecasts.agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.greatest(p, 1 - p)).alias("mean_confidence"), F.avg(entropy(p)).alias("mean_entropy"), F.min(p).alias("least"), F.max(p).alias("greatest"))


def histogram(forecasts: DataFrame, bins: int = 10) -> DataFrame:
    return forecasts.groupBy(_bin(bins).alias("bin")).agg(F.count("*").alias("n"))


def subgroups(forecasts: DataFrame, least: int = 30) -> DataFrame:
    name = F.coalesce(F.nullif("subgroup", F.lit("")), F.lit("unspecified"))
    y, wrong = F.col("y"), (F.col("p") >= 0.5) != F.col("y")
    return forecasts.groupBy(name.alias("subgroup")).agg(
        F.count("*").alias("total"), F.count("y").alias("scored"), F.count_if(y.isNull()).alias("missing"), F.count_if(wrong).alias("errors"),
        F.count_if("shift").alias("shifted"), (F.count("y") < least).alias("below_minimum"))


def _running(rows: DataFrame, order: Column, sums: dict[str, str]) -> DataFrame:
    """``rows`` with running sums in ``order`` and, as total, the last of the first one.

    Rows are dealt by ranges of the order and written; each range sums its own
    rows and takes the sums of the ranges before it, a row per task.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = written(rows.withColumn("_key", order).repartitionByRange(parts, "_key").withColumn("_part", F.spark_partition_id()), "running")
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    each = dealt.groupBy("_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    each = each.select("_part", *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"_{n}") for n in sums], F.sum(next(iter(sums))).over(W.partitionBy()).alias("total"))
    upto = W.partitionBy("_part").orderBy("_key").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = dealt.join(F.broadcast(each), "_part")  # a row per task
    return placed.select(*rows.columns, *[(F.sum(c).over(upto) + F.col(f"_{n}")).alias(n) for n, c in sums.items()], "total")


def risk_coverage(forecasts: DataFrame) -> DataFrame:
    """By descending confidence, ties together: retained rows, errors, coverage and risk."""
    rows = forecasts.where("y IS NOT NULL").groupBy(F.greatest(F.col("p"), 1 - F.col("p")).alias("confidence")).agg(F.count("*").alias("n"), F.count_if((F.col("p") >= 0.5) != F.col("y")).alias("e"))
    rows = _running(rows, -F.col("confidence"), {"retained": "n", "errors": "e"})
    return rows.select("confidence", "retained", "errors", (F.col("retained") / F.col("total")).alias("coverage"), (F.col("errors") / F.col("retained")).alias("risk"))


def conformal_threshold(forecasts: DataFrame, alpha_percent: int) -> DataFrame:
    """k-th least score 1 - p(outcome), k = ceil((n + 1)(1 - alpha)); infinite if k exceeds n.

    Scores are counted by value before they are ranked.
    """
    score = F.when(F.col("y"), 1 - F.col("p")).otherwise(F.col("p"))
    scores = forecasts.where("y IS NOT NULL").groupBy(score.alias("score")).agg(F.count("*").alias("c"))
    ranked = _running(scores, F.col("score"), {"upto": "c"}).withColumnRenamed("total", "n")
    k = F.floor(((F.col("n") + 1) * (100 - alpha_percent) + 99) / 100).cast("long")
    return ranked.withColumn("k", k).groupBy("n", "k").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("k"), F.col("score"))), F.lit(float("inf"))).alias("threshold"))


def prediction_sets(forecasts: DataFrame, threshold: DataFrame) -> DataFrame:
    return forecasts.join(F.broadcast(threshold.select("threshold")), F.lit(True)).select("observation_id", F.size(prediction_set(F.col("p"), F.col("threshold"))).alias("set_size"), F.array_join(prediction_set(F.col("p"), F.col("threshold")).cast("array<string>"), ",").alias("labels"))  # one row
