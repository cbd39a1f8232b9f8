"""Prequential expert mixture: predict before each update, by windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def accept(rows: DataFrame) -> DataFrame:
    """Rows with status: partition gate, phase order, non-results, then first of each id.

    Training is closed by the first accepted streaming row before it.
    """
    by = W.partitionBy("stream_id").orderBy("seq")
    may = F.col("partition").isin("training", "streaming")
    usable = F.col("outcome").isin("completed", "not_completed")
    first = F.row_number().over(W.partitionBy("stream_id", "observation_id", may & usable).orderBy("seq")) == 1
    opened = F.coalesce(F.max(F.when((F.col("partition") == "streaming") & usable & first, 1)).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("status", F.when(~may, "unauthorized").when((F.col("partition") == "training") & (opened == 1), "late_training").when(~usable, "non_result").when(~first, "duplicate").otherwise("accepted"))


def experts(rows: DataFrame) -> DataFrame:
    """rows: stream_id, seq, context, y (0/1).  Adds prev, and each expert's p before the row.

    Experts count by stream, by context, and by previous outcome; each says
    (completed + 1) / (seen + 2).
    """
    past = lambda *keys: W.partitionBy(*keys).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    prev = F.coalesce(F.lag("y").over(W.partitionBy("stream_id").orderBy("seq")).cast("string"), F.lit("start"))
    rows = rows.withColumn("prev", prev)
    p = lambda w: (F.coalesce(F.sum("y").over(w), F.lit(0)) + 1) / (F.count("y").over(w) + 2)
    return rows.withColumn("p_global", p(past("stream_id"))).withColumn("p_context", p(past("stream_id", "context"))).withColumn("p_prev", p(past("stream_id", "prev")))


def mixture(rows: DataFrame) -> DataFrame:
    """Adds posterior weights before the row and the mixture probability and log score."""
    names = ["global", "context", "prev"]
    past = W.partitionBy("stream_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    log_q = lambda n: F.log(F.when(F.col("y") == 1, F.col(f"p_{n}")).otherwise(1 - F.col(f"p_{n}")))
    rows = rows.select("*", *[F.coalesce(F.sum(log_q(n)).over(past), F.lit(0.0)).alias(f"l_{n}") for n in names])
    top = F.greatest(*[F.col(f"l_{n}") for n in names])
    total = sum((F.exp(F.col(f"l_{n}") - top) for n in names), F.lit(0.0))
    rows = rows.select("*", *[(F.exp(F.col(f"l_{n}") - top) / total).alias(f"w_{n}") for n in names])
    p = sum((F.col(f"w_{n}") * F.col(f"p_{n}") for n in names), F.lit(0.0))
    rows = rows.withColumn("p_mix", p)
    return rows.withColumn("log_score", F.log(F.when(F.col("y") == 1, F.col("p_mix")).otherwise(1 - F.col("p_mix"))))


def mixture_summary(rows: DataFrame) -> DataFrame:
    """Log score and counts of each stream."""
    return mixture(experts(rows)).groupBy("stream_id").agg(F.count("*").alias("n"), F.sum("y").alias("completed"), F.sum("log_score").alias("log_score"))


def snapshot(rows: DataFrame) -> DataFrame:
    """The learner's counts after the accepted rows (see ``experts``): stream_id, kind (global, context, previous), key, seen, completed."""
    known = rows.withColumn("prev", F.coalesce(F.lag("y").over(W.partitionBy("stream_id").orderBy("seq")).cast("string"), F.lit("start")))
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in (("global", F.lit("all")), ("context", F.col("context")), ("previous", F.col("prev")))])).alias("k")
    return known.select("stream_id", "y", keys).groupBy("stream_id", "k.kind", "k.key").agg(F.count("*").alias("seen"), F.sum("y").alias("completed"))
