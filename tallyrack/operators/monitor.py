"""Change monitoring: one-sided CUSUM in closed form over windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cusum(rows: DataFrame, before: float, after: float, sigma: float, threshold: float, value: str = "value") -> DataFrame:
    """rows: stream_id, seq, value.  Adds llr, w and alarm (w above threshold).

    w = max(0, w + llr) equals the running sum less its least value so far, 0 included.
    Sums are exact, so that w at the threshold is no alarm by rounding; from a
    stream's first value past 12 decimals or 10**12 on, they are sums of doubles.
    """
    by = W.partitionBy("stream_id").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    scale, middle = (after - before) / (sigma * sigma), (before + after) / 2
    rows = rows.withColumn("llr", scale * (F.col(value) - middle)).withColumn("_sum", F.sum("llr").over(by))
    exact = F.when(F.abs(F.col(value)) < 1e12, F.col(value).try_cast("decimal(38,12)"))
    step = exact - F.lit(middle).cast("decimal(38,12)") if scale >= 0 else F.lit(middle).cast("decimal(38,12)") - exact
    rows = rows.withColumn("_rough", F.max(~F.coalesce(exact.cast("double") == F.col(value), F.col(value).isNull())).over(by)).withColumn("_exact", F.sum(step.cast("decimal(38,12)")).over(by))
    rise = F.col("_exact") - F.least(F.lit(0).cast("decimal(38,12)"), F.min("_exact").over(by))
    plain = F.col("_sum") - F.least(F.lit(0.0), F.min("_sum").over(by))
    return rows.withColumn("w", F.when(F.col("_rough"), plain).otherwise(abs(scale) * rise.cast("double"))).withColumn("alarm", F.col("w") > threshold).drop("_sum", "_rough", "_exact")


def first_alarms(rows: DataFrame) -> DataFrame:
    return rows.groupBy("stream_id").agg(F.min(F.when(F.col("alarm"), F.col("seq"))).alias("first_alarm"), F.max("w").alias("peak"), F.count("*").alias("n"))


def cadence(rows: DataFrame, every: int) -> DataFrame:
    """Each ``every``-th accepted row of a stream."""
    k = F.row_number().over(W.partitionBy("stream_id").orderBy("seq"))
    return rows.withColumn("k", k).where(F.col("k") % every == 0)


def grid_search(cases: DataFrame, limits: DataFrame) -> DataFrame:
    """cases: case_id, nodes; limits: node_limit.  Completed count and mean log1p(nodes) for each limit, best first."""
    done = F.col("nodes") <= F.col("node_limit")
    scored = cases.join(F.broadcast(limits), F.lit(True)).groupBy("node_limit").agg(  # eight limits
        F.count_if(done).alias("completed"), F.sum(F.when(done, F.col("nodes"))).alias("nodes"), F.avg(F.when(done, F.log1p(F.col("nodes").cast("double")))).alias("mean_log_nodes"))
    best = F.row_number().over(W.orderBy(F.desc("completed"), "node_limit")) == 1
    return scored.withColumn("chosen", best)
