"""Search for the least budget that completes most cases, by rounds of growing budgets over the cases still open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrack.functions.scalars import valid_identifier
from tallyrack.operators.wmc import exact_counts
from tallyrack.sources.shared import written

SCORES = "node_limit long, completed long, nodes long, mean_log_nodes double, tried long, chosen boolean, status string"


def preflight(cases: DataFrame) -> DataFrame:
    """cases: case_id, partition, expected (decimal or long), satisfiable.  case_id, issues of the cases that shut the search out.

    Only development cases may be used; ids are valid and not repeated; the
    expected count is known, not negative, and positive only where the case is satisfiable.
    """
    again = F.count("*").over(W.partitionBy("case_id")) > 1
    rules = [
        (~F.coalesce(F.col("partition") == "development", F.lit(False)), "partition"),
        (~F.coalesce(valid_identifier(F.col("case_id").cast("string")), F.lit(False)), "case_id"),
        (again, "case_id_repeated"),
        (F.col("expected").isNull() | (F.col("expected") < 0), "expected"),
        (F.coalesce(F.col("expected") > 0, F.lit(False)) & ~F.coalesce("satisfiable", F.lit(False)), "satisfiable"),
    ]
    issues = F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in rules]), lambda x: x.isNotNull())
    return cases.select("case_id", issues.alias("issues")).where(F.size("issues") > 0)


def solver_runs(open_cases: DataFrame, node_limit: int) -> DataFrame:
    """open_cases: case_id, text, expected, satisfiable.  case_id, done, nodes, agrees, by the exact solver."""
    runs = exact_counts(open_cases.select(F.col("case_id").cast("string").alias("formula_id"), "text"), node_limit=node_limit, seconds=0)
    done = F.col("status") == "success"
    value = F.when(F.col("den") == "1", F.col("num"))
    agrees = (value == F.col("expected").cast("string")) & F.col("found").eqNullSafe(F.col("satisfiable"))
    found = runs.select(F.col("formula_id").alias("_id"), "status", F.col("satisfiable").alias("found"), "num", "den", "nodes")
    return open_cases.join(found, F.col("case_id").cast("string") == F.col("_id")).select("case_id", done.alias("done"), "nodes", (~done | F.coalesce(agrees, F.lit(False))).alias("agrees"))


def search(cases: DataFrame, limits: list[int], evaluate: Callable[[DataFrame, int], DataFrame] = solver_runs) -> DataFrame:
    """cases: case_id, partition, expected, satisfiable and what ``evaluate`` reads.  One row per limit: node_limit, completed, nodes, mean_log_nodes, tried, chosen, status.

    The limits are tried from the least; a case that is done under one limit
    has the same result under all greater ones, so each limit runs only the
    cases that are still open (``tried``) and the scores are still those of
    the full grid.  The chosen limit completes most cases, ties to the least.
    Status: ``invalid_input`` (a case fails ``preflight``, or there is none;
    nothing is run), ``mismatch`` (a done case disagrees with what it should
    give; the limits after it are not tried), ``no_baseline`` (the greatest
    limit completes none), else ``success``.  Only ``success`` has a chosen
    limit.  Each limit's runs are a written table.
    """
    spark, limits = cases.sparkSession, sorted(set(limits))
    refused = preflight(cases).limit(1).count() > 0 or not limits
    waiting = written(cases, "search-cases")
    total = waiting.count()
    runs, status, tried = None, "invalid_input" if refused or not total else "success", {}
    for limit in limits if status == "success" else []:
        got = written(evaluate(waiting, limit).select("case_id", "done", "nodes", "agrees", F.lit(limit).cast("long").alias("node_limit")), "search-runs")
        runs = got if runs is None else runs.unionByName(got)
        wrong, open_, tried[limit] = got.agg(F.count_if(~F.col("agrees")), F.count_if(~F.col("done")), F.count("*")).first()
        if wrong:
            status = "mismatch"
            break
        if not open_:
            break
        waiting = waiting.join(got.where("NOT done").select("case_id"), "case_id", "left_semi")
    grid = spark.createDataFrame([(x, tried.get(x, 0)) for x in limits], "node_limit long, tried long")
    if runs is None:
        return grid.select("node_limit", F.lit(0).cast("long").alias("completed"), F.lit(None).cast("long").alias("nodes"), F.lit(None).cast("double").alias("mean_log_nodes"), "tried", F.lit(False).alias("chosen"), F.lit(status).alias("status"))
    each = runs.where("done").groupBy("node_limit").agg(F.count("*").alias("c"), F.sum("nodes").alias("s"), F.sum(F.log1p(F.col("nodes").cast("double"))).alias("g"))
    upto = W.orderBy("node_limit").rowsBetween(W.unboundedPreceding, W.currentRow)  # a row per limit
    scored = grid.join(each, "node_limit", "left").select("node_limit", "tried", *[F.sum(x).over(upto).alias(x) for x in "csg"])
    best = F.row_number().over(W.orderBy(F.desc_nulls_last("c"), "node_limit")) == 1
    ended = F.lit(status) if status != "success" else F.when(F.max("c").over(W.partitionBy()) > 0, "success").otherwise("no_baseline")
    scored = scored.withColumn("status", ended).withColumn("best", best)
    return scored.select("node_limit", F.coalesce("c", F.lit(0)).cast("long").alias("completed"), F.col("s").alias("nodes"), (F.col("g") / F.col("c")).alias("mean_log_nodes"), "tried", (F.col("best") & (F.col("status") == "success")).alias("chosen"), "status")
