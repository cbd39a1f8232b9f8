"""Connected components of an edge table by alternating large and small stars.

Each round is aggregates and equi-joins; a hub's edges are summed before they
move and its join can be split.  Rounds are written to the shared folder, so
lineage stays short; they end when the star forest no longer changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("dst"), F.col("src"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
    return moved.union(least.select(F.col("u"), F.col("m"))).where("src <> dst").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label (least node of its component) for every node of ``edges`` (src, dst) but the least ones."""
    now = written(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        if before == (state["n"], state["h"]):
            break
        before = (state["n"], state["h"])
        now = written(_small(_large(now)), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("label"))
