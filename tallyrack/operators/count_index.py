"""Count-ranked lookup index: build, merge, query, evaluate, shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrack.sources.shared import written

KEYS = ["subject_key", "relation_key", "answer_key"]


def build(records: DataFrame) -> DataFrame:
    """records: record_id, ord, subject_key, relation_key, answer_key, answer_surface.

    A record counts a key once; the first surface in order is kept.  Without
    record_id, each row is a key's only one in its record, or with count the
    sum of that many.
    """
    once = records.select(*KEYS, F.struct("ord", "answer_surface").alias("s"), *(["count"] if "count" in records.columns else []))
    if "record_id" in records.columns:
        once = records.groupBy("record_id", *KEYS).agg(F.min(F.struct("ord", "answer_surface")).alias("s"))
    number = F.sum("count") if "count" in once.columns else F.count("*")
    return once.groupBy(*KEYS).agg(F.min("s").alias("s"), number.alias("count")).select(*KEYS, F.col("s.answer_surface").alias("answer_surface"), F.col("s.ord").alias("ord"), "count")


def merge(parts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """parts: the columns of ``build`` and shard; counts add, the earliest shard's surface stays.

    ``by`` are columns that follow from the key and stay, in front.
    """
    found = parts.groupBy(*by, *KEYS).agg(F.sum("count").alias("count"), F.min(F.struct("shard", "ord", "answer_surface")).alias("s"))
    return found.select(*by, *KEYS, F.col("s.answer_surface").alias("answer_surface"), "count")


def numbered(records: DataFrame, order: list[str], within: list[str] = ()) -> DataFrame:
    """Adds row, the place from 0 by ``order`` and then ``within`` (nulls first), and total.

    Ranges go by ``order`` alone, whose values are sampled.  Rows are numbered
    from per-range counts, so no task sees them all; ranges are written first,
    for drawn anew they could fall elsewhere.
    """
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = written(records.repartitionByRange(parts, *order).sortWithinPartitions(*order, *within).withColumn("_part", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id()), "numbered")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_mono").alias("_lead"))
    before = counts.select("_part", "_lead", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy()).alias("total"))
    placed = ranged.join(F.broadcast(before), "_part")  # a row per task
    return placed.withColumn("row", F.col("_before") + F.col("_mono") - F.col("_lead")).drop("_part", "_mono", "_lead", "_before")


def balanced(row: str, total: str, shards: int) -> Column:
    """The shard of a row by its number: contiguous ranges, the first ones larger by one."""
    size, larger = F.floor(F.col(total) / shards), F.col(total) % shards
    edge = larger * (size + 1)
    return F.when(F.col(row) < edge, F.floor(F.col(row) / (size + 1))).otherwise(larger + F.floor((F.col(row) - edge) / F.greatest(size, F.lit(1)))).cast("int")


def shard_plan(records: DataFrame, shards: int, order: str) -> DataFrame:
    """Adds shard: contiguous balanced shards in order, the first ones larger by one."""
    return numbered(records, [order]).withColumn("shard", balanced("row", "total", shards)).drop("row", "total")


def ranked(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """queries: query_id, subject_keys array, relation_key.  Top k by count, key; share over all candidates.

    Aliases merge by the larger count, not the sum.  Queries that ask for the
    same keys are one question: its candidates meet once, and only the k best
    go to each of its queries.
    """
    keys = queries.select("query_id", F.explode("subject_keys").alias("subject_key"), "relation_key").where("subject_key IS NOT NULL AND relation_key IS NOT NULL")
    asked = written(keys.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("subject_key", "relation_key"))).alias("question")), "asked")
    pairs = asked.select("question").distinct().select("question", F.inline("question"))
    found = pairs.join(index, ["subject_key", "relation_key"]).groupBy("question", "answer_key").agg(F.max(F.struct("count", "answer_surface")).alias("m"))
    found = found.select("question", "answer_key", F.col("m.count").alias("count"), F.col("m.answer_surface").alias("answer_surface"))
    total = found.groupBy("question").agg(F.sum("count").alias("total"))
    place = F.row_number().over(W.partitionBy("question").orderBy(F.desc("count"), "answer_key", "answer_surface"))
    best = found.withColumn("rank", place).where(F.col("rank") <= k).join(total, "question")
    best = best.groupBy("question").agg(F.collect_list(F.struct("answer_key", "count", "answer_surface", "total", "rank")).alias("best"))  # k
    return asked.join(best, "question").select("query_id", F.inline("best")).withColumn("share", F.col("count") / F.col("total"))


def evaluate(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """queries also carry gold array.  Coverage, top-1, top-k and top-1 among covered; uncovered is a miss."""
    top = ranked(index, queries, k).groupBy("query_id").agg(F.max_by("answer_key", -F.col("rank")).alias("first"), F.collect_set("answer_key").alias("all"))
    rows = queries.join(top, "query_id", "left")
    covered = F.col("first").isNotNull()
    hit = F.coalesce(F.array_contains("gold", F.col("first")), F.lit(False))
    any_hit = F.coalesce(F.arrays_overlap("gold", "all"), F.lit(False))
    return rows.agg(F.count("*").alias("n"), F.count_if(covered).alias("covered"), F.count_if(hit).alias("top1"), F.count_if(any_hit).alias("topk"))
