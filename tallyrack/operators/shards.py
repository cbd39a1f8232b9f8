"""Shard sets: records in balanced contiguous ranges, a manifest, what differs from it, and reruns that write only that."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrack.operators.count_index import balanced, numbered
from tallyrack.sources.shared import written

STORED = "row long, line string, shard int"
SEAL = ["start", "stop", "records", "bytes", "digest"]


def placed(records: DataFrame, shards: int, order: str, line: Column | str) -> DataFrame:
    """row, line, shard of each record.  Rows go by ``order`` (nulls first), ties by the line, so repeated rows are interchangeable."""
    line = F.col(line) if isinstance(line, str) else line
    rows = numbered(records.select(F.col(order).alias("_order"), line.alias("line"), F.xxhash64(line).alias("_tie")), ["_order", "_tie"], ["line"])
    return rows.select("row", "line", balanced("row", "total", shards).alias("shard"))


def _digest(sums: list[Column]) -> Column:
    return F.sha2(F.concat_ws(":", *[s.cast("string") for s in sums]), 256)


def sealed(rows: DataFrame) -> DataFrame:
    """shard, start, stop, records, bytes, digest of rows of shard, row and line.

    A row's SHA-256 covers its place and its line (null differs from any text);
    the four 64-bit parts are summed, so partial sums meet and no task holds a
    shard.  That finds changes, moves and losses, not a forger who can choose
    many lines.
    """
    digest = F.sha2(F.concat(F.col("row").cast("string"), F.coalesce(F.concat(F.lit(":"), "line"), F.lit("null"))), 256)
    parts = [F.sum(F.conv(F.substring("_d", 16 * i + 1, 16), 16, 10).cast("decimal(28,0)")).alias(f"_{i}") for i in range(4)]
    found = rows.select("shard", "row", F.octet_length("line").alias("_b"), digest.alias("_d")).groupBy("shard").agg(
        F.min("row").alias("start"), (F.max("row") + 1).alias("stop"), F.count("*").alias("records"), F.coalesce(F.sum("_b"), F.lit(0)).cast("long").alias("bytes"), *parts)
    return found.select("shard", "start", "stop", "records", "bytes", _digest([F.col(c) for c in ("records", "_0", "_1", "_2", "_3")]).alias("digest"))


def planned(spark: SparkSession, total: int, shards: int) -> DataFrame:
    """shard, start, stop, records of every shard of a plan, empty ones too."""
    base, larger = divmod(total, shards)
    start = F.col("shard") * F.lit(base).cast("long") + F.least("shard", F.lit(larger))
    plan = spark.range(shards).select(F.col("id").cast("int").alias("shard")).withColumn("start", start.cast("long"))
    return plan.withColumn("records", F.lit(base).cast("long") + F.when(F.col("shard") < larger, 1).otherwise(0)).select("shard", "start", (F.col("start") + F.col("records")).alias("stop"), "records")


def manifest(rows: DataFrame, shards: int) -> DataFrame:
    """The plan's shards with the bytes and digest of the rows ``placed`` gave; an empty shard has the digest of no rows."""
    seen = sealed(rows).select("shard", "bytes", "digest")
    nothing = _digest([F.lit(0)] * 5)
    return planned(rows.sparkSession, rows.count(), shards).join(seen, "shard", "left").select(
        "shard", "start", "stop", "records", F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"), F.coalesce("digest", nothing).alias("digest"))


def manifest_issues(kept: DataFrame) -> DataFrame:
    """shard, issues of each row of a manifest: shard, range, records, bytes, digest.  A sound manifest has only empty arrays.

    Numbers must be listed once each from 0, ranges be the balanced plan of all
    records, and an empty shard have no bytes; nulls are issues.
    """
    total = kept.agg(F.coalesce(F.sum("records"), F.lit(0)), F.count("*")).first()
    plan = planned(kept.sparkSession, max(total[0], 0), max(total[1], 1)).select("shard", F.col("start").alias("_start"), F.col("stop").alias("_stop"))
    times = kept.groupBy("shard").agg(F.count("*").alias("_times"))
    rows = kept.join(times, kept["shard"].eqNullSafe(times["shard"]), "left").drop(times["shard"]).join(plan, "shard", "left")

    def issue(name: str, sound: Column) -> Column:
        return F.when(~F.coalesce(sound, F.lit(False)), name)

    span = F.col("stop") - F.col("start")
    found = F.array_compact(F.array(
        issue("shard", (F.col("_times") == 1) & F.col("_start").isNotNull()),
        issue("range", (F.col("start") == F.col("_start")) & (F.col("stop") == F.col("_stop"))),
        issue("records", (F.col("records") == span) & (F.col("records") >= 0)),
        issue("bytes", (F.col("bytes") >= 0) & ((F.col("records") > 0) | (F.col("bytes") == 0))),
        issue("digest", F.col("digest").rlike("^[0-9a-f]{64}$")),
    ))
    return rows.select("shard", found.alias("issues"))


def reconciled(kept: DataFrame, rows: DataFrame) -> DataFrame:
    """The manifest's columns, seen_records, seen_bytes and status of each shard of a manifest or of the rows.

    status is the first of: unexpected (no such shard in the manifest), missing
    (no row of it), records, range, bytes, digest, ok.
    """
    seen = sealed(rows).select("shard", *[F.col(c).alias(f"seen_{c}") for c in SEAL])
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"seen_{c}"))
    status = F.when(F.col("digest").isNull(), "unexpected").when((F.col("records") == 0) & F.col("seen_records").isNull(), "ok").when(F.col("seen_records").isNull(), "missing")
    status = status.when(differs("records"), "records").when(differs("start") | differs("stop"), "range").when(differs("bytes"), "bytes").when(differs("digest"), "digest").otherwise("ok")
    zero = F.lit(0).cast("long")
    return kept.join(seen, "shard", "full").select("shard", *SEAL, F.coalesce("seen_records", zero).alias("seen_records"), F.coalesce("seen_bytes", zero).alias("seen_bytes"), status.alias("status"))


def stored(spark: SparkSession, path: str) -> DataFrame:
    """row, line, shard as the files hold them; a file that can't be read counts as absent, which ``reconciled`` then shows."""
    return spark.read.schema(STORED).option("ignoreCorruptFiles", "true").parquet(f"{path}/shards")


def check(spark: SparkSession, path: str) -> DataFrame:
    """``reconciled`` of what a folder holds and its own manifest."""
    return reconciled(spark.read.parquet(f"{path}/manifest"), stored(spark, path))


def write(records: DataFrame, path: str, shards: int, order: str, line: Column | str) -> DataFrame:
    """Write the records as shards below ``path`` and return the manifest, which is written last.

    A folder that holds shards already is held against the new manifest and
    only shards that differ are written again, so a run that was ended midway
    is taken up where it stood and a rerun writes nothing.  Where the folder
    has rows of a shard that should have none, all of it is replaced.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    spark = records.sparkSession
    rows = placed(records, shards, order, line)
    made = written(manifest(rows, shards), "shard-manifest")
    try:
        at = written(reconciled(made, stored(spark, path)).where("status <> 'ok'"), "shard-differences")
        surplus = at.where("status = 'unexpected' OR records = 0").limit(1).count() > 0
        left = None if surplus else at.select("shard")
    except AnalysisException as absent:
        if absent.getCondition() != "PATH_NOT_FOUND":
            raise
        left = None
    if left is None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("shard").parquet(f"{path}/shards")
    elif left.limit(1).count():
        few = F.broadcast(left)  # at most a row a shard
        rows.join(few, "shard", "left_semi").select("row", "line", "shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{path}/shards")
    made.write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """row and line of all shards together, the records that were written; a set that differs from its manifest is refused."""
    bad = manifest_issues(spark.read.parquet(f"{path}/manifest")).where("size(issues) > 0").select("shard").unionByName(check(spark, path).where("status <> 'ok'").select("shard")).first()
    if bad:
        raise ValueError(f"shard {bad[0]} differs from the manifest")
    return stored(spark, path).select("row", "line")
