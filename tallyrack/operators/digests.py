"""Digests of tables as a tree of fixed fan-out: equal for any order and partitioning of the rows, compared by descending."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrack.sources.shared import written

LEAF_ROWS = 256


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_digest(rows: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the columns' text forms in the order given, each led by its length; null differs from any text.

    Binary values count as base64, nested ones as JSON, all others as Spark casts them.
    """
    kinds = {f.name: f.dataType.typeName() for f in rows.schema}

    def part(name: str) -> Column:
        value = F.col(quoted(name))
        text = F.base64(value) if kinds[name] == "binary" else F.to_json(value) if kinds[name] in ("struct", "array", "map") else value.cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("null"))

    return F.sha2(F.concat_ws(",", *map(part, columns)), 256)


def depth_for(rows: int) -> int:
    """Levels below the root that leave about ``LEAF_ROWS`` rows in a leaf."""
    return max(0, ceil(log(max(rows, 1) / LEAF_ROWS, 16) - 1e-9))


def _leaves(rows: DataFrame, columns: list[str], depth: int) -> DataFrame:
    counts = rows.select(row_digest(rows, columns).alias("d")).groupBy("d").agg(F.count("*").alias("c"))
    line = F.concat(F.col("d"), F.lit("x"), F.col("c").cast("string"))
    return counts.groupBy(F.substring("d", 1, depth).alias("prefix")).agg(F.sum("c").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("digest"))


def _parents(nodes: DataFrame, level: int) -> DataFrame:
    line = F.concat(F.col("prefix"), F.lit("="), F.col("digest"))
    made = (F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("digest"))
    return nodes.groupBy(F.substring("prefix", 1, level).alias("prefix")).agg(*made) if level else nodes.agg(*made).select(F.lit("").alias("prefix"), "n", "digest")


def tree(rows: DataFrame, columns: list[str] | None = None, depth: int | None = None) -> DataFrame:
    """level, prefix, n, digest of each node; level 0 is the digest of the whole table, level ``depth`` the leaves.

    A row belongs to the leaf that the first hexadecimal digits of its own
    digest name, so neither a hot key nor sorted input makes a leaf large, and
    repeated rows are one digest with a count.  A parent is the digest of its
    up to 16 children.  The table is read once; parents come from the written
    leaves.  Where the order of rows matters, include their number as a column.
    Two trees can be compared if their columns and depths agree; ``depth`` is
    set by the number of rows where it is not given.  An empty table has a root.
    """
    columns = columns or rows.columns
    depth = depth_for(rows.count()) if depth is None else depth
    nodes = written(_leaves(rows, columns, depth), "digest-leaves")
    levels = [nodes.select(F.lit(depth).alias("level"), "prefix", "n", "digest")] if depth else []
    for level in range(depth - 1, -1, -1) if depth else [0]:
        nodes = _parents(nodes, level)
        levels.append(nodes.select(F.lit(level).alias("level"), "prefix", "n", "digest"))
    every = levels[0]
    for one in levels[1:]:
        every = every.unionByName(one)
    return written(every, "digest-tree")


def unlike(one: DataFrame, other: DataFrame) -> DataFrame:
    """prefix, n_one, n_other of the leaves in which two trees differ; only nodes below unlike parents are read."""
    depth, theirs = (t.agg(F.max("level")).first()[0] for t in (one, other))
    if depth != theirs:
        raise ValueError(f"trees of depth {depth} and {theirs}")
    at = None
    for level in range(depth + 1):
        a, b = (t.where(F.col("level") == level).drop("level") for t in (one, other))
        if at is not None:
            parent = at.select(F.col("prefix").alias("_parent"))
            a, b = (t.join(parent, F.substring("prefix", 1, level - 1) == F.col("_parent"), "left_semi") for t in (a, b))
        a, b = a.select("prefix", F.col("n").alias("n_one"), F.col("digest").alias("_one")), b.select("prefix", F.col("n").alias("n_other"), F.col("digest").alias("_other"))
        at = a.join(b, "prefix", "full").where(~F.col("_one").eqNullSafe(F.col("_other"))).select("prefix", F.coalesce("n_one", F.lit(0)).alias("n_one"), F.coalesce("n_other", F.lit(0)).alias("n_other"))
    return at


def changes(one: DataFrame, other: DataFrame, columns: list[str] | None = None, depth: int | None = None) -> DataFrame:
    """The columns of each row whose number of copies differs, n_one and n_other; only rows of unlike leaves are brought together."""
    columns = columns or one.columns
    depth = depth_for(max(one.count(), other.count())) if depth is None else depth
    at = written(unlike(tree(one, columns, depth), tree(other, columns, depth)).select(F.col("prefix").alias("_leaf")), "unlike-leaves")
    plain = [F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)]
    both = one.select(*plain, row_digest(one, columns).alias("_d"), F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(other.select(*plain, row_digest(other, columns).alias("_d"), F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    met = both.withColumn("_leaf", F.substring("_d", 1, depth)).join(at, "_leaf", "left_semi").groupBy("_d").agg(*[F.first(f"c{i}").alias(f"c{i}") for i in range(len(columns))], F.sum("_a").alias("n_one"), F.sum("_b").alias("n_other"))
    return met.where("n_one <> n_other").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "n_one", "n_other")
