"""Connected components: edges are contracted where they lie, least labels spread over what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrack.sources.shared import written


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a batch of edges with the least node that the batch's edges lead to; each batch by itself."""
    for batch in batches:
        ends = np.concatenate([np.asarray(batch.column(k).cast(pa.int64())) for k in (0, 1)])
        nodes, at = np.unique(ends, return_inverse=True)
        a, b = np.split(at, 2)
        label, before = np.arange(len(nodes)), None
        while before is None or (label != before).any():
            before, least = label, label.copy()
            low = np.minimum(label[a], label[b])
            for end in (a, b, label[a], label[b]):  # a node's label moves with the node
                np.minimum.at(least, end, low)
            label = least[least]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "root"])


def _spread(edges: DataFrame, most_rounds: int) -> DataFrame:
    """node, component: each round takes the least label among neighbours, then the label's own label."""
    both = written(edges.union(edges.select("dst", "src")).toDF("node", "other").distinct(), "graph")
    labels = written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("m"))
        step = labels.join(near, "node").select("node", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        hop = step.select(F.col("node").alias("component"), F.col("component").alias("up"))
        labels = written(step.join(hop, "component", "left").select("node", F.least("component", F.coalesce("up", "component")).alias("component"), "old"), "labels")
        if labels.where("component <> old").isEmpty():
            return labels.drop("old")
        labels = labels.drop("old")
    raise RuntimeError("components did not settle")


def connected_components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """edges: src, dst (whole numbers).  node, component (least node reachable).

    Each batch of edges is first replaced by its nodes and their least ones, so
    what moves is a row for each node of a batch, however many edges it has.
    A node's roots are then linked (a root is one of its own), and only roots
    that other batches touch go through rounds; a round is equi-joins with partial aggregates.
    """
    kept = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src IS NOT NULL AND dst IS NOT NULL")
    stars = kept.mapInArrow(_contract, "node long, root long")
    met = stars.groupBy("node").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots"))
    met = written(met.select("node", "root", F.when(F.size("roots") > 1, F.col("roots")).alias("roots")), "stars")
    links = met.where("roots IS NOT NULL").select("root", F.explode("roots").alias("other")).where("root <> other").toDF("src", "dst")
    if links.isEmpty():
        return met.select("node", F.col("root").alias("component"))
    final = _spread(links, most_rounds).toDF("root", "component")
    return met.join(final, "root", "left").select("node", F.coalesce("component", "root").alias("component"))
