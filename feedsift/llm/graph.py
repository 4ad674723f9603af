"""Connected components and the comparison blocks of candidate buckets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b), both long: component is the smallest node reachable.

    Each round a node takes the smallest label among its neighbours' and the label of its label, so labels travel twice
    as far each round. Labels are written to the shared folder; only the count of changes comes to the driver. Labels are as many
    as nodes, so they are merged, whatever size Spark takes their files for."""
    pairs = edges.filter("a <> b").select("a", "b")
    both = stored(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        far = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        step = labels.join(near.hint("merge"), "node", "left").join(far.hint("merge"), "component", "left").select("node", F.least("component", "near", "far").alias("component"), F.col("component").alias("was"))
        step = stored(step, "labels")
        labels = step.select("node", "component")
        if not step.filter("component < was").count():
            return labels


def pair_blocks(rows: DataFrame, keys: Sequence[str], item: str, size: int) -> DataFrame:
    """The rows of buckets (equal keys) that hold two rows or more, in blocks of about size rows for comparison.

    A bucket of up to `size` rows is one block. A larger one is cut into chunks by a hash of item, and each two chunks
    make a block, so every pair of a bucket's rows meets in exactly one block and no task holds a whole large bucket.
    Adds: __low and __high (the chunks of the block), __chunk (the row's own). Rows may come of an explode, whose size Spark
    takes for that of the table before it, so counts are merged and never broadcast."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    chunks = F.ceil(F.col("__n") / size).cast("int")
    out = rows.join(counts.hint("merge"), list(keys)).withColumn("__chunk", F.pmod(F.xxhash64(F.col(item), F.lit("chunk")), chunks).cast("int"))
    out = out.withColumn("__other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return out.withColumn("__low", F.least("__chunk", "__other")).withColumn("__high", F.greatest("__chunk", "__other")).drop("__n", "__other")


def forest(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (smallest, other) of stars that join what the links left-right join, among items 0 to n - 1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    others = np.flatnonzero(label != np.arange(n))
    return label[others], others
