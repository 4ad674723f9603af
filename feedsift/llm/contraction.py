"""Subtree totals of forests by parallel tree contraction, in join rounds.

A round rakes all leaves: their totals are final and are added to their parents. Then it compresses unary chains: nodes with one
child left, chosen by a coin so that no two neighbours go at once, are spliced out; the child goes to the node's parent,
which takes over the node's own amount. So a chain halves in a few rounds however long it is, and a forest of n nodes takes
O(log n) rounds. Then the rounds are undone from the last to the first: a spliced node's total is what it had gathered when it
went plus the total of the child it had, which is known by then.

Nodes meet by their ids only, each once, and children are added up before they are shuffled: a parent with a third of all nodes
weighs on no task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def subtree_totals(nodes: DataFrame, values: Sequence[str]) -> DataFrame:
    """(id, *values): of each node the sums over its subtree, itself included.

    nodes: (id, parent, *values), ids and values long, ids distinct, parent null for roots or the id of another node. Every
    node has to hang on a root."""
    own = nodes.select("id", "parent", *values)
    kids = own.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("of")).agg(F.count(F.lit(1)).alias("kids"))
    active = stored(own.join(kids, F.col("id") == F.col("of"), "left").select(*own.columns, F.coalesce("kids", F.lit(0)).alias("kids")), "forest")
    totals, spliced, rounds = [], [], 0
    while True:
        totals.append(active.filter("kids = 0").select("id", *values))
        if active.filter("kids > 0").isEmpty():
            break
        raked = stored(rake(active, values), "raked")
        gone = stored(chosen(raked, values, rounds), "spliced")
        active = stored(splice(raked, gone, values), "forest")
        spliced.append(gone)
        rounds += 1
    for gone in reversed(spliced):
        known = reduce(DataFrame.union, totals).select(F.col("id").alias("child"), *(F.col(v).alias(f"below_{v}") for v in values))
        totals.append(stored(gone.join(known, "child").select("id", *((F.col(v) + F.col(f"below_{v}")).alias(v) for v in values)), "totals"))
    return reduce(DataFrame.union, totals)


def rake(active: DataFrame, values: Sequence[str]) -> DataFrame:
    """The nodes that are no leaves, with their leaves' amounts; how many children stay, and which if it is one."""
    leaf = F.col("kids") == 0
    below = active.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("of")).agg(
        F.count_if(~leaf).alias("left"), F.min(F.when(~leaf, F.col("id"))).alias("child"), *(F.sum(F.when(leaf, F.col(v)).otherwise(0)).alias(f"add_{v}") for v in values),
    )
    met = active.filter(~leaf).join(below, F.col("id") == F.col("of"))
    return met.select("id", "parent", *((F.col(v) + F.col(f"add_{v}")).alias(v) for v in values), F.col("left").alias("kids"), F.when(F.col("left") == 1, F.col("child")).alias("child"))


def chosen(raked: DataFrame, values: Sequence[str], rounds: int) -> DataFrame:
    """The nodes to splice out: unary ones that are no roots and whose coin shows heads, but for those whose parent is such a
    node, too."""
    heads = F.pmod(F.xxhash64("id", F.lit(rounds)), F.lit(2)) == 1
    unary = raked.filter(F.col("child").isNotNull() & F.col("parent").isNotNull() & heads)
    return unary.join(unary.select(F.col("child").alias("id")), "id", "left_anti").select("id", "parent", "child", *values)


def splice(raked: DataFrame, gone: DataFrame, values: Sequence[str]) -> DataFrame:
    """The forest without the nodes that go: their amounts at their parents, their children there, too."""
    none = [F.lit(0).cast("long").alias(v) for v in values]
    up, no = F.lit(None).cast("long").alias("up"), F.lit(False).alias("goes")
    changes = gone.select(F.col("parent").alias("of"), *values, up, no).union(gone.select("child", *none, F.col("parent").alias("up"), no)).union(gone.select("id", *none, up, F.lit(True).alias("goes")))
    changes = changes.groupBy("of").agg(*(F.sum(v).alias(f"add_{v}") for v in values), F.max("up").alias("up"), F.max("goes").alias("goes"))
    met = raked.join(changes, F.col("id") == F.col("of"), "left").filter("goes IS NULL OR NOT goes")
    return met.select("id", F.coalesce("up", "parent").alias("parent"), *((F.col(v) + F.coalesce(f"add_{v}", F.lit(0))).alias(v) for v in values), "kids")
