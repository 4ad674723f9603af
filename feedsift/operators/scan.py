"""Sorted scans whose state runs across partitions: a group of any size is worked on by as many tasks as it fills.

Rows are dealt to ranges of (group, order) and sorted, so a large group lies in several neighbouring partitions. Each partition
folds its rows on its own, starting its first group from nothing, and reports what that group and its last one came to; the
driver, which gets one short row for each partition, adds these up and tells each partition what its first group carries in.

`running` is the same in two levels of windows, for logic that built-in functions can say: a group is cut into chunks, each
chunk is worked on by itself, and what the chunks before it come to, a row each, is carried in by a join."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Added by `ranged`: the number of a row's partition. Partitions follow each other in the order of the keys.
PARTITION = "__partition"


def ranged(rows: DataFrame, *keys: Column, partitions: int | None = None) -> DataFrame:
    """The rows in partitions that are ranges of the keys, sorted by them. Rows of equal keys may part too, so that not even a
    group of equal rows is one task's; such rows can be told apart by nothing but place."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("__place", F.monotonically_increasing_id())
    order = [*keys, F.col("__place").asc()]
    return placed.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("__place")


def carried(ends: Sequence[tuple[int, Any, Any, bool]], join: Callable[[Any, Any], Any], nothing: Any) -> dict[int, Any]:
    """What each partition's first group brings along from the partitions before it.

    ends: of each partition with rows, in any order: (number, first group, (last group, what the partition's rows of that
    group come to), whether it is one group throughout)."""
    out, group, held = {}, None, nothing
    seen = False
    for number, first, (last, total), whole in sorted(ends, key=lambda e: e[0]):
        goes_on = seen and first == group
        out[number] = held if goes_on else nothing
        held = join(held, total) if whole and goes_on else total
        group, seen = last, True
    return out


def running(rows: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str], lasts: dict[str, Column] | None = None, since: dict[str, Column] | None = None, least: dict[str, Column] | None = None) -> DataFrame:
    """The rows with running values of their group (equal keys; nulls are equal) in the order of `order`, which is total in it.

    lasts: the latest known value before the row; since: how many rows lie behind the latest one, this row included, for which
    the condition holds (behind the group's start where there is none); least: the smallest value so far, this row's included.
    chunk, never null, must not fall along the order. No window is larger than a chunk, but for that over a group's chunks,
    which has a row for each of them."""
    lasts, since, least = lasts or {}, since or {}, least or {}
    inside = Window.partitionBy("__group", "__chunk").orderBy(*order)
    here, above = (inside.rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    held = rows.withColumn("__group", F.struct(*keys)).withColumn("__chunk", chunk).withColumn("__row", F.row_number().over(inside))
    place = F.struct(*order)
    totals = held.groupBy("__group", "__chunk").agg(
        F.count(F.lit(1)).alias("__rows"),
        *(F.max_by(c, F.when(c.isNotNull(), place)).alias(f"__was_{name}") for name, c in lasts.items()),
        *(F.max(F.when(c, F.col("__row"))).alias(f"__was_{name}") for name, c in since.items()),
        *(F.min(c).alias(f"__was_{name}") for name, c in least.items()),
    )
    before = Window.partitionBy("__group").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__ahead", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
    carry = totals.select(
        "__group", "__chunk", "__ahead",
        *(F.last_value(f"__was_{name}", F.lit(True)).over(before).alias(f"__was_{name}") for name in lasts),
        *(F.coalesce(F.last_value(F.col("__ahead") + F.col(f"__was_{name}"), F.lit(True)).over(before), F.lit(0)).alias(f"__was_{name}") for name in since),
        *(F.min(f"__was_{name}").over(before).alias(f"__was_{name}") for name in least),
    )
    local = held.withColumns(
        {name: F.last_value(c, F.lit(True)).over(above) for name, c in lasts.items()} | {name: F.max(F.when(c, F.col("__row"))).over(here) for name, c in since.items()} | {name: F.min(c).over(here) for name, c in least.items()}
    )
    number = F.col("__ahead") + F.col("__row")
    out = local.join(carry, ["__group", "__chunk"]).withColumns(
        {name: F.coalesce(name, f"__was_{name}") for name in lasts}
        | {name: number - F.coalesce(F.col("__ahead") + F.col(name), F.col(f"__was_{name}")) for name in since}
        | {name: F.least(name, f"__was_{name}") for name in least}
    )
    return out.drop("__group", "__chunk", "__row", "__ahead", *(f"__was_{name}" for name in (*lasts, *since, *least)))
