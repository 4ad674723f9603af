"""The fleet as it stood at a time: what the registry's pulls did, who was a member, who was gated, and in which state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BANDS = ("ADMIT", "WATCH", "QUARANTINE", "NO_ACCESS")
JOINING, LEAVING = ("PROVISIONED", "REAPPEARED"), ("DECOMMISSIONED",)


def absences(pulls: DataFrame) -> DataFrame:
    """(publisher_key, pull, present, missing, needs_key, had_key) of every publisher for each pull since its first: missing
    counts the pulls since it was last there, had_key is the flag of the last pull that had it before."""
    last = pulls.agg(F.max("pull")).first()[0] or 0
    known = pulls.groupBy("publisher_key").agg(F.min("pull").alias("first"))
    grid = known.select("publisher_key", "first", F.explode(F.sequence("first", F.lit(last).cast("long"))).alias("pull"))
    rows = grid.join(pulls.select("publisher_key", "pull", "needs_key", F.lit(True).alias("present")), ["publisher_key", "pull"], "left").withColumn("present", F.coalesce("present", F.lit(False)))
    order = Window.partitionBy("publisher_key").orderBy("pull")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last_value(F.when(F.col("present"), F.col("pull")), F.lit(True)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("publisher_key", "pull", "first", "present", (F.col("pull") - seen).alias("missing"), "needs_key", F.last_value(F.when(F.col("present"), F.col("needs_key")), F.lit(True)).over(before).alias("had_key"), F.lag("present").over(order).alias("was_present"))


def registry_events(pulls: DataFrame, patience: int = 3) -> DataFrame:
    """(publisher_key, pull, event) over all pulls: a publisher is ABSENT until it has missed `patience` pulls, then
    DECOMMISSIONED; it REAPPEARED when it is back after any absence."""
    present, gated = F.col("present"), F.col("needs_key")
    events = F.array(
        F.when(F.col("pull") == F.col("first"), "PROVISIONED"), F.when(present & ~F.col("was_present"), "REAPPEARED"),
        F.when(~present & (F.col("missing") < patience), "ABSENT"), F.when(~present & (F.col("missing") == patience), "DECOMMISSIONED"),
        F.when(present & gated & ~F.coalesce("had_key", F.lit(False)), "ACCESS_LOST"), F.when(present & ~gated & F.coalesce("had_key", F.lit(False)), "ACCESS_GAINED"),
    )
    return absences(pulls).select("publisher_key", "pull", F.explode(F.array_compact(events)).alias("event"))


def last_of(events: DataFrame, kinds: tuple[str, ...], at: int) -> DataFrame:
    """(publisher_key, event): the last of these kinds of event up to pull `at`."""
    rows = events.filter(F.col("event").isin(*kinds) & (F.col("pull") <= at))
    return rows.groupBy("publisher_key").agg(F.max_by("event", "pull").alias("event"))


def members_at(events: DataFrame, at: int) -> DataFrame:
    return last_of(events, JOINING + LEAVING, at).filter(F.col("event").isin(*JOINING)).select("publisher_key")


def gated_at(events: DataFrame, at: int) -> DataFrame:
    return last_of(events, ("ACCESS_LOST", "ACCESS_GAINED"), at).filter("event = 'ACCESS_LOST'").select("publisher_key")


def snapshot_at(events: DataFrame, states: DataFrame, at: int) -> DataFrame:
    """(publisher_key, state) of every member: NO_ACCESS where gated, WATCH where no state is known."""
    gated = gated_at(events, at).withColumn("__gated", F.lit(True))
    rows = members_at(events, at).join(states, "publisher_key", "left").join(gated, "publisher_key", "left")
    return rows.select("publisher_key", F.when(F.col("__gated"), "NO_ACCESS").otherwise(F.coalesce("state", F.lit("WATCH"))).alias("state"))


def band_counts(snapshot: DataFrame, shown) -> DataFrame:
    """(band, shown, total): all four bands appear; shown counts what the filter lets through."""
    bands = snapshot.sparkSession.createDataFrame([(b,) for b in BANDS], "band string")
    counts = snapshot.groupBy(F.col("state").alias("band")).agg(F.count_if(shown).alias("shown"), F.count(F.lit(1)).alias("total"))
    return bands.join(counts, "band", "left").select("band", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("shown", "total")))


def horizon(polls: DataFrame, changes: DataFrame, events: DataFrame) -> DataFrame:
    """One row: the earliest poll, transition and registry event that can be replayed."""
    parts = [polls.agg(F.min("polled_us").alias("earliest_poll")), changes.agg(F.min("polled_us").alias("earliest_transition")), events.agg(F.min("pull").alias("earliest_pull"))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each
