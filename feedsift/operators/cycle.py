"""What a cycle decides from the poll history: which publisher is due, which body stands, which rules changed their answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp
from .history import carry_forward, over_days, poll_status, unchanged_streak


def due(polls: DataFrame, now_us: int, cycle_seconds: int = 300, calm: int = 12) -> DataFrame:
    """(publisher_key, interval_seconds, due) by each publisher's newest poll: an hour once `calm` polls were alike, else the
    declared cadence within bounds; due from half a cycle before the interval is over."""
    newest = unchanged_streak(polls).groupBy("publisher_key").agg(F.max_by(F.struct("polled_us", "unchanged", "declared_cadence_seconds"), F.struct("polled_us", "event_id")).alias("p"))
    interval = F.when(F.col("p.unchanged") >= calm, 3600).otherwise(clamp(F.col("p.declared_cadence_seconds"))).cast("long")
    elapsed = (F.lit(now_us) - F.col("p.polled_us")) / 1_000_000
    return newest.select("publisher_key", interval.alias("interval_seconds"), F.coalesce(elapsed >= interval - cycle_seconds / 2, F.lit(True)).alias("due"))


def body_snapshots(polls: DataFrame) -> DataFrame:
    """(publisher_key, stored_us, content_hash, writes): the body that stands, and how often a changed one was written."""
    rows = over_days(poll_status(polls).filter(F.col("has_body") & F.col("content_hash").isNotNull()), lasts={"stood": F.col("content_hash")})
    changed = rows.filter(~F.col("content_hash").eqNullSafe(F.col("stood")))
    newest = F.max_by(F.struct("polled_us", "content_hash"), F.struct("polled_us", "event_id"))
    return changed.groupBy("publisher_key").agg(newest.alias("n"), F.count(F.lit(1)).alias("writes")).select("publisher_key", F.col("n.polled_us").alias("stored_us"), F.col("n.content_hash").alias("content_hash"), "writes")


def retained(polls: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The not-modified polls whose carried hash is that of the body which stands: only these may use it."""
    rows = carry_forward(polls).filter("carried_forward").select("publisher_key", "event_id", "content_hash")
    return rows.join(snapshots.select("publisher_key", "content_hash"), ["publisher_key", "content_hash"], "left_semi")


def last_measured(polls: DataFrame) -> DataFrame:
    known = F.when(F.col("active_count").isNotNull(), F.struct("polled_us", "event_id"))
    return polls.groupBy("publisher_key").agg(F.coalesce(F.max_by("active_count", known), F.lit(0)).cast("long").alias("active_count"))


def validators(polls: DataFrame) -> DataFrame:
    """(publisher_key, behaviour, avoidable): whether a publisher answers 304 or serves the same body again, and how many whole
    bodies were the same as the one before."""
    rows = over_days(poll_status(polls), lasts={"known_hash": F.col("content_hash")})
    again = F.count_if(F.col("has_body") & F.coalesce(F.col("content_hash") == F.col("known_hash"), F.lit(False)))
    honours = F.count_if(F.col("not_modified") & ~F.col("failed")) > 0
    return rows.groupBy("publisher_key").agg(F.when(honours, "HONOURS").when(again > 0, "IGNORES").otherwise("INCONCLUSIVE").alias("behaviour"), again.alias("avoidable"))


def replayed(stored: DataFrame, anew: DataFrame) -> DataFrame:
    """(rule_id, stored_verdict, verdict, polls): how answers differ between two versions of the rules, over the long results."""
    old = stored.select("event_id", "rule_id", F.col("verdict").alias("stored_verdict"))
    rows = old.join(anew.select("event_id", "rule_id", "verdict"), ["event_id", "rule_id"], "full_outer")
    return rows.filter(~F.col("stored_verdict").eqNullSafe(F.col("verdict"))).groupBy("rule_id", "stored_verdict", "verdict").agg(F.count(F.lit(1)).alias("polls"))


def fired_and_evaluated(evaluated: DataFrame) -> DataFrame:
    """(event_id, fired, evaluated): the rules that fired and those that could be applied, in rule order."""

    def named(keep: Callable[[Column], Column]) -> Column:
        return F.array_join(F.transform(F.filter("results", keep), lambda r: r["rule_id"]), ",")

    return evaluated.select("event_id", named(lambda r: r["verdict"].isin("WATCH", "QUARANTINE")).alias("fired"), named(lambda r: r["verdict"] != "NOT_APPLICABLE").alias("evaluated"))
