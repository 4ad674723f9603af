"""Ordered logic over a publisher's polls, by (polled_us, event_id). A publisher's history may be a third of all polls: it is cut
into days, worked on side by side (scan.running), so that no window spans more than two of its days. Polls without a time come
first and are a chunk of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import DAY_US, day_of, has_body, poll_failed, poll_unreached
from .scan import running

ORDER = ["polled_us", "event_id"]
#: The chunk of polls without a time, below all days.
UNDATED = -(1 << 40)


def by_time() -> WindowSpec:
    return Window.partitionBy("publisher_key").orderBy(*ORDER)


def day_number() -> Column:
    return F.coalesce(F.floor(F.col("polled_us") / DAY_US), F.lit(UNDATED)).cast("long")


def numbered(polls: DataFrame) -> DataFrame:
    """Adds n: the poll's number in its publisher's history, from 1."""
    return over_days(polls, since={"n": F.lit(False)})


def over_days(polls: DataFrame, **found: dict[str, Column]) -> DataFrame:
    return running(polls, ["publisher_key"], day_number(), ORDER, **found)


def poll_status(polls: DataFrame) -> DataFrame:
    return polls.withColumn("failed", poll_failed()).withColumn("unreached", poll_unreached()).withColumn("has_body", has_body())


def consecutive_failures(polls: DataFrame) -> DataFrame:
    """Adds failures: the run of failed polls ending here; a poll that never left this side stops it and has null itself."""
    rows = poll_status(polls)
    rows = over_days(rows, since={"failures": ~F.col("failed") | F.col("unreached")})
    return rows.withColumn("failures", F.when(~F.col("unreached"), F.col("failures")))


def unchanged_streak(polls: DataFrame) -> DataFrame:
    """Adds unchanged: how many polls back, this one included, had this content hash without a failure between; 0 if failed."""
    rows = over_days(poll_status(polls), lasts={"before": F.struct("content_hash")})
    lost = F.col("failed") | F.col("content_hash").isNull()
    rows = over_days(rows, since={"unchanged": lost | ~F.coalesce(F.col("content_hash") == F.col("before.content_hash"), F.lit(False))})
    return rows.withColumn("unchanged", F.when(lost, 0).otherwise(F.col("unchanged") + 1).cast("long")).drop("before")


def latest_polls(polls: DataFrame, n: int) -> DataFrame:
    """The newest n polls of each publisher with their place; polls without a time come last."""
    newest = Window.partitionBy("publisher_key").orderBy(F.desc_nulls_last("polled_us"), F.desc("event_id"))
    return polls.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= n)


def retained_polls(polls: DataFrame, n: int, days: int) -> DataFrame:
    """The newest n polls of each publisher that are at most so many days older than the newest of all."""
    last = polls.agg((F.max("polled_us") - days * DAY_US).alias("__least"))  # one row
    return latest_polls(polls, n).crossJoin(F.broadcast(last)).filter(F.col("polled_us") >= F.col("__least")).drop("place", "__least")


def dedupe_polls(polls: DataFrame) -> DataFrame:
    """One poll per publisher and time: that with the greatest event_id."""
    best = polls.groupBy("publisher_key", "polled_us").agg(F.max("event_id").alias("event_id"))
    return polls.join(best, ["publisher_key", "polled_us", "event_id"], "left_semi")


def carry_forward(polls: DataFrame) -> DataFrame:
    """A not-modified poll takes the body's fields from the latest earlier poll with a content hash; schema errors never."""
    fields = ["update_us", "active_count", "active_with_past_end_date", "active_undated", "content_hash", "structural_hash"]
    body = F.struct(*fields)
    rows = over_days(poll_status(polls), lasts={"last_body": F.when(F.col("has_body") & F.col("content_hash").isNotNull(), body)})
    carried = F.col("not_modified") & ~F.col("failed") & F.col("last_body").isNotNull()
    rows = rows.withColumn("carried_forward", carried)
    for f in fields:
        rows = rows.withColumn(f, F.when(F.col("carried_forward"), F.col(f"last_body.{f}")).otherwise(F.col(f)))
    age = (F.col("polled_us") - F.col("update_us")) / 1_000_000
    return rows.withColumn("update_age_seconds", F.when(F.col("carried_forward"), age).otherwise(F.col("update_age_seconds"))).drop("last_body")


def hash_changes(polls: DataFrame) -> DataFrame:
    """(publisher_key, day, hash_changes): content hashes unlike the last one known, carried over midnight; the first ever
    is no change."""
    rows = over_days(polls, lasts={"known_hash": F.col("content_hash")})
    changed = F.col("content_hash").isNotNull() & F.col("known_hash").isNotNull() & (F.col("content_hash") != F.col("known_hash"))
    return rows.groupBy("publisher_key", day_of("polled_us").alias("day")).agg(F.count_if(changed).alias("hash_changes"))


def frozen(polls: DataFrame) -> DataFrame:
    """The structure rule's measures for each usable poll (not failed, hash and time known, one per time): (event_id, oldest,
    run_start, n, advances).

    Stamps are compared with the last known one before them; the poll before the window is its baseline, so a stamp that is
    the first known in the window counts only if the known one before it is that baseline."""
    usable = poll_status(polls).filter(~F.col("failed") & F.col("structural_hash").isNotNull() & F.col("polled_us").isNotNull())
    best = F.max_by(F.struct("structural_hash", "update_us"), "event_id").alias("best")
    rows = usable.groupBy("publisher_key", "polled_us").agg(F.max("event_id").alias("event_id"), best).select("publisher_key", "polled_us", "event_id", "best.*")
    at = F.col("polled_us").alias("at")
    known = F.when(F.col("update_us").isNotNull(), F.struct(F.col("update_us").alias("stamp"), at))
    rows = over_days(rows, lasts={"before": F.struct("structural_hash", at), "known": known}, least={"oldest": F.col("polled_us")})
    rows = rows.withColumn("__begins", F.when(F.coalesce(F.col("structural_hash") == F.col("before.structural_hash"), F.lit(False)), None).otherwise(F.col("polled_us")))
    rows = over_days(rows, lasts={"run_start": F.col("__begins")}).withColumn("run_start", F.coalesce("__begins", "run_start"))
    rows = rows.withColumn("__advance", F.coalesce(F.col("update_us") > F.col("known.stamp"), F.lit(False)).cast("long"))
    # the last 24 hours of a run lie in a poll's day and the one before: a poll is looked at in its own day and lent to the next
    rows = rows.withColumn("__day", F.explode(F.array(day_number(), day_number() + 1)))
    day = Window.partitionBy("publisher_key", "__day", "run_start").orderBy("polled_us").rangeBetween(-DAY_US, 0)
    first = F.first_value(F.when(F.col("update_us").isNotNull(), F.struct("__advance", F.col("known.at").alias("at"))), F.lit(True)).over(day)
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(day), "__sum": F.sum("__advance").over(day), "__first": first, "__base": F.first_value("before.at").over(day)})
    lost = F.when(F.col("__first.at") < F.col("__base"), F.col("__first.__advance")).otherwise(0)
    return rows.filter(F.col("__day") == day_number()).select("event_id", "oldest", "run_start", "n", (F.col("__sum") - lost).alias("advances"))
