"""Daily aggregates of polls and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import day_of
from .history import hash_changes, poll_status

KEYS = ["publisher_key", "day"]


def publisher_daily(polls: DataFrame) -> DataFrame:
    """Per publisher and UTC day: polls by kind, latency percentiles by nearest rank, the greatest age, schema errors (null
    unless every body was checked) and hash changes."""
    rows = poll_status(polls).withColumn("day", day_of("polled_us"))
    latency, errors, bodies = F.when(~F.col("failed"), F.col("latency_ms")), F.when(F.col("has_body"), F.col("schema_error_count")), F.count_if("has_body")
    daily = rows.withColumn("__latency", latency).withColumn("__errors", errors).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("poll_count"), F.count_if("failed").alias("failure_count"), F.count_if(F.col("not_modified") & ~F.col("failed")).alias("not_modified_count"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY __latency)").alias("latency_p50_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY __latency)").alias("latency_p95_ms"),
        F.max("update_age_seconds").alias("max_update_age_seconds"),
        F.when((F.count("__errors") == bodies) & (F.count("__errors") > 0), F.sum("__errors")).alias("schema_error_count"),
    )
    return daily.join(hash_changes(polls), KEYS)


def poll_outcomes(polls: DataFrame) -> DataFrame:
    """Polls per publisher, day and outcome; a poll that never left this side was not attempted."""
    rows = poll_status(polls)
    kind = F.when(F.col("unreached"), "not_attempted").when(F.col("failed") & (F.col("http_status") == 0), "no_response").when(F.col("failed"), "refused").when(F.col("not_modified"), "not_modified").otherwise("fetched")
    return rows.groupBy("publisher_key", day_of("polled_us").alias("day"), kind.alias("outcome")).agg(F.count(F.lit(1)).alias("polls"))


def rule_coverage(results: DataFrame) -> DataFrame:
    """Per rule and day how often each verdict was given, with its reason: what was not checked is not a pass."""
    return results.groupBy("rule_id", day_of("polled_us").alias("day"), "verdict", "reason").agg(F.count(F.lit(1)).alias("polls"))


def fired_rules(results: DataFrame) -> DataFrame:
    """Per publisher and day the rules that fired, in the order in which they first did."""
    first = results.filter(F.col("verdict").isin("WATCH", "QUARANTINE")).groupBy("publisher_key", day_of("polled_us").alias("day"), "rule_id").agg(F.min(F.struct("polled_us", "event_id")).alias("at"))
    return first.groupBy(*KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "rule_id"))), lambda x: x["rule_id"]), ",").alias("fired_rules"))
