"""The registry of publishers: what changed from pull to pull, and what the entries look like."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cadence_seconds


def registry_diff(known: DataFrame, pull: DataFrame) -> DataFrame:
    """(publisher_key, event, from_value, to_value) of one pull against the known fleet, by one full outer join."""
    old = known.select("publisher_key", *(F.col(c).alias(f"old_{c}") for c in ("url", "version", "cadence", "needs_key")), F.lit(True).alias("was"))
    new = pull.select("publisher_key", "url", "version", "cadence", "needs_key", F.lit(True).alias("now"))
    rows = old.join(new, "publisher_key", "full_outer")
    fresh, gone, both = F.col("was").isNull(), F.col("now").isNull(), F.col("was").isNotNull() & F.col("now").isNotNull()
    before, after = cadence_seconds("old_cadence"), cadence_seconds("cadence")

    def event(when, name, old=None, new=None):
        text = [F.lit(None).cast("string") if x is None else x.cast("string") for x in (old, new)]
        return F.when(when, F.struct(F.lit(name).alias("event"), text[0].alias("from_value"), text[1].alias("to_value")))

    gated = F.col("needs_key")
    events = F.array(
        event(fresh, "PROVISIONED", None, F.col("url")), event(fresh & gated, "ACCESS_LOST", None, F.lit("NO_ACCESS")), event(gone, "ABSENT", F.lit(1)),
        event(both & (F.col("url") != "") & ~F.col("url").eqNullSafe(F.col("old_url")) & F.col("url").isNotNull(), "URL_CHANGED", F.col("old_url"), F.col("url")),
        event(both & ~F.col("version").eqNullSafe(F.col("old_version")), "VERSION_CHANGED", F.col("old_version"), F.col("version")),
        event(both & (before != after), "CADENCE_CHANGED", before, after),
        event(both & gated & ~F.col("old_needs_key"), "ACCESS_LOST", F.lit("WATCH"), F.lit("NO_ACCESS")), event(both & ~gated & F.col("old_needs_key"), "ACCESS_GAINED", F.lit("NO_ACCESS"), F.lit("WATCH")),
    )
    return rows.select("publisher_key", F.inline(F.filter(events, lambda e: e.isNotNull())))


def short_read(known: DataFrame, pull: DataFrame, share: float = 0.5) -> DataFrame:
    """(live, entries, rejected): a pull with fewer keys than this share of the live fleet is not to be compared."""
    live, entries = known.agg(F.count_distinct("publisher_key").alias("live")), pull.agg(F.count_distinct("publisher_key").alias("entries"))
    return live.crossJoin(entries).withColumn("rejected", F.col("entries") < F.col("live") * share)  # one row each


def duplicate_keys(pull: DataFrame) -> DataFrame:
    return pull.groupBy("publisher_key").agg(F.count(F.lit(1)).alias("entries")).filter("entries > 1")


def audit(pull: DataFrame) -> DataFrame:
    """(field, value, entries): histograms of cadence in seconds, version and organisation."""
    fields = F.array(*(F.struct(F.lit(n).alias("field"), c.cast("string").alias("value")) for n, c in (("cadence", cadence_seconds("cadence")), ("version", F.col("version")), ("organisation", F.col("n_name")))))
    return pull.select(F.inline(fields)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("entries"))
