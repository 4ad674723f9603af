"""The merged feed: each zone's fields by recency of its sources, what keeps a zone out, and the output's counts.

A zone holds one source per publisher at most, so its sources fit one row; everything after the grouping is one expression
per zone and needs no further shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adapters import VERIFIED as EITHER

REQUIRED = ("start_date", "end_date", "vehicle_impact", "location_method")
FIELDS = (*REQUIRED, *(f for pair in EITHER for f in pair))
REASONS = ("null_geometry", "decommissioned_sources_only", "quarantined_sources_only", "missing_required_field")


def merged(sources: DataFrame, states: DataFrame) -> DataFrame:
    """A row for each zone: its sources, the most recent first (unknown dates last, then the lowest publisher), each with its
    publisher's state (WATCH where none is known), and the lowest publisher's geometry and direction."""
    known = sources.join(states.select("publisher_key", "state", "decommissioned"), "publisher_key", "left")
    source = F.struct(F.coalesce(-F.col("update_us"), F.lit(2**63 - 1)).alias("age"), "publisher_key", "pos", "update_us", F.coalesce("state", F.lit("WATCH")).alias("state"), F.coalesce("decommissioned", F.lit(False)).alias("decommissioned"), *FIELDS)
    return known.groupBy("zone_id").agg(F.array_sort(F.collect_list(source)).alias("sources"), F.min_by(F.struct("lon", "lat", "length", "direction"), F.struct("publisher_key", "pos")).alias("core"))


def primary() -> Column:
    return F.get("sources", F.lit(0))["publisher_key"]


def offers(field: str) -> Column:
    """The sources that state the field, the one that wins first."""
    return F.filter("sources", lambda s: s[field].isNotNull())


def resolved(field: str) -> Column:
    return F.get(offers(field), F.lit(0))[field]


def fields_long(zones: DataFrame) -> DataFrame:
    """(zone_id, field, value, publisher_key, losers) of each field that some source states; losers counts the others."""
    found = F.array(*(F.struct(F.lit(f).alias("field"), resolved(f).alias("value"), F.get(offers(f), F.lit(0))["publisher_key"].alias("publisher_key"), (F.size(offers(f)) - 1).cast("long").alias("losers")) for f in FIELDS))
    return zones.select("zone_id", F.inline(F.filter(found, lambda x: x["value"].isNotNull())))


def missing_required() -> Column:
    """Names of what the zone lacks."""
    lacks = [F.when(F.size(offers(f)) == 0, f) for f in REQUIRED] + [F.when((F.size(offers(a)) == 0) & (F.size(offers(b)) == 0), f"{a} or {b}") for a, b in EITHER]
    return F.array_compact(F.array(*lacks, F.when(F.col("core.lon").isNull(), "geometry"), F.when(F.size("sources") == 0, "sources")))


def exclusion_reason() -> Column:
    """The first reason that keeps a zone out; null if it is emitted."""
    live = F.filter("sources", lambda s: ~s["decommissioned"])
    return (
        F.when(F.col("core.lon").isNull(), "null_geometry").when(F.size(live) == 0, "decommissioned_sources_only")
        .when(F.forall(live, lambda s: s["state"] == "QUARANTINE"), "quarantined_sources_only").when(F.size(missing_required()) > 0, "missing_required_field")
    )


def exclusions(zones: DataFrame, sample: int = 200) -> DataFrame:
    """(reason, zones, first_ids): every reason's count, and its first ids for the report."""
    out = zones.select("zone_id", exclusion_reason().alias("reason")).filter("reason IS NOT NULL")
    counts = out.groupBy("reason").agg(F.count(F.lit(1)).alias("zones"))
    # the first ids by a window that keeps no more than `sample` rows a reason before they are gathered
    place = F.row_number().over(Window.partitionBy("reason").orderBy("zone_id"))
    first = out.withColumn("__n", place).filter(F.col("__n") <= sample).groupBy("reason").agg(F.array_join(F.array_sort(F.collect_list("zone_id")), ",").alias("first_ids"))
    return counts.join(first, "reason")


def missing_fields(zones: DataFrame) -> DataFrame:
    return zones.select(F.explode(missing_required()).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("zones"))


def artifact(zones: DataFrame) -> DataFrame:
    """One row: zones in, emitted, sources of the emitted, and the count of each exclusion."""
    rows = zones.select(exclusion_reason().alias("reason"), F.size("sources").cast("long").alias("n"))
    emitted = F.col("reason").isNull()
    return rows.agg(F.count(F.lit(1)).alias("input_zones"), F.count_if(emitted).alias("emitted"), F.coalesce(F.sum(F.when(emitted, F.col("n"))), F.lit(0)).alias("source_zones"), *(F.count_if(F.col("reason") == r).alias(r) for r in REASONS))


def features(zones: DataFrame) -> DataFrame:
    """The emitted zones as output columns: the primary source is the data source; a field that several sources state counts
    as a disagreement, equal values included."""
    disagreements = sum((F.when(F.size(offers(f)) > 1, 1).otherwise(0) for f in FIELDS), F.lit(0)).cast("long")
    return zones.filter(exclusion_reason().isNull()).select(
        "zone_id", primary().alias("data_source_id"), F.coalesce("core.direction", F.lit("unknown")).alias("direction"), *(resolved(f).alias(f) for f in FIELDS),
        F.array_join(F.transform("sources", lambda s: s["publisher_key"]), ",").alias("provenance"), disagreements.alias("disagreements"), F.col("core.lon").alias("lon"), F.col("core.lat").alias("lat"), F.col("core.length").alias("length"),
    )


def feed_lines(rows: DataFrame) -> DataFrame:
    """One JSON feature per line (zone_id, value), keys in a fixed order, for a text writer."""
    there = F.col("length") == 0
    shape = F.struct(F.when(there, "Point").otherwise("LineString").alias("type"), F.when(there, F.array(F.array("lon", "lat"))).otherwise(F.array(F.array("lon", "lat"), F.array(F.col("lon") + F.col("length"), F.col("lat")))).alias("coordinates"))
    feature = F.struct(shape.alias("geometry"), F.col("zone_id").alias("id"), F.struct(*sorted(("data_source_id", "direction", "disagreements", "provenance", *FIELDS))).alias("properties"), F.lit("Feature").alias("type"))
    return rows.select("zone_id", F.to_json(feature).alias("value"))


def self_validated(rows: DataFrame) -> DataFrame:
    """One row of the gate: (valid, dropped, withheld, published). Features whose dates or direction break a constraint are
    dropped once. An error that names no feature (one without id) is not a zone's fault: then nothing is published and all
    that was left is withheld, by count."""
    bad = F.coalesce(F.col("start_date").cast("long") > F.col("end_date").cast("long"), F.lit(False)) | ~F.col("direction").isin("northbound", "southbound", "eastbound", "westbound", "unknown")
    nameless = F.col("zone_id").isNull()
    counts = rows.agg(F.count_if(~bad & ~nameless).alias("valid"), F.count_if(bad & ~nameless).alias("dropped"), F.count_if(nameless).alias("__unattributed"))
    published = F.col("__unattributed") == 0
    # an unattributed error stops the drop: all that was emitted stays, withheld
    return counts.select(F.when(published, F.col("valid")).otherwise(0).alias("valid"), F.when(published, F.col("dropped")).otherwise(0).alias("dropped"), F.when(published, 0).otherwise(F.col("valid") + F.col("dropped") + F.col("__unattributed")).cast("long").alias("withheld"), published.alias("published"))


def write_feed(lines: DataFrame, folder: str, cycle: int) -> DataFrame:
    """Writes the lines of a feed compressed, under its cycle and as the latest, and gives those of the cycle as read back."""
    for place in (f"{folder}/cycle={cycle}", f"{folder}/latest"):
        lines.select("value").write.mode("overwrite").option("compression", "gzip").text(place)
    return lines.sparkSession.read.text(f"{folder}/cycle={cycle}")


def write_cycle(tables: dict[str, DataFrame], folder: str, cycle: int) -> DataFrame:
    """Writes each table of a cycle under its name and the cycle's id, and counts (name, rows) what can be read back."""
    counts = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/cycle_id={cycle}")
        held = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}/cycle_id={cycle}")
        counts.append(held.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows"))
    return reduce(DataFrame.union, counts)


def contributors(rows: DataFrame) -> DataFrame:
    """Publishers of the emitted zones and how many zones each is in."""
    return rows.select(F.explode(F.split("provenance", ",")).alias("publisher_key")).groupBy("publisher_key").agg(F.count(F.lit(1)).alias("zones"))


def changed_zones(before: DataFrame, now: DataFrame, ignored: tuple[str, ...] = ("last_seen_cycle",)) -> DataFrame:
    """The zones of now whose content, apart from the ignored columns, is new."""

    def hashed(df: DataFrame) -> DataFrame:
        return df.withColumn("content_hash", F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c not in ignored))), 256))

    return hashed(now).join(hashed(before).select("zone_id", "content_hash"), ["zone_id", "content_hash"], "left_anti")


def admitted(zones: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The zones of publishers that may contribute, and per withheld publisher the reason and the count."""
    rows = zones.join(states, "publisher_key", "left")
    reason = F.when(F.coalesce("decommissioned", F.lit(False)), "NOT_POLLABLE").when(F.col("state") == "QUARANTINE", "QUARANTINE")
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL").groupBy("publisher_key", "reason").agg(F.count(F.lit(1)).alias("zones"))
