"""Free text: screened once per distinct text, redacted where it does not pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what stands in place of a text that did not pass.
REDACTED = "[redacted: failed screening]"


def keywords(needles: Sequence[tuple[str, str]]) -> Callable[[Column], Column]:
    """A screener: the category of the first needle that a text holds (lower case); null where none."""
    return lambda text: F.coalesce(*(F.when(F.contains(F.lower(text), F.lit(n.lower())), F.lit(c)) for n, c in needles))


def screen(texts: DataFrame, screener: Sequence[tuple[str, str]] | Callable[[Column], Column]) -> DataFrame:
    """(digest, text, verdict, category) of each distinct text: BLOCK with the category that the screener (see keywords) gives,
    else PASS. Only digests and one text for each are shuffled, aggregated before the exchange."""
    category = (screener if callable(screener) else keywords(screener))(F.col("text"))
    distinct = texts.filter(F.col("text").isNotNull()).groupBy(F.sha2("text", 256).alias("digest")).agg(F.any_value("text").alias("text"))
    return distinct.select("digest", "text", F.when(category.isNull(), "PASS").otherwise("BLOCK").alias("verdict"), category.alias("category"))


def blocked_zones(sources: DataFrame, blocked: DataFrame) -> DataFrame:
    """(zone_id, fields) of the zones with a source (publisher_key, pos) of which a field was withheld (blocked: publisher_key,
    pos, field): a zone inherits what any of its sources lost."""
    return sources.select("zone_id", "publisher_key", "pos").join(blocked, ["publisher_key", "pos"]).groupBy("zone_id").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))


def screened(texts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each occurrence with its verdict; a text without one is UNAVAILABLE and redacted as well. Null texts pass as null."""
    rows = texts.withColumn("digest", F.sha2("text", 256)).join(verdicts.select("digest", "verdict", "category"), "digest", "left")
    verdict = F.when(F.col("text").isNull(), "PASS").otherwise(F.coalesce("verdict", F.lit("UNAVAILABLE")))
    return rows.withColumn("verdict", verdict).withColumn("served", F.when(verdict == "PASS", F.col("text")).otherwise(REDACTED))


def incidents(rows: DataFrame) -> DataFrame:
    """Per publisher, verdict and category: occurrences and distinct texts."""
    return rows.groupBy("publisher_key", "verdict", "category").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("digest").alias("texts"))


def first_seen(rows: DataFrame) -> DataFrame:
    """Of each blocked text its earliest sighting and how many publishers served it."""
    return rows.filter("verdict = 'BLOCK'").groupBy("digest").agg(F.min("seen_at").alias("first_seen"), F.min_by("publisher_key", "seen_at").alias("first_publisher"), F.count_distinct("publisher_key").alias("publishers"))


def unscreened(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """(digest, text) of each distinct text that has no usable verdict yet."""
    distinct = texts.filter(F.col("text").isNotNull()).select("text").distinct().select(F.sha2("text", 256).alias("digest"), "text")
    return distinct.join(cache.filter(F.col("verdict").isin("PASS", "BLOCK")).select("digest"), "digest", "left_anti")
