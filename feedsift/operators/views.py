"""Read models and checks beside the cycle: registry entries, captured files, constraints, boards, withheld publishers."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import has_body
from .history import frozen, over_days

#: Versions with a schema, the short ways to write two of them, rules that need a body, states in order of concern.
KNOWN_VERSIONS = ("3.0", "3.1", "4.0", "4.1", "4.2")
VERSION_ALIASES = {"4": "4.0", "3": "3.0"}
BODY_RULES = ("R3", "R4", "R5")
CONCERN = ("QUARANTINE", "WATCH", "NO_ACCESS", "ADMIT")
#: Versions of the rules in order, and the rules whose answers each changed.
RULESETS = ("v1", "v2")
RULESET_CHANGES = {"v2": ("R6",)}


def registry_entries(entries: DataFrame) -> DataFrame:
    """(organization, feedname, publisher_key, url, version, needs_key, active) of registry entries (entry: JSON text).

    The url stands in url.url or as text; a missing needapikey or active counts as false; publisher_key is null where a part of
    it is missing. What is no JSON object gives nulls."""
    entry = F.try_parse_json("entry")

    def text(path: str) -> Column:
        return F.nullif(F.try_variant_get(entry, path, "string"), F.lit(""))

    def flag(path: str) -> Column:
        return F.coalesce(F.try_variant_get(entry, path, "boolean"), F.lit(False))

    org, feed = text("$.issuingorganization"), text("$.feedname")
    nested = F.try_variant_get(entry, "$.url.url", "string")
    url = F.when(F.schema_of_variant(F.try_variant_get(entry, "$.url", "variant")).startswith("OBJECT"), nested).otherwise(F.try_variant_get(entry, "$.url", "string"))
    return entries.select(org.alias("organization"), feed.alias("feedname"), F.concat(org, F.lit("|"), feed).alias("publisher_key"), url.alias("url"), text("$.version").alias("version"), flag("$.needapikey").alias("needs_key"), flag("$.active").alias("active"))


def schema_version(declared: Column) -> Column:
    """The version whose schema checks a feed, or SCHEMA_UNKNOWN."""
    aliases = F.create_map(*(F.lit(x) for x in chain(*VERSION_ALIASES.items())))
    named = F.coalesce(F.try_element_at(aliases, F.trim(declared)), F.trim(declared))
    return F.when(named.isin(*KNOWN_VERSIONS), named).otherwise("SCHEMA_UNKNOWN")


def placed(rows: DataFrame, declared: str, places: DataFrame) -> DataFrame:
    """rows with place_id: the place of that two-letter code or full name (places: place_id, code, name), else null. Rows
    without a place stay, to be listed."""
    asked = F.lower(F.trim(declared))
    keys = places.select("place_id", F.explode(F.array(F.lower("code"), F.lower("name"))).alias("__asked")).filter("__asked IS NOT NULL").groupBy("__asked").agg(F.min("place_id").alias("place_id"))
    return rows.withColumn("__asked", asked).join(keys, "__asked", "left").drop("__asked")


def verified(artifacts: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, outcome) over captured artifacts (name, content) and a manifest (name, sha256, bytes): OK, CHANGED, MISSING (listed
    only) or UNLISTED (captured only). Contents are hashed where they lie; only digests are shuffled."""
    found = artifacts.select("name", F.sha2(F.col("content"), 256).alias("__sha"), F.octet_length("content").cast("long").alias("__bytes"))
    rows = found.join(manifest, "name", "full_outer")
    same = (F.col("__sha") == F.col("sha256")) & (F.col("__bytes") == F.col("bytes"))
    return rows.select("name", F.when(F.col("__sha").isNull(), "MISSING").when(F.col("sha256").isNull(), "UNLISTED").when(same, "OK").otherwise("CHANGED").alias("outcome"))


def violations(rows: DataFrame, keys: Sequence[str], constraints: Sequence[tuple[str, str, Sequence[str]]]) -> DataFrame:
    """(*keys, path, kind) of each broken constraint (column, kind, values): `required` (not null or empty) or `one_of` (null or
    one of the values). All constraints are judged in one pass over the rows."""

    def broken(column: str, kind: str, values: Sequence[str]) -> Column:
        bad = F.coalesce(F.col(column), F.lit("")) == "" if kind == "required" else F.coalesce(~F.col(column).isin(*values), F.lit(False))
        return F.when(bad, F.struct(F.lit(column).alias("path"), F.lit(kind).alias("kind")))

    return rows.select(*keys, F.explode(F.array_compact(F.array(*(broken(*c) for c in constraints)))).alias("__v")).select(*keys, "__v.path", "__v.kind")


def last_validators(polls: DataFrame) -> DataFrame:
    """(event_id, conditional, etag, last_modified): what a poll may send. It is conditional once an earlier poll of the publisher
    measured a body; both validators come from one poll, the newest earlier one that carried either."""
    body = F.when(F.col("content_hash").isNotNull() & has_body(), F.lit(True))
    carried = F.when((F.coalesce("etag", F.lit("")) != "") | (F.coalesce("last_modified", F.lit("")) != ""), F.struct("etag", "last_modified"))
    rows = over_days(polls, lasts={"measured": body, "sent": carried}).withColumn("conditional", F.coalesce("measured", F.lit(False)))
    return rows.select("event_id", "conditional", *(F.when(F.col("conditional"), F.col(f"sent.{c}")).alias(c) for c in ("etag", "last_modified")))


def without_body(publishers: DataFrame, fed: DataFrame, polls: DataFrame) -> DataFrame:
    """(publisher_key, withheld, reason) of each pollable publisher that handed in no body: withheld is the count of its newest
    poll that measured one, 0 if none did."""
    missing = publishers.filter("pollable").select("publisher_key").join(fed.select("publisher_key"), "publisher_key", "left_anti")
    known = F.when(F.col("active_count").isNotNull(), F.struct("polled_us", "event_id"))
    newest = polls.groupBy("publisher_key").agg(F.max_by("active_count", known).alias("__n"))
    return missing.join(newest, "publisher_key", "left").select("publisher_key", F.coalesce("__n", F.lit(0)).cast("long").alias("withheld"), F.lit("NO_RETAINED_BODY").alias("reason"))


def schema_error_days(polls: DataFrame) -> DataFrame:
    """(publisher_key, day, schema_errors): the sum over a day's polls with a body; null if none was checked, or one was not."""
    n, body = F.col("schema_error_count"), has_body()
    checked = F.count(F.when(body, n))
    return polls.groupBy("publisher_key", "day").agg(F.when((checked == F.count_if(body)) & (checked > 0), F.sum(F.when(body, n))).alias("schema_errors"))


def oldest_poll(board: DataFrame) -> DataFrame:
    """One row: the oldest last poll of the rows shown, null unless each has one."""
    last = F.col("last_polled_us")
    return board.agg(F.when(F.count(last) == F.count(F.lit(1)), F.min(last)).alias("oldest_us"), F.count(F.lit(1)).alias("shown"))


def newest(rows: DataFrame, n: int) -> DataFrame:
    """The n newest polls of each publisher. A window with a bound on its rank keeps n rows a task before the shuffle."""
    order = Window.partitionBy("publisher_key").orderBy(F.desc("polled_us"), F.desc("event_id"))
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def rules_changed_since(version: Column) -> Column:
    """The rules that a later version of the rules changed, sorted; an unknown version gives all that ever changed."""
    every = sorted({r for rules in RULESET_CHANGES.values() for r in rules})
    after = {v: sorted({r for w in RULESETS[k + 1 :] for r in RULESET_CHANGES.get(w, ())}) for k, v in enumerate(RULESETS)}

    def listed(rules: Sequence[str]) -> Column:
        return F.array(*map(F.lit, rules)) if rules else F.array().cast("array<string>")

    out = listed(every)
    for v, rules in after.items():
        out = F.when(version == v, listed(rules)).otherwise(out)
    return out


def churn(evaluated: DataFrame, polls: DataFrame) -> DataFrame:
    """(event_id, status, polls_in_window, advances): OK where the frozen-structure rule could be evaluated, with its measures;
    else the reason why not, without."""
    reason = F.filter("results", lambda r: r["rule_id"] == "R5")[0]["reason"]
    ok = reason == "EVALUATED"
    rows = evaluated.join(frozen(polls).select("event_id", "n", "advances"), "event_id", "left")
    return rows.select("event_id", F.when(ok, "OK").otherwise(reason).alias("status"), F.when(ok, F.col("n")).cast("long").alias("polls_in_window"), F.when(ok, F.col("advances")).cast("long").alias("advances"))


def upserted(held: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The rows of both, one for each key: that of the greatest order. Writing the same rows again changes nothing."""
    rows = held.unionByName(new)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row")).select(*keys, "__row.*")


def description_similarity(pairs: DataFrame) -> DataFrame:
    """One row over pairs (left_text, right_text): pairs with text on both sides, the upper median of their ratio of matching
    characters (to four digits), and how many are near-identical (0.90 or more), related (0.60 or more) or unlike.

    Equal pairs of texts are compared once; the median needs only the counts of at most 10,001 rounded ratios."""
    texts = pairs.filter("left_text <> '' AND right_text <> ''").groupBy("left_text", "right_text").agg(F.count(F.lit(1)).alias("n"))

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)])

    n, ratio_, parts = F.col("n"), F.col("ratio"), F.col("parts")
    counts = texts.withColumn("ratio", ratio("left_text", "right_text")).groupBy(F.round(ratio_ * 10_000).cast("int").alias("parts")).agg(
        F.sum(n).alias("n"), F.sum(F.when(ratio_ >= 0.9, n).otherwise(0)).alias("high"), F.sum(F.when(ratio_ < 0.6, n).otherwise(0)).alias("low"))
    ranked = counts.withColumn("__total", F.sum(n).over(Window.partitionBy())).withColumn("__upto", F.sum(n).over(Window.orderBy("parts")))
    total, high, low = (F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "high", "low"))
    median = F.min(F.when(F.col("__upto") > F.floor(F.col("__total") / 2), parts)) / 10_000
    return ranked.agg(total.alias("pairs"), median.alias("median"), high.alias("near_identical"), (total - high - low).alias("related"), low.alias("unlike"))
