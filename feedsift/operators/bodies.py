"""Feed bodies as JSON text: features, header, hashes and consistency. What is malformed gives no rows and no error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .views import violations


def vertices(geometry: Column) -> Column:
    """The (lon, lat) of a GeoJSON geometry (variant): of a Point its one, of a LineString or MultiPoint all in order, MultiPoints as
    lines; none of any other kind. Entries that are too short or hold no numbers are left out."""

    def pair(x: Column) -> Column:
        return F.array(F.try_variant_get(x, "$[0]", "double"), F.try_variant_get(x, "$[1]", "double"))

    kind, coordinates = F.try_variant_get(geometry, "$.type", "string"), F.try_variant_get(geometry, "$.coordinates", "variant")
    line = F.transform(F.try_variant_get(coordinates, "$", "array<variant>"), pair)
    found = F.when(kind == "Point", F.array(pair(coordinates))).when(kind.isin("LineString", "MultiPoint"), line)
    return F.coalesce(F.filter(found, lambda p: F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull()), F.array().cast("array<array<double>>"))


def features(bodies: DataFrame) -> DataFrame:
    """(feed_key, pos, feature_id, shape, vertices, start_date, end_date, event_status, description, road_names, direction,
    data_source_id, raw): a row for each feature in feed order. Core fields are read from core_details if that is an object, else from the properties."""
    body = F.try_parse_json("body")
    rows = bodies.select("feed_key", F.posexplode(F.try_variant_get(body, "$.features", "array<variant>")).alias("pos", "f"))

    def core(field: str, kind: str) -> Column:
        nested = F.schema_of_variant(F.try_variant_get("f", "$.properties.core_details", "variant")).startswith("OBJECT")
        return F.when(nested, F.try_variant_get("f", f"$.properties.core_details.{field}", kind)).otherwise(F.try_variant_get("f", f"$.properties.{field}", kind))

    text = {"id": "feature_id", "properties.start_date": "start_date", "properties.end_date": "end_date"}
    return rows.select(
        "feed_key", F.col("pos").cast("long").alias("pos"), *(F.try_variant_get("f", f"$.{path}", "string").alias(name) for path, name in text.items()),
        F.try_variant_get("f", "$.geometry.type", "string").alias("shape"), F.try_variant_get("f", "$.geometry", "string").alias("geometry"),
        F.coalesce(core("event_status", "string"), F.try_variant_get("f", "$.properties.event_status", "string")).alias("event_status"),
        core("description", "string").alias("description"), core("road_names", "array<string>").alias("road_names"), core("direction", "string").alias("direction"), core("data_source_id", "string").alias("data_source_id"),
        vertices(F.try_variant_get("f", "$.geometry", "variant")).alias("vertices"), F.to_json("f").alias("raw"),
    )


def header(bodies: DataFrame) -> DataFrame:
    """(feed_key, readable, update_date): from feed_info, else from road_event_feed_info."""
    body = F.try_parse_json("body")
    stamp = F.coalesce(*(F.try_variant_get(body, f"$.{x}.update_date", "string") for x in ("feed_info", "road_event_feed_info")))
    return bodies.select("feed_key", body.isNotNull().alias("readable"), stamp.alias("update_date"))


def hashes(rows: DataFrame) -> DataFrame:
    """(feed_key, content_hash, structural_hash): SHA-256 over the sorted digests of the features, so the order in the feed does
    not matter; the structural one leaves out free text. A feature without properties counts by its raw text."""

    def digest(*more: str) -> Column:
        core = F.to_json(F.struct("feature_id", "geometry", "start_date", "end_date", "event_status", *more, F.when(F.coalesce("start_date", "end_date", "feature_id").isNull(), F.col("raw")).alias("odd")), {"ignoreNullFields": "false"})
        return F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2(core, 256))), ""), 256)

    return rows.groupBy("feed_key").agg(digest("description", "road_names").alias("content_hash"), digest().alias("structural_hash"))


def consistency(rows: DataFrame, now_us: Column) -> DataFrame:
    """(feed_key, features, active, active_past, active_undated): active features, those whose end has passed, and those whose
    end is missing or unreadable."""
    active, end = F.col("event_status") == "active", F.expr("try_cast(end_date AS long)")
    return rows.groupBy("feed_key").agg(F.count(F.lit(1)).alias("features"), F.count_if(active).alias("active"), F.count_if(active & (end < now_us)).alias("active_past"), F.count_if(active & end.isNull()).alias("active_undated"))


def work_zone_fields(rows: DataFrame) -> DataFrame:
    """(feed_key, pos, field, value) of each property of a feature that is neither an object nor a list."""
    held = F.try_variant_get(F.try_parse_json("raw"), "$.properties", "map<string,variant>")
    entries = rows.select("feed_key", "pos", F.explode(held).alias("field", "v"))
    kind = F.schema_of_variant("v")
    plain = ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY") & (kind != "VOID")
    return entries.filter(plain).select("feed_key", "pos", "field", F.try_variant_get("v", "$", "string").alias("value"))


def observations(feeds: DataFrame, now_us: Column, constraints: Sequence[tuple[str, str, Sequence[str]]]) -> DataFrame:
    """What the body of each feed measures: (feed_key, update_date, features, active, active_past, active_undated, schema_errors,
    content_hash, structural_hash). Feeds without a feature measure nothing."""
    rows = features(feeds)
    errors = violations(rows, ["feed_key"], constraints).groupBy("feed_key").agg(F.count(F.lit(1)).alias("schema_errors"))
    found = consistency(rows, now_us).join(hashes(rows), "feed_key").join(errors, "feed_key", "left").join(header(feeds).select("feed_key", "update_date"), "feed_key")
    return found.withColumn("schema_errors", F.coalesce("schema_errors", F.lit(0)))
