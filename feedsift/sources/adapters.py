"""Feed tables derived from the star-schema tables: the poll log, registry pulls, zones and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Cadences and versions dealt to the registry's entries, fields of which a zone needs either.
CADENCES = ("1m", "5m", "10m", "30m", "60m", "72h", "168h", None)
VERIFIED = (
    ("is_start_date_verified", "start_date_accuracy"), ("is_start_position_verified", "beginning_accuracy"),
    ("is_end_date_verified", "end_date_accuracy"), ("is_end_position_verified", "ending_accuracy"),
)
#: Rows that one order may have: what its zones' places are numbered up to.
LINES = 1 << 20
#: Users that make one publisher of the poll log: their number grows with the table, the polls of each do not.
USERS = 30
VERSIONS = ("3.1", "4", "4.1", "4.2", "CWZ 1.0")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def poll_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_polls(table(spark, sf_dir, "events"))


def as_polls(events: DataFrame) -> DataFrame:
    """One row per poll, from a table or a stream of events: times in microseconds since 1970, measures null where nothing was
    measured."""
    org, g, k, kind = F.col("org"), F.col("g"), F.col("k"), F.col("event_type")
    events = events.select(
        "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("polled_us"), F.floor(F.col("user_id") / USERS).cast("long").alias("org"), (F.floor(F.col("user_id") / USERS) % 5).cast("int").alias("g"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"), "event_type", "value",
    )
    error, body = kind == "error", ~kind.isin("error", "view")
    age = (
        F.when(g == 0, F.lit(1e8)).when(g == 1, F.col("value")).when(g == 2, F.lit(691200.0))
        .when(g == 3, F.when(k >= 10, (5 - k).cast("double"))).otherwise(F.lit(3600.0))
    )
    structural = F.when(~error, F.when(g.isin(0, 4), F.lit("c")).when(g == 1, F.dayofmonth(F.timestamp_micros("polled_us")).cast("string")).otherwise((k % 2).cast("string")))
    rows = events.select(
        "event_id", F.concat(F.lit("org"), org, F.lit("|feed"), org).alias("publisher_key"), "polled_us",
        F.when(error, F.when(k % 10 == 0, 0).otherwise(503)).when(kind == "view", 304).otherwise(200).alias("http_status"),
        (kind == "view").alias("not_modified"), F.when(error, F.lit("failed")).alias("error"),
        F.when(error, F.when(k % 10 == 0, "OWN_SIDE").otherwise("PUBLISHER")).alias("error_origin"),
        F.when(~error, F.col("value")).alias("latency_ms"), age.alias("update_age_seconds"),
        F.when(body, k).alias("active_count"),
        F.when(body, F.when(g == 0, k).when(g == 1, F.floor(k / 4).cast("int")).otherwise(0)).alias("active_with_past_end_date"),
        F.when(body, 0).alias("active_undated"),
        F.when(g == 2, "SCHEMA_UNKNOWN").otherwise("4.2").alias("schema_version_used"),
        F.when(body & (g != 2), F.when((g == 3) & (k % 11 == 0), 2).otherwise(0)).alias("schema_error_count"),
        structural.alias("structural_hash"), F.concat(structural, F.lit(":"), k % 3).alias("content_hash"),
        F.lit(3600).alias("declared_cadence_seconds"), g.alias("g"),
    )
    stamp = F.when(F.col("g") == 0, F.lit(1_500_000_000_000_000)).otherwise(F.col("polled_us") - F.round(F.col("update_age_seconds") * 1_000_000).cast("long"))
    return rows.withColumn("update_us", stamp.cast("long")).drop("g")


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses before they are judged, one for each page: (page_id, allowed, transport_error, not_modified, http_status, body)."""
    n = F.col("page_id")
    allowed = F.lower(F.regexp_extract("url", "^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https") & (n % 23 != 0)
    return table(spark, sf_dir, "pages").select(
        n, F.coalesce(allowed, F.lit(False)).alias("allowed"), F.when(n % 5 == 1, "Timeout").alias("transport_error"), (n % 7 == 1).alias("not_modified"),
        F.when((n % 7 == 1) & (n % 2 == 0), 304).when(n % 11 == 3, 503).otherwise(200).alias("http_status"), F.when(n % 13 != 4, F.when(n % 17 == 5, "[1, 2").otherwise('{"features": []}')).alias("body"),
    )


def registry_pull(spark: SparkSession, sf_dir: str, pull: int) -> DataFrame:
    """The registry as pull 1 or 2 read it."""
    key = F.col("s_suppkey")
    cadence = F.element_at(F.array(*(F.lit(x) for x in CADENCES)), (key % 8 + 1).cast("int"))
    url = F.concat(F.lit("https://feeds.example/"), key)
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat("n_name", F.lit("|"), "s_name").alias("publisher_key"), key.alias("source_key"), "n_name",
        (F.when(key % 7 == 1, F.concat(url, F.lit("/v2"))).otherwise(url) if pull == 2 else url).alias("url"),
        F.element_at(F.array(*(F.lit(x) for x in VERSIONS)), (key % 5 + 1).cast("int")).alias("version"),
        (F.when(key % 9 == 2, "15m").otherwise(cadence) if pull == 2 else cadence).alias("cadence"),
        ((key % 20 == 0) != (key % 11 == 5) if pull == 2 else key % 20 == 0).alias("needs_key"),
    )
    return rows.filter("source_key % 10 <> 3") if pull == 2 else rows.filter("source_key % 13 <> 4")


def registry_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_key, entry): the registry's entries as JSON text; some lack a field, one in 19 is broken."""
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    url = F.concat(F.lit("https://feeds.example/"), key)
    fields = [
        F.when(key % 17 != 0, F.col("n_name")).alias("issuingorganization"), F.col("s_name").alias("feedname"), F.element_at(F.array(*(F.lit(x) for x in VERSIONS)), (key % 5 + 1).cast("int")).alias("version"),
        F.when(key % 20 == 0, True).alias("needapikey"), F.when(key % 3 == 0, True).when(key % 3 == 1, False).alias("active"),
    ]
    nested, plain = (F.to_json(F.struct(*fields, u.alias("url"))) for u in (F.struct(url.alias("url")), url))
    return rows.select(key.alias("source_key"), F.when(key % 19 == 0, "[1").when(key % 2 == 0, nested).otherwise(plain).alias("entry"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point and line zones of six publishers; a line runs east from its first point for `length` degrees.

    pos numbers the zones in feed order: by order, then by the row's place among the order's rows, of which there may be LINES
    (rows that are equal throughout take either place). Places keep a distance of some 2 km between latitudes -60 and
    60, then go on two degrees further east; beyond some 50 million parts they meet again."""
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag", "l_linestatus")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumn("place", F.row_number().over(place))  # last, so that zones lie by order
    step = F.floor(F.col("l_partkey") / 50) + 5000
    g = F.col("l_suppkey") % 6
    present = F.col("l_orderkey") % 400 != 0
    start = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    rows = lines.select(
        F.col("l_partkey").alias("part_key"), F.col("l_orderkey").alias("order_key"),
        F.concat(F.lit("p"), g).alias("publisher_key"), (F.col("l_orderkey") * LINES + F.col("place")).alias("pos"),
        F.concat("l_orderkey", F.lit("-"), F.when(F.col("l_linenumber") == 7, 1).otherwise(F.col("l_linenumber"))).alias("feature_id"),
        F.when(present, (69 + 2 * F.floor(step / 6000)) % 360 - 180 + (F.col("l_partkey") % 50) * 0.02 + g * 0.0005 * (F.col("l_partkey") % 4)).alias("lon"),
        F.when(present, 40 + (step % 6000 - 5000) * 0.02).alias("lat"),
        F.when(F.col("l_linenumber") % 2 == 1, F.lit(0.0)).otherwise(0.001 * (1 + F.col("l_quantity") % 10)).alias("length"),
        F.col("l_returnflag").alias("data_source_id"), F.array("p_name", F.concat(F.lit("State Route "), F.col("l_partkey") % 9)).alias("road_names"),
        F.when(F.col("l_linestatus") == "O", "northbound").otherwise("unknown").alias("direction"),
        start.alias("start_us"), (start + F.col("l_quantity").cast("long") * 86_400_000_000).alias("end_us"),
        F.when(F.col("l_orderkey") % 13 != 0, start + (F.col("l_orderkey") % 30) * 86_400_000_000).alias("update_us"),
    )
    a, b = F.array("lon", "lat"), F.array(F.col("lon") + F.col("length"), F.col("lat"))
    vertices = F.when(F.col("lon").isNull(), F.array().cast("array<array<double>>")).when(F.col("length") == 0, F.array(a)).otherwise(F.array(a, b))
    return rows.withColumn("vertices", vertices)


def zone_verdicts(pairs: DataFrame) -> DataFrame:
    """Adjudications of some pairs: (left_pos, right_pos, verdict)."""
    return pairs.select("left_pos", "right_pos", zone_verdict("left_pos", "right_pos").alias("verdict")).filter("verdict IS NOT NULL")


def zone_verdict(left: str, right: str) -> Column:
    n = (F.col(left) + F.col(right)) % 7
    return F.when(n < 2, "DUPLICATE").when(n == 2, "DISTINCT").when(n == 3, "UNSURE")


def zone_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of merged zones: each publisher's first zone of a part, with the fields that it states."""
    pos = F.col("pos")

    def every(n: int, value: str, shift: int = 0):
        return F.when((pos + shift) % n == 0, value)

    first = zones(spark, sf_dir).groupBy("part_key", "publisher_key").agg(F.min_by(F.struct("pos", "lon", "lat", "length", "update_us", "start_us", "end_us", "direction"), "pos").alias("z"))
    pairs = [f for i, (v, a) in enumerate(VERIFIED) for f in (every(2, "true", i).alias(v), every(3, "estimated", i).alias(a))]
    return first.select(F.concat(F.lit("z"), "part_key").alias("zone_id"), "publisher_key", "z.*").select(
        "zone_id", "publisher_key", "pos", "lon", "lat", "length", "update_us", "direction", F.col("start_us").cast("string").alias("start_date"), F.when(pos % 11 != 0, F.col("end_us").cast("string")).alias("end_date"),
        F.when(pos % 3 == 0, "some-lanes-closed").when(pos % 3 == 1, "all-lanes-open").alias("vehicle_impact"), F.when(pos % 4 != 0, "channel-device-method").alias("location_method"), *pairs,
    )


def publisher_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trust state of the zones' publishers; some have none."""
    n = F.sum("s_nationkey")
    rows = table(spark, sf_dir, "supplier").groupBy(F.concat(F.lit("p"), F.col("s_suppkey") % 6).alias("publisher_key")).agg(n.alias("n"))
    return rows.filter("n % 7 <> 0").select("publisher_key", F.element_at(F.array(*(F.lit(s) for s in ("ADMIT", "WATCH", "QUARANTINE"))), (F.col("n") % 3 + 1).cast("int")).alias("state"), (F.col("n") % 5 == 0).alias("decommissioned"))


def registry_pulls(spark: SparkSession, sf_dir: str, pulls: int = 8) -> DataFrame:
    """The entries of several pulls: (publisher_key, host_key, pull, needs_key)."""
    s, pull = F.col("s_suppkey"), F.col("pull")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.explode(F.sequence(F.lit(1), F.lit(pulls))).alias("pull")).filter((s * 5 + pull) % 11 > 3)
    return rows.select(F.col("s_name").alias("publisher_key"), F.concat(F.lit("org"), s % 5, F.lit("|feed"), s % 5).alias("host_key"), pull.cast("long").alias("pull"), ((s + pull) % 9 < 2).alias("needs_key"))


def feed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feed_key, body): a feature collection as JSON text for each order's zones; a few bodies are broken or hold no list."""
    props = F.struct(
        F.struct("data_source_id", "direction", "road_names", F.col("feature_id").alias("description")).alias("core_details"), F.col("start_us").cast("string").alias("start_date"),
        F.when(F.col("pos") % 11 != 0, F.col("end_us").cast("string")).alias("end_date"), F.when(F.col("pos") % 3 != 0, "active").otherwise("planned").alias("event_status"),
    )
    shape = F.when(F.size("vertices") > 0, F.struct(F.when(F.col("length") == 0, "Point").otherwise("LineString").alias("type"), F.col("vertices").alias("coordinates")))
    feature = F.struct(F.col("feature_id").alias("id"), F.lit("Feature").alias("type"), props.alias("properties"), shape.alias("geometry"))
    rows = zones(spark, sf_dir).groupBy(F.col("order_key").alias("feed_key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", feature.alias("f")))), lambda x: x["f"]).alias("features"))
    whole = F.to_json(F.struct(F.struct(F.col("feed_key").cast("string").alias("update_date")).alias("feed_info"), "features"))
    broken = F.when(F.col("feed_key") % 17 == 0, "[1, 2").when(F.col("feed_key") % 19 == 0, '{"features": 5}').otherwise(whole)
    return rows.select("feed_key", broken.alias("body"))


#: Parts whose zones of one publisher make a feed of its own, so that no body grows with the tables.
BLOCK = 50


def publisher_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feed_key, publisher_key, body): the feeds of the zones' publishers as JSON text, a feed for each block of parts; one in 13 is
    broken."""
    block = F.floor(F.col("part_key") / BLOCK)
    core = F.struct("data_source_id", "direction", "road_names", F.concat(F.get("road_names", F.lit(0)), F.lit(" at "), F.get("road_names", F.lit(1))).alias("description"))
    props = F.struct(core.alias("core_details"), F.col("start_us").cast("string").alias("start_date"), F.col("end_us").cast("string").alias("end_date"), F.lit("active").alias("event_status"))
    point, line = (F.to_json(F.struct(F.lit(kind).alias("type"), c.alias("coordinates"))) for kind, c in (("Point", F.get("vertices", F.lit(0))), ("LineString", F.col("vertices"))))
    shape = F.parse_json(F.when(F.size("vertices") == 1, point).when(F.size("vertices") > 1, line))
    feature = F.struct(F.col("feature_id").alias("id"), F.lit("Feature").alias("type"), props.alias("properties"), shape.alias("geometry"))
    rows = zones(spark, sf_dir).groupBy("publisher_key", block.alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.to_json(feature).alias("f")))), lambda x: x["f"]).alias("features"))
    whole = F.concat(F.lit('{"feed_info": {"update_date": "'), F.col("block").cast("string"), F.lit('"}, "features": ['), F.array_join("features", ","), F.lit("]}"))
    return rows.select(F.concat("publisher_key", F.lit("-"), "block").alias("feed_key"), "publisher_key", F.when(F.col("block") % 13 == 6, "[1, 2").otherwise(whole).alias("body"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free texts as publishers serve them: one row per occurrence."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("publisher_key"), F.col("doc_id").alias("seen_at"), "text")
