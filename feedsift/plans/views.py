"""Queries of read models and checks, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import cadence_seconds, clamp, coordinates, day_of, has_body, line_length
from ..functions.text import TEXT_BYTES, cut_utf8, pair_key, road_label, safe_id
from ..operators import reconcile, rollup, rules, screening, views
from ..sources import adapters
from . import boards, cycles, merge, streams
from .queries import POLLS, PULLS, RESULTS, ZONES
from .queries import ORACLE_SQL as QUERIES_SQL
from .queries import join_registry_diff, seconds

#: What a feature must state, as (column, kind, values).
CONSTRAINTS = (("start_date", "required", ()), ("end_date", "required", ()), ("shape", "required", ()), ("event_status", "one_of", ("active", "completed")))


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.poll_log(spark, sf_dir).withColumn("day", day_of("polled_us"))


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.evaluate(adapters.poll_log(spark, sf_dir))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.registry_entries(adapters.registry_json(spark, sf_dir))


def prj_registry_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir)


def src_registry_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).filter("active AND publisher_key IS NOT NULL").select("publisher_key", "url")


def prj_publisher_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by whether they can be named."""
    return entries(spark, sf_dir).groupBy(F.col("publisher_key").isNull().alias("rejected")).agg(F.count(F.lit(1)).alias("entries"))


def prj_declared_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.registry_pull(spark, sf_dir, 1).select("publisher_key", views.schema_version(F.col("version")).alias("schema_version"))


def prj_us_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's declared place, written in several ways, among the nations."""
    n = F.col("n_nationkey")
    places = adapters.table(spark, sf_dir, "nation").select(n.alias("place_id"), F.concat(F.char(n + 65), F.lit("A")).alias("code"), F.col("n_name").alias("name"))
    rows = adapters.table(spark, sf_dir, "supplier").join(F.broadcast(places), F.col("s_nationkey") == F.col("place_id")).drop("place_id")
    k = F.col("s_suppkey") % 4
    declared = F.when(k == 0, F.lower("code")).when(k == 1, F.concat(F.lit(" "), F.initcap("name"))).when(k == 2, "n/a")
    return views.placed(rows.select("s_suppkey", declared.alias("declared")), "declared", places).select("s_suppkey", "place_id")


def fn_parse_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    cadence = cadence_seconds("cadence")
    return adapters.registry_pull(spark, sf_dir, 2).select("publisher_key", cadence.alias("declared_seconds"), clamp(cadence).cast("long").alias("seconds"))


def fn_send_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether no rule that needs a body fired at a poll."""
    fired = F.exists("results", lambda r: r["verdict"].isin("WATCH", "QUARANTINE") & r["rule_id"].isin(*views.BODY_RULES))
    return evaluated(spark, sf_dir).select("event_id", (~fired).alias("conditional"))


def win_last_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    etag, stamp = F.when(F.col("event_id") % 3 != 0, F.col("content_hash")), F.when(F.col("event_id") % 5 == 0, F.col("update_us").cast("string"))
    return views.last_validators(polls(spark, sf_dir).withColumn("etag", etag).withColumn("last_modified", stamp))


def join_missing_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = polls(spark, sf_dir)
    newest = rows.groupBy("publisher_key").agg(F.max_by(has_body(), F.struct("polled_us", "event_id")).alias("fed"))
    known = newest.withColumn("pollable", F.col("publisher_key") != "org4|feed4")
    return views.without_body(known, newest.filter("fed"), rows)


def agg_schema_error_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.schema_error_days(polls(spark, sf_dir))


def agg_oldest_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = polls(spark, sf_dir).groupBy("publisher_key").agg(F.max("polled_us").alias("last_polled_us"))
    return views.oldest_poll(last)


def agg_evidence_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir).select("event_id", "depth")


def prj_churn_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.churn(evaluated(spark, sf_dir), adapters.poll_log(spark, sf_dir))


def top_recent_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.newest(polls(spark, sf_dir), 20).select("publisher_key", "event_id", F.col("place").cast("long").alias("place"))


def top_daily_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven newest days of each publisher."""
    daily = rollup.publisher_daily(adapters.poll_log(spark, sf_dir)).withColumnsRenamed({"day": "polled_us"}).withColumn("event_id", F.lit(0))
    return views.newest(daily, 7).select("publisher_key", F.col("polled_us").alias("day"), "poll_count")


def top_embedded_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 newest polls of each publisher, newest last: what a packet embeds."""
    rows = views.newest(polls(spark, sf_dir), 50)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("polled_us", "event_id"))), lambda x: x["event_id"].cast("string"))
    return rows.groupBy("publisher_key").agg(F.array_join(listed, ",").alias("observations"))


def top_fleet_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, views.CONCERN)), F.col("state")), F.lit(0))
    rows = boards.asof_snapshot_at(spark, sf_dir).select("publisher_key", "state", F.when(rank == 0, 10).otherwise(rank).cast("long").alias("concern"))
    return rows.orderBy("concern", "publisher_key")


def packet_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.element_at(F.array(F.lit("v1"), F.lit("v2"), F.lit("draft")), (F.col("event_id") % 3 + 1).cast("int"))
    return evaluated(spark, sf_dir).withColumn("changed", views.rules_changed_since(version))


def set_rules_changed_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packet_versions(spark, sf_dir).select("event_id", F.array_join("changed", ",").alias("changed"))


def set_superseded_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls at which a rule fired that later versions of the rules changed."""
    fired = F.transform(F.filter("results", lambda r: r["verdict"].isin("WATCH", "QUARANTINE")), lambda r: r["rule_id"])
    return packet_versions(spark, sf_dir).filter(F.arrays_overlap(fired, F.col("changed"))).select("event_id")


def fn_safe_doc_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    value = F.when(k == 0, F.col("url")).when(k == 1, "").when(k == 2, "..").when(k == 3, F.concat(F.lit("__"), "page_id", F.lit("__"))).otherwise(F.repeat(F.concat("url", F.lit("~é%")), F.lit(60)))
    return adapters.table(spark, sf_dir, "pages").select("page_id", safe_id(F.coalesce(value, F.lit(""))).alias("id"))


def fn_truncate_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = adapters.table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    kept = cut_utf8(F.col("text"), TEXT_BYTES)
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), (F.octet_length("text") > TEXT_BYTES).alias("truncated"), F.sha2("text", 256).alias("digest"), F.sha2(kept, 256).alias("kept_digest"))


def fn_pair_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "documents").filter("text IS NOT NULL AND source IS NOT NULL").select("doc_id", pair_key(F.col("text"), F.col("source"), "model-1", "p3").alias("key"))


def prj_road_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to call each place: the road names of each publisher's first zone there, one of which is withheld."""
    name = F.get("road_names", F.lit(0))
    spelled = F.when(F.col("pos") % 2 == 1, F.upper(name)).otherwise(F.concat(F.lit(" "), name))
    route = F.get("road_names", F.lit(1))
    shown = F.when(route == "State Route 3", screening.REDACTED).otherwise(route)
    listed = F.when(F.col("pos") % 3 == 0, F.array(spelled, shown)).when(F.col("pos") % 3 == 1, F.array(shown)).otherwise(F.array().cast("array<string>"))
    rows = adapters.zones(spark, sf_dir).groupBy("part_key", "publisher_key").agg(F.min_by(F.struct("pos", "road_names", "direction"), "pos").alias("z")).select("part_key", "publisher_key", "z.*")
    names = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("publisher_key", listed.alias("names")))), lambda x: x["names"]))
    places = rows.groupBy("part_key").agg(names.alias("names"), F.min_by("direction", "publisher_key").alias("direction"))
    return places.select("part_key", road_label(F.col("names"), F.col("direction"), screening.REDACTED).alias("r")).select("part_key", "r.*")


def prj_geometry_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices stored as text and read back; what is unreadable is counted."""
    text = F.when(F.col("pos") % 9 == 0, "[[oops").otherwise(F.to_json("vertices"))
    back = adapters.zones(spark, sf_dir).select("publisher_key", "vertices", F.from_json(text, "array<array<double>>").alias("back"))
    return back.groupBy("publisher_key").agg(F.count_if(F.col("back").isNull()).alias("unreadable"), F.count_if(F.col("back") == F.col("vertices")).alias("same"), F.sum(F.size("back")).alias("vertices"))


def agg_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = [f(coordinates("vertices", k)) for k in (0, 1) for f in (F.array_min, F.array_max)]
    rows = adapters.zones(spark, sf_dir).select("publisher_key", *(e.alias(n) for e, n in zip(edges, ("west", "east", "south", "north"), strict=True)))
    return rows.groupBy("publisher_key").agg(*(F.round(f(c) * 1e6).cast("long").alias(c) for c, f in (("west", F.min), ("east", F.max), ("south", F.min), ("north", F.max))))


def fn_length_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reconcile.drop_duplicate_ids(adapters.zones(spark, sf_dir))
    return rows.select("publisher_key", "pos", F.round(line_length("vertices") * 10).cast("long").alias("decimetres"))


def agg_schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.violations(streams.parsed(spark, sf_dir), ["feed_key"], CONSTRAINTS).groupBy("feed_key", "path", "kind").agg(F.count(F.lit(1)).alias("violations"))


def src_manifest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured pages against their manifest; some were lost, changed or never listed."""
    n, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    pages = adapters.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("page-"), n).alias("name"), html.alias("html"))
    captured = pages.filter(n % 13 != 0).select("name", F.encode(F.when(n % 11 == 0, F.concat("html", F.lit("."))).otherwise(F.col("html")), "UTF-8").alias("content"))
    manifest = pages.filter(n % 17 != 0).select("name", F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("bytes"))
    return views.verified(captured, manifest)


def sink_idempotent_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = polls(spark, sf_dir).select("publisher_key", "polled_us", "event_id", "http_status")
    held = views.upserted(rows.filter("event_id % 3 <> 0"), rows.filter("event_id % 3 = 2"), ["publisher_key", "polled_us"], "event_id")
    return views.upserted(held, rows.filter("event_id % 3 <> 1").select(held.columns), ["publisher_key", "polled_us"], "event_id")


def agg_description_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the descriptions of matched zones are."""
    text = F.concat_ws(" ", F.get("road_names", F.lit(0)), F.lit("order"), F.col("order_key").cast("string"), "direction")
    texts = merge.kept(spark, sf_dir).select("pos", text.alias("text"))
    pairs = merge.judged(spark, sf_dir, "left_pos", "right_pos", "matched").filter("matched").drop("matched")
    pairs = pairs.join(texts.withColumnsRenamed({"pos": "left_pos", "text": "left_text"}), "left_pos").join(texts.withColumnsRenamed({"pos": "right_pos", "text": "right_text"}), "right_pos")
    return views.description_similarity(pairs)


def pipe_cycle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a cycle's single steps as (step, outcome, items), each over its own tables: the registry's changes, who is due,
    verdicts, bodies, feeds, zones left out. (pipe_fleet_cycle is the chain in which steps feed each other.)"""
    steps = {
        "registry": (join_registry_diff(spark, sf_dir), "event"),
        "due": (cycles.fn_due(spark, sf_dir), "due"),
        "verdict": (boards.asof_snapshot_at(spark, sf_dir), "state"),
        "body": (join_missing_bodies(spark, sf_dir), "reason"),
        "feed": (streams.src_feed_header(spark, sf_dir), "readable"),
        "zone": (merge.pub_exclusion_reason(spark, sf_dir), "reason"),
    }
    counts = [df.groupBy(F.lit(step).alias("step"), F.coalesce(F.col(c).cast("string"), F.lit("PUBLISHED")).alias("outcome")).agg(F.count(F.lit(1)).alias("items")) for step, (df, c) in steps.items()]
    return reduce(DataFrame.unionByName, counts)


QUERIES = {
    f.__name__: f
    for f in (
        prj_registry_fields, src_registry_active, prj_publisher_key, prj_declared_version, prj_us_state, fn_parse_cadence, fn_send_conditional, win_last_validator, join_missing_bodies,
        agg_schema_error_day, agg_oldest_poll, agg_evidence_depth, prj_churn_status, top_recent_observations, top_daily_window, top_embedded_observations, top_fleet_sort,
        set_rules_changed_since, set_superseded_packets, fn_safe_doc_id, fn_truncate_utf8, fn_pair_key, prj_road_label, prj_geometry_codec, agg_bbox, fn_length_m, agg_schema_violations,
        src_manifest_verify, sink_idempotent_upsert, agg_description_similarity, pipe_cycle_counts,
    )
}

ENTRIES = """e AS (
    SELECT s_suppkey AS s, s_suppkey % 19 <> 0 AS readable, CASE WHEN s_suppkey % 17 <> 0 THEN n_name END AS org, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
), entries AS (
    SELECT CASE WHEN readable THEN org END AS organization, CASE WHEN readable THEN s_name END AS feedname, CASE WHEN readable THEN org || '|' || s_name END AS publisher_key,
        CASE WHEN readable THEN 'https://feeds.example/' || s END AS url, CASE WHEN readable THEN ['3.1', '4', '4.1', '4.2', 'CWZ 1.0'][(s % 5 + 1)::INT] END AS version, readable AND s % 20 = 0 AS needs_key, readable AND s % 3 = 0 AS active
    FROM e
)"""
FIRED = "verdict IN ('WATCH', 'QUARANTINE')"
NEWEST = "row_number() OVER (PARTITION BY publisher_key ORDER BY polled_us DESC, event_id DESC)"
MISSING_BODIES = f"""SELECT publisher_key, withheld, reason FROM (
    WITH {POLLS} SELECT publisher_key, coalesce(arg_max(active_count, (polled_us, event_id)) FILTER (active_count IS NOT NULL), 0)::BIGINT AS withheld, 'NO_RETAINED_BODY' AS reason, arg_max(has_body, (polled_us, event_id)) AS fed
    FROM polls GROUP BY 1) WHERE NOT fed AND publisher_key <> 'org4|feed4'"""
VALUE = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN '' WHEN 2 THEN '..' WHEN 3 THEN '__' || page_id || '__' ELSE repeat(url || '~é%', 60) END"
CUT = ", ".join(f"CASE WHEN strlen(text) > {TEXT_BYTES} THEN TRY(decode(encode(text)[1:{n}])) ELSE text END" for n in range(TEXT_BYTES, TEXT_BYTES - 4, -1))

ORACLE_SQL = {
    "prj_registry_fields": f"WITH {ENTRIES} SELECT * FROM entries",
    "src_registry_active": f"WITH {ENTRIES} SELECT publisher_key, url FROM entries WHERE active AND publisher_key IS NOT NULL",
    "prj_publisher_key": f"WITH {ENTRIES} SELECT publisher_key IS NULL AS rejected, count(*) AS entries FROM entries GROUP BY 1",
    "prj_declared_version": f"WITH {PULLS} SELECT publisher_key, CASE version WHEN '4' THEN '4.0' WHEN 'CWZ 1.0' THEN 'SCHEMA_UNKNOWN' ELSE version END AS schema_version FROM pull1",
    "prj_us_state": "SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 2 THEN s_nationkey END AS place_id FROM supplier",
    "fn_parse_cadence": f"WITH {PULLS} SELECT publisher_key, {seconds('cadence')}::BIGINT AS declared_seconds, least(greatest({seconds('cadence')}, 300), 3600)::BIGINT AS seconds FROM pull2",
    "fn_send_conditional": f"WITH {RESULTS} SELECT event_id, NOT bool_or({FIRED} AND rule_id IN ('R3', 'R4', 'R5')) AS conditional FROM results GROUP BY 1",
    "win_last_validator": f"""WITH {POLLS}, v AS (SELECT *, CASE WHEN event_id % 3 <> 0 THEN content_hash END AS e, CASE WHEN event_id % 5 = 0 THEN update_us::VARCHAR END AS m FROM polls
    ), w AS (SELECT event_id, coalesce(bool_or(has_body AND content_hash IS NOT NULL) OVER o, false) AS conditional, last_value(CASE WHEN e IS NOT NULL OR m IS NOT NULL THEN {{'e': e, 'm': m}} END IGNORE NULLS) OVER o AS last
        FROM v WINDOW o AS (PARTITION BY publisher_key ORDER BY polled_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_id, conditional, CASE WHEN conditional THEN last.e END AS etag, CASE WHEN conditional THEN last.m END AS last_modified FROM w""",
    "join_missing_bodies": MISSING_BODIES,
    "agg_schema_error_day": f"WITH {POLLS} SELECT publisher_key, day, CASE WHEN count(schema_error_count) FILTER (has_body) = count(*) FILTER (has_body) AND count(*) FILTER (has_body) > 0 THEN sum(schema_error_count) FILTER (has_body)::BIGINT END AS schema_errors FROM polls GROUP BY ALL",
    "agg_oldest_poll": f"WITH {POLLS} SELECT min(p) AS oldest_us, count(*) AS shown FROM (SELECT max(polled_us) AS p FROM polls GROUP BY publisher_key)",
    "agg_evidence_depth": f"WITH {RESULTS} SELECT r.event_id, greatest(1, max(CASE WHEN rule_id = 'R1' AND {FIRED} THEN failures END), max(CASE WHEN rule_id = 'R5' AND {FIRED} THEN n END))::BIGINT AS depth FROM results r JOIN failures USING (event_id) LEFT JOIN frozen USING (event_id) GROUP BY 1",
    "prj_churn_status": f"WITH {RESULTS} SELECT event_id, CASE WHEN reason = 'EVALUATED' THEN 'OK' ELSE reason END AS status, CASE WHEN reason = 'EVALUATED' THEN n END AS polls_in_window, CASE WHEN reason = 'EVALUATED' THEN advances END AS advances FROM results LEFT JOIN frozen USING (event_id) WHERE rule_id = 'R5'",
    "top_recent_observations": f"WITH {POLLS} SELECT publisher_key, event_id, {NEWEST} AS place FROM polls QUALIFY place <= 20",
    "top_daily_window": f"WITH {POLLS} SELECT publisher_key, day, count(*) AS poll_count FROM polls GROUP BY publisher_key, day QUALIFY row_number() OVER (PARTITION BY publisher_key ORDER BY day DESC) <= 7",
    "top_embedded_observations": f"WITH {POLLS} SELECT publisher_key, string_agg(event_id::VARCHAR, ',' ORDER BY polled_us, event_id) AS observations FROM (SELECT * FROM polls QUALIFY {NEWEST} <= 50) GROUP BY 1",
    "top_fleet_sort": f"SELECT publisher_key, state, CASE state WHEN 'QUARANTINE' THEN 1 WHEN 'WATCH' THEN 2 WHEN 'NO_ACCESS' THEN 3 WHEN 'ADMIT' THEN 4 ELSE 10 END::BIGINT AS concern FROM ({boards.ORACLE_SQL['asof_snapshot_at']})",
    "set_rules_changed_since": f"WITH {POLLS} SELECT event_id, CASE WHEN event_id % 3 = 1 THEN '' ELSE 'R6' END AS changed FROM polls",
    "set_superseded_packets": f"WITH {RESULTS} SELECT event_id FROM results WHERE rule_id = 'R6' AND {FIRED} AND event_id % 3 <> 1",
    "fn_safe_doc_id": f"""WITH v AS (SELECT page_id, coalesce({VALUE}, '') AS v FROM pages), e AS (SELECT *, replace(replace(replace(v, '%', '%25'), '/', '%2F'), '~', '%7E') AS e FROM v)
    SELECT page_id, CASE WHEN e NOT IN ('', '.', '..') AND NOT (starts_with(e, '__') AND ends_with(e, '__')) AND strlen(e) <= 1500 THEN e
        ELSE left(e, list_max(list_filter(range(0, 201), lambda i: strlen(left(e, i)) <= 200))) || '~' || left(sha256(v), 32) END AS id FROM e""",
    "fn_truncate_utf8": f"SELECT doc_id, strlen(text)::BIGINT AS bytes, strlen(text) > {TEXT_BYTES} AS truncated, sha256(text) AS digest, sha256(coalesce({CUT})) AS kept_digest FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
    "fn_pair_key": "SELECT doc_id, least(sha256(text), sha256(source)) || '|' || greatest(sha256(text), sha256(source)) || '|model-1|p3' AS key FROM documents WHERE text IS NOT NULL AND source IS NOT NULL",
    "prj_road_label": f"""WITH {ZONES}, z AS (SELECT *, CASE WHEN road_names[2] = 'State Route 3' THEN '{screening.REDACTED}' ELSE road_names[2] END AS route, CASE WHEN pos % 2 = 1 THEN upper(road_names[1]) ELSE ' ' || road_names[1] END AS name
        FROM zones QUALIFY row_number() OVER (PARTITION BY part_key, publisher_key ORDER BY pos) = 1
    ), n AS (SELECT part_key, flatten(list(CASE pos % 3 WHEN 0 THEN [name, route] WHEN 1 THEN [route] ELSE []::VARCHAR[] END ORDER BY publisher_key)) AS names, arg_min(north, publisher_key) AS north FROM z GROUP BY 1
    ), p AS (SELECT *, list_transform(list_filter(names, lambda x: x <> '{screening.REDACTED}' AND trim(x) <> ''), lambda x: trim(x)) AS plain FROM n
    ), f AS (SELECT *, list_filter(plain, lambda x, i: list_position(list_transform(plain, lambda y: lower(y)), lower(x)) = i) AS kept, len(names) - len(plain) AS held FROM p)
    SELECT part_key, CASE WHEN len(kept) > 0 THEN array_to_string(kept, ' / ') WHEN held > 0 THEN '' WHEN north THEN 'northbound' ELSE 'unnamed' END AS label, held::BIGINT AS redacted, greatest(len(kept) - 1, 0)::BIGINT AS alternatives FROM f""",
    "prj_geometry_codec": f"WITH {ZONES} SELECT publisher_key, count(*) FILTER (pos % 9 = 0) AS unreadable, count(*) FILTER (pos % 9 <> 0) AS same, sum(CASE WHEN pos % 9 <> 0 THEN CASE WHEN lon IS NULL THEN 0 WHEN length = 0 THEN 1 ELSE 2 END END)::BIGINT AS vertices FROM zones GROUP BY 1",
    "agg_bbox": f"WITH {ZONES} SELECT publisher_key, round(min(lon) * 1e6)::BIGINT AS west, round(max(lon + length) * 1e6)::BIGINT AS east, round(min(lat) * 1e6)::BIGINT AS south, round(max(lat) * 1e6)::BIGINT AS north FROM zones GROUP BY 1",
    "fn_length_m": f"WITH {ZONES} SELECT publisher_key, pos, round(6371008.8 * radians(length) * cos(radians(lat)) * 10)::BIGINT AS decimetres FROM kept",
    "agg_schema_violations": f"""WITH {streams.FEATURES}, broken AS (
        SELECT feed_key, 'start_date' AS path, 'required' AS kind FROM features WHERE start_date IS NULL UNION ALL SELECT feed_key, 'end_date', 'required' FROM features WHERE end_date IS NULL
        UNION ALL SELECT feed_key, 'shape', 'required' FROM features WHERE shape IS NULL UNION ALL SELECT feed_key, 'event_status', 'one_of' FROM features WHERE event_status NOT IN ('active', 'completed'))
    SELECT feed_key, path, kind, count(*) AS violations FROM broken GROUP BY ALL""",
    "src_manifest_verify": "SELECT 'page-' || page_id AS name, CASE WHEN page_id % 13 = 0 THEN 'MISSING' WHEN page_id % 17 = 0 THEN 'UNLISTED' WHEN page_id % 11 = 0 THEN 'CHANGED' ELSE 'OK' END AS outcome FROM pages WHERE page_id % 13 <> 0 OR page_id % 17 <> 0",
    "sink_idempotent_upsert": f"WITH {POLLS} SELECT publisher_key, polled_us, max(event_id) AS event_id, arg_max(http_status, event_id) AS http_status FROM polls GROUP BY ALL",
    "pipe_cycle_counts": " UNION ALL ".join(
        f"SELECT '{step}' AS step, coalesce({column}::VARCHAR, 'PUBLISHED') AS outcome, count(*) AS items FROM ({sql}) GROUP BY ALL"
        for step, column, sql in (
            ("registry", "event", QUERIES_SQL["join_registry_diff"]), ("due", "due", cycles.ORACLE_SQL["fn_due"]), ("verdict", "state", boards.ORACLE_SQL["asof_snapshot_at"]), ("body", "reason", MISSING_BODIES),
            ("feed", "readable", streams.ORACLE_SQL["src_feed_header"]), ("zone", "reason", merge.ORACLE_SQL["pub_exclusion_reason"]),
        )
    ),
}
