"""Queries of single rules, functions and steps that the others are made of, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns, text
from ..operators import bodies, evidence, history, matching, reconcile, republish, rules, screening
from ..sources import adapters
from ..sources.storage import new_folder, written
from ..streaming import trust
from . import boards, merge, streams
from .boards import VERDICTS
from .merge import IDENTITY, MATCHES, MERGED
from .queries import FOLD, NEEDLES, POLLS, PULLS, RESULTS, SCREENED, ZONES, polls, seconds, states
from .streams import FEATURES

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    """Registers a query under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.poll_status(polls(spark, sf_dir))


def rule_query(rule: str, name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rules.one_rule(polls(spark, sf_dir), rule)

    run.__name__ = name
    query(f"WITH {RESULTS} SELECT event_id, verdict, reason FROM results WHERE rule_id = '{rule}'")(run)


for _rule, _name in zip(rules.RULES, ("rule_r1_unreachable", "rule_r2_stale", "rule_r3_schema", "rule_r4_contradiction", "rule_r5_frozen", "rule_r6_undeterminable"), strict=True):
    rule_query(_rule, _name)


@query(f"WITH {POLLS} SELECT event_id, CASE WHEN failed THEN 'NOT_APPLICABLE' WHEN update_age_seconds IS NULL OR update_age_seconds < 0 THEN 'NOT_APPLICABLE' WHEN update_age_seconds > 86400 THEN 'QUARANTINE' WHEN update_age_seconds > 3600 * 3 THEN 'WATCH' ELSE 'ADMIT' END AS verdict FROM polls")
def udf_ruleset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule under thresholds of one's own."""
    strict = rules.Ruleset(version="strict", watch_age=3600, quarantine_age=86400)
    return rules.one_rule(polls(spark, sf_dir), "R2", strict).select("event_id", "verdict")


@query(f"WITH {POLLS} SELECT event_id, failed FROM polls")
def prd_poll_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polls(spark, sf_dir).select("event_id", columns.poll_failed().alias("failed"))


@query(f"WITH {POLLS} SELECT event_id, unreached FROM polls")
def prd_unreached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polls(spark, sf_dir).select("event_id", columns.poll_unreached().alias("unreached"))


@query(f"WITH {POLLS} SELECT event_id, has_body FROM polls")
def prd_has_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polls(spark, sf_dir).select("event_id", columns.has_body().alias("has_body"))


@query("""WITH r AS (
    SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('http', 'https') AND page_id % 23 <> 0 AS allowed, page_id % 5 = 1 AS timeout, page_id % 7 = 1 AS same,
        CASE WHEN page_id % 7 = 1 AND page_id % 2 = 0 THEN 304 WHEN page_id % 11 = 3 THEN 503 ELSE 200 END AS code, page_id % 13 = 4 AS empty, page_id % 17 = 5 AS broken FROM pages
), c AS (
    SELECT *, CASE WHEN NOT allowed THEN 'SchemeRefused' WHEN timeout THEN 'Timeout' WHEN same AND code <> 304 THEN 'HTTPStatus' WHEN same THEN NULL WHEN code <> 200 THEN 'HTTPStatus' WHEN empty THEN 'EmptyResponse' WHEN broken THEN 'Unreadable' END AS error FROM r
) SELECT page_id, error, CASE WHEN error IS NOT NULL THEN CASE WHEN allowed THEN 'PUBLISHER' ELSE 'OWN_SIDE' END END AS error_origin FROM c""")
def src_poll_log_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each raw response, and whose fault it is."""
    raw = adapters.raw_responses(spark, sf_dir)
    error, origin = columns.classified(F.col("allowed"))
    return raw.select("page_id", error.alias("error"), origin.alias("error_origin"))


@query(f"WITH {POLLS} SELECT event_id, round((polled_us - update_us) / 1e6::DOUBLE, 3) AS age_seconds FROM polls")
def fn_age_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polls(spark, sf_dir).select("event_id", F.round((F.col("polled_us") - F.col("update_us")) / 1_000_000, 3).alias("age_seconds"))


@query(f"WITH {POLLS} SELECT event_id, day FROM polls")
def fn_utc_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polls(spark, sf_dir).select("event_id", columns.day_of("polled_us").alias("day"))


@query(f"WITH {POLLS} SELECT event_id, strftime(make_timestamp(polled_us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN polled_us % 1000000 <> 0 THEN strftime(make_timestamp(polled_us), '.%f') ELSE '' END || '+00:00' AS iso FROM polls")
def fn_iso_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polls(spark, sf_dir).select("event_id", columns.iso_utc(F.col("polled_us")).alias("iso"))


@query(f"""WITH {POLLS}, t AS (SELECT event_id, make_timestamp(polled_us // 1000000 * 1000000) AS stamp, event_id % 5 AS n FROM polls)
    SELECT event_id, CASE n WHEN 0 THEN strftime(stamp + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') || ' UTC' WHEN 1 THEN strftime(stamp, '%Y-%m-%d %H:%M:%S') || ' UTC' WHEN 2 THEN strftime(stamp, '%Y-%m-%d %H:%M:%S') || ' (no time zone given)'
        WHEN 3 THEN 'soon (unreadable as a timestamp)' ELSE 'not recorded' END AS shown FROM t""")
def fn_utc_moment(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, local = F.col("event_id") % 5, F.date_format(F.timestamp_micros("polled_us"), "yyyy-MM-dd'T'HH:mm:ss")
    stamp = F.when(n == 0, F.concat(local, F.lit(".861489-06:00"))).when(n == 1, F.concat(local, F.lit("Z"))).when(n == 2, local).when(n == 3, "soon").otherwise("")
    return polls(spark, sf_dir).select("event_id", columns.utc_moment(stamp).alias("shown"))


@query(f"WITH {PULLS} SELECT publisher_key, least(greatest({seconds('cadence')}, 300), 3600) AS interval_seconds FROM pull1")
def fn_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.registry_pull(spark, sf_dir, 1).select("publisher_key", columns.clamp(columns.cadence_seconds("cadence")).alias("interval_seconds"))


@query(f"WITH {POLLS} SELECT publisher_key, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95 FROM polls WHERE NOT failed GROUP BY 1")
def agg_percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = (F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY latency_ms)").alias(name) for p, name in ((0.5, "p50"), (0.95, "p95")))
    return status(spark, sf_dir).filter("NOT failed").groupBy("publisher_key").agg(*ranks)


@query(f"WITH RECURSIVE {FOLD} SELECT event_id, clean FROM states")
def fold_clean_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, sf_dir).select("event_id", "clean")


@query(f"WITH RECURSIVE {FOLD} SELECT event_id, latches FROM states WHERE state <> 'ADMIT'")
def set_latch_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds each publisher's state after each poll that leaves it other than admitted."""
    return states(spark, sf_dir).filter("state <> 'ADMIT'").select("event_id", "latches")


@query(f"WITH {RESULTS}, r5 AS (SELECT event_id FROM results WHERE rule_id = 'R5' AND reason = 'EVALUATED') SELECT event_id, n AS polls_in_window, advances FROM r5 JOIN frozen USING (event_id)")
def prj_churn_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = polls(spark, sf_dir)
    judged = rules.one_rule(log, "R5").filter("reason = 'EVALUATED'").select("event_id")
    return history.frozen(log).join(judged, "event_id", "left_semi").select("event_id", F.col("n").alias("polls_in_window"), "advances")


@query(f"WITH {POLLS}, newest AS (SELECT max(polled_us) AS last FROM polls) SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY publisher_key ORDER BY polled_us DESC, event_id DESC) AS place FROM polls) p, newest WHERE place <= 1000 AND polled_us >= last - 20 * 86400000000")
def st_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polls that stay: of each publisher the newest 1,000, and none older than 20 days before the newest of all."""
    return history.retained_polls(polls(spark, sf_dir), 1000, 20).select("event_id")


@query(f"WITH {POLLS} SELECT event_id, failed FROM polls")
def st_poll_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The poll log read as a stream until it is drained."""
    return trust.drained(history.poll_status(streams.poll_stream(spark, sf_dir)).select("event_id", "failed"), new_folder(spark, "polls"))


@query(f"WITH {POLLS} SELECT event_id, publisher_key, content_hash FROM polls")
def st_cycle_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches written idempotently: a repeated batch replaces itself, the last written row of a key counts."""
    folder = new_folder(spark, "cycles")
    stream = streams.poll_stream(spark, sf_dir).select("event_id", "publisher_key", "content_hash")
    trust.upserted(stream, f"{folder}/rows", f"{folder}/progress").awaitTermination()
    return trust.newest(spark, f"{folder}/rows", "event_id")


# feed bodies


@query(f"WITH {FEATURES} SELECT feed_key, pos, feature_id AS description, road_names FROM features")
def prj_core_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.parsed(spark, sf_dir).select("feed_key", "pos", "description", F.array_join("road_names", ";").alias("road_names"))


@query(f"WITH {FEATURES} SELECT feed_key, pos, event_status FROM features")
def prj_event_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.parsed(spark, sf_dir).select("feed_key", "pos", "event_status")


@query(f"WITH {FEATURES} SELECT feed_key, pos, 'start_date' AS field, start_date AS value FROM features UNION ALL SELECT feed_key, pos, 'end_date', end_date FROM features WHERE end_date IS NOT NULL UNION ALL SELECT feed_key, pos, 'event_status', event_status FROM features")
def prj_work_zone_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bodies.work_zone_fields(streams.parsed(spark, sf_dir))


@query(f"""WITH {FEATURES}, per AS (SELECT feed_key, count(*) AS features, count(*) FILTER (event_status = 'active') AS active, count(*) FILTER (event_status = 'active' AND end_date::BIGINT < 800000000000000) AS active_past,
    count(*) FILTER (event_status = 'active' AND end_date IS NULL) AS active_undated, count(*) FILTER (end_date IS NULL)::BIGINT + count(*) FILTER (shape IS NULL)::BIGINT + count(*) FILTER (event_status NOT IN ('active', 'completed')) AS schema_errors FROM features GROUP BY 1)
    SELECT feed_key, feed_key::VARCHAR AS update_date, features, active, active_past, active_undated, schema_errors FROM per""")
def agg_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a poll's body measures: its stamp, counts and broken constraints (hashes: agg_content_hash)."""
    return observed(spark, sf_dir).drop("content_hash", "structural_hash")


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .views import CONSTRAINTS

    return bodies.observations(adapters.feed_bodies(spark, sf_dir), F.lit(800_000_000_000_000), CONSTRAINTS)


@query(None)
def agg_structural_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many feeds share each structural hash of the observations."""
    return observed(spark, sf_dir).groupBy("structural_hash").agg(F.count(F.lit(1)).alias("feeds"))


@query(f"WITH {ZONES} SELECT pos, feature_id AS road_event_id, source AS data_source_id, CASE WHEN north THEN 'northbound' ELSE 'unknown' END AS direction, start_us, end_us, update_us FROM kept")
def prj_source_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.kept(spark, sf_dir).select("pos", F.coalesce("feature_id", F.lit("")).alias("road_event_id"), "data_source_id", F.coalesce("direction", F.lit("unknown")).alias("direction"), "start_us", "end_us", "update_us")


@query(f"WITH {ZONES}, f AS (SELECT pos, update_us, CASE WHEN order_key % 17 <> 0 AND order_key % 19 <> 0 THEN order_key::VARCHAR END AS feed FROM kept) SELECT pos, coalesce(update_us::VARCHAR, feed) AS source_update_date, CASE WHEN update_us IS NOT NULL THEN 'FEATURE' WHEN feed IS NOT NULL THEN 'FEED' END AS scope FROM f")
def prj_update_date_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each zone's own stamp, else that of its feed's header, and which of them it is."""
    feeds = bodies.header(adapters.feed_bodies(spark, sf_dir)).select(F.col("feed_key").alias("order_key"), F.nullif("update_date", F.lit("")).alias("feed"))
    own = F.col("update_us").cast("string")
    rows = merge.kept(spark, sf_dir).select("pos", "order_key", "update_us").join(feeds, "order_key", "left")
    return rows.select("pos", F.coalesce(own, "feed").alias("source_update_date"), F.when(own.isNotNull(), "FEATURE").when(F.col("feed").isNotNull(), "FEED").alias("scope"))


# geometry and pairs

METRES = "6371008.8 * radians(lon) * cos(radians(lat))"


@query(f"WITH {ZONES} SELECT pos, round({METRES} * 100)::BIGINT AS east_cm, round(6371008.8 * radians(lat) * 100)::BIGINT AS north_cm FROM kept WHERE lon IS NOT NULL")
def fn_to_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    east, north = columns.to_metres(F.col("lon"), F.col("lat"), F.col("lat"))
    return merge.kept(spark, sf_dir).filter("lon IS NOT NULL").select("pos", F.round(east * 100).cast("long").alias("east_cm"), F.round(north * 100).cast("long").alias("north_cm"))


@query(f"WITH {ZONES} SELECT pos, round((lon - 360 * round_even((lon - 179.5::DOUBLE) / 360, 0)) * 1e7::DOUBLE)::BIGINT AS lon_e7 FROM kept WHERE lon IS NOT NULL")
def fn_unwrap_lon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longitudes in the branch of a place beyond the antimeridian."""
    return merge.kept(spark, sf_dir).filter("lon IS NOT NULL").select("pos", F.round(columns.unwrapped(F.col("lon"), F.lit(179.5)) * 1e7).cast("long").alias("lon_e7"))


PAIR = "left_pos, right_pos"


@query(f"WITH {MATCHES} SELECT {PAIR}, CAST(round(metres * 100) AS BIGINT) AS centimetres FROM judged")
def fn_min_distance_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.judged(spark, sf_dir, "left_pos", "right_pos", "metres").select("left_pos", "right_pos", F.round(F.col("metres") * 100).cast("long").alias("centimetres"))


@query(f"WITH {MATCHES} SELECT {PAIR}, CAST(round(coverage * 1e6::DOUBLE) AS BIGINT) AS coverage_ppm FROM judged WHERE coverage IS NOT NULL")
def fn_symmetric_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.judged(spark, sf_dir, "left_pos", "right_pos", "coverage").filter("coverage IS NOT NULL").select("left_pos", "right_pos", F.round(F.col("coverage") * 1e6).cast("long").alias("coverage_ppm"))


@query(f"WITH {MATCHES} SELECT pos, CASE WHEN long_m > 0 THEN ceil(long_m / 25)::BIGINT + 1 ELSE 1 END AS samples FROM sides")
def fn_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many samples each zone's line has."""
    zones = merge.kept(spark, sf_dir).filter(F.size("vertices") > 0).select("pos", "vertices")
    return matching.densified(zones).select("pos", F.size("samples").cast("long").alias("samples"))


@query(f"""WITH {MATCHES} SELECT {PAIR}, CAST(round({merge.share("a", "b")} * 1e6::DOUBLE) AS BIGINT) AS left_ppm, CAST(round({merge.share("b", "a")} * 1e6::DOUBLE) AS BIGINT) AS right_ppm
    FROM judged JOIN sides a ON a.pos = left_pos JOIN sides b ON b.pos = right_pos WHERE coverage IS NOT NULL""")
def fn_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each way's coverage of the pairs within reach that have a line."""
    found = merge.judged(spark, sf_dir, "left_pos", "right_pos", "left_share", "right_share").filter("left_share IS NOT NULL")
    return found.select("left_pos", "right_pos", *(F.round(F.col(f"{side}_share") * 1e6).cast("long").alias(f"{side}_ppm") for side in ("left", "right")))


@query(f"WITH {MATCHES} SELECT left_pos, x[1] AS right_publisher, x[2] AS right_pos, x[3] AS tier FROM (SELECT left_pos, arg_min((right_publisher, right_pos, tier), (tier, CAST(round(metres * 100) AS BIGINT), left_publisher, right_publisher, left_pos, right_pos)) AS x FROM judged WHERE matched GROUP BY left_pos)")
def fn_pair_sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each left zone's first matched pair in the order of pairs, distances in whole centimetres."""
    pairs = merge.judged(spark, sf_dir, "left_publisher", "left_pos", "right_publisher", "right_pos", "metres", "matched", "tier").filter("matched").withColumn("metres", F.round(F.col("metres") * 100).cast("long") / 100)
    return matching.first_pairs(pairs)


@query(f"WITH {MATCHES} SELECT {PAIR}, tier FROM judged WHERE matched")
def fn_classify_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.judged(spark, sf_dir, "left_pos", "right_pos", "matched", "tier").filter("matched").select("left_pos", "right_pos", "tier")


@query(f"WITH {MATCHES} SELECT {PAIR}, shared_road, same_direction, dates_overlap FROM judged WHERE matched")
def fn_corroborators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.judged(spark, sf_dir, "left_pos", "right_pos", "matched", "shared_road", "same_direction", "dates_overlap").filter("matched").drop("matched")


@query(f"WITH {MATCHES} SELECT {PAIR}, dates_overlap FROM judged")
def join_date_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.judged(spark, sf_dir, "left_pos", "right_pos", "dates_overlap")


@query(f"WITH {MATCHES} SELECT {PAIR}, CASE WHEN shared_road AND dates_overlap THEN 'DUPLICATE' WHEN NOT shared_road THEN 'DISTINCT' ELSE 'UNSURE' END AS verdict FROM judged WHERE matched AND tier = 'TIER_2'")
def udf_adjudicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of an adjudicator given as a column of the pair."""
    pairs = merge.judged(spark, sf_dir, "left_pos", "right_pos", "matched", "tier", "shared_road", "dates_overlap")
    verdict = F.when(F.col("shared_road") & F.col("dates_overlap"), "DUPLICATE").when(~F.col("shared_road"), "DISTINCT")
    return matching.verdicts(pairs, verdict)


@query(f"""WITH {MATCHES}, same AS (SELECT a.pos AS left_pos, b.pos AS right_pos FROM sides a JOIN sides b ON a.part_key = b.part_key AND a.publisher_key = b.publisher_key AND a.pos < b.pos)
    SELECT 'within_reach' AS kind, count(*) AS n FROM judged UNION ALL SELECT 'no_geometry', count(*) FROM kept WHERE lon IS NULL UNION ALL SELECT 'zones', count(*) FROM kept""")
def join_cross_publisher_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of different publishers lie within reach, and how many zones could take no part."""
    zones = merge.kept(spark, sf_dir)
    counts = zones.agg(F.count_if(F.size("vertices") == 0).alias("no_geometry"), F.count(F.lit(1)).alias("zones"))
    rows = counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("n")) for c in counts.columns))))
    return rows.union(merge.judged(spark, sf_dir, "metres").agg(F.count(F.lit(1)).alias("n")).select(F.lit("within_reach"), "n"))


@query(f"WITH {MATCHES} SELECT {PAIR}, CAST(round(metres * 100) AS BIGINT) AS centimetres, matched FROM judged WHERE left_publisher = 'p1' AND right_publisher = 'p4'")
def join_dedup_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of two publishers within reach, matched or rejected. Only their zones are indexed."""
    two = merge.kept(spark, sf_dir).filter(F.col("publisher_key").isin("p1", "p4"))
    return matching.within_reach(two, ("left_pos", "right_pos", "metres", "matched")).select("left_pos", "right_pos", F.round(F.col("metres") * 100).cast("long").alias("centimetres"), "matched")


# identity


@query(f"WITH {IDENTITY} SELECT group_key, source_key, canonical_id, first_mapped_at FROM members LEFT JOIN held USING (source_key)")
def join_identity_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, held = merge.identity_inputs(spark, sf_dir)
    return members.join(held, "source_key", "left")


@query(f"WITH {IDENTITY} SELECT group_key, oldest[2] AS canonical_id, oldest[1] AS first_mapped_at FROM g WHERE oldest IS NOT NULL")
def win_inherit_oldest_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.claims(*merge.identity_inputs(spark, sf_dir)).filter("oldest IS NOT NULL").select("group_key", "oldest.canonical_id", "oldest.first_mapped_at")


@query(f"WITH {IDENTITY} SELECT group_key, claimed, n AS place FROM claims WHERE n > 0")
def win_split_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.claims(*merge.identity_inputs(spark, sf_dir)).filter("place > 0").select("group_key", F.col("oldest.canonical_id").alias("claimed"), F.col("place").cast("long").alias("place"))


@query(f"WITH {IDENTITY} SELECT group_key, unnest(CASE WHEN n = 1 THEN list_filter(ids, lambda x: x <> claimed) WHEN n > 1 THEN [claimed] ELSE [] END) AS superseded FROM claims")
def set_supersedes(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, held = merge.identity_inputs(spark, sf_dir)
    return matching.assign_identity(members, held, at=9).select("group_key", F.explode("supersedes").alias("superseded"))


@query(f"WITH {IDENTITY} SELECT group_key, CASE WHEN n = 1 THEN claimed ELSE 'zone-' || parts[1] END AS canonical_id FROM claims")
def udf_mint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities with a mint of one's own."""
    members, held = merge.identity_inputs(spark, sf_dir)
    return matching.assign_identity(members, held, 9, mint=lambda first: F.concat(F.lit("zone-"), first)).select("group_key", "canonical_id")


@query(f"WITH {ZONES} SELECT part_key, min((publisher_key, pos))[2] AS lead FROM kept GROUP BY 1")
def win_zone_lead_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member of the lowest (publisher, position) of the zones at one place."""
    return merge.kept(spark, sf_dir).groupBy("part_key").agg(F.min_by("pos", F.struct("publisher_key", "pos")).alias("lead"))


# screening


@query(f"WITH {SCREENED} SELECT digest, category FROM rows WHERE category IS NOT NULL GROUP BY ALL")
def fn_keyword_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.screen(adapters.texts(spark, sf_dir), NEEDLES).filter("verdict = 'BLOCK'").select("digest", "category")


@query("SELECT sha256(text) AS digest, CASE WHEN length(text) > 4000 THEN 'BLOCK' ELSE 'PASS' END AS verdict FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def udf_screener(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of a screener given as a column of the text."""
    return screening.screen(adapters.texts(spark, sf_dir), lambda t: F.when(F.char_length(t) > 4000, "long")).select("digest", "verdict")


@query(f"WITH {SCREENED} SELECT seen_at, CASE WHEN category IS NULL THEN digest ELSE sha256('[redacted: failed screening]') END AS served_sha256 FROM rows")
def fn_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = adapters.texts(spark, sf_dir)
    return screening.screened(texts, screening.screen(texts, NEEDLES)).select("seen_at", F.sha2("served", 256).alias("served_sha256"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def fn_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT doc_id, sha256(text) || '|p1|m1' AS cache_key FROM documents WHERE text IS NOT NULL")
def fn_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", text.cache_key(F.col("text"), "p1", "m1").alias("cache_key"))


BLOCKED = "SELECT zone_id, CASE WHEN pos % 9 = 0 THEN 'description' END AS d, CASE WHEN pos % 14 = 0 THEN 'road_names' END AS r FROM sources"


@query(f"WITH {MERGED}, b AS ({BLOCKED}), f AS (SELECT DISTINCT zone_id, unnest(list_filter([d, r], lambda x: x IS NOT NULL)) AS field FROM b) SELECT zone_id, string_agg(field, ',' ORDER BY field) AS fields FROM f GROUP BY 1")
def join_blocked_to_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = adapters.zone_sources(spark, sf_dir)
    pos = F.col("pos")
    fields = F.array_compact(F.array(F.when(pos % 9 == 0, "description"), F.when(pos % 14 == 0, "road_names")))
    return screening.blocked_zones(sources, sources.select("publisher_key", "pos", F.explode(fields).alias("field")))


# the merged feed and its tables


@query(f"WITH {ZONES}, {merge.STATES} SELECT publisher_key FROM states WHERE NOT decommissioned")
def flt_pollable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.publisher_states(spark, sf_dir).filter("NOT decommissioned AND state <> 'NO_ACCESS'").select("publisher_key")


@query(f"WITH {MERGED} SELECT zone_id, n AS sources FROM merged WHERE n > 1 ORDER BY n DESC, zone_id LIMIT 51")
def top_merged_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zones of most sources, one more than the page shows, so that a page knows whether more follow."""
    rows = merge.merged(spark, sf_dir).select("zone_id", F.size("sources").cast("long").alias("sources")).filter("sources > 1")
    return rows.orderBy(F.desc("sources"), "zone_id").limit(51)


@query(f"WITH {ZONES}, inside AS (SELECT pos FROM kept WHERE lon <= -110.3 AND lon + length >= -110.8 AND lat BETWEEN 40.0 AND 40.5) SELECT least(count(*), 2000) AS shown, count(*) AS matched FROM inside")
def top_viewport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a view its capped list shows."""
    return merge.join_viewport(spark, sf_dir).agg(F.count(F.lit(1)).alias("shown"), F.coalesce(F.max("matched"), F.lit(0)).alias("matched"))


@query(f"WITH {MERGED} SELECT 'canonical_zones' AS name, count(*) AS rows FROM merged UNION ALL SELECT 'features', count(*) FROM merged WHERE reason IS NULL UNION ALL SELECT 'exclusions', count(*) FROM merged WHERE reason IS NOT NULL")
def sink_cycle_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of a cycle, written under its id, and how many rows each holds."""
    zones = written(merge.merged(spark, sf_dir), "zones")  # three tables come from it
    tables = {"canonical_zones": zones, "features": republish.features(zones), "exclusions": zones.select("zone_id", republish.exclusion_reason().alias("reason")).filter("reason IS NOT NULL")}
    return republish.write_cycle(tables, new_folder(spark, "cycle"), 1)


# evidence


@query(f"WITH RECURSIVE {VERDICTS} SELECT packet_id, closed_us, closing_id FROM packets WHERE closed_us IS NOT NULL")
def ev_close_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.win_packet_episodes(spark, sf_dir).filter("closed_us IS NOT NULL").select("packet_id", "closed_us", "closing_id")


@query(f"WITH RECURSIVE {VERDICTS} SELECT packet_id, approval_state, opened_us FROM drafts WHERE approval_state <> 'DRAFT' ORDER BY opened_us DESC, packet_id LIMIT 51")
def top_decided_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boards.drafts(spark, sf_dir).filter("approval_state <> 'DRAFT'").select("packet_id", "approval_state", "opened_us")
    return rows.orderBy(F.desc("opened_us"), "packet_id").limit(51)


@query(f"""WITH RECURSIVE {VERDICTS}, later AS (
    SELECT packet_id, list(b.event_id) AS more FROM packets JOIN marks a USING (event_id) JOIN marks b ON a.publisher_key = b.publisher_key AND b.k BETWEEN a.k + 1 AND a.k + 3 GROUP BY 1
) SELECT packet_id, CASE WHEN closed_us IS NULL AND more IS NOT NULL THEN array_to_string(list_sort(list_distinct(list_append(more, event_id))), ',') ELSE event_id::VARCHAR END AS observation_ids,
    closed_us IS NOT NULL AND more IS NOT NULL AS refused FROM packets LEFT JOIN later USING (packet_id)""")
def set_extend_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets with the three polls after their opening; a closed one refuses them."""
    packets = written(boards.win_packet_episodes(spark, sf_dir), "packets")
    numbered = history.numbered(polls(spark, sf_dir).select("publisher_key", "polled_us", "event_id")).select("publisher_key", "event_id", "n")
    opened = packets.select("packet_id", "event_id").join(numbered, "event_id").select("packet_id", "publisher_key", F.explode(F.sequence(F.col("n") + 1, F.col("n") + 3)).alias("n"))
    later = opened.join(numbered, ["publisher_key", "n"]).select("packet_id", "event_id")
    held = packets.select("packet_id", F.lit("APPROVED").alias("approval_state"), "closed_us", F.array("event_id").alias("observation_ids"))
    return evidence.extended(held, later).select("packet_id", F.array_join("observation_ids", ",").alias("observation_ids"), "refused")


@query(f"""WITH RECURSIVE {VERDICTS} SELECT packet_id, CASE event_id % 3 WHEN 0 THEN 'REWRITE' WHEN 1 THEN 'KEEP_MODEL' ELSE 'UNCHANGED' END AS outcome FROM drafts WHERE approval_state = 'DRAFT' AND rendering IS NOT NULL""")
def ev_redraft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a new wording does to stored drafts: text of a model stays, old wording is written anew."""
    rows = boards.drafts(spark, sf_dir).filter("rendering IS NOT NULL")
    stored = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Old: "), "rendering")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Prose.\\n\\n---\\nFacts of record:\\n"), "rendering")).otherwise(F.col("rendering"))
    return evidence.redrafted(rows.withColumn("stored", stored)).select("packet_id", "outcome")


@query(f"WITH RECURSIVE {VERDICTS} SELECT packet_id, event_id % 2 = 0 AS used FROM drafts")
def udf_drafter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose of a drafter, used only where it cites no number that the packet's facts lack."""
    rows = boards.drafts(spark, sf_dir)
    prose = F.concat(F.lit("It rests on "), F.when(F.col("event_id") % 2 == 0, F.col("observations")).otherwise(F.col("observations") + 9999).cast("string"), F.lit(" polls."))
    return evidence.guarded(rows.withColumn("prose", prose)).select("packet_id", F.col("used"))


@query(f"""WITH RECURSIVE {VERDICTS}, cited AS (SELECT packets.*, w.observations, c.rule_ids FROM packets JOIN windows w USING (packet_id) JOIN changes c USING (event_id))
    SELECT packet_id, publisher_key, to_state, rule_ids, observations, least(observations, 50) AS embedded, observations > 50 AS truncated, closed_us AS resolved_us FROM cited""")
def fn_packet_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).drop("window_start", "window_end")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = written(boards.changes(spark, sf_dir), "changes")
    packets = evidence.packets(moved)
    return evidence.facts(packets, boards.windows_of(spark, sf_dir, packets), moved)


WINDOW = "strftime(make_timestamp(window_start), '%Y-%m-%d %H:%M:%S') || ' to ' || strftime(make_timestamp(window_end), '%Y-%m-%d %H:%M:%S') || ' UTC'"
POLL_WORDS = "CASE WHEN observations = 1 THEN '1 poll' ELSE observations || ' polls' END"
FACTS_SQL = f"""WITH RECURSIVE {VERDICTS}, cited AS (SELECT packets.*, w.window_start, w.window_end, w.observations, c.rule_ids FROM packets JOIN windows w USING (packet_id) JOIN changes c USING (event_id))"""


@query(f"{FACTS_SQL} SELECT packet_id, concat_ws(chr(10), 'Decision record: ' || split_part(publisher_key, '|', 1), 'Feed: ' || split_part(publisher_key, '|', 2), 'State: ' || to_state, 'Rules fired: ' || replace(rule_ids, ',', ', '), 'Observed: ' || {POLL_WORDS} || ', ' || {WINDOW}, 'Status: ' || CASE WHEN closed_us IS NULL THEN 'open' ELSE 'resolved ' || strftime(make_timestamp(closed_us), '%Y-%m-%d %H:%M:%S') || ' UTC' END) AS rendering FROM cited")
def fn_render_consumer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("packet_id", evidence.consumer_text().alias("rendering"))


@query(f"{FACTS_SQL} SELECT packet_id, concat_ws(chr(10), 'Notice on the registry entry of ' || split_part(publisher_key, '|', 1), 'Feed: ' || split_part(publisher_key, '|', 2), 'Rules: ' || replace(rule_ids, ',', ', '), 'Observed: ' || {POLL_WORDS} || ', ' || {WINDOW}, 'This notice is a draft and goes out only when a person approves it.') AS rendering FROM cited")
def fn_render_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("packet_id", evidence.registry_text().alias("rendering"))


@query(f"WITH RECURSIVE {VERDICTS} SELECT * FROM packets WHERE packet_id = (SELECT min(packet_id) FROM packets)")
def get_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packet by its id; here the first of all ids."""
    found = written(boards.win_packet_episodes(spark, sf_dir), "packets")
    return found.join(F.broadcast(found.agg(F.min("packet_id").alias("packet_id"))), "packet_id", "left_semi")  # one row


@query(f"WITH {POLLS}, days AS (SELECT day AS cycle, count(*) AS polls, count(*) FILTER (failed) AS failed FROM polls GROUP BY 1) SELECT cycle, polls, failed FROM days ORDER BY cycle DESC LIMIT 1")
def top_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot of the last cycle; a day is a cycle."""
    return cycles_of(spark, sf_dir).orderBy(F.desc("cycle")).limit(1)


@query(f"WITH {POLLS} SELECT day AS cycle, count(*) AS polls, count(*) FILTER (failed) AS failed FROM polls WHERE day = 19730 GROUP BY 1")
def get_cycle_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles_of(spark, sf_dir).filter("cycle = 19730")


def cycles_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status(spark, sf_dir).groupBy(columns.day_of("polled_us").alias("cycle")).agg(F.count(F.lit(1)).alias("polls"), F.count_if("failed").alias("failed"))


@query(f"""WITH RECURSIVE {FOLD}, last AS (SELECT day, publisher_key, arg_max(states.state, (states.polled_us, states.event_id)) AS state FROM states JOIN polls USING (event_id, publisher_key) GROUP BY ALL)
    SELECT day AS cycle, state, count(*) AS publishers FROM last GROUP BY ALL""")
def pipe_multi_cycle_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fleet at the end of each cycle (a day), from one fold over all polls: state carries over from cycle to cycle."""
    rows = states(spark, sf_dir).groupBy("publisher_key", columns.day_of("polled_us").alias("cycle")).agg(F.max_by("state", F.struct("polled_us", "event_id")).alias("state"))
    return rows.groupBy("cycle", "state").agg(F.count(F.lit(1)).alias("publishers"))


@query(f"WITH {FEATURES}, v AS (SELECT feed_key, pos, 'end_date is required' AS error FROM features WHERE end_date IS NULL UNION ALL SELECT feed_key, pos, 'shape is required' FROM features WHERE shape IS NULL) SELECT feed_key, pos, error, (SELECT count(*) FROM v) > 20 AS truncated FROM v ORDER BY feed_key, pos, error LIMIT 20")
def top_error_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 broken constraints, cut to 300 characters, and whether there are more."""
    from ..operators.views import violations
    from .views import CONSTRAINTS

    found = violations(streams.parsed(spark, sf_dir), ["feed_key", "pos"], [c for c in CONSTRAINTS if c[1] == "required"])
    rows = found.select("feed_key", "pos", F.left(F.concat("path", F.lit(" is "), "kind"), F.lit(300)).alias("error"))
    first = rows.orderBy("feed_key", "pos", "error").limit(21)
    return first.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > 20).orderBy("feed_key", "pos", "error").limit(20)  # 21 rows at most
