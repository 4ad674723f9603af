"""Queries over the registry's history, replay, the fleet board and evidence packets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import board, evidence, history, rules
from ..sources import adapters
from ..sources.storage import written
from .queries import AT_US, FOLD, POLLS, states

#: The pull that replays ask for; three days lie between pulls, so it was taken at AT_US.
AT = 6


def pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.registry_pulls(spark, sf_dir)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.registry_events(pulls(spark, sf_dir))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transitions of the latched state."""
    return rules.transitions(states(spark, sf_dir))


def host_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state, at the asked time, of the host of each publisher."""
    latest = rules.states_at(changes(spark, sf_dir), AT_US).withColumnRenamed("publisher_key", "host_key")
    return pulls(spark, sf_dir).select("publisher_key", "host_key").distinct().join(latest, "host_key").select("publisher_key", "state")


def win_registry_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.absences(pulls(spark, sf_dir)).select("publisher_key", "pull", "present", "missing")


def registry_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir)


def asof_membership_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.members_at(events(spark, sf_dir), AT)


def asof_access_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.gated_at(events(spark, sf_dir), AT)


def asof_snapshot_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.snapshot_at(events(spark, sf_dir), host_states(spark, sf_dir), AT)


def agg_band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.band_counts(asof_snapshot_at(spark, sf_dir), F.contains(F.lower("publisher_key"), F.lit("2")))


def flt_fleet_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof_snapshot_at(spark, sf_dir).filter((F.col("state") != "NO_ACCESS") & F.contains(F.lower("publisher_key"), F.lit("supplier")))


def win_packet_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.packets(changes(spark, sf_dir))


def agg_evidence_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows_of(spark, sf_dir, win_packet_episodes(spark, sf_dir))


def windows_of(spark: SparkSession, sf_dir: str, packets: DataFrame) -> DataFrame:
    return evidence.windows(packets, adapters.poll_log(spark, sf_dir))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(win_packet_episodes(spark, sf_dir), "packets")  # few rows behind the whole fold: read twice
    found = found.join(windows_of(spark, sf_dir, found), "packet_id")
    text = F.when(F.col("event_id") % 7 != 0, evidence.rendering())
    return found.withColumn("rendering", text).withColumn("approval_state", F.when(F.col("event_id") % 5 == 0, "APPROVED").otherwise("DRAFT"))


def ev_open_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drafts(spark, sf_dir).select("packet_id", "rendering", "approval_state", "observations")


def ev_apply_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drafts(spark, sf_dir)
    made = found.select("packet_id", F.when(F.col("event_id") % 4 != 0, F.lit("reviewer")).alias("identity"), F.lit("APPROVED").alias("decision"), F.when(F.col("event_id") % 11 == 0, "other").otherwise(F.sha2("rendering", 256)).alias("displayed_sha256"))
    return evidence.decided(found.select("packet_id", "approval_state", "rendering"), made)


def top_notice_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drafts(spark, sf_dir).filter("approval_state = 'DRAFT' AND closed_us IS NULL").orderBy("opened_us", "packet_id").select("packet_id", "opened_us")


def top_recent_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes(spark, sf_dir).select("event_id", "publisher_key", "polled_us", "to_state")
    return rows.orderBy(F.desc("polled_us"), F.desc("event_id")).limit(100)


def agg_replay_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.horizon(adapters.poll_log(spark, sf_dir), changes(spark, sf_dir), events(spark, sf_dir))


def agg_feed_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per publisher: polls, reached, stale, without a date, and bodies that contradict themselves."""
    rows = history.poll_status(adapters.poll_log(spark, sf_dir))
    age, past = F.col("update_age_seconds"), F.col("active_with_past_end_date")
    return rows.groupBy("publisher_key").agg(F.count(F.lit(1)).alias("polls"), F.count_if(~F.col("failed")).alias("reached"), F.count_if(F.col("has_body") & (age > 604800)).alias("stale"), F.count_if(F.col("has_body") & age.isNull()).alias("undeterminable"), F.count_if(F.col("has_body") & (past > 0)).alias("contradictory"))


def set_unsupported_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws(" ", "doc_id", "n_chars").alias("facts"))
    return evidence.unsupported_numbers(rows, "text", "facts").select("doc_id", F.array_join("unsupported", ",").alias("unsupported"))


def agg_transfer_economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes a day at each floor of the polling interval, if every page were polled at a cadence of its own."""
    rows = adapters.table(spark, sf_dir, "pages").select(F.octet_length("html").cast("long").alias("wire"), (F.lit(60) * (1 + F.col("page_id") % 90)).alias("cadence"))
    floors = F.explode(F.array(*(F.lit(x) for x in (0, 300, 900, 3600)))).alias("floor_seconds")
    return rows.select("wire", "cadence", floors).groupBy(F.col("floor_seconds").cast("long").alias("floor_seconds")).agg(F.sum("wire").alias("wire_bytes"), F.sum(F.expr("wire * 86400 div greatest(cadence, floor_seconds)")).alias("bytes_a_day"))


QUERIES = {
    f.__name__: f
    for f in (
        win_registry_absence, registry_history, asof_membership_at, asof_access_at, asof_snapshot_at, agg_band_counts, flt_fleet_board, win_packet_episodes, agg_evidence_window, ev_open_packet,
        ev_apply_decisions, top_notice_queue, top_recent_transitions, agg_replay_horizon, agg_feed_health, set_unsupported_numbers, agg_transfer_economics,
    )
}

EVENTS = """
pulls AS (
    SELECT s_name AS publisher_key, 'org' || (s_suppkey % 5) || '|feed' || (s_suppkey % 5) AS host_key, pull, (s_suppkey + pull) % 9 < 2 AS needs_key
    FROM supplier, range(1, 9) r(pull) WHERE (s_suppkey * 5 + pull) % 11 > 3
), grid AS (
    SELECT publisher_key, since, pull FROM (SELECT publisher_key, min(pull) AS since FROM pulls GROUP BY 1), range(1, 9) r(pull) WHERE pull >= since
), joined AS (
    SELECT g.*, p.publisher_key IS NOT NULL AS present, p.needs_key FROM grid g LEFT JOIN pulls p USING (publisher_key, pull)
), absences AS (
    SELECT *, pull - max(CASE WHEN present THEN pull END) OVER (PARTITION BY publisher_key ORDER BY pull) AS missing, lag(present) OVER (PARTITION BY publisher_key ORDER BY pull) AS was_present,
        coalesce(last_value(CASE WHEN present THEN needs_key END IGNORE NULLS) OVER (PARTITION BY publisher_key ORDER BY pull ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS had_key
    FROM joined
), registry_events AS (
    SELECT publisher_key, pull, 'PROVISIONED' AS event FROM absences WHERE pull = since
    UNION ALL SELECT publisher_key, pull, 'REAPPEARED' FROM absences WHERE present AND NOT was_present
    UNION ALL SELECT publisher_key, pull, CASE WHEN missing < 3 THEN 'ABSENT' ELSE 'DECOMMISSIONED' END FROM absences WHERE NOT present AND missing <= 3
    UNION ALL SELECT publisher_key, pull, CASE WHEN needs_key THEN 'ACCESS_LOST' ELSE 'ACCESS_GAINED' END FROM absences WHERE present AND needs_key <> had_key
), members AS (
    SELECT publisher_key FROM registry_events WHERE pull <= 6 AND event IN ('PROVISIONED', 'REAPPEARED', 'DECOMMISSIONED') GROUP BY 1 HAVING arg_max(event, pull) <> 'DECOMMISSIONED'
), gated AS (
    SELECT publisher_key FROM registry_events WHERE pull <= 6 AND event IN ('ACCESS_LOST', 'ACCESS_GAINED') GROUP BY 1 HAVING arg_max(event, pull) = 'ACCESS_LOST'
)"""

VERDICTS = FOLD + """, episodes AS (
    SELECT *, first_value(CASE WHEN NOT worse THEN {'u': polled_us, 'e': event_id} END IGNORE NULLS) OVER (PARTITION BY publisher_key ORDER BY polled_us, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS closing FROM changes
), packets AS (
    SELECT concat_ws('|', publisher_key, to_state, event_id) AS packet_id, publisher_key, to_state, event_id, polled_us AS opened_us, closing.u AS closed_us, closing.e AS closing_id, depth FROM episodes WHERE worse
), windows AS (
    SELECT packet_id, min(b.polled_us) AS window_start, max(b.polled_us) AS window_end, count(*) AS observations, count(*) > 50 AS truncated
    FROM packets JOIN marks a USING (event_id) JOIN marks b ON a.publisher_key = b.publisher_key AND b.k BETWEEN a.k - packets.depth + 1 AND a.k GROUP BY 1
), drafts AS (
    SELECT packets.*, observations, CASE WHEN event_id % 7 <> 0 THEN 'Publisher ' || publisher_key || ' moved to ' || to_state || ' on ' || CASE WHEN observations = 1 THEN '1 poll' ELSE observations || ' polls' END || '.' END AS rendering,
        CASE WHEN event_id % 5 = 0 THEN 'APPROVED' ELSE 'DRAFT' END AS approval_state
    FROM packets JOIN windows USING (packet_id)
)"""

SNAPSHOT = f"{EVENTS}, {VERDICTS.strip()}" + f""", hosts AS (
    SELECT publisher_key AS host_key, arg_max(to_state, (polled_us, event_id)) AS state FROM changes WHERE polled_us <= {AT_US} GROUP BY 1
), snapshot AS (
    SELECT publisher_key, CASE WHEN publisher_key IN (SELECT publisher_key FROM gated) THEN 'NO_ACCESS' ELSE coalesce(state, 'WATCH') END AS state
    FROM members LEFT JOIN (SELECT DISTINCT publisher_key, host_key FROM pulls) USING (publisher_key) LEFT JOIN hosts USING (host_key)
)"""


def found_numbers(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '[0-9][0-9,.]*'), lambda n: rtrim(replace(n, ',', ''), '.'))"


ORACLE_SQL = {
    "win_registry_absence": f"WITH {EVENTS} SELECT publisher_key, pull, present, missing FROM absences",
    "registry_history": f"WITH {EVENTS} SELECT * FROM registry_events",
    "asof_membership_at": f"WITH {EVENTS} SELECT * FROM members",
    "asof_access_at": f"WITH {EVENTS} SELECT * FROM gated",
    "asof_snapshot_at": f"WITH RECURSIVE {SNAPSHOT} SELECT * FROM snapshot",
    "agg_band_counts": f"WITH RECURSIVE {SNAPSHOT} SELECT band, count(publisher_key) FILTER (contains(lower(publisher_key), '2')) AS shown, count(publisher_key) AS total FROM (SELECT unnest(['ADMIT', 'WATCH', 'QUARANTINE', 'NO_ACCESS']) AS band) LEFT JOIN snapshot ON band = state GROUP BY 1",
    "flt_fleet_board": f"WITH RECURSIVE {SNAPSHOT} SELECT * FROM snapshot WHERE state <> 'NO_ACCESS' AND contains(lower(publisher_key), 'supplier')",
    "win_packet_episodes": f"WITH RECURSIVE {VERDICTS} SELECT * FROM packets",
    "agg_evidence_window": f"WITH RECURSIVE {VERDICTS} SELECT * FROM windows",
    "ev_open_packet": f"WITH RECURSIVE {VERDICTS} SELECT packet_id, rendering, approval_state, observations FROM drafts",
    "ev_apply_decisions": f"""WITH RECURSIVE {VERDICTS}, made AS (
        SELECT packet_id, CASE WHEN event_id % 4 <> 0 THEN 'reviewer' END AS identity, rendering, CASE WHEN event_id % 4 = 0 THEN 'E_EVID_002' WHEN approval_state <> 'DRAFT' THEN 'E_EVID_003' WHEN rendering IS NULL THEN 'E_EVID_001'
            WHEN event_id % 11 = 0 THEN 'E_EVID_003' ELSE 'ACCEPTED' END AS outcome FROM drafts
    ) SELECT packet_id, identity, outcome, CASE WHEN outcome = 'ACCEPTED' THEN 'APPROVED' END AS approval_state, CASE WHEN outcome = 'ACCEPTED' THEN sha256(rendering) END AS approved_sha256 FROM made""",
    "top_notice_queue": f"WITH RECURSIVE {VERDICTS} SELECT packet_id, opened_us FROM drafts WHERE approval_state = 'DRAFT' AND closed_us IS NULL ORDER BY opened_us, packet_id",
    "top_recent_transitions": f"WITH RECURSIVE {VERDICTS} SELECT event_id, publisher_key, polled_us, to_state FROM changes ORDER BY polled_us DESC, event_id DESC LIMIT 100",
    "agg_replay_horizon": f"WITH RECURSIVE {EVENTS}, {VERDICTS.strip()} SELECT (SELECT min(polled_us) FROM polls) AS earliest_poll, (SELECT min(polled_us) FROM changes) AS earliest_transition, (SELECT min(pull) FROM registry_events) AS earliest_pull",
    "agg_feed_health": f"WITH {POLLS} SELECT publisher_key, count(*) AS polls, count(*) FILTER (NOT failed) AS reached, count(*) FILTER (has_body AND update_age_seconds > 604800) AS stale, count(*) FILTER (has_body AND update_age_seconds IS NULL) AS undeterminable, count(*) FILTER (has_body AND past > 0) AS contradictory FROM polls GROUP BY 1",
    "set_unsupported_numbers": f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter({found_numbers('text')}, lambda n: NOT list_contains([doc_id::VARCHAR, n_chars::VARCHAR], n)))), ',') AS unsupported FROM documents",
    "agg_transfer_economics": "SELECT f AS floor_seconds, sum(w)::BIGINT AS wire_bytes, sum(w * 86400 // greatest(c, f))::BIGINT AS bytes_a_day FROM (SELECT strlen(html) AS w, 60 * (1 + page_id % 90) AS c, unnest([0, 300, 900, 3600])::BIGINT AS f FROM pages) GROUP BY 1",
}
