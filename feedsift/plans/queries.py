"""The queries over derived feed tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ROAD_WORDS, cadence_seconds, clamp, normal_road
from ..operators import history, reconcile, registry, rollup, rules, screening
from ..sources import adapters

#: The time that replays ask for: 18 days after the start of the tables' year, in microseconds.
AT_US = 1_704_067_200_000_000 + 18 * 86_400_000_000
#: What the screen looks for in the driver's texts, in order.
NEEDLES = (("password", "secret"), ("@", "contact"), ("idiot", "abuse"), ("license", "notice"))


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.poll_log(spark, sf_dir)


def prd_poll_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.poll_status(polls(spark, sf_dir)).select("event_id", "failed", "unreached", "has_body")


def win_consecutive_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.consecutive_failures(polls(spark, sf_dir)).select("event_id", "failures")


def win_unchanged_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.unchanged_streak(polls(spark, sf_dir)).select("event_id", "unchanged")


def src_latest_n_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest_polls(polls(spark, sf_dir), 28).select("publisher_key", "event_id", F.col("place").cast("long").alias("place"))


def win_dedupe_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.dedupe_polls(polls(spark, sf_dir)).select("publisher_key", "polled_us", "event_id")


def asof_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.carry_forward(polls(spark, sf_dir)).select("event_id", "carried_forward", "update_us", "active_count", "content_hash", "schema_error_count")


def win_hash_changes_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.hash_changes(polls(spark, sf_dir))


def win_r5_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.frozen(polls(spark, sf_dir))


def rule_results_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.results_long(rules.evaluate(polls(spark, sf_dir))).select("event_id", "rule_id", "verdict", "reason")


def fold_most_severe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.evaluate(polls(spark, sf_dir)).select("event_id", "instantaneous")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.trust_states(rules.evaluate(polls(spark, sf_dir)))


def fold_trust_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, sf_dir).drop("rule_ids", "depth")


def fold_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.transitions(states(spark, sf_dir)).drop("depth")


def asof_states_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.states_at(rules.transitions(states(spark, sf_dir)), AT_US)


def agg_publisher_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.publisher_daily(polls(spark, sf_dir))


def agg_poll_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.poll_outcomes(polls(spark, sf_dir))


def agg_rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.rule_coverage(rules.results_long(rules.evaluate(polls(spark, sf_dir))))


def agg_fired_rules_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.fired_rules(rules.results_long(rules.evaluate(polls(spark, sf_dir))))


def join_registry_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.registry_diff(adapters.registry_pull(spark, sf_dir, 1), adapters.registry_pull(spark, sf_dir, 2))


def chk_registry_short_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.short_read(adapters.registry_pull(spark, sf_dir, 1), adapters.registry_pull(spark, sf_dir, 2))


def chk_registry_duplicate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    pull = adapters.registry_pull(spark, sf_dir, 1)
    return registry.duplicate_keys(pull.union(pull.filter("source_key % 9 = 1")))


def agg_registry_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.audit(adapters.registry_pull(spark, sf_dir, 1))


def fn_poll_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.registry_pull(spark, sf_dir, 2).select("publisher_key", cadence_seconds("cadence").alias("cadence_seconds"), clamp(cadence_seconds("cadence")).alias("interval_seconds"))


def win_drop_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.drop_duplicate_ids(adapters.zones(spark, sf_dir)).select("publisher_key", "feature_id", "pos")


def fn_normalize_road(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = adapters.zones(spark, sf_dir).select(F.explode("road_names").alias("name")).distinct()
    return names.select("name", normal_road(F.col("name")).alias("road"))


def scr_screen_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = adapters.texts(spark, sf_dir)
    return screening.incidents(screening.screened(texts, screening.screen(texts, NEEDLES)))


def win_first_seen_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = adapters.texts(spark, sf_dir)
    return screening.first_seen(screening.screened(texts, screening.screen(texts, NEEDLES)))


def flt_scheme_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    scheme = F.lower(F.regexp_extract("url", "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rows = adapters.table(spark, sf_dir, "pages").select("html", scheme.alias("scheme"), F.octet_length("html").alias("wire_bytes"))
    return rows.groupBy("scheme", F.col("scheme").isin("http", "https").alias("allowed")).agg(F.count(F.lit(1)).alias("pages"), F.sum("wire_bytes").alias("wire_bytes"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        prd_poll_status, win_consecutive_failures, win_unchanged_streak, src_latest_n_per_key, win_dedupe_polls, asof_carry_forward, win_hash_changes_day, win_r5_frozen,
        rule_results_long, fold_most_severe, fold_trust_state, fold_transition, asof_states_at, agg_publisher_daily, agg_poll_outcomes, agg_rule_coverage, agg_fired_rules_day,
        join_registry_diff, chk_registry_short_read, chk_registry_duplicate_key, agg_registry_audit, fn_poll_interval, win_drop_duplicate_ids, fn_normalize_road,
        scr_screen_sources, win_first_seen_text, flt_scheme_allowed,
    )
}

POLLS = """
base AS (
    SELECT event_id, ts, epoch_us(ts) AS polled_us, user_id // 30 AS org, user_id // 30 % 5 AS g, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, event_type, value,
        event_type = 'error' AS err, event_type NOT IN ('error', 'view') AS body
    FROM events
), named AS (
    SELECT *, 'org' || org || '|feed' || org AS publisher_key,
        CASE WHEN err THEN CASE WHEN k % 10 = 0 THEN 0 ELSE 503 END WHEN event_type = 'view' THEN 304 ELSE 200 END AS http_status,
        event_type = 'view' AS not_modified, CASE WHEN NOT err THEN value END AS latency_ms,
        CASE g WHEN 0 THEN 1e8::DOUBLE WHEN 1 THEN value WHEN 2 THEN 691200.0::DOUBLE WHEN 3 THEN CASE WHEN k >= 10 THEN (5 - k)::DOUBLE END ELSE 3600.0::DOUBLE END AS update_age_seconds,
        CASE WHEN body THEN k END AS active_count,
        CASE WHEN body THEN CASE g WHEN 0 THEN k WHEN 1 THEN k // 4 ELSE 0 END END AS past,
        CASE WHEN body AND g <> 2 THEN CASE WHEN g = 3 AND k % 11 = 0 THEN 2 ELSE 0 END END AS schema_error_count,
        CASE WHEN NOT err THEN CASE WHEN g IN (0, 4) THEN 'c' WHEN g = 1 THEN day(ts)::VARCHAR ELSE (k % 2)::VARCHAR END END AS structural_hash
    FROM base
), polls AS (
    SELECT *, structural_hash || ':' || (k % 3) AS content_hash, err AS failed, err AND k % 10 = 0 AS unreached, body AS has_body,
        CASE WHEN g = 0 THEN 1500000000000000 ELSE polled_us - CAST(round(update_age_seconds * 1000000) AS BIGINT) END AS update_us,
        polled_us // 86400000000 AS day
    FROM named
)"""

FAILURES = POLLS + """, islands AS (
    SELECT *, sum(CASE WHEN failed AND NOT unreached THEN 0 ELSE 1 END) OVER (PARTITION BY publisher_key ORDER BY polled_us, event_id ROWS UNBOUNDED PRECEDING) AS island FROM polls
), failures AS (
    SELECT *, CASE WHEN NOT unreached THEN sum(CASE WHEN failed AND NOT unreached THEN 1 ELSE 0 END) OVER (PARTITION BY publisher_key, island ORDER BY polled_us, event_id ROWS UNBOUNDED PRECEDING) END AS failures
    FROM islands
)"""

CHANGES = POLLS + """, lagged AS (
    SELECT *, last_value(content_hash IGNORE NULLS) OVER (PARTITION BY publisher_key ORDER BY polled_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM polls
), changes AS (
    SELECT publisher_key, day, count(*) FILTER (content_hash IS NOT NULL AND before IS NOT NULL AND content_hash <> before) AS hash_changes FROM lagged GROUP BY ALL
)"""

FROZEN = FAILURES + """, deduped AS (
    SELECT publisher_key, polled_us, max(event_id) AS event_id FROM polls WHERE NOT failed AND structural_hash IS NOT NULL GROUP BY ALL
), u AS (
    SELECT p.*, row_number() OVER w AS pos, lag(structural_hash) OVER w AS before
    FROM polls p SEMI JOIN deduped d USING (publisher_key, polled_us, event_id) WINDOW w AS (PARTITION BY publisher_key ORDER BY polled_us, event_id)
), r AS (
    SELECT *, sum(CASE WHEN structural_hash = before THEN 0 ELSE 1 END) OVER w AS run, min(polled_us) OVER w AS oldest,
        last_value(CASE WHEN update_us IS NOT NULL THEN {'stamp': update_us, 'pos': pos} END IGNORE NULLS) OVER (PARTITION BY publisher_key ORDER BY polled_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
    FROM u WINDOW w AS (PARTITION BY publisher_key ORDER BY polled_us, event_id ROWS UNBOUNDED PRECEDING)
), a AS (
    SELECT *, CASE WHEN update_us > last.stamp THEN 1 ELSE 0 END AS advance FROM r
), f AS (
    SELECT *, min(polled_us) OVER (PARTITION BY publisher_key, run ORDER BY polled_us, event_id ROWS UNBOUNDED PRECEDING) AS run_start,
        count(*) OVER d AS n, sum(advance) OVER d AS total,
        first_value(CASE WHEN update_us IS NOT NULL THEN {'advance': advance, 'pos': last.pos} END IGNORE NULLS) OVER d AS first
    FROM a WINDOW d AS (PARTITION BY publisher_key, run ORDER BY polled_us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)
), frozen AS (
    SELECT event_id, oldest, run_start, n, (total - CASE WHEN first.pos < pos - n THEN first.advance ELSE 0 END)::BIGINT AS advances FROM f
)"""


def graded(watch: str, quarantine: str) -> str:
    return f"CASE WHEN {quarantine} THEN 'QUARANTINE/EVALUATED' WHEN {watch} THEN 'WATCH/EVALUATED' ELSE 'ADMIT/EVALUATED' END"


RESULTS = FROZEN + f""", judged AS (
    SELECT p.event_id, p.publisher_key, p.polled_us, p.day, p.failed, p.failures, n, [
        CASE WHEN unreached THEN 'NOT_APPLICABLE/MISSING_INPUT' ELSE {graded("failures >= 3", "failures >= 12")} END,
        CASE WHEN failed THEN 'NOT_APPLICABLE/NO_BODY' WHEN update_age_seconds IS NULL OR update_age_seconds < 0 THEN 'NOT_APPLICABLE/MISSING_INPUT'
            ELSE {graded("update_age_seconds > 604800", "update_age_seconds > 2592000")} END,
        CASE WHEN NOT has_body THEN 'NOT_APPLICABLE/NO_BODY' WHEN g = 2 THEN 'NOT_APPLICABLE/SCHEMA_UNKNOWN' WHEN schema_error_count IS NULL THEN 'NOT_APPLICABLE/MISSING_INPUT'
            ELSE {graded("schema_error_count > 0", "false")} END,
        CASE WHEN NOT has_body THEN 'NOT_APPLICABLE/NO_BODY' WHEN active_count <= 0 THEN 'NOT_APPLICABLE/MEASURED_INAPPLICABLE'
            ELSE {graded("past::DOUBLE / active_count > 0.05", "past::DOUBLE / active_count > 0.5")} END,
        CASE WHEN NOT has_body OR structural_hash IS NULL THEN 'NOT_APPLICABLE/NO_BODY' WHEN oldest > polled_us - 86400000000 THEN 'NOT_APPLICABLE/INSUFFICIENT_HISTORY'
            WHEN run_start > polled_us - 86400000000 THEN 'ADMIT/EVALUATED' WHEN n < 12 THEN 'NOT_APPLICABLE/INSUFFICIENT_HISTORY' WHEN advances >= 3 THEN 'QUARANTINE/EVALUATED' ELSE 'WATCH/EVALUATED' END,
        CASE WHEN failed THEN 'NOT_APPLICABLE/SUPPRESSED'
            ELSE {graded("update_us IS NULL OR coalesce(update_age_seconds < -(5.0 + coalesce(latency_ms, 0) / 1000), false)", "false")} END
    ] AS found
    FROM failures p LEFT JOIN frozen USING (event_id)
), results AS (
    SELECT event_id, publisher_key, polled_us, day, 'R' || x.i AS rule_id, split_part(x.v, '/', 1) AS verdict, split_part(x.v, '/', 2) AS reason
    FROM (SELECT *, unnest(list_zip(range(1, 7), found), max_depth := 1) AS z FROM judged) q, LATERAL (SELECT z[1] AS i, z[2] AS v) x
)"""



def bits(condition: str) -> str:
    """The rules whose answer x meets the condition, as bits of a number."""
    return f"list_sum(list_transform(found, lambda x, i: CASE WHEN {condition} THEN 1 << (i - 1)::INT ELSE 0 END))::INT"


def named(mask: str) -> str:
    return f"list_filter(['R1', 'R2', 'R3', 'R4', 'R5', 'R6'], lambda x, i: {mask} & (1 << (i - 1)::INT) > 0)"


#: The state of each publisher poll by poll: every step joins each publisher's next poll.
FOLD = RESULTS + f""", masks AS (
    SELECT event_id, publisher_key, polled_us, failed, failures, n, row_number() OVER (PARTITION BY publisher_key ORDER BY polled_us, event_id) AS k,
        {bits("starts_with(x, 'QUARANTINE')")} AS q, {bits("starts_with(x, 'WATCH')")} AS w, {bits("starts_with(x, 'ADMIT')")} AS fine, {bits("starts_with(x, 'NOT_APPLICABLE') AND NOT contains(x, 'MEASURED')")} AS unmeasured
    FROM judged
), marks AS MATERIALIZED (
    SELECT *, CASE WHEN q > 0 THEN 2 WHEN w > 0 THEN 1 WHEN fine > 0 THEN 0 ELSE 1 END AS grade,
        greatest(1, CASE WHEN (q | w) & 1 > 0 THEN failures END, CASE WHEN (q | w) & 16 > 0 THEN n END)::BIGINT AS depth FROM masks
), fold AS (
    SELECT publisher_key, 0::BIGINT AS k, 1 AS old, 1 AS state, 0 AS latches, 0::BIGINT AS streak, NULL::BIGINT AS since, false AS clean FROM marks WHERE k = 1
    UNION ALL
    SELECT publisher_key, k, state, new, CASE WHEN new < state OR new = 0 THEN 0 ELSE latches | CASE WHEN new = 2 THEN q ELSE q | w END END, CASE WHEN new = state THEN run ELSE 0 END, CASE WHEN new = state THEN start END, clean
    FROM (
        SELECT *, CASE WHEN grade > state THEN grade WHEN state = 2 AND run >= 12 AND (polled_us - start) / 3.6e9::DOUBLE >= 6 THEN 1 WHEN state = 1 AND run >= 6 THEN 0 ELSE state END AS new
        FROM (
            SELECT *, CASE WHEN clean AND grade <= state THEN streak + 1 ELSE 0 END AS run, CASE WHEN clean AND grade <= state THEN coalesce(since, polled_us) END AS start
            FROM (SELECT m.*, f.state, f.latches, f.streak, f.since, NOT m.failed AND m.grade = 0 AND f.latches & m.unmeasured = 0 AS clean FROM fold f JOIN marks m ON m.publisher_key = f.publisher_key AND m.k = f.k + 1)
        )
    )
), states AS (
    SELECT m.*, ['ADMIT', 'WATCH', 'QUARANTINE'][f.old + 1] AS from_state, ['ADMIT', 'WATCH', 'QUARANTINE'][f.state + 1] AS state, f.clean, f.streak, array_to_string({named("f.latches")}, ',') AS latches,
        array_to_string(list_concat({named("q")}, {named("w")}), ',') AS rule_ids, f.state > f.old AS worse
    FROM marks m JOIN fold f USING (publisher_key, k)
), changes AS (
    SELECT event_id, publisher_key, polled_us, from_state, state AS to_state, rule_ids, nullif(split_part(rule_ids, ',', 1), '') AS primary_rule_id, CASE WHEN worse THEN 'ESCALATION' ELSE 'DE_ESCALATION' END AS direction, depth, worse
    FROM states WHERE state <> from_state
)"""

PULLS = """
pull AS (
    SELECT n_name || '|' || s_name AS publisher_key, s_suppkey AS s, n_name, 'https://feeds.example/' || s_suppkey AS url,
        ['3.1', '4', '4.1', '4.2', 'CWZ 1.0'][(s_suppkey % 5 + 1)::INT] AS version, ['1m', '5m', '10m', '30m', '60m', '72h', '168h', NULL][(s_suppkey % 8 + 1)::INT] AS cadence,
        s_suppkey % 20 = 0 AS needs_key
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
), pull1 AS (SELECT * FROM pull WHERE s % 13 <> 4),
pull2 AS (
    SELECT publisher_key, s, n_name, CASE WHEN s % 7 = 1 THEN url || '/v2' ELSE url END AS url, version, CASE WHEN s % 9 = 2 THEN '15m' ELSE cadence END AS cadence,
        (needs_key) <> (s % 11 = 5) AS needs_key
    FROM pull WHERE s % 10 <> 3
)"""


def seconds(cadence: str) -> str:
    return f"coalesce(CAST(nullif(regexp_extract({cadence}, '^(\\d+)[smh]$', 1), '') AS BIGINT) * CASE right({cadence}, 1) WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 END, 3600)"


def road_sql(name: str) -> str:
    """The steps of normal_road as SQL; the one lookahead of the list is written as a group."""
    out = f"regexp_replace(lower(trim({name})), '[^a-z0-9 ]+', ' ', 'g')"
    for pattern, word in ROAD_WORDS:
        ahead = "(?=\\d)" in pattern
        out = f"regexp_replace({out}, '{pattern.replace('(?=\\d)', '(\\d)')}', '{word}{'\\1' if ahead else ''}', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


ZONES = """
zones AS (
    SELECT 'p' || (l_suppkey % 6) AS publisher_key, l_orderkey * 1048576 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_returnflag, l_linestatus) AS pos,
        l_orderkey || '-' || CASE WHEN l_linenumber = 7 THEN 1 ELSE l_linenumber END AS feature_id,
        CASE WHEN l_orderkey % 400 <> 0 THEN (69 + 2 * ((l_partkey // 50 + 5000) // 6000)) % 360 - 180 + (l_partkey % 50) * 0.02::DOUBLE + (l_suppkey % 6) * 0.0005::DOUBLE * (l_partkey % 4) END AS lon,
        CASE WHEN l_orderkey % 400 <> 0 THEN 40 + ((l_partkey // 50 + 5000) % 6000 - 5000) * 0.02::DOUBLE END AS lat,
        l_linenumber % 2 = 1 AS point, l_returnflag AS source, [p_name, 'State Route ' || (l_partkey % 9)] AS road_names, l_linestatus = 'O' AS north,
        epoch_us(l_shipdate) AS start_us, epoch_us(l_shipdate) + CAST(l_quantity AS BIGINT) * 86400000000 AS end_us,
        l_partkey AS part_key, l_orderkey AS order_key, CASE WHEN l_linenumber % 2 = 1 THEN 0 ELSE 0.001::DOUBLE * (1 + l_quantity % 10) END AS length,
        CASE WHEN l_orderkey % 13 <> 0 THEN epoch_us(l_shipdate) + (l_orderkey % 30) * 86400000000 END AS update_us
    FROM lineitem JOIN part ON l_partkey = p_partkey
), kept AS (
    SELECT * FROM zones QUALIFY row_number() OVER (PARTITION BY publisher_key, feature_id ORDER BY pos) = 1
)"""

SCREENED = """
rows AS (
    SELECT source AS publisher_key, doc_id AS seen_at, sha256(text) AS digest,
        CASE WHEN contains(lower(text), 'password') THEN 'secret' WHEN contains(lower(text), '@') THEN 'contact' WHEN contains(lower(text), 'idiot') THEN 'abuse' WHEN contains(lower(text), 'license') THEN 'notice' END AS category
    FROM documents
)"""

ORACLE_SQL: dict[str, str] = {
    "prd_poll_status": f"WITH {POLLS} SELECT event_id, failed, unreached, has_body FROM polls",
    "win_consecutive_failures": f"WITH {FAILURES} SELECT event_id, failures::BIGINT AS failures FROM failures",
    "win_unchanged_streak": f"""WITH {POLLS}, b AS (
        SELECT *, lag(content_hash) OVER (PARTITION BY publisher_key ORDER BY polled_us, event_id) AS before FROM polls
    ), r AS (
        SELECT *, sum(CASE WHEN failed OR content_hash IS NULL OR before IS NULL OR content_hash <> before THEN 1 ELSE 0 END) OVER (PARTITION BY publisher_key ORDER BY polled_us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM b
    ) SELECT event_id, CASE WHEN failed OR content_hash IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY publisher_key, run ORDER BY polled_us, event_id) END AS unchanged FROM r""",
    "src_latest_n_per_key": f"WITH {POLLS} SELECT publisher_key, event_id, row_number() OVER (PARTITION BY publisher_key ORDER BY polled_us DESC NULLS LAST, event_id DESC) AS place FROM polls QUALIFY place <= 28",
    "win_dedupe_polls": f"WITH {POLLS} SELECT publisher_key, polled_us, max(event_id) AS event_id FROM polls GROUP BY ALL",
    "asof_carry_forward": f"""WITH {POLLS}, l AS (
        SELECT *, last_value(CASE WHEN has_body AND content_hash IS NOT NULL THEN {{'u': update_us, 'a': active_count, 'h': content_hash}} END IGNORE NULLS) OVER (PARTITION BY publisher_key ORDER BY polled_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM polls
    ), c AS (SELECT *, not_modified AND last IS NOT NULL AS carried_forward FROM l)
    SELECT event_id, carried_forward, CASE WHEN carried_forward THEN last.u ELSE update_us END AS update_us, CASE WHEN carried_forward THEN last.a ELSE active_count END AS active_count,
        CASE WHEN carried_forward THEN last.h ELSE content_hash END AS content_hash, schema_error_count FROM c""",
    "win_hash_changes_day": f"WITH {CHANGES} SELECT * FROM changes",
    "win_r5_frozen": f"WITH {FROZEN} SELECT * FROM frozen",
    "rule_results_long": f"WITH {RESULTS} SELECT event_id, rule_id, verdict, reason FROM results",
    "fold_most_severe": f"WITH {RESULTS} SELECT event_id, ['ADMIT', 'WATCH', 'QUARANTINE'][coalesce(max(CASE verdict WHEN 'QUARANTINE' THEN 3 WHEN 'WATCH' THEN 2 WHEN 'ADMIT' THEN 1 END), 2)] AS instantaneous FROM results GROUP BY event_id",
    "fold_trust_state": f"WITH RECURSIVE {FOLD} SELECT event_id, publisher_key, polled_us, from_state, state, clean, streak, latches FROM states",
    "fold_transition": f"WITH RECURSIVE {FOLD} SELECT event_id, publisher_key, polled_us, from_state, to_state, rule_ids, primary_rule_id, direction FROM changes",
    "asof_states_at": f"WITH RECURSIVE {FOLD} SELECT publisher_key, arg_max(to_state, (polled_us, event_id)) AS state FROM changes WHERE polled_us <= {AT_US} GROUP BY 1",
    "agg_publisher_daily": f"""WITH {CHANGES}, daily AS (
        SELECT publisher_key, day, count(*) AS poll_count, count(*) FILTER (failed) AS failure_count, count(*) FILTER (not_modified AND NOT failed) AS not_modified_count,
            quantile_disc(CASE WHEN NOT failed THEN latency_ms END, 0.5) AS latency_p50_ms, quantile_disc(CASE WHEN NOT failed THEN latency_ms END, 0.95) AS latency_p95_ms,
            max(update_age_seconds) AS max_update_age_seconds,
            CASE WHEN count(schema_error_count) FILTER (has_body) = count(*) FILTER (has_body) AND count(schema_error_count) FILTER (has_body) > 0 THEN sum(schema_error_count) FILTER (has_body) END::BIGINT AS schema_error_count
        FROM polls GROUP BY ALL
    ) SELECT daily.*, hash_changes FROM daily JOIN changes USING (publisher_key, day)""",
    "agg_poll_outcomes": f"WITH {POLLS} SELECT publisher_key, day, CASE WHEN unreached THEN 'not_attempted' WHEN failed AND http_status = 0 THEN 'no_response' WHEN failed THEN 'refused' WHEN not_modified THEN 'not_modified' ELSE 'fetched' END AS outcome, count(*) AS polls FROM polls GROUP BY ALL",
    "agg_rule_coverage": f"WITH {RESULTS} SELECT rule_id, day, verdict, reason, count(*) AS polls FROM results GROUP BY ALL",
    "agg_fired_rules_day": f"""WITH {RESULTS}, firsts AS (
        SELECT publisher_key, day, rule_id, min((polled_us, event_id)) AS first_at FROM results WHERE verdict IN ('WATCH', 'QUARANTINE') GROUP BY ALL
    ) SELECT publisher_key, day, string_agg(rule_id, ',' ORDER BY first_at, rule_id) AS fired_rules FROM firsts GROUP BY ALL""",
    "join_registry_diff": f"""WITH {PULLS}, j AS (
        SELECT coalesce(o.publisher_key, n.publisher_key) AS publisher_key, o.publisher_key IS NULL AS fresh, n.publisher_key IS NULL AS gone, o.url AS ou, n.url AS nu, o.version AS ov, n.version AS nv,
            {seconds("o.cadence")} AS oc, {seconds("n.cadence")} AS nc, o.needs_key AS ok, n.needs_key AS nk
        FROM pull1 o FULL JOIN pull2 n ON o.publisher_key = n.publisher_key
    )
    SELECT publisher_key, 'PROVISIONED' AS event, NULL::VARCHAR AS from_value, nu AS to_value FROM j WHERE fresh
    UNION ALL SELECT publisher_key, 'ACCESS_LOST', NULL, 'NO_ACCESS' FROM j WHERE fresh AND nk
    UNION ALL SELECT publisher_key, 'ABSENT', '1', NULL FROM j WHERE gone
    UNION ALL SELECT publisher_key, 'URL_CHANGED', ou, nu FROM j WHERE NOT fresh AND NOT gone AND ou <> nu
    UNION ALL SELECT publisher_key, 'VERSION_CHANGED', ov, nv FROM j WHERE NOT fresh AND NOT gone AND ov <> nv
    UNION ALL SELECT publisher_key, 'CADENCE_CHANGED', oc::VARCHAR, nc::VARCHAR FROM j WHERE NOT fresh AND NOT gone AND oc <> nc
    UNION ALL SELECT publisher_key, 'ACCESS_LOST', 'WATCH', 'NO_ACCESS' FROM j WHERE NOT fresh AND NOT gone AND nk AND NOT ok
    UNION ALL SELECT publisher_key, 'ACCESS_GAINED', 'NO_ACCESS', 'WATCH' FROM j WHERE NOT fresh AND NOT gone AND ok AND NOT nk""",
    "chk_registry_short_read": f"WITH {PULLS} SELECT (SELECT count(*) FROM pull1) AS live, (SELECT count(*) FROM pull2) AS entries, (SELECT count(*) FROM pull2) < 0.5 * (SELECT count(*) FROM pull1) AS rejected",
    "chk_registry_duplicate_key": f"WITH {PULLS} SELECT publisher_key, count(*) AS entries FROM (SELECT * FROM pull1 UNION ALL SELECT * FROM pull1 WHERE s % 9 = 1) GROUP BY 1 HAVING count(*) > 1",
    "agg_registry_audit": f"""WITH {PULLS} SELECT 'cadence' AS field, {seconds("cadence")}::VARCHAR AS value, count(*) AS entries FROM pull1 GROUP BY ALL
    UNION ALL SELECT 'version', version, count(*) FROM pull1 GROUP BY ALL UNION ALL SELECT 'organisation', n_name, count(*) FROM pull1 GROUP BY ALL""",
    "fn_poll_interval": f"WITH {PULLS} SELECT publisher_key, {seconds('cadence')} AS cadence_seconds, least(greatest({seconds('cadence')}, 300), 3600) AS interval_seconds FROM pull2",
    "win_drop_duplicate_ids": f"WITH {ZONES} SELECT publisher_key, feature_id, pos FROM kept",
    "fn_normalize_road": f"WITH {ZONES}, names AS (SELECT DISTINCT unnest(road_names) AS name FROM zones) SELECT name, {road_sql('name')} AS road FROM names",
    "scr_screen_sources": f"WITH {SCREENED} SELECT publisher_key, CASE WHEN category IS NULL THEN 'PASS' ELSE 'BLOCK' END AS verdict, category, count(*) AS occurrences, count(DISTINCT digest) AS texts FROM rows GROUP BY ALL",
    "win_first_seen_text": f"WITH {SCREENED} SELECT digest, min(seen_at) AS first_seen, min_by(publisher_key, seen_at) AS first_publisher, count(DISTINCT publisher_key) AS publishers FROM rows WHERE category IS NOT NULL GROUP BY digest",
    "flt_scheme_allowed": "SELECT lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('http', 'https') AS allowed, count(*) AS pages, sum(strlen(html))::BIGINT AS wire_bytes FROM pages GROUP BY ALL",
}
