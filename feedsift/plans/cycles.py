"""Queries over a cycle's decisions and the screening of text, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rfc3339_micros
from ..operators import cycle, rollup, rules, screening
from ..sources import adapters
from .queries import CHANGES, NEEDLES, POLLS, RESULTS, SCREENED

#: The rules of another version, and when a cycle runs (microseconds).
STRICT, NOW = rules.Ruleset(version="strict", watch_failures=2, watch_age=3 * 86400), 1_706_700_000_000_000


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.poll_log(spark, sf_dir)


def fn_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycle.due(polls(spark, sf_dir), NOW)


def sink_body_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycle.body_snapshots(polls(spark, sf_dir))


def join_retained_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycle.retained(polls(spark, sf_dir), cycle.body_snapshots(polls(spark, sf_dir)))


def win_last_measured_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycle.last_measured(polls(spark, sf_dir))


def agg_validator_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycle.validators(polls(spark, sf_dir))


def fold_ruleset_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, anew = (rules.results_long(rules.evaluate(polls(spark, sf_dir), r)) for r in (None, STRICT))
    return cycle.replayed(stored, anew)


def set_fired_evaluated_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycle.fired_and_evaluated(rules.evaluate(polls(spark, sf_dir)))


def top_daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.publisher_daily(polls(spark, sf_dir)).filter("publisher_key = 'org1|feed1'").orderBy("day").select("day", "poll_count", "failure_count", "hash_changes")


def fn_parse_rfc3339(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps of several shapes, some of them unreadable, read back."""
    n = F.col("event_id") % 5
    whole = F.date_format(F.timestamp_micros("polled_us"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(n == 0, F.concat(whole, F.lit("Z"))).when(n == 1, F.concat(whole, F.lit(".1234567+02:00"))).when(n == 2, F.concat(F.lower(whole), F.lit("-0530"))).when(n == 3, whole).otherwise(F.substring(whole, 1, 10))
    return polls(spark, sf_dir).select("event_id", rfc3339_micros(text).alias("micros"))


def cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of an earlier cycle: the texts of two thirds of the documents."""
    return screening.screen(adapters.texts(spark, sf_dir).filter("seen_at % 3 <> 0"), NEEDLES)


def join_verdict_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.unscreened(adapters.texts(spark, sf_dir), cached(spark, sf_dir)).select("digest")


def scr_fail_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = screening.screened(adapters.texts(spark, sf_dir), cached(spark, sf_dir))
    return rows.groupBy("publisher_key", "verdict").agg(F.count(F.lit(1)).alias("occurrences"), F.count_if(F.col("served") == screening.REDACTED).alias("redacted"))


def agg_screening_publishers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = screening.screened(adapters.texts(spark, sf_dir), cached(spark, sf_dir)).filter("verdict = 'BLOCK'")
    return rows.groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set("publisher_key")), ",").alias("publishers"))


def agg_text_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.texts(spark, sf_dir)
    return rows.groupBy("publisher_key").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.length("text") > 0).alias("described"), F.max(F.length("text")).cast("long").alias("longest"), F.count_distinct("text").alias("distinct_texts"))


QUERIES = {
    f.__name__: f
    for f in (
        fn_due, sink_body_snapshot, join_retained_body, win_last_measured_count, agg_validator_summary, fold_ruleset_replay, set_fired_evaluated_rules, top_daily_series, fn_parse_rfc3339,
        join_verdict_cache, scr_fail_closed, agg_screening_publishers, agg_text_surface,
    )
}

STRICTER = RESULTS.replace("failures >= 3", "failures >= 2").replace("update_age_seconds > 604800", "update_age_seconds > 259200")
SNAPSHOTS = POLLS + """, bodies AS (
    SELECT *, lag(content_hash) OVER (PARTITION BY publisher_key ORDER BY polled_us, event_id) AS before FROM polls WHERE has_body AND content_hash IS NOT NULL
), snapshots AS (
    SELECT publisher_key, arg_max(polled_us, (polled_us, event_id)) AS stored_us, arg_max(content_hash, (polled_us, event_id)) AS content_hash, count(*) AS writes FROM bodies WHERE content_hash IS DISTINCT FROM before GROUP BY 1
)"""
LATEST = "last_value(CASE WHEN has_body THEN content_hash END IGNORE NULLS) OVER (PARTITION BY publisher_key ORDER BY polled_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
CACHED = SCREENED + ", cache AS (SELECT DISTINCT digest FROM rows WHERE seen_at % 3 <> 0), judged AS (SELECT rows.*, CASE WHEN digest IS NULL THEN 'PASS' WHEN digest NOT IN (SELECT digest FROM cache WHERE digest IS NOT NULL) THEN 'UNAVAILABLE' WHEN category IS NULL THEN 'PASS' ELSE 'BLOCK' END AS verdict FROM rows)"

ORACLE_SQL = {
    "fn_due": f"""WITH {POLLS}, b AS (SELECT *, lag(content_hash) OVER (PARTITION BY publisher_key ORDER BY polled_us, event_id) AS before FROM polls
    ), r AS (SELECT *, sum(CASE WHEN failed OR content_hash IS NULL OR before IS NULL OR content_hash <> before THEN 1 ELSE 0 END) OVER (PARTITION BY publisher_key ORDER BY polled_us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM b
    ), u AS (SELECT *, CASE WHEN failed OR content_hash IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY publisher_key, run ORDER BY polled_us, event_id) END AS unchanged FROM r)
    SELECT publisher_key, 3600::BIGINT AS interval_seconds, (1706700000000000 - max(polled_us)) / 1e6 >= 3450 AS due FROM u GROUP BY 1""",
    "sink_body_snapshot": f"WITH {SNAPSHOTS} SELECT * FROM snapshots",
    "join_retained_body": f"WITH {SNAPSHOTS}, c AS (SELECT *, {LATEST} AS held FROM polls) SELECT publisher_key, event_id, held AS content_hash FROM c SEMI JOIN snapshots s ON c.publisher_key = s.publisher_key AND held = s.content_hash WHERE not_modified",
    "win_last_measured_count": f"WITH {POLLS} SELECT publisher_key, coalesce(arg_max(active_count, (polled_us, event_id)) FILTER (active_count IS NOT NULL), 0)::BIGINT AS active_count FROM polls GROUP BY 1",
    "agg_validator_summary": f"WITH {CHANGES} SELECT publisher_key, CASE WHEN count(*) FILTER (not_modified) > 0 THEN 'HONOURS' WHEN count(*) FILTER (has_body AND content_hash = before) > 0 THEN 'IGNORES' ELSE 'INCONCLUSIVE' END AS behaviour, count(*) FILTER (has_body AND content_hash = before) AS avoidable FROM lagged GROUP BY 1",
    "fold_ruleset_replay": f"SELECT rule_id, a.verdict AS stored_verdict, b.verdict, count(*) AS polls FROM (WITH {RESULTS} SELECT * FROM results) a JOIN (WITH {STRICTER} SELECT * FROM results) b USING (event_id, rule_id) WHERE a.verdict <> b.verdict GROUP BY ALL",
    "set_fired_evaluated_rules": f"WITH {RESULTS} SELECT event_id, coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (verdict IN ('WATCH', 'QUARANTINE')), '') AS fired, coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (verdict <> 'NOT_APPLICABLE'), '') AS evaluated FROM results GROUP BY 1",
    "top_daily_series": f"WITH {CHANGES} SELECT day, count(*) AS poll_count, count(*) FILTER (failed) AS failure_count, any_value(hash_changes) AS hash_changes FROM polls JOIN changes USING (publisher_key, day) WHERE publisher_key = 'org1|feed1' GROUP BY 1 ORDER BY 1",
    "fn_parse_rfc3339": f"WITH {POLLS} SELECT event_id, CASE event_id % 5 WHEN 0 THEN polled_us // 1000000 * 1000000 WHEN 1 THEN polled_us // 1000000 * 1000000 + 123456 - 7200000000 WHEN 2 THEN polled_us // 1000000 * 1000000 + 19800000000 END AS micros FROM polls",
    "join_verdict_cache": f"WITH {CACHED} SELECT DISTINCT digest FROM judged WHERE verdict = 'UNAVAILABLE'",
    "scr_fail_closed": f"WITH {CACHED} SELECT publisher_key, verdict, count(*) AS occurrences, count(*) FILTER (verdict <> 'PASS') AS redacted FROM judged GROUP BY ALL",
    "agg_screening_publishers": f"WITH {CACHED} SELECT digest, string_agg(DISTINCT publisher_key, ',' ORDER BY publisher_key) AS publishers FROM judged WHERE verdict = 'BLOCK' GROUP BY 1",
    "agg_text_surface": "SELECT source AS publisher_key, count(*) AS entries, count(*) FILTER (length(text) > 0) AS described, max(length(text)) AS longest, count(DISTINCT text) AS distinct_texts FROM documents GROUP BY 1",
}
