"""Queries over streams and over feed bodies, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bodies, history, rules
from ..sources import adapters
from ..sources.storage import new_folder, written
from ..streaming import buffered, trust
from .queries import FOLD, FROZEN, POLLS, ZONES


def poll_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = adapters.table(spark, sf_dir, "events").schema
    return adapters.as_polls(spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet"))  # a pattern: the table may be a single file


def st_daily_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.drained(trust.daily(poll_stream(spark, sf_dir)), new_folder(spark, "daily"))


def st_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.drained(trust.deduped(poll_stream(spark, sf_dir)).select("publisher_key", "polled_us"), new_folder(spark, "deduped"))


def in_waves(rows: DataFrame, n: int, behind: Column | None = None) -> list[DataFrame]:
    """The rows in n parts of equal time, in order; what is behind comes one part later than it should."""
    low, high = rows.agg(F.min("polled_us"), F.max("polled_us")).first()
    if low is None:
        return [rows]
    place = F.floor((F.col("polled_us") - low) * n / (high - low + 1)).cast("int")
    place = place if behind is None else place + behind.cast("int")
    return [rows.filter(place == k) for k in range(n if behind is None else n + 1)]


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(rules.evaluate(adapters.poll_log(spark, sf_dir)), "evaluated")


def streamed(waves: list[DataFrame], fleet: DataFrame | None = None) -> DataFrame:
    spark = waves[0].sparkSession
    return trust.fed(waves, lambda rows: buffered.trust_states(rows, fleet=fleet), new_folder(spark, "polls"), new_folder(spark, "states"))


STATE = ["event_id", "publisher_key", "polled_us", "from_state", "state", "clean", "streak", "latches"]


def st_trust_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after each poll that the watermark has passed, from three waves of polls, the job begun anew at each."""
    return streamed(in_waves(evaluated(spark, sf_dir), 3)).select(*STATE)


def st_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four waves in which each tenth poll comes a wave too late: those that the watermark has passed stand aside (state null), the
    others give the states that follow without them."""
    rows = streamed(in_waves(evaluated(spark, sf_dir), 4, F.col("event_id") % 10 == 0))
    return rows.select("event_id", "late", F.when(~F.col("late"), F.col("state")).alias("state"))


def st_sliding_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls = written(history.poll_status(adapters.poll_log(spark, sf_dir)), "status")
    rows = trust.fed(in_waves(polls, 2), buffered.frozen, new_folder(spark, "polls"), new_folder(spark, "windows"))
    return rows.select("event_id", "oldest", "run_start", "n", "advances")


def st_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the polls, then a stop at which the checkpoint is lost: the second run takes the publishers up from the stored fleet
    table, and all polls of buckets that the first had not folded yet."""
    rows = evaluated(spark, sf_dir)
    first = streamed(in_waves(rows, 2)[:1])
    fleet = written(buffered.fleet_table(first), "fleet")
    end = F.floor(F.col("polled_us") / buffered.BUCKET_US) + 1
    folded = first.agg(F.max(end)).first()[0] or 0
    return first.union(streamed([rows.filter(end > folded)], fleet)).select(*STATE)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bodies.features(adapters.feed_bodies(spark, sf_dir))


def src_explode_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).select("feed_key", "pos", "feature_id", "shape", "start_date", "end_date", "event_status", F.array_join("road_names", ";").alias("road_names"))


def src_feed_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bodies.header(adapters.feed_bodies(spark, sf_dir))


def agg_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bodies.consistency(parsed(spark, sf_dir), F.lit(800_000_000_000_000))


def agg_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bodies.hashes(parsed(spark, sf_dir))


QUERIES = {f.__name__: f for f in (st_daily_tumbling, st_dedupe, st_trust_state, st_late_rows, st_sliding_24h, st_restart, src_explode_features, src_feed_header, agg_consistency, agg_content_hash)}

FEATURES = ZONES + """, features AS (
    SELECT order_key AS feed_key, row_number() OVER (PARTITION BY order_key ORDER BY pos) - 1 AS pos, feature_id, CASE WHEN lon IS NOT NULL THEN CASE WHEN length = 0 THEN 'Point' ELSE 'LineString' END END AS shape,
        start_us::VARCHAR AS start_date, CASE WHEN z.pos % 11 <> 0 THEN end_us::VARCHAR END AS end_date, CASE WHEN z.pos % 3 <> 0 THEN 'active' ELSE 'planned' END AS event_status, array_to_string(road_names, ';') AS road_names
    FROM zones z WHERE order_key % 17 <> 0 AND order_key % 19 <> 0
)"""

#: Polls whose bucket the watermark, an hour behind the newest poll, has passed.
PASSED = "(polled_us // 3600000000 + 1) * 3600000 <= (SELECT max(polled_us) // 1000 - 3600000 FROM polls)"
STATES = f"WITH RECURSIVE {FOLD} SELECT event_id, publisher_key, polled_us, from_state, state, clean, streak, latches FROM states WHERE {PASSED}"
LATE = """, arrivals AS (
    SELECT event_id, polled_us, floor((polled_us - (SELECT min(polled_us) FROM polls)) * 4 / (SELECT max(polled_us) - min(polled_us) + 1 FROM polls))::INT + (event_id % 10 = 0)::INT AS wave FROM polls
), marks_of AS (
    SELECT wave, max(max(polled_us)) OVER (ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM arrivals GROUP BY wave
), late AS (
    SELECT event_id FROM arrivals JOIN marks_of USING (wave) WHERE (polled_us // 3600000000 + 1) * 3600000 <= seen // 1000 - 3600000
), masks AS ("""

ORACLE_SQL = {
    "st_trust_state": STATES,
    "st_restart": STATES,
    "st_late_rows": "WITH RECURSIVE " + FOLD.replace(", masks AS (", LATE, 1).replace("FROM judged\n), marks", "FROM judged ANTI JOIN late USING (event_id)\n), marks", 1) + f" SELECT event_id, false AS late, state FROM states WHERE {PASSED} UNION ALL SELECT event_id, true, NULL FROM late",
    "st_sliding_24h": f"WITH {FROZEN} SELECT event_id, oldest, run_start, n, advances FROM frozen JOIN polls USING (event_id) WHERE {PASSED}",
    "st_daily_tumbling": f"WITH {POLLS} SELECT publisher_key, day, count(*) AS poll_count, count(*) FILTER (failed) AS failure_count, count(*) FILTER (not_modified AND NOT failed) AS not_modified_count FROM polls GROUP BY ALL HAVING (day + 1) * 86400000000 <= (SELECT max(polled_us) - 3600000000 FROM polls)",
    "st_dedupe": f"WITH {POLLS} SELECT DISTINCT publisher_key, polled_us FROM polls",
    "src_explode_features": f"WITH {FEATURES} SELECT * FROM features",
    "src_feed_header": f"WITH {ZONES} SELECT DISTINCT order_key AS feed_key, order_key % 17 <> 0 AS readable, CASE WHEN order_key % 17 <> 0 AND order_key % 19 <> 0 THEN order_key::VARCHAR END AS update_date FROM zones",
    "agg_consistency": f"WITH {FEATURES} SELECT feed_key, count(*) AS features, count(*) FILTER (event_status = 'active') AS active, count(*) FILTER (event_status = 'active' AND end_date::BIGINT < 800000000000000) AS active_past, count(*) FILTER (event_status = 'active' AND end_date IS NULL) AS active_undated FROM features GROUP BY 1",
}
