"""Streams against the batch results, and what bodies give."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from feedsift.operators import bodies, evidence, rules
from feedsift.plans import queries
from feedsift.streaming import buffered, trust

SF = "/root/testdata/sf0.001"
STATE = ["event_id", "publisher_key", "polled_us", "from_state", "state", "clean", "streak", "latches"]


@pytest.fixture(scope="module")
def evaluated(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("evaluated") / "all")
    rules.evaluate(queries.polls(spark, SF)).write.parquet(path)
    return spark.read.parquet(path)


def streamed(spark, tmp_path, name, waves, **how):
    return trust.fed(waves, lambda rows: buffered.trust_states(rows, **how), str(tmp_path / f"{name}-in"), str(tmp_path / f"{name}-out"))


def test_disordered_polls_give_the_batch_states_but_for_those_behind_the_watermark(spark, evaluated, tmp_path):
    cuts = [*evaluated.selectExpr("percentile_approx(polled_us, array(0.0, 0.3, 0.6))").first()[0], 2**62]
    parts = [evaluated.filter((F.col("polled_us") >= a) & (F.col("polled_us") < b)).orderBy(F.desc("polled_us")) for a, b in itertools.pairwise(cuts)]
    rows = streamed(spark, tmp_path, "all", [*parts, evaluated.orderBy("polled_us").limit(1)])
    got = sorted(tuple(r) for r in rows.filter("NOT late").select(*STATE).collect())
    want = sorted(tuple(r) for r in rules.trust_states(evaluated).select(*STATE).collect())
    assert set(got) <= set(want) and len(got) > 0.9 * len(want)  # the last hour waits
    end = evaluated.agg(F.max("polled_us")).first()[0] - 2 * buffered.BUCKET_US
    assert {r for r in want if r[2] < end} <= set(got)
    late = rows.filter("late").collect()
    assert len(late) == 1 and late[0]["state"] == late[0]["from_state"]


def test_a_lost_checkpoint_is_made_up_by_the_fleet_table(spark, evaluated, tmp_path):
    cut = evaluated.selectExpr("percentile_approx(polled_us, 0.5)").first()[0]
    first = streamed(spark, tmp_path, "first", [evaluated.filter(F.col("polled_us") < cut)])
    fleet = buffered.fleet_table(first)
    fleet.write.parquet(str(tmp_path / "fleet"))
    seen = first.agg(F.max("polled_us")).first()[0] // buffered.BUCKET_US
    rest = evaluated.filter(F.floor(F.col("polled_us") / buffered.BUCKET_US) > seen)
    second = streamed(spark, tmp_path, "second", [rest], fleet=spark.read.parquet(str(tmp_path / "fleet")))
    whole = {r["event_id"]: tuple(r) for r in rules.trust_states(evaluated).select(*STATE).collect()}
    got = first.union(second).select(*STATE).collect()
    assert all(tuple(r) == whole[r["event_id"]] for r in got) and len(got) > 0.9 * len(whole)
    alone = streamed(spark, tmp_path, "alone", [rest]).select(*STATE).collect()
    assert any(tuple(r) != whole[r["event_id"]] for r in alone)  # without it states are others


def test_the_window_counts_as_a_plain_reading_does():
    import random

    rng = random.Random(4)
    for _ in range(30):
        window, polls, us = buffered.Window(), [], 0
        for k in range(150):
            us += rng.choice([600, 3600, 30_000]) * 1_000_000
            polls.append((us, rng.choice("aaaab"), None if rng.random() < 0.3 else rng.randrange(40)))
            run = list(itertools.takewhile(lambda p: p[1] == polls[-1][1], reversed(polls)))
            inside = [p for p in run if p[0] >= us - 86_400_000_000]
            before = polls[len(polls) - len(inside) - 1] if len(inside) < len(polls) else None
            last, advances = before[2] if before else None, 0
            for _, _, stamp in reversed(inside):
                if stamp is not None:
                    advances += last is not None and stamp > last
                    last = stamp
            assert window.step(*polls[-1]) == (polls[0][0], run[-1][0], len(inside), advances)
            if k % 17 == 0:
                window = buffered.Window(window.held(), list(window.rows))


def test_a_repeated_poll_is_dropped(spark, tmp_path):
    polls = queries.polls(spark, SF)
    polls.union(polls).write.parquet(str(tmp_path / "in"))
    stream = trust.deduped(spark.readStream.schema(polls.schema).parquet(str(tmp_path / "in"))).select("publisher_key", "polled_us")
    assert trust.drained(stream, str(tmp_path / "out")).count() == polls.select("publisher_key", "polled_us").distinct().count()


def test_upserts_keep_the_last_row_of_a_key(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for value in (1, 2):
        spark.createDataFrame([("a", value), (f"only{value}", value)], "k string, v int").write.mode("append").parquet(source)
        trust.upserted(spark.readStream.schema("k string, v int").parquet(source), out, str(tmp_path / "progress")).awaitTermination()
    assert {tuple(r) for r in trust.newest(spark, out, "k").collect()} == {("a", 2), ("only1", 1), ("only2", 2)}


def body(*features):
    return json.dumps({"feed_info": {"update_date": "t"}, "features": list(features)})


def test_hashes_do_not_see_order_and_the_structural_one_no_free_text(spark):
    one, two = ({"id": i, "properties": {"core_details": {"description": "d", "road_names": ["x"]}, "start_date": "1"}} for i in ("a", "b"))
    reworded = {**one, "properties": {"core_details": {"description": "other", "road_names": ["x"]}, "start_date": "1"}}
    rows = spark.createDataFrame([(1, body(one, two)), (2, body(two, one)), (3, body(reworded, two)), (4, body({"properties": "A"})), (5, body({"properties": "B"}))], "feed_key int, body string")
    h = {r["feed_key"]: r for r in bodies.hashes(bodies.features(rows)).collect()}
    assert h[1]["content_hash"] == h[2]["content_hash"] != h[3]["content_hash"]
    assert h[1]["structural_hash"] == h[3]["structural_hash"] and h[4]["structural_hash"] != h[5]["structural_hash"]


def test_malformed_bodies_give_no_features(spark):
    rows = spark.createDataFrame([(1, "[1, 2"), (2, '{"features": 5}'), (3, None), (4, "[]"), (5, "{}"), (6, body())], "feed_key int, body string")
    assert bodies.features(rows).count() == 0
    assert {r["feed_key"]: r["readable"] for r in bodies.header(rows).collect()} == {1: False, 2: True, 3: False, 4: True, 5: True, 6: True}


def test_later_evidence_reopens_a_draft_and_leaves_closed_packets(spark):
    found = spark.createDataFrame([("p", "APPROVED", None, [1, 2]), ("q", "APPROVED", 9, [1]), ("r", "APPROVED", None, [4])], "packet_id string, approval_state string, closed_us long, observation_ids array<long>")
    later = spark.createDataFrame([("p", 2), ("p", 3), ("q", 7)], "packet_id string, event_id long")
    rows = {r["packet_id"]: tuple(r)[1:] for r in evidence.extended(found, later).collect()}
    assert rows == {"p": ([1, 2, 3], "DRAFT", False), "q": ([1], "APPROVED", True), "r": ([4], "APPROVED", False)}


def test_numbers_that_the_facts_do_not_hold(spark):
    rows = spark.createDataFrame([("It failed 1,236 times in 30 days, not 12.", "1236 times 12")], "text string, facts string")
    assert evidence.unsupported_numbers(rows, "text", "facts").first()["unsupported"] == ["30"]
