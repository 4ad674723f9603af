"""What SQL does not check: transitions, states at a time, zones, the snapshot, the feed's size, similarity, cuts by bytes."""

from bisect import bisect_right
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from feedsift.functions.columns import line_length
from feedsift.functions.text import cut_utf8, road_label, safe_id
from feedsift.operators import matching, rules, views
from feedsift.plans import merge, queries

SF = "/root/testdata/sf0.001"
FOLD_SF = "/root/testdata/sf0.01"  # several publishers
RANK = {"ADMIT": 0, "WATCH": 1, "QUARANTINE": 2}


@pytest.fixture(scope="module")
def folded(spark):
    evaluated = rules.evaluate(queries.polls(spark, FOLD_SF)).collect()
    found = {r["event_id"]: {x["rule_id"]: x["verdict"] for x in r["results"]} for r in evaluated}
    return sorted(rules.trust_states(rules.evaluate(queries.polls(spark, FOLD_SF))).collect(), key=lambda r: (r["publisher_key"], r["polled_us"], r["event_id"])), found


def test_transitions_are_the_changes_of_state_with_the_rules_that_fired(spark, folded):
    states, found = folded
    want = set()
    last: dict[str, str] = {}
    for r in states:
        old, last[r["publisher_key"]] = last.get(r["publisher_key"], "WATCH"), r["state"]
        if old != r["state"]:
            fired = sorted((k for k, v in found[r["event_id"]].items() if v in ("WATCH", "QUARANTINE")), key=lambda k, e=r["event_id"]: (-RANK[found[e][k]], k))
            want.add((r["event_id"], old, r["state"], ",".join(fired), fired[0] if fired else None, "ESCALATION" if RANK[r["state"]] > RANK[old] else "DE_ESCALATION"))
    got = {(r["event_id"], r["from_state"], r["to_state"], r["rule_ids"], r["primary_rule_id"], r["direction"]) for r in queries.fold_transition(spark, FOLD_SF).collect()}
    assert got == want and len(want) > 3


def test_states_at_a_time_are_those_of_the_last_transition(spark, folded):
    states, _ = folded
    at = queries.AT_US
    moves: dict[str, list[tuple[int, str]]] = {}
    last: dict[str, str] = {}
    for r in states:
        if r["state"] != last.get(r["publisher_key"], "WATCH"):
            moves.setdefault(r["publisher_key"], []).append((r["polled_us"], r["state"]))
        last[r["publisher_key"]] = r["state"]
    want = {k: v[n - 1][1] for k, v in moves.items() if (n := bisect_right([t for t, _ in v], at))}
    assert {r["publisher_key"]: r["state"] for r in queries.asof_states_at(spark, FOLD_SF).collect()} == want


def test_zones_hold_every_member_once_in_a_box_around_them(spark):
    zones = {r["pos"]: r for r in merge.kept(spark, SF).collect()}
    grouped = matching.groups(merge.adjudicated(spark, SF))
    members = {r["pos"]: r["lead"] for r in matching.memberships(merge.kept(spark, SF), grouped).collect()}
    assert set(members) == set(zones)
    of: dict[int, list[int]] = {}
    for pos, lead in members.items():
        of.setdefault(lead, []).append(pos)
    dropped = {(r["a"], r["b"]) for r in grouped.collect() if r["kind"] == "dropped"}
    rows = {r["lead"]: r for r in merge.zone_build(spark, SF).collect()}
    assert set(rows) == set(of)
    for lead, own in of.items():
        points = [p for pos in own for p in zones[pos]["vertices"]]
        box = [f(p[k] for p in points) for k in (0, 1) for f in (min, max)] if points else [None] * 4
        first = min(own, key=lambda pos: (zones[pos]["publisher_key"], pos))
        lost = {e for e in dropped if set(e) & set(own)}
        row = rows[lead]
        assert [row["west"], row["east"], row["south"], row["north"]] == box
        assert (row["source_count"], row["conflicts"], row["start_us"]) == (len(own), len(lost), zones[first]["start_us"])
        assert row["publishers"].split(",") == sorted(zones[pos]["publisher_key"] for pos in own)
    (total,) = merge.agg_reconciliation_snapshot(spark, SF).collect()
    assert (total["groups"], total["merged"], total["zones"], total["conflicts"]) == (len(of), sum(len(x) > 1 for x in of.values()), len(zones), sum(r["conflicts"] for r in rows.values()))


def test_the_feed_has_a_line_for_each_published_feature(spark):
    (size,) = merge.sink_merged_feed(spark, SF).collect()
    lines = [r["value"] for r in merge.republish.feed_lines(merge.republish.features(merge.merged(spark, SF))).collect()]
    published = merge.pub_exclusion_reason(spark, SF).filter("reason IS NULL").count()
    assert size["features"] == len(lines) == published > 0 and size["bytes"] == sum(len(x.encode()) for x in lines)


def test_similarity_equals_a_plain_count(spark):
    words = ["left lane closed", "left lane closed ahead", "right lane closed", "", "bridge works", None, "Bridge works at night"]
    pairs = [(a, b) for a in words for b in words]
    (row,) = views.description_similarity(spark.createDataFrame(pairs, "left_text string, right_text string")).collect()
    ratios = sorted(SequenceMatcher(None, a, b).ratio() for a, b in pairs if a and b)
    assert row["pairs"] == len(ratios) and row["median"] == pytest.approx(ratios[len(ratios) // 2], abs=1e-4)
    assert (row["near_identical"], row["related"], row["unlike"]) == (sum(r >= 0.9 for r in ratios), sum(0.6 <= r < 0.9 for r in ratios), sum(r < 0.6 for r in ratios))
    (none,) = views.description_similarity(spark.createDataFrame([], "left_text string, right_text string")).collect()
    assert (none["pairs"], none["median"]) == (0, None)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 7, 100])
def test_cuts_by_bytes_keep_whole_characters(spark, size):
    texts = ["", "abc", "é", "aé", "日本語", "a😀b", "😀😀", "plain and longer text"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cut_utf8(F.col("t"), size).alias("c")).collect()
    assert all(r["c"] == r["t"].encode()[:size].decode(errors="ignore") for r in rows)


def test_ids_stay_one_for_each_value(spark):
    values = ["org|feed", "a/b", "a%2Fb", "a~b", "", ".", "..", "__x__", "y" * 1501, "é" * 800]
    ids = [r["i"] for r in spark.createDataFrame([(v,) for v in values], "v string").select(safe_id(F.col("v")).alias("i")).collect()]
    assert ids[:3] == ["org|feed", "a%2Fb", "a%252Fb"] and len(set(ids)) == len(values)
    assert all(0 < len(i.encode()) <= 1500 and "/" not in i for i in ids)


def test_labels_name_each_road_once(spark):
    rows = [(["I-70", " i-70 ", "Main St", "X"], "unknown"), (["X", "X"], "northbound"), (["", " "], "northbound"), (None, "unknown"), ([], None)]
    got = spark.createDataFrame(rows, "n array<string>, d string").select(road_label(F.col("n"), F.col("d"), "X").alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [("I-70 / Main St", 1, 1), ("", 2, 0), ("northbound", 0, 0), ("unnamed", 0, 0), ("unnamed", 0, 0)]


def test_lengths_of_points_lines_and_nothing(spark):
    rows = [([],), ([[1.0, 2.0]],), ([[0.0, 0.0], [0.0, 1.0], [0.0, 0.0]],), ([[179.5, 0.0], [-179.5, 0.0]],)]
    got = [r["m"] for r in spark.createDataFrame(rows, "v array<array<double>>").select(line_length("v").alias("m")).collect()]
    degree = 6_371_008.8 * 3.141592653589793 / 180
    assert got[:2] == [None, 0.0] and got[2:] == pytest.approx([2 * degree, degree])


def test_a_manifest_tells_lost_changed_and_unlisted_files(spark):
    files = spark.createDataFrame([("a", b"x"), ("b", b"y"), ("c", b"z")], "name string, content binary")
    listed = spark.createDataFrame([("a", b"x"), ("b", b"other"), ("d", b"w")], "name string, content binary").select("name", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))
    assert {r["name"]: r["outcome"] for r in views.verified(files, listed).collect()} == {"a": "OK", "b": "CHANGED", "c": "UNLISTED", "d": "MISSING"}
