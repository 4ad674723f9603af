"""Ordered logic in chunks of days against plain loops over whole histories."""

import random

import pytest
from pyspark.sql import functions as F

from feedsift.operators import history, scan

DAY = 86_400_000_000


@pytest.fixture(scope="module")
def polls(spark):
    rng = random.Random(3)
    rows = []
    for n in range(900):
        key = rng.choice(["hot", "hot", "hot", "a", "b", None])
        at = None if rng.random() < 0.03 else rng.randrange(12) * DAY + rng.randrange(24) * 3_600_000_000 * rng.choice([0, 1, 1])
        status = rng.choice([200, 200, 200, 304, 500, None])
        body = status == 200 and rng.random() < 0.9
        rows.append((n, key, at, status, rng.choice(["x", "x", "y"]) if body else None, rng.choice(["s", "s", "s", "t"]) if body else None, rng.choice([None, rng.randrange(12) * DAY])))
    return spark.createDataFrame(rows, "event_id long, publisher_key string, polled_us long, status int, content_hash string, structural_hash string, update_us long").cache()


def histories(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r["polled_us"] is not None, r["polled_us"] or 0, r["event_id"])):
        found.setdefault(r["publisher_key"], []).append(r)
    return found.values()


def test_running_values_cross_chunks(polls):
    mark = F.coalesce(F.col("content_hash") == "y", F.lit(False))
    got = scan.running(polls, ["publisher_key"], history.day_number(), history.ORDER, {"last": F.col("content_hash"), "prev": F.struct("content_hash")}, {"behind": mark, "n": F.lit(False)}, {"low": F.col("update_us")})
    assert got.columns == [*polls.columns, "last", "prev", "behind", "n", "low"]
    got = {r["event_id"]: r for r in got.collect()}
    assert len(got) == 900
    for rows in histories(polls.collect()):
        last = prev = low = None
        behind = 0
        for n, r in enumerate(rows, 1):
            behind = 0 if r["content_hash"] == "y" else behind + 1
            low = min((x for x in (low, r["update_us"]) if x is not None), default=None)
            x = got[r["event_id"]]
            assert (x["last"], x["behind"], x["n"], x["low"]) == (last, behind, n, low)
            assert (x["prev"] and x["prev"]["content_hash"]) == prev and (x["prev"] is None) == (n == 1)
            prev, last = r["content_hash"], r["content_hash"] or last


def test_no_window_spans_a_publishers_history(polls):
    """A window's rows are one chunk's: the only one over a publisher's chunks has a row for each."""
    plan = scan.running(polls, ["publisher_key"], history.day_number(), history.ORDER, since={"n": F.lit(False)})._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__chunk" in line for line in windows)


def test_empty_history(polls):
    assert history.numbered(polls.limit(0)).count() == 0


def usable_status(spark_polls):
    """The polls with the columns that the status functions read."""
    return spark_polls.withColumns({"failed": F.lit(False), "has_body": F.lit(True)})


def test_frozen_equals_a_plain_loop(polls, monkeypatch):
    monkeypatch.setattr(history, "poll_status", usable_status)
    got = {r["event_id"]: tuple(r)[1:] for r in history.frozen(polls).collect()}
    count = 0
    for rows in histories(r for r in polls.collect() if r["structural_hash"] is not None and r["polled_us"] is not None):
        rows = list({r["polled_us"]: r for r in rows}.values())  # of polls at one time the one of greatest id
        for n, r in enumerate(rows):
            start = n
            while start and rows[start - 1]["structural_hash"] == r["structural_hash"]:
                start -= 1
            low = next(k for k in range(start, n + 1) if rows[k]["polled_us"] >= r["polled_us"] - DAY)
            known = [x["update_us"] for x in rows[max(0, low - 1) : n + 1]]
            base = known.pop(0) if low else None  # the poll before the window is its baseline; older stamps count for nothing
            advances, last, seen = 0, base, base is not None
            for stamp in known:
                if stamp is None:
                    continue
                if seen:
                    advances += stamp > last
                last, seen = stamp, True
            assert got[r["event_id"]] == (rows[0]["polled_us"], rows[start]["polled_us"], n - low + 1, advances)
            count += 1
    assert count == len(got) > 100
