"""Queries over the derived feed tables against their SQL, and the state fold against a plain loop."""

import duckdb
import pytest

from feedsift.operators import rules
from feedsift.plans import catalog, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    frame = catalog.QUERIES[name](spark, SF)
    cols = sorted(frame.columns)
    want = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    rows = [tuple(r[names.index(c)] for c in cols) for r in want.fetchall()]
    assert sorted(map(repr, ([r[c] for c in cols] for r in frame.collect()))) == sorted(repr(list(r)) for r in rows)


def fold(polls, ruleset=None):
    """State after each poll of one publisher, written out as plain steps."""
    rank = {"ADMIT": 0, "WATCH": 1, "QUARANTINE": 2}
    state, latch, run, since, out = "WATCH", set(), 0, None, []
    for at, failed, now, results in polls:
        measured = {n for n, v, why in results if v != "NOT_APPLICABLE" or why == "MEASURED_INAPPLICABLE"}
        clean = not failed and now == "ADMIT" and latch <= measured
        stepped = False
        if rank[now] > rank[state]:
            state, run, since = now, 0, None
        else:
            run, since = (run + 1, since if since is not None else at) if clean else (0, None)
            if state == "QUARANTINE" and run >= 12 and at - since >= 6 * 3_600_000_000:
                state, stepped = "WATCH", True
            elif state == "WATCH" and run >= 6:
                state, stepped = "ADMIT", True
        if stepped:
            latch, run, since = set(), 0, None
        elif state == "ADMIT":
            latch = set()
        else:
            latch = latch | {n for n, v, _ in results if v in rank and rank[v] >= rank[state]}
        out.append((state, clean, run, ",".join(sorted(latch))))
    return out


def test_trust_states_equal_a_plain_loop(spark):
    evaluated = rules.evaluate(queries.polls(spark, "/root/testdata/sf0.01"))
    series = {}
    for r in evaluated.orderBy("polled_us", "event_id").collect():
        series.setdefault(r["publisher_key"], []).append((r["event_id"], (r["polled_us"], r["failed"], r["instantaneous"], [tuple(x) for x in r["results"]])))
    want = {e: s for rows in series.values() for (e, _), s in zip(rows, fold([p for _, p in rows]), strict=True)}
    got = {r["event_id"]: (r["state"], r["clean"], r["streak"], r["latches"]) for r in rules.trust_states(evaluated).collect()}
    assert got == want and len({s[0] for s in want.values()}) > 1
