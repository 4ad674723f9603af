"""Keyed state over late and disordered polls: rows wait in time buckets until the watermark has passed, then fold in order.

A publisher's waiting rows are held in a map by bucket, in the state store; each bucket has a timer at its end. When the watermark
passes it, that bucket alone is read, sorted and folded, so memory holds a bucket and never a micro-batch or a history. What comes
after its bucket was folded is behind the watermark: it changes nothing and comes out marked as late, for a batch run."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import DAY_US
from ..operators.rules import Fold, Ruleset

ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
STATES = "event_id long, publisher_key string, polled_us long, from_state string, state string, clean boolean, streak long, since long, latches string, late boolean"
MEASURES = "event_id long, publisher_key string, polled_us long, oldest long, run_start long, n long, advances long, late boolean"
#: Microseconds of a bucket.
BUCKET_US = 3_600_000_000


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings; afterwards it has its own again."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def columns_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class Buffered(StatefulProcessor):
    """Rows of a publisher_key in order of (polled_us, event_id), bucket after bucket. Rows hold the key and these two first."""

    schema: str

    def __init__(self, bucket_us: int = BUCKET_US):
        self.bucket_us = bucket_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "end_ms long", "rows string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            frame = frame.drop(columns="publisher_key")
            end = (frame["polled_us"] // self.bucket_us + 1) * self.bucket_us // 1000
            behind = end <= now
            if behind.any():
                yield self.table(self.late(key[0], frame[behind].values.tolist()))
            for at, part in frame[~behind].groupby(end[~behind]):
                bucket = (int(at),)
                held = self.waiting.getValue(bucket)
                known = json.loads(held[0]) if held else []
                if not known:
                    self.handle.registerTimer(bucket[0])
                self.waiting.updateValue(bucket, (json.dumps(known + [plain(r) for r in part.values.tolist()]),))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        bucket = (expiredTimerInfo.getExpiryTimeInMs(),)
        rows = sorted(json.loads(self.waiting.getValue(bucket)[0]), key=lambda r: r[:2])
        self.waiting.removeKey(bucket)
        yield self.table(self.fold(key[0], rows))

    def table(self, rows: Iterable[tuple]) -> pd.DataFrame:
        """The rows; whole numbers stay whole beside nulls."""
        names = columns_of(self.schema)
        out = pd.DataFrame(list(rows), columns=names, dtype=object)
        return out.astype({c.split()[0]: "Int64" for c in self.schema.split(", ") if c.endswith(" long")})

    def fold(self, key: str, rows: list[list]) -> Iterator[tuple]:
        raise NotImplementedError

    def late(self, key: str, rows: list[list]) -> Iterator[tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def plain(row: list) -> list:
    """Values that JSON can hold; a whole number that stood beside nulls is whole again."""
    row = [v.item() if hasattr(v, "item") else v for v in row]
    return [None if v is None or v != v else int(v) if isinstance(v, float) else v for v in row]


class TrustStates(Buffered):
    """The trust state after each poll. Rows: polled_us, event_id, failed, instantaneous, verdicts, reasons (joined by commas)."""

    schema = STATES

    def __init__(self, rules: Ruleset, bucket_us: int = BUCKET_US):
        super().__init__(bucket_us)
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getValueState("state", "state string, latches string, streak long, since long, last_us long, last_id long")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        """Takes a publisher up where a stored fleet table left it; what was latched stays so."""
        state, latches, streak, since, last_us, last_id = initialState[["state", "latches", "streak", "since", "last_us", "last_id"]].values.tolist()[0]
        self.kept.update((state, latches, int(streak), -1 if since is None or since != since else int(since), int(last_us), int(last_id)))

    def known(self) -> tuple[Fold, tuple[int, int]]:
        fold, held = Fold(self.rules), self.kept.get()
        if not held:
            return fold, (-(2**63), -(2**63))
        fold.state, latches, fold.streak, since, us, event = held
        fold.latches, fold.since = set(filter(None, latches.split(","))), None if since < 0 else since
        return fold, (us, event)

    def fold(self, key: str, rows: list[list]) -> Iterator[tuple]:
        fold, last = self.known()
        for us, event, failed, instantaneous, verdicts, reasons in rows:
            before, late, clean = fold.state, (us, event) <= last, False
            if not late:
                clean, last = fold.step(us, failed, instantaneous, verdicts.split(","), reasons.split(",")), (us, event)
            yield (event, key, us, before, fold.state, clean, fold.streak, fold.since, ",".join(sorted(fold.latches)), late)
        self.kept.update((fold.state, ",".join(sorted(fold.latches)), fold.streak, -1 if fold.since is None else fold.since, *last))

    def late(self, key: str, rows: list[list]) -> Iterator[tuple]:
        fold, _ = self.known()
        for us, event, *_ in rows:
            yield (int(event), key, int(us), fold.state, fold.state, False, fold.streak, fold.since, ",".join(sorted(fold.latches)), True)


class Window:
    """The structure rule's measures poll by poll: the run of polls of one structure, of it what lies within a day of the newest,
    and how often the stamp advanced there. Counts are kept as polls come and go; no window is read again."""

    def __init__(self, held: tuple | None = None, rows: Iterable[tuple] = ()):
        self.pos, self.oldest, self.hash, self.run_start, self.stamp, self.stamp_pos = held or (0, None, None, None, None, 0)
        self.rows, self.stamped, self.advances = deque(), deque(), 0
        for row in rows:
            self.add(row)

    def add(self, row: tuple[int, bool, int, int]) -> None:
        self.rows.append(row)
        self.advances += row[2]
        if row[1]:
            self.stamped.append(row)

    def step(self, us: int, structure: str, stamp: int | None) -> tuple[int, int, int, int]:
        """Takes one usable poll: (oldest, run_start, n, advances)."""
        self.pos += 1
        self.oldest = us if self.oldest is None else self.oldest
        if structure != self.hash:
            self.hash, self.run_start, self.advances = structure, us, 0
            self.rows.clear()
            self.stamped.clear()
        advance = int(stamp is not None and self.stamp is not None and stamp > self.stamp)
        self.add((us, stamp is not None, advance, self.stamp_pos))
        while self.rows[0][0] < us - DAY_US:
            gone = self.rows.popleft()
            self.advances -= gone[2]
            if gone[1]:
                self.stamped.popleft()
        if stamp is not None:
            self.stamp, self.stamp_pos = stamp, self.pos
        n = len(self.rows)
        # the first known stamp of the window counts only against the poll just before the window
        lost = self.stamped[0][2] if self.stamped and self.stamped[0][3] < self.pos - n else 0
        return self.oldest, self.run_start, n, self.advances - lost

    def held(self) -> tuple:
        return self.pos, self.oldest, self.hash, self.run_start, self.stamp, self.stamp_pos


class Frozen(Buffered):
    """Window's measures for each usable poll. Rows: polled_us, event_id, structural_hash, update_us, all of usable polls; of polls at
    one time that of the greatest event_id counts."""

    schema = MEASURES

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getValueState("window", "pos long, oldest long, hash string, run_start long, stamp long, stamp_pos long")
        self.polls = handle.getListState("polls", "us long, stamped boolean, advance int, stamp_pos long")

    def fold(self, key: str, rows: list[list]) -> Iterator[tuple]:
        held = self.kept.get()
        window = Window(held, self.polls.get()) if held else Window()
        for k, (us, event, structure, stamp) in enumerate(rows):
            if k + 1 == len(rows) or rows[k + 1][0] != us:
                yield (event, key, us, *window.step(us, structure, stamp), False)
        self.kept.update(window.held())
        self.polls.put(list(window.rows))

    def late(self, key: str, rows: list[list]) -> Iterator[tuple]:
        for us, event, *_ in rows:
            yield (int(event), key, int(us), None, None, None, None, True)


def watermarked(rows: DataFrame, delay: str) -> DataFrame:
    """The rows of a stream with a watermark over polled_us, but without its column, so that no operator drops what is behind it."""
    return rows.withColumn("__at", F.timestamp_micros("polled_us")).withWatermark("__at", delay).drop("__at")


def trust_states(evaluated: DataFrame, rules: Ruleset | None = None, delay: str = "1 hour", fleet: DataFrame | None = None, bucket_us: int = BUCKET_US) -> DataFrame:
    """STATES of a stream of evaluated polls, each once the watermark has passed its bucket. fleet: what fleet_table gave of an earlier
    run, to go on from when its checkpoint is lost."""
    rows = watermarked(evaluated, delay).select("publisher_key", "polled_us", "event_id", "failed", "instantaneous", F.array_join("results.verdict", ",").alias("verdicts"), F.array_join("results.reason", ",").alias("reasons"))
    grouped = rows.groupBy("publisher_key")
    return grouped.transformWithStateInPandas(TrustStates(rules or Ruleset(), bucket_us), STATES, "append", "eventTime", initialState=fleet.groupBy("publisher_key") if fleet is not None else None)


def frozen(polls: DataFrame, delay: str = "1 hour", bucket_us: int = BUCKET_US) -> DataFrame:
    """MEASURES of a stream of polls with their status, for those that did not fail and have a structure, each once the watermark has
    passed its bucket."""
    rows = watermarked(polls, delay).filter(~F.col("failed") & F.col("structural_hash").isNotNull() & F.col("polled_us").isNotNull())
    return rows.select("publisher_key", "polled_us", "event_id", "structural_hash", "update_us").groupBy("publisher_key").transformWithStateInPandas(Frozen(bucket_us), MEASURES, "append", "eventTime")


def fleet_table(states: DataFrame) -> DataFrame:
    """(publisher_key, state, latches, streak, since, last_us, last_id) after the last poll folded of each publisher."""
    last = F.struct("polled_us", "event_id")
    rows = states.filter("NOT late").groupBy("publisher_key").agg(F.max_by(F.struct("state", "latches", "streak", "since", "polled_us", "event_id"), last).alias("s"))
    return rows.select("publisher_key", "s.state", "s.latches", "s.streak", "s.since", F.col("s.polled_us").alias("last_us"), F.col("s.event_id").alias("last_id"))
