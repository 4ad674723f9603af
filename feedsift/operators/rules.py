"""The six trust rules, what they add up to, and the state that follows from them poll by poll."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import DAY_US
from .history import consecutive_failures, frozen, poll_status

RULES = ("R1", "R2", "R3", "R4", "R5", "R6")
SEVERITY = {"ADMIT": 0, "WATCH": 1, "QUARANTINE": 2}
STATES = ("ADMIT", "WATCH", "QUARANTINE")


@dataclass(frozen=True)
class Ruleset:
    """Thresholds of one version of the rules."""

    version: str = "v2"
    watch_failures: int = 3
    quarantine_failures: int = 12
    watch_age: int = 7 * 86400
    quarantine_age: int = 30 * 86400
    watch_cadences: int = 3
    quarantine_cadences: int = 10
    watch_share: float = 0.05
    quarantine_share: float = 0.5
    least_polls: int = 12
    quarantine_advances: int = 3
    skew_seconds: float = 5.0
    watch_polls: int = 12
    watch_hours: float = 6.0
    admit_polls: int = 6


def outcome(verdict: Column | str, reason: str = "EVALUATED") -> Column:
    return F.struct((F.lit(verdict) if isinstance(verdict, str) else verdict).alias("verdict"), F.lit(reason).alias("reason"))


def not_applicable(reason: str) -> Column:
    return outcome("NOT_APPLICABLE", reason)


def graded(watch: Column, quarantine: Column) -> Column:
    return outcome(F.when(quarantine, "QUARANTINE").when(watch, "WATCH").otherwise("ADMIT"))


def rule_columns(r: Ruleset) -> list[Column]:
    """The rules R1 to R6 over polls that carry failures and the measures of frozen()."""
    failed, body, age, cadence = F.col("failed"), F.col("has_body"), F.col("update_age_seconds"), F.greatest(F.lit(1), F.col("declared_cadence_seconds"))
    r1 = F.when(F.col("unreached"), not_applicable("MISSING_INPUT")).otherwise(graded(F.col("failures") >= r.watch_failures, F.col("failures") >= r.quarantine_failures))
    r2 = F.when(failed, not_applicable("NO_BODY")).when(age.isNull() | (age < 0), not_applicable("MISSING_INPUT")).otherwise(
        graded(age > F.greatest(F.lit(r.watch_age), cadence * r.watch_cadences), age > F.greatest(F.lit(r.quarantine_age), cadence * r.quarantine_cadences)))
    version, errors = F.col("schema_version_used"), F.col("schema_error_count")
    r3 = F.when(~body, not_applicable("NO_BODY")).when(version.isNull() | (version == "SCHEMA_UNKNOWN"), not_applicable("SCHEMA_UNKNOWN")).when(errors.isNull(), not_applicable("MISSING_INPUT")).otherwise(graded(errors > 0, F.lit(False)))
    active, past, undated = F.col("active_count"), F.col("active_with_past_end_date"), F.col("active_undated")
    dated = active - F.coalesce(undated, F.lit(0))
    r4 = F.when(~body, not_applicable("NO_BODY")).when(active.isNull() | past.isNull() | ((active > 0) & undated.isNull()), not_applicable("MISSING_INPUT")).when(dated <= 0, not_applicable("MEASURED_INAPPLICABLE")).otherwise(
        graded(past / dated > r.watch_share, past / dated > r.quarantine_share))
    cutoff = F.col("polled_us") - DAY_US
    r5 = (
        F.when(~body | F.col("structural_hash").isNull(), not_applicable("NO_BODY")).when(F.col("oldest") > cutoff, not_applicable("INSUFFICIENT_HISTORY"))
        .when(F.col("run_start") > cutoff, outcome("ADMIT")).when(F.col("n") < r.least_polls, not_applicable("INSUFFICIENT_HISTORY"))
        .otherwise(outcome(F.when(F.col("advances") >= r.quarantine_advances, "QUARANTINE").otherwise("WATCH")))
    )
    ahead = F.coalesce(age < -(r.skew_seconds + F.coalesce(F.col("latency_ms"), F.lit(0.0)) / 1000), F.lit(False))
    r6 = F.when(failed, not_applicable("SUPPRESSED")).otherwise(graded(F.col("update_us").isNull() | ahead, F.lit(False)))
    return [r1, r2, r3, r4, r5, r6]


def evaluate(polls: DataFrame, rules: Ruleset | None = None) -> DataFrame:
    """(event_id, publisher_key, polled_us, failed, results, depth, instantaneous): results is an array of (rule_id, verdict,
    reason) in rule order; depth is how many polls back the rules that fired looked, 1 at least; instantaneous the most severe
    verdict, WATCH if no rule applies."""
    rows = consecutive_failures(polls).join(frozen(polls), "event_id", "left")
    results = F.array(*(F.struct(F.lit(n).alias("rule_id"), c["verdict"].alias("verdict"), c["reason"].alias("reason")) for n, c in zip(RULES, rule_columns(rules or Ruleset()), strict=True)))
    rows = rows.withColumn("results", results)
    depth = F.greatest(F.lit(1), F.when(fired("R1"), F.col("failures")), F.when(fired("R5"), F.col("n"))).cast("long")
    return rows.select("event_id", "publisher_key", "polled_us", "failed", "results", depth.alias("depth")).withColumn("instantaneous", most_severe(F.col("results")))


def one_rule(polls: DataFrame, rule: str, rules: Ruleset | None = None) -> DataFrame:
    """(event_id, verdict, reason) of one rule alone, with no other window than it needs."""
    rows = consecutive_failures(polls) if rule == "R1" else poll_status(polls)
    if rule == "R5":
        rows = rows.join(frozen(polls), "event_id", "left")
    found = rule_columns(rules or Ruleset())[RULES.index(rule)]
    return rows.select("event_id", found["verdict"].alias("verdict"), found["reason"].alias("reason"))


def fired(rule: str) -> Column:
    return F.exists("results", lambda r: (r["rule_id"] == rule) & r["verdict"].isin("WATCH", "QUARANTINE"))


def fired_rules() -> Column:
    """The rules that fired, the most severe first, else in rule order."""

    def having(verdict: str) -> Column:
        return F.transform(F.filter("results", lambda r: r["verdict"] == verdict), lambda r: r["rule_id"])

    return F.concat(having("QUARANTINE"), having("WATCH"))


def most_severe(results: Column) -> Column:
    grade = F.array_max(F.transform(results, lambda r: F.when(r["verdict"] == "QUARANTINE", 2).when(r["verdict"] == "WATCH", 1).when(r["verdict"] == "ADMIT", 0)))
    return F.element_at(F.array(*(F.lit(s) for s in STATES)), F.coalesce(grade, F.lit(1)) + 1)


def results_long(evaluated: DataFrame) -> DataFrame:
    return evaluated.select("event_id", "publisher_key", "polled_us", F.inline("results"))


class Fold:
    """The state of one publisher, carried from poll to poll."""

    def __init__(self, rules: Ruleset):
        self.rules, self.state, self.latches, self.streak, self.since = rules, "WATCH", set(), 0, None

    def step(self, at: int, failed: bool, instantaneous: str, verdicts: list[str], reasons: list[str]) -> bool:
        """Takes one poll and says whether it is clean. A poll is clean when it did not fail, admits, and measured every rule
        that holds the state. Raising is immediate; lowering takes a run of clean polls (and hours, from quarantine)."""
        held = [RULES.index(x) for x in self.latches]
        clean = not failed and instantaneous == "ADMIT" and all(verdicts[k] != "NOT_APPLICABLE" or reasons[k] == "MEASURED_INAPPLICABLE" for k in held)
        before = self.state
        if SEVERITY[instantaneous] > SEVERITY[before]:
            self.state, self.streak, self.since = instantaneous, 0, None
        else:
            self.streak, self.since = (self.streak + 1, at if self.since is None else self.since) if clean else (0, None)
            if before == "QUARANTINE" and self.streak >= self.rules.watch_polls and (at - self.since) / 3.6e9 >= self.rules.watch_hours:
                self.state = "WATCH"
            elif before == "WATCH" and self.streak >= self.rules.admit_polls:
                self.state = "ADMIT"
            if self.state != before:
                self.latches, self.streak, self.since = set(), 0, None
                return clean
        firing = {r for r, v in zip(RULES, verdicts, strict=True) if v in SEVERITY and SEVERITY[v] >= max(1, SEVERITY[self.state])}
        self.latches = (self.latches | firing) if self.state != "ADMIT" else set()
        return clean


def trust_states(evaluated: DataFrame, rules: Ruleset | None = None) -> DataFrame:
    """(event_id, publisher_key, polled_us, from_state, state, clean, streak, latches, rule_ids, depth) of each poll, in time
    order; rule_ids: those that fired, the most severe first.

    A publisher's polls stream through one task in order; only its state is held, so a long history needs no memory."""
    rules = rules or Ruleset()
    rows = evaluated.select("publisher_key", "polled_us", "event_id", "failed", "instantaneous", F.col("results.verdict").alias("verdicts"), F.col("results.reason").alias("reasons"), F.array_join(fired_rules(), ",").alias("rule_ids"), "depth")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fold = None, Fold(rules)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["publisher_key"] != key:
                    key, fold = r["publisher_key"], Fold(rules)
                before = fold.state
                clean = fold.step(r["polled_us"], r["failed"], r["instantaneous"], r["verdicts"], r["reasons"])
                out.append({"event_id": r["event_id"], "publisher_key": key, "polled_us": r["polled_us"], "from_state": before, "state": fold.state, "clean": clean, "streak": fold.streak, "latches": ",".join(sorted(fold.latches)), "rule_ids": r["rule_ids"], "depth": r["depth"]})
            if out:
                yield pa.RecordBatch.from_pylist(out)

    return rows.repartition("publisher_key").sortWithinPartitions("publisher_key", "polled_us", "event_id").mapInArrow(run, "event_id long, publisher_key string, polled_us long, from_state string, state string, clean boolean, streak long, latches string, rule_ids string, depth long")


def transitions(states: DataFrame) -> DataFrame:
    """A row for each change of state, with the rules that fired, most severe first, the depth of their evidence and the
    direction."""
    grade = F.create_map(*(F.lit(x) for p in SEVERITY.items() for x in p))
    first = F.nullif(F.split_part("rule_ids", F.lit(","), F.lit(1)), F.lit(""))
    return states.filter("state <> from_state").select("event_id", "publisher_key", "polled_us", "from_state", F.col("state").alias("to_state"), "rule_ids", first.alias("primary_rule_id"),
                                                       F.when(grade[F.col("state")] > grade[F.col("from_state")], "ESCALATION").otherwise("DE_ESCALATION").alias("direction"), "depth")


def states_at(changes: DataFrame, at_us: int) -> DataFrame:
    """The state of each publisher at a time: that of its last transition up to then."""
    return changes.filter(F.col("polled_us") <= at_us).groupBy("publisher_key").agg(F.max_by("to_state", F.struct("polled_us", "event_id")).alias("state"))


__all__ = ["Ruleset", "evaluate", "most_severe", "poll_status", "results_long", "states_at", "transitions", "trust_states"]
