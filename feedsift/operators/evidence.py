"""Evidence packets: opened when a publisher's state worsens, closed when it recovers, with the polls that they rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .history import by_time, numbered


def packets(changes: DataFrame) -> DataFrame:
    """(packet_id, publisher_key, to_state, event_id, opened_us, closed_us, closing_id, depth): each escalation of the latched
    state opens a packet; the
    publisher's next recovery closes it. An episode that starts anew after a recovery is a packet of its own."""
    ahead = by_time().rowsBetween(1, Window.unboundedFollowing)
    closing = F.first_value(F.when(F.col("direction") == "DE_ESCALATION", F.struct("polled_us", "event_id")), F.lit(True)).over(ahead)
    rows = changes.withColumn("__closing", closing).filter("direction = 'ESCALATION'")
    return rows.select(F.concat_ws("|", "publisher_key", "to_state", "event_id").alias("packet_id"), "publisher_key", "to_state", "event_id", F.col("polled_us").alias("opened_us"), F.col("__closing.polled_us").alias("closed_us"), F.col("__closing.event_id").alias("closing_id"), "depth")


def windows(found: DataFrame, polls: DataFrame, embedded: int = 50) -> DataFrame:
    """(packet_id, window_start, window_end, observations, truncated): the newest polls at each opening, as many as the rules
    that fired rested on (depth).

    Polls are numbered per publisher, and a packet asks for its numbers by equi-join: no range join, whatever the history."""
    places = numbered(polls.select("publisher_key", "polled_us", "event_id"))
    opened = found.join(places.select("event_id", "n"), "event_id")
    asked = opened.select("packet_id", "publisher_key", F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - F.col("depth") + 1), F.col("n"))).alias("n"))
    rows = asked.join(places, ["publisher_key", "n"]).groupBy("packet_id")
    return rows.agg(F.min("polled_us").alias("window_start"), F.max("polled_us").alias("window_end"), F.count(F.lit(1)).alias("observations"), (F.count(F.lit(1)) > embedded).alias("truncated"))


def decided(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each decision with its outcome: ACCEPTED, or the reason that it is refused. An anonymous one is refused first, then one
    for a packet that is no draft, then one for a packet without a notice, then one that read another notice."""
    rows = decisions.join(found, "packet_id", "left")
    identity = F.trim(F.coalesce("identity", F.lit("")))
    outcome = (
        F.when(identity == "", "E_EVID_002").when(F.coalesce("approval_state", F.lit("")) != "DRAFT", "E_EVID_003").when(F.coalesce("rendering", F.lit("")) == "", "E_EVID_001")
        .when(F.col("displayed_sha256") != F.sha2("rendering", 256), "E_EVID_003").otherwise("ACCEPTED")
    )
    accepted = F.col("outcome") == "ACCEPTED"
    return rows.withColumn("outcome", outcome).select("packet_id", "identity", "outcome", F.when(accepted, F.col("decision")).alias("approval_state"), F.when(accepted, F.sha2("rendering", 256)).alias("approved_sha256"))


def rendering() -> Column:
    """The notice's text from a packet's facts alone."""
    polls = F.when(F.col("observations") == 1, F.lit("1 poll")).otherwise(F.concat(F.col("observations").cast("string"), F.lit(" polls")))
    return F.concat(F.lit("Publisher "), F.col("publisher_key"), F.lit(" moved to "), F.col("to_state"), F.lit(" on "), polls, F.lit("."))


#: What stands between a model's prose and the facts that it was given.
MARKER = "Facts of record:"


def facts(found: DataFrame, windows_: DataFrame, changes: DataFrame, embedded: int = 50) -> DataFrame:
    """What a notice may cite of each packet, and nothing else."""
    rows = found.join(windows_, "packet_id").join(changes.select("event_id", "rule_ids"), "event_id")
    return rows.select("packet_id", "publisher_key", "to_state", "rule_ids", "window_start", "window_end", "observations", F.least("observations", F.lit(embedded)).cast("long").alias("embedded"), "truncated", F.col("closed_us").alias("resolved_us"))


def moment(micros: str) -> Column:
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd HH:mm:ss")


def lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def stated(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value)


def observed() -> Column:
    n = F.when(F.col("observations") == 1, F.lit("1 poll")).otherwise(F.concat(F.col("observations").cast("string"), F.lit(" polls")))
    return stated("Observed", F.concat(n, F.lit(", "), moment("window_start"), F.lit(" to "), moment("window_end"), F.lit(" UTC")))


def consumer_text() -> Column:
    """The decision record for those who use the feed, from a packet's facts."""
    org, feed = (F.split_part("publisher_key", F.lit("|"), F.lit(k)) for k in (1, 2))
    status = F.when(F.col("resolved_us").isNull(), "open").otherwise(F.concat(F.lit("resolved "), moment("resolved_us"), F.lit(" UTC")))
    return lines(stated("Decision record", org), stated("Feed", feed), stated("State", F.col("to_state")), stated("Rules fired", F.replace("rule_ids", F.lit(","), F.lit(", "))), observed(), stated("Status", status))


def registry_text() -> Column:
    """The notice for the registry, a draft until a person approves it."""
    org, feed = (F.split_part("publisher_key", F.lit("|"), F.lit(k)) for k in (1, 2))
    return lines(F.concat(F.lit("Notice on the registry entry of "), org), stated("Feed", feed), stated("Rules", F.replace("rule_ids", F.lit(","), F.lit(", "))), observed(), F.lit("This notice is a draft and goes out only when a person approves it."))


def redrafted(found: DataFrame) -> DataFrame:
    """Drafts (rendering: today's wording; stored: what is held) with outcome: KEEP_MODEL where a model wrote the text, REWRITE
    where the wording is older, else UNCHANGED. What is no draft is left out."""
    outcome = F.when(F.contains("stored", F.lit(MARKER)), "KEEP_MODEL").when(~F.col("stored").eqNullSafe(F.col("rendering")), "REWRITE").otherwise("UNCHANGED")
    return found.filter("approval_state = 'DRAFT'").withColumn("outcome", outcome)


def guarded(found: DataFrame) -> DataFrame:
    """Packets with used: whether a drafter's prose cites only numbers of the packet's facts."""
    cited = F.concat_ws(" ", F.col("observations").cast("string"), "publisher_key", "packet_id")
    checked = unsupported_numbers(found.withColumn("__facts", cited), "prose", "__facts")
    return checked.withColumn("used", (F.size("unsupported") == 0) & (F.trim("prose") != "")).drop("__facts", "unsupported")


def extended(found: DataFrame, later: DataFrame) -> DataFrame:
    """Packets (packet_id, approval_state, closed_us, observation_ids) with later observations (packet_id, event_id): ids join as
    a set, what is no draft becomes one again, and a closed packet is refused (refused, unchanged)."""
    more = later.groupBy("packet_id").agg(F.collect_set("event_id").alias("__more"))
    refused, grows = F.col("closed_us").isNotNull(), F.col("__more").isNotNull() & F.col("closed_us").isNull()
    rows = found.join(more, "packet_id", "left")
    ids = F.when(grows, F.array_sort(F.array_union("observation_ids", "__more"))).otherwise(F.col("observation_ids"))
    return rows.select("packet_id", ids.alias("observation_ids"), F.when(grows, "DRAFT").otherwise(F.col("approval_state")).alias("approval_state"), (refused & F.col("__more").isNotNull()).alias("refused"))


def numbers(text: str) -> Column:
    """The distinct numbers of a text, without thousands' commas and a sentence's dot."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9][0-9,.]*)"))
    return F.array_distinct(F.transform(found, lambda n: F.regexp_replace(F.regexp_replace(n, ",", ""), r"\.+$", "")))


def unsupported_numbers(rows: DataFrame, text: str, facts: str) -> DataFrame:
    """Adds unsupported: the numbers that the text cites and its facts do not."""
    return rows.withColumn("unsupported", F.array_sort(F.array_except(numbers(text), numbers(facts))))
