"""Zones of any geometry that describe one place: candidates by grid, exact refinement, adjudication, grouping, identity."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.columns import EARTH_METRES, coordinates, normal_road
from ..sources.storage import written
from . import tiles
from .reconcile import REACH, SURE

#: What else of a zone corroborates a pair.
ATTRIBUTES = ("data_source_id", "roads", "direction", "start_us", "end_us")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it stands there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


class Grid:
    """Cells of about twice the reach, as columns over longitude and latitude (pairs are found by tiles, see there). Rows are strips of equal height; each band of
    BAND rows has as many columns as fit at its latitude furthest from the equator, so a zone near a pole widens its own
    band's cells and no others'."""

    BAND = 400

    def __init__(self, reach: float):
        self.size = 2 * reach

    def row(self, lat: Column) -> Column:
        return F.floor(F.radians(lat) * EARTH_METRES / self.size)

    def columns(self, row: Column) -> Column:
        """How many cells the band of a row has around the globe."""
        band = F.floor(row / self.BAND)
        far = F.greatest(F.abs(band), F.abs(band + 1)) * (self.BAND * self.size / EARTH_METRES)
        around = F.floor(math.tau * EARTH_METRES / self.size * F.cos(F.least(far, F.lit(math.pi / 2))))
        return F.greatest(around, F.lit(1)).cast("long")

    def touched(self, vertices: str) -> Column:
        """The cells (row, column) that a geometry touches, walked in steps of at most half a cell."""
        v = F.col(vertices)

        def walk(i: Column) -> Column:
            a, b = F.get(v, i), F.get(v, F.least(i + 1, F.size(v) - 1))
            ends = F.struct(F.get(a, F.lit(0)).alias("x"), F.get(a, F.lit(1)).alias("y"), (F.get(b, F.lit(0)) - F.get(a, F.lit(0))).alias("east"), (F.get(b, F.lit(1)) - F.get(a, F.lit(1))).alias("north"))
            return let(ends, lambda e: let(F.struct(e["x"].alias("x"), e["y"].alias("y"), (e["east"] - 360 * F.bround(e["east"] / 360)).alias("east"), e["north"].alias("north"), steps(e).alias("n")), samples))

        def steps(e: Column) -> Column:
            far = F.when(e["y"] * (e["y"] + e["north"]) <= 0, 0.0).otherwise(F.least(F.abs(e["y"]), F.abs(e["y"] + e["north"])))  # where cells are narrowest on the way
            east = F.abs(e["east"] - 360 * F.bround(e["east"] / 360)) / 360 * self.columns(self.row(far))
            return F.greatest(F.ceil(2 * F.greatest(east, F.abs(F.radians(e["north"])) * EARTH_METRES / self.size)).cast("int"), F.lit(1))

        def samples(e: Column) -> Column:
            at = F.transform(F.sequence(F.lit(0), e["n"]), lambda j: F.struct(self.row(e["y"] + e["north"] * j / e["n"]).alias("row"), (e["x"] + e["east"] * j / e["n"]).alias("x")))
            wide = F.transform(at, lambda p: F.struct(p["row"].alias("row"), p["x"].alias("x"), self.columns(p["row"]).alias("n")))
            return F.transform(wide, lambda p: F.struct(p["row"].alias("row"), F.pmod(F.floor(p["x"] / 360 * p["n"]), p["n"]).alias("column")))

        return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 2, F.lit(0))), walk)))


def candidates(zones: DataFrame, reach: float = REACH) -> DataFrame:
    """Each pair of zones of different publishers that may be within reach metres, once: publisher_key, pos and vertices of both
    sides (l_..., r_...). Zones without geometry take no part."""
    rows = tiles.met(zones, ["left_publisher", "left_pos", "l_vertices", "right_publisher", "right_pos", "r_vertices"], reach, judge=False)
    return rows.withColumnsRenamed({"left_publisher": "l_publisher_key", "left_pos": "l_pos", "right_publisher": "r_publisher_key", "right_pos": "r_pos"})


PAIR = ("left_publisher", "left_pos", "right_publisher", "right_pos", "metres", "coverage", "matched", "tier", "shared_road", "same_direction", "dates_overlap")


def within_reach(zones: DataFrame, columns: Sequence[str] = PAIR, reach: float = REACH, sure: float = SURE) -> DataFrame:
    """The pairs of zones within reach, with the columns asked for (of PAIR, and the share of either side that lies within reach of
    the other): metres, coverage (null between points), matched, tier and what corroborates them. A pair within reach whose
    coverage is too small stays, unmatched. Only what the columns ask for goes along with a zone."""
    asked = list(dict.fromkeys(x for c in columns for x in (("metres", "same_source") if c == "tier" else (c,))))
    tier = F.when(F.col("same_source") & (F.col("metres") <= sure), "TIER_1").otherwise("TIER_2").alias("tier")
    return tiles.met(zones, asked, reach).select(*(tier if c == "tier" else F.col(c) for c in columns))


def judge_geometry(reach: float) -> Column:
    """(metres, coverage, matched) of the pair's vertices."""

    @F.arrow_udf("struct<metres: double, coverage: double, matched: boolean>")
    def judged(left: pa.Array, right: pa.Array) -> pa.Array:
        sides = []
        for column in (left, right):
            size = column.value_lengths().to_numpy()
            sides.append((column.flatten().flatten().to_numpy().reshape(-1, 2), np.cumsum(size) - size, size))
        metres, *shares = geometry.judge(*sides, reach)
        coverage = np.minimum(*shares)
        alone = np.isnan(coverage)
        matched = (metres <= reach) & (alone | (coverage >= geometry.LEAST_COVERAGE))
        return pa.StructArray.from_arrays([pa.array(metres), pa.array(coverage, mask=alone), pa.array(matched)], names=["metres", "coverage", "matched"])

    return judged("l_vertices", "r_vertices")


def matches(pairs: DataFrame, zones: DataFrame, reach: float = REACH, sure: float = SURE) -> DataFrame:
    """As within_reach, of pairs found before. Only pairs found within reach get their zones' other attributes, by two joins."""
    judged = pairs.select("l_publisher_key", "l_pos", "r_publisher_key", "r_pos", judge_geometry(reach).alias("__g")).filter(F.col("__g.metres") <= reach)
    known = zones.filter(F.size("vertices") > 0).withColumn("roads", F.array_distinct(F.transform("road_names", normal_road)))
    for side in ("l", "r"):
        judged = judged.join(known.select(F.col("pos").alias(f"{side}_pos"), *(F.col(c).alias(f"{side}_{c}") for c in ATTRIBUTES)), f"{side}_pos")
    same_source = F.coalesce((F.col("l_data_source_id") == F.col("r_data_source_id")) & (F.col("l_data_source_id") != ""), F.lit(False))
    overlap = F.coalesce((F.col("l_start_us") <= F.col("r_end_us")) & (F.col("r_start_us") <= F.col("l_end_us")), F.lit(True))
    return judged.select(
        F.col("l_publisher_key").alias("left_publisher"), F.col("l_pos").alias("left_pos"), F.col("r_publisher_key").alias("right_publisher"), F.col("r_pos").alias("right_pos"),
        "__g.metres", "__g.coverage", "__g.matched", F.when(same_source & (F.col("__g.metres") <= sure), "TIER_1").otherwise("TIER_2").alias("tier"),
        F.arrays_overlap("l_roads", "r_roads").alias("shared_road"), ((F.col("l_direction") != "unknown") & (F.col("l_direction") == F.col("r_direction"))).alias("same_direction"), overlap.alias("dates_overlap"),
    )


def verdicts(pairs: DataFrame, adjudicator: Column) -> DataFrame:
    """(left_pos, right_pos, verdict) of the matched pairs of the second tier, by an adjudicator over the pair's columns; what it
    does not answer is UNSURE."""
    asked = pairs.filter("matched AND tier = 'TIER_2'")
    return asked.select("left_pos", "right_pos", F.coalesce(adjudicator, F.lit("UNSURE")).alias("verdict"))


def adjudicated(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The matched pairs with the verdict on each of the second tier: (left_pos, right_pos, verdict) is looked up, a pair
    without a usable one is NOT_RUN. Only the first tier and DUPLICATE are accepted."""
    usable = verdicts.filter(F.col("verdict").isin("DUPLICATE", "DISTINCT", "UNSURE")).select("left_pos", "right_pos", F.col("verdict").alias("__v"))
    rows = pairs.filter("matched").join(usable, ["left_pos", "right_pos"], "left")
    verdict = F.when(F.col("tier") == "TIER_1", "DETERMINISTIC").otherwise(F.coalesce("__v", F.lit("NOT_RUN")))
    return rows.withColumn("verdict", verdict).withColumn("accepted", F.col("verdict").isin("DETERMINISTIC", "DUPLICATE")).drop("__v")


def answered(pairs: DataFrame, verdict: Column) -> DataFrame:
    """The matched pairs as adjudicated gives them, where the verdict is a column of the pair (null: none)."""
    usable = F.when(verdict.isin("DUPLICATE", "DISTINCT", "UNSURE"), verdict)
    rows = pairs.filter("matched").withColumn("verdict", F.when(F.col("tier") == "TIER_1", "DETERMINISTIC").otherwise(F.coalesce(usable, F.lit("NOT_RUN"))))
    return rows.withColumn("accepted", F.col("verdict").isin("DETERMINISTIC", "DUPLICATE"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): component is the smallest node that it reaches. Labels fall to the
    smallest of the neighbours' and jump to their label's label, so rounds grow with the logarithm of the longest chain."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        asked = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("__near"))
        lower = labels.join(asked, "node").select("node", F.least("component", "__near").alias("__low"), F.col("component").alias("__old"))
        roots = labels.select(F.col("node").alias("__low"), F.col("component").alias("__root"))
        moved = written(lower.join(roots, "__low").select("node", F.least("__low", "__root").alias("component"), "__old"), "labels")
        changed = moved.filter("component <> __old").limit(1).count()
        labels = moved.drop("__old")
        if not changed:
            return labels


def greedy(edges: Iterable[tuple]) -> Iterator[tuple[str, int, int]]:
    """('member', node, lead) of each node and ('dropped', a, b) of each refused edge of one component. edges (a, b, publisher of
    a, publisher of b, refused): first the pairs that were judged apart, then the accepted ones in total order. No group holds
    two zones of one publisher, nor a pair that was judged apart."""
    group_of: dict[int, int] = {}
    nodes: dict[int, set[int]] = {}
    owners: dict[int, set[str]] = {}
    apart: dict[int, set[int]] = {}  # of a node, then of a group: the nodes that it must not hold
    for a, b, pa_, pb, refused in edges:
        if refused:
            apart.setdefault(a, set()).add(b)
            apart.setdefault(b, set()).add(a)
            continue
        for node, owner in ((a, pa_), (b, pb)):
            if node not in group_of:
                group_of[node], nodes[node], owners[node] = node, {node}, {owner}
        into, other = group_of[a], group_of[b]
        if into == other:
            continue
        if owners[into] & owners[other] or not apart.get(into, set()).isdisjoint(nodes[other]):
            yield "dropped", a, b
            continue
        if len(nodes[into]) < len(nodes[other]):
            into, other = other, into
        for node in nodes[other]:
            group_of[node] = into
        nodes[into] |= nodes.pop(other)
        owners[into] |= owners.pop(other)
        if other in apart:
            apart.setdefault(into, set()).update(apart.pop(other))
    for members in nodes.values():
        lead = min(members)
        yield from (("member", node, lead) for node in members)


EDGE = ["a", "b", "pa", "pb", "tier", "metres", "refused"]


def settled(edges: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dropped, united, live): edges of large components decided side by side, as their order would decide them, and those that
    are left after so many rounds.

    An edge whose groups already share a publisher, or were judged apart, stays refused however they grow: it is dropped at once.
    An edge that comes first at both its groups meets them as they are now, whatever happens elsewhere: it unites them. No
    group has two such edges, so a round decides all of them by joins on groups, which hold no more nodes than there
    are publishers; where order is not against it, edges get fewer by a share each round."""
    accepted = edges.filter("NOT refused").withColumn("o", F.struct("tier", "metres", "pa", "pb", "a", "b"))
    apart = edges.filter("refused").select("a", "b")
    labels = accepted.select(F.col("a").alias("node"), F.col("pa").alias("owner")).union(accepted.select("b", "pb")).distinct().withColumn("grp", F.col("node"))
    live, dropped, united = accepted, [], []
    for _ in range(rounds):
        of = written(labels.join(labels.groupBy("grp").agg(F.collect_set("owner").alias("owners")), "grp").select("node", "owner", "grp", "owners"), "labels")
        left, right = (of.select(F.col("node").alias(n), F.col("grp").alias(f"g{n}"), F.col("owners").alias(f"o{n}")) for n in ("a", "b"))
        pair = [F.least("ga", "gb").alias("low"), F.greatest("ga", "gb").alias("high")]
        parted = apart.join(left, "a").join(right, "b").select(*pair).distinct().withColumn("parted", F.lit(True))
        met = live.join(left, "a").join(right, "b").filter("ga <> gb").select("*", *pair).join(parted, ["low", "high"], "left")
        met = written(met.withColumn("bad", F.arrays_overlap("oa", "ob") | F.coalesce("parted", F.lit(False))), "met")
        dropped.append(met.filter("bad").select(*EDGE))
        free = met.filter("NOT bad")
        if free.isEmpty():
            live = free
            break
        first = free.select(F.col("ga").alias("g"), "o").union(free.select("gb", "o")).groupBy("g").agg(F.min("o").alias("least"))
        chosen = written(free.join(first.select(F.col("g").alias("ga"), F.col("least").alias("o")), ["ga", "o"]).join(first.select(F.col("g").alias("gb"), F.col("least").alias("o")), ["gb", "o"]), "chosen")
        united.append(chosen.select(*EDGE))
        labels = of.join(chosen.select(F.col("high").alias("grp"), F.col("low").alias("into")), "grp", "left").select("node", "owner", F.coalesce("into", "grp").alias("grp"))
        live = written(free.join(chosen.select("a", "b"), ["a", "b"], "left_anti").select(*EDGE, "o"), "live")
    none = edges.limit(0).select(*EDGE)
    return reduce(DataFrame.union, dropped, none), reduce(DataFrame.union, united, none), live.select(*EDGE)


def groups(pairs: DataFrame, most_edges: int = 1_000_000, rounds: int = 60) -> DataFrame:
    """(kind, a, b) of all components of the accepted pairs: ('member', node, lead) and ('dropped', a, b). Pairs judged DISTINCT
    never share a group. A pair stands there once.

    Edges of different components cannot interact, so each component is decided by itself, in the order (tier, metres,
    publishers, positions). Components of more than most_edges edges are first decided side by side as far as that goes (see
    settled), which breaks them up. Then a component's edges stream past in order, sorted by Spark; a task holds a component's
    nodes, never its edges. A group of zones never holds more members than there are publishers."""
    rows = pairs.filter("accepted OR verdict = 'DISTINCT'")
    edges = written(rows.select(F.col("left_pos").alias("a"), F.col("right_pos").alias("b"), F.col("left_publisher").alias("pa"), F.col("right_publisher").alias("pb"), "tier", "metres", (~F.col("accepted")).alias("refused")), "pairs")
    held = written(edges.join(components(edges.filter("NOT refused")).withColumnRenamed("node", "a"), "a").withColumn("turn", F.when(F.col("refused"), 0).otherwise(2)), "held")
    large = held.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_edges)
    gone = None
    if not large.isEmpty():
        many = written(held.join(large.select("component"), "component", "left_semi").select(*EDGE), "large")
        gone, united, live = settled(many, rounds)
        left = written(united.withColumn("turn", F.lit(1)).union(live.withColumn("turn", F.lit(2))), "left")
        anew = components(left).withColumnRenamed("node", "a")
        again = left.union(many.filter("refused").withColumn("turn", F.lit(0))).join(anew, "a")
        held = held.join(large.select("component"), "component", "left_anti").select(*again.columns).union(again)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("component", "a", "b", "pa", "pb", "refused")), strict=True))
        found: list[tuple[str, int, int]] = []
        for _, part in groupby(rows, key=itemgetter(0)):
            found += greedy(row[1:] for row in part)
            if len(found) >= 10_000:
                yield as_batch(found)
                found = []
        if found:
            yield as_batch(found)

    order = ["component", "turn", "tier", "metres", "pa", "pb", "a", "b"]
    out = held.repartition("component").sortWithinPartitions(*order).mapInArrow(run, "kind string, a long, b long")
    return out if gone is None else out.union(alone_and_dropped(many, left, gone))


def alone_and_dropped(many: DataFrame, left: DataFrame, gone: DataFrame) -> DataFrame:
    """What the streams do not see of large components: edges dropped before, and nodes that lost all their edges."""
    ends = many.filter("NOT refused").select(F.explode(F.array("a", "b")).alias("a")).distinct()
    alone = ends.join(left.select(F.explode(F.array("a", "b")).alias("a")), "a", "left_anti")
    return alone.select(F.lit("member").alias("kind"), "a", F.col("a").alias("b")).union(gone.select(F.lit("dropped"), "a", "b"))


def as_batch(found: list[tuple[str, int, int]]) -> pa.RecordBatch:
    kind, a, b = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])


def memberships(zones: DataFrame, grouped: DataFrame) -> DataFrame:
    """(pos, lead) of every zone: of its group, or itself when nothing matched it."""
    found = grouped.filter("kind = 'member'").select(F.col("a").alias("pos"), F.col("b").alias("lead"))
    return zones.select("pos").join(found, "pos", "left").withColumn("lead", F.coalesce("lead", "pos"))


def canonical(zones: DataFrame, members: DataFrame, grouped: DataFrame) -> DataFrame:
    """A row for each group: the lead's geometry and attributes, sources in order, their count, the box, and the edges that
    were dropped at it. The lead is the member of the lowest (publisher, pos)."""
    source = F.struct("publisher_key", "pos", "feature_id", "update_us")
    first = F.struct("publisher_key", "pos")
    x, y = (coordinates("vertices", k) for k in (0, 1))
    rows = zones.join(members, "pos").groupBy("lead").agg(
        F.min_by(F.struct("vertices", "road_names", "direction", "start_us", "end_us"), first).alias("core"), F.array_sort(F.collect_list(source)).alias("sources"), F.count(F.lit(1)).alias("source_count"),
        F.min(F.array_min(x)).alias("west"), F.max(F.array_max(x)).alias("east"), F.min(F.array_min(y)).alias("south"), F.max(F.array_max(y)).alias("north"),
    )
    lost = grouped.filter("kind = 'dropped'").select(F.explode(F.array("a", "b")).alias("pos"), "a", "b").join(members, "pos").groupBy("lead").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("conflicts"))
    return rows.join(lost, "lead", "left")


def claims(members: DataFrame, held: DataFrame) -> DataFrame:
    """(group_key, members, held, oldest, place) of each group of (group_key, source_key), from the map (source_key,
    canonical_id, first_mapped_at): the oldest id that a member holds (null without any), and the group's place among those
    that claim it: the largest first, by members on ties."""
    old = F.struct("first_mapped_at", "canonical_id")
    rows = members.join(held, "source_key", "left").groupBy("group_key").agg(
        F.min(F.when(F.col("canonical_id").isNotNull(), old)).alias("oldest"), F.collect_set("canonical_id").alias("held"), F.array_sort(F.collect_list("source_key")).alias("members"))
    order = Window.partitionBy("oldest.canonical_id").orderBy(F.desc(F.size("members")), "members")
    inherits = rows.filter("oldest IS NOT NULL").withColumn("place", F.row_number().over(order))
    return inherits.unionByName(rows.filter("oldest IS NULL").withColumn("place", F.lit(0)))


def digest_id(at: int) -> Callable[[Column], Column]:
    """Mints a digest of the cycle and a group's first member, so a repeated task mints the same."""
    return lambda first: F.sha2(F.concat_ws("|", F.lit(str(at)), first.cast("string")), 256)


def assign_identity(members: DataFrame, held: DataFrame, at: int, mint: Callable[[Column], Column] | None = None) -> DataFrame:
    """(group_key, canonical_id, first_mapped_at, minted, supersedes) of each group of (group_key, source_key), from the map
    (source_key, canonical_id, first_mapped_at).

    A group inherits the oldest id that a member holds. Where several claim one, the largest keeps it, by members on ties; the
    others mint (from their first member) and name the claimed id as superseded."""
    rows = claims(members, held)
    fresh = (mint or digest_id(at))(F.get("members", F.lit(0)))
    keeps, claimed = F.col("place") == 1, F.col("oldest.canonical_id")
    superseded = F.when(keeps, F.array_sort(F.array_except("held", F.array(claimed)))).when(F.col("place") > 1, F.array(claimed)).otherwise(F.array().cast("array<string>"))
    return rows.select("group_key", F.when(keeps, claimed).otherwise(fresh).alias("canonical_id"), F.when(keeps, F.col("oldest.first_mapped_at")).otherwise(F.lit(at)).alias("first_mapped_at"), (~keeps).alias("minted"), superseded.alias("supersedes"))


def new_entries(members: DataFrame, assigned: DataFrame, held: DataFrame) -> DataFrame:
    """(source_key, canonical_id) of the map that this cycle added or pointed elsewhere."""
    return members.join(assigned, "group_key").select("source_key", "canonical_id").join(held.select("source_key", "canonical_id"), ["source_key", "canonical_id"], "left_anti")


def densified(zones: DataFrame) -> DataFrame:
    """The zones with samples: points (lon, lat) every 25 m along the line and its end once; a point is its own sample, and
    without vertices there is none."""

    @F.arrow_udf("array<array<double>>")
    def walk(vertices: pa.Array) -> pa.Array:
        return pa.array([None if v is None else geometry.samples(np.array(v, dtype=np.float64)).tolist() if v else [] for v in vertices.to_pylist()], pa.list_(pa.list_(pa.float64())))

    return zones.withColumn("samples", walk("vertices"))


def pair_sort_key() -> Column:
    """The total order of pairs: tier, then distance (none known is farthest), then publishers, then places."""
    distance = F.coalesce("metres", F.lit(float("inf"))).alias("metres")
    return F.struct("tier", distance, "left_publisher", "right_publisher", "left_pos", "right_pos")


def first_pairs(pairs: DataFrame) -> DataFrame:
    """Of each left zone its first pair in the order of pairs."""
    return pairs.groupBy("left_pos").agg(F.min(pair_sort_key()).alias("__first")).select("left_pos", "__first.right_publisher", "__first.right_pos", "__first.tier")
