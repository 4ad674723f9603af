"""Geometry, grouping and identity against plain versions."""

import itertools

import numpy as np
import pytest

from feedsift.functions import geometry
from feedsift.operators import matching
from feedsift.plans import merge


def test_a_ramp_inside_a_long_corridor_does_not_match_it():
    ramp, corridor = np.array([[-90.0, 38.0], [-89.95, 38.0]]), np.array([[-90.1, 38.0], [-89.72, 38.0]])
    assert geometry.min_distance(ramp, corridor) < 1e-6
    assert geometry.symmetric_coverage(ramp, corridor, 150.0) < 0.2


def test_coverage_does_not_depend_on_how_finely_a_line_is_written():
    short, coarse = np.array([[0.0, 0.0], [0.0054, 0.0]]), np.array([[0.0, 0.0], [0.009, 0.0]])
    fine = np.column_stack([np.linspace(0.0, 0.009, 400), np.zeros(400)])
    assert geometry.symmetric_coverage(short, coarse, 1.0) == pytest.approx(geometry.symmetric_coverage(short, fine, 1.0))


def test_evenly_inserted_vertices_change_nothing():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.array([[10.0, 60.0], [10.0, 60.0]]) + rng.uniform(-0.02, 0.02, (2, 2)) for _ in range(2))
        fine = np.column_stack([np.linspace(*a[:, k], 401) for k in (0, 1)])
        assert geometry.min_distance(a, b) == pytest.approx(geometry.min_distance(fine, b), abs=1e-6)
        assert geometry.min_distance(b[:1], a) == pytest.approx(geometry.min_distance(b[:1], fine), abs=1e-6)
        assert geometry.symmetric_coverage(a, b, 150.0) == pytest.approx(geometry.symmetric_coverage(fine, b, 150.0), abs=0.02)


def test_the_plane_lies_about_the_mean_of_the_means():
    point, line = np.array([[0.0, 60.0]]), np.array([[0.002, 61.0], [0.002, 60.0], [0.002, 59.0]])
    metres = 6371008.8 * np.radians(0.002) * np.cos(np.radians(60.0))
    assert geometry.min_distance(point, line) == pytest.approx(metres)
    assert geometry.min_distance(point, line[:2]) == pytest.approx(6371008.8 * np.radians(0.002) * np.cos(np.radians((60 + 60.5) / 2)))


def test_lines_that_cross_and_lines_over_the_antimeridian():
    assert geometry.min_distance(np.array([[0.0, -1.0], [0.0, 1.0]]), np.array([[-1.0, 0.0], [1.0, 0.0]])) == 0.0
    assert geometry.min_distance(np.array([[179.9995, 10.0]]), np.array([[-179.9995, 10.0]])) == pytest.approx(109.5, abs=0.5)


def test_candidates_miss_no_pair_within_reach(spark):
    rng = np.random.default_rng(5)
    zones = []
    for pos in range(160):
        start = np.array([rng.choice([179.999, -179.999, 0.0]) + rng.uniform(-0.004, 0.004), 60 + rng.uniform(-0.004, 0.004)])
        n = int(rng.integers(1, 4))
        line = [start] + [start + rng.uniform(-0.003, 0.003, 2) * k for k in range(1, n)]
        zones.append((f"p{pos % 4}", pos, [[(float(x) + 180) % 360 - 180, float(y)] for x, y in line], "s", ["I-70"], "unknown", 0, 1))
    frame = spark.createDataFrame(zones, "publisher_key string, pos long, vertices array<array<double>>, data_source_id string, road_names array<string>, direction string, start_us long, end_us long")
    empty = spark.createDataFrame([("p9", 999, [], "s", ["x"], "unknown", 0, 1)], frame.schema)
    frame = frame.union(empty)
    rows = matching.matches(matching.candidates(frame), frame).collect()
    got = {frozenset((r["left_pos"], r["right_pos"])) for r in rows}
    want = {frozenset((a[1], b[1])) for a, b in itertools.combinations(zones, 2) if a[0] != b[0] and geometry.min_distance(np.array(a[2]), np.array(b[2])) <= 150}
    assert got == want and len(rows) == len(got) > 20


def test_line_corroboration_counts_every_matched_pair(spark):
    sf = "/root/testdata/sf0.001"
    matched = [r for r in merge.join_spatial_match(spark, sf).collect() if r["matched"]]
    want = {t: sum(r["tier"] == t for r in matched) for t in ("TIER_1", "TIER_2")}
    assert {r["tier"]: r["pairs"] for r in merge.agg_line_corroboration(spark, sf).collect()} == {t: n for t, n in want.items() if n}
    assert {r["coverage_ppm"] is None for r in matched} == {False, True}  # lines, and pairs of points


def test_groups_hold_one_zone_of_a_publisher_and_keep_the_better_edge():
    edges = [(1, 2, "a", "b", False), (2, 3, "b", "a", False), (3, 4, "a", "c", False), (2, 4, "b", "c", False)]
    found = list(matching.greedy(edges))
    assert [x for x in found if x[0] == "dropped"] == [("dropped", 2, 3), ("dropped", 2, 4)]
    assert sorted(x[1:] for x in found if x[0] == "member") == [(1, 1), (2, 1), (3, 3), (4, 3)]
    assert ("dropped", 1, 2) in list(matching.greedy([(1, 2, "a", "b", True), *edges]))


def test_a_pair_judged_apart_binds_whole_groups():
    # 1-2 and 3-4 are groups; 2 and 4 were judged apart, so 1-3 must not join them
    edges = [(2, 4, "b", "d", True), (1, 2, "a", "b", False), (3, 4, "c", "d", False), (1, 3, "a", "c", False)]
    assert [x for x in matching.greedy(edges) if x[0] == "dropped"] == [("dropped", 1, 3)]


def test_short_geometries_are_judged_as_one_by_one():
    rng = np.random.default_rng(2)
    n = 400
    a, b = (rng.uniform(-0.004, 0.004, (n, 2, 2)) + [179.999, 50.0] for _ in range(2))
    for x in (a, b):  # many cross the antimeridian
        x[..., 0] = (x[..., 0] + 180) % 360 - 180
    points, others = rng.random(n) < 0.3, rng.random(n) < 0.3
    a[points, 1], b[others, 1] = a[points, 0], b[others, 0]
    metres, coverage = geometry.judge_short(a, b, points, others, 150.0)
    for k in range(n):
        x, y = (g[k, :1] if p[k] else g[k] for g, p in ((a, points), (b, others)))
        assert metres[k] == pytest.approx(geometry.min_distance(x, y), abs=1e-6)
        whole = metres[k] <= 150 and max(geometry.length(x), geometry.length(y)) >= geometry.POINT_METRES
        assert np.isnan(coverage[k]) if not whole else coverage[k] == pytest.approx(geometry.symmetric_coverage(x, y, 150.0))


def test_groups_of_a_whole_table_equal_one_pass_over_all_edges(spark):
    pairs = merge.adjudicated(spark, "/root/testdata/sf0.001").collect()
    apart = [(r["left_pos"], r["right_pos"]) for r in pairs if r["verdict"] == "DISTINCT"]
    order = sorted((r["tier"], r["metres"], r["left_publisher"], r["right_publisher"], r["left_pos"], r["right_pos"]) for r in pairs if r["accepted"])
    want = {x[1:] for x in matching.greedy([(a, b, "", "", True) for a, b in apart] + [(a, b, p, q, False) for _, _, p, q, a, b in order]) if x[0] == "member"}
    rows = merge.grp_constrained_components(spark, "/root/testdata/sf0.001").collect()
    lead = {r["pos"]: r["lead"] for r in rows}
    assert {(p, lead[p]) for p, _ in want} == want and all(p == q for p, q in lead.items() if (p, q) not in want)
    assert len(apart) > 50 and all(lead[a] != lead[b] for a, b in apart)


def test_components_reach_the_smallest_node(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100)]
    rows = matching.components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in rows} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_the_largest_fragment_keeps_a_claimed_id(spark):
    members = spark.createDataFrame([("g1", "a"), ("g1", "b"), ("g2", "c"), ("g3", "d"), ("g3", "e")], "group_key string, source_key string")
    held = spark.createDataFrame([("a", "X", 1), ("b", "Y", 0), ("c", "Y", 0)], "source_key string, canonical_id string, first_mapped_at int")
    rows = {r["group_key"]: r for r in matching.assign_identity(members, held, at=7).collect()}
    assert (rows["g1"]["canonical_id"], rows["g1"]["supersedes"], rows["g1"]["minted"]) == ("Y", ["X"], False)
    assert rows["g2"]["minted"] and rows["g2"]["supersedes"] == ["Y"] and rows["g2"]["first_mapped_at"] == 7
    assert rows["g3"]["minted"] and rows["g3"]["supersedes"] == []


SCHEMA = "publisher_key string, pos long, vertices array<array<double>>, data_source_id string, road_names array<string>, direction string, start_us long, end_us long"


def as_zones(spark, lines):
    return spark.createDataFrame([(f"p{k % 5}", k, [[(float(x) + 180) % 360 - 180, float(y)] for x, y in line], "s", ["I-70"], "unknown", 0, 1) for k, line in enumerate(lines)], SCHEMA)


def test_no_pair_is_missed_at_poles_antimeridian_and_where_bands_meet(spark):
    rng = np.random.default_rng(7)
    strip = 400 * 300 / 6371008.8 * 180 / np.pi  # degrees of latitude of a band
    places = [(0.0, 0.0), (179.9999, 30.0), (10.0, 88.99), (40.0, 89.95), (0.0, -89.9), *((20.0 * k, b * strip) for k, b in enumerate((-40, -3, 1, 20, 55, 80, 82)))]
    lines = []
    for lon, lat in places:
        wide = 0.003 / max(np.cos(np.radians(lat)), 0.005)
        for _ in range(24):
            start = np.array([lon + rng.uniform(-wide, wide), np.clip(lat + rng.uniform(-0.003, 0.003), -89.9999, 89.9999)])
            lines.append([start] + [np.array([start[0] + rng.uniform(-wide, wide), np.clip(start[1] + rng.uniform(-0.003, 0.003), -89.9999, 89.9999)]) for _ in range(int(rng.integers(0, 3)))])
    frame = as_zones(spark, lines)
    held = {r["pos"]: np.array(r["vertices"]) for r in frame.collect()}
    got = [tuple(sorted((r["l_pos"], r["r_pos"]))) for r in matching.candidates(frame).collect()]
    want = {(a, b) for a, b in itertools.combinations(held, 2) if a % 5 != b % 5 and geometry.min_distance(held[a], held[b]) <= 150}
    assert len(got) == len(set(got)) and want <= set(got) and len(want) > 300


def test_a_zone_at_the_pole_changes_no_other_cells(spark):
    grid = matching.Grid(150.0)
    few = as_zones(spark, [[(10.0, 45.0), (10.02, 45.01)], [(-100.0, 30.0)]])
    more = as_zones(spark, [[(10.0, 45.0), (10.02, 45.01)], [(-100.0, 30.0)], [(0.0, 89.9)]])
    of = lambda f: {r["pos"]: r["c"] for r in f.select("pos", grid.touched("vertices").alias("c")).collect()}
    assert of(few).items() <= of(more).items()


def test_keys_are_unique_and_places_on_the_globe_at_large_scale(spark, tmp_path):
    from feedsift.sources import adapters

    lines = [(60_000_000, 7, 2_000_000, 100_000), (60_000_000, 7, 2_000_000, 100_000), (60_000_000, 7, 1_999_999, 1), (600_000_000_000, 1, 20_000_000_000, 5), (13, 2, 300_000, 3), (1294, 4, 123, 0), (1294, 4, 123, 0)]
    rows = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    rows.selectExpr("*", "date'1995-01-01' AS l_shipdate", "5.0D AS l_quantity", "'N' AS l_returnflag", "'O' AS l_linestatus").write.parquet(str(tmp_path / "lineitem.parquet"))
    rows.selectExpr("l_partkey AS p_partkey", "'x' AS p_name").distinct().write.parquet(str(tmp_path / "part.parquet"))
    found = adapters.zones(spark, str(tmp_path)).collect()
    assert len({r["pos"] for r in found}) == len(found) == len(lines)
    assert all(r["lat"] is None or (-60 <= r["lat"] <= 60 and -180 <= r["lon"] < 180) for r in found)
    assert [r["part_key"] for r in sorted(found, key=lambda r: r["pos"]) if r["order_key"] == 60_000_000] == [1_999_999, 2_000_000, 2_000_000]


def as_pairs(spark, edges):
    """Pairs of (a, b, publisher of a, publisher of b, tier, metres, verdict)."""
    rows = [(a, b, p, q, tier, float(m), v != "DISTINCT", v) for a, b, p, q, tier, m, v in edges]
    return spark.createDataFrame(rows, "left_pos long, right_pos long, left_publisher string, right_publisher string, tier string, metres double, accepted boolean, verdict string")


@pytest.mark.parametrize("seed", [1, 2])
def test_large_components_are_decided_side_by_side_as_in_order(spark, seed):
    rng = np.random.default_rng(seed)
    edges = {}
    for _ in range(700):
        a, b = sorted(int(x) for x in rng.integers(0, 150, 2))
        if a % 7 != b % 7:
            edges[a, b] = (a, b, f"p{a % 7}", f"p{b % 7}", f"TIER_{rng.integers(1, 3)}", int(rng.integers(0, 20)), "DISTINCT" if rng.random() < 0.15 else "DUPLICATE")
    rows = sorted(edges.values(), key=lambda e: (e[6] != "DISTINCT", *((e[4], e[5], e[2], e[3], e[0], e[1]) if e[6] != "DISTINCT" else ())))
    want = set(matching.greedy((a, b, p, q, v == "DISTINCT") for a, b, p, q, _, _, v in rows))
    pairs = as_pairs(spark, edges.values())
    whole, few, all_rounds = (matching.groups(pairs, **how).collect() for how in ({}, {"most_edges": 10, "rounds": 2}, {"most_edges": 10}))
    for found in (whole, few, all_rounds):
        assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_a_long_chain_breaks_into_small_groups(spark):
    n = 3000
    order = np.random.default_rng(1).permutation(n)
    pairs = as_pairs(spark, [(k, k + 1, f"p{k % 3}", f"p{(k + 1) % 3}", "TIER_2", int(order[k]), "DUPLICATE") for k in range(n)])
    edges = pairs.selectExpr("left_pos AS a", "right_pos AS b", "left_publisher AS pa", "right_publisher AS pb", "tier", "metres", "NOT accepted AS refused")
    dropped, united, live = matching.settled(edges, 40)
    assert live.count() == 0 and dropped.count() + united.count() == n
    got = matching.components(united).groupBy("component").count().agg({"count": "max"}).first()[0]
    assert got <= 3
