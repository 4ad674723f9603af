"""Pairs found tile by tile against pairs joined and judged one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedsift.functions import geometry
from feedsift.functions.columns import normal_road
from feedsift.operators import matching, tiles
from feedsift.plans import merge

SCHEMA = "publisher_key string, pos long, vertices array<array<double>>, data_source_id string, road_names array<string>, direction string, start_us long, end_us long"
NAMES = ["Interstate 70", "I-70", " State Route 5 ", "US Hwy 20", "u s 20", "North Main Street", "Größe Straße", "sr 5", "İ 5", "", None]


@pytest.fixture(scope="module")
def zones(spark):
    rng, rows = np.random.default_rng(11), []
    for pos in range(200):
        n = int(rng.choice([1, 2, 2, 3, 40]))
        step = 0.06 if rng.random() < 0.1 else 0.003  # some are tall, and wide, as several tiles
        line = rng.choice([179.999, 0.0]) + rng.uniform(-0.004, 0.004), 60 + rng.uniform(-0.004, 0.004)
        line = [np.array(line) + (rng.uniform(-step, step, 2) if k else 0) for k in range(n)]
        some = [None, [], *([NAMES[k] for k in rng.integers(0, len(NAMES), m)] for m in (1, 2, 2, 20))]
        rows.append((f"p{pos % 4}" if pos % 50 else None, pos, [[(float(x) + 180) % 360 - 180, float(y)] for x, y in line], *(x[int(rng.integers(len(x)))] for x in ([None, "", "s", "t"], some, [None, "unknown", "northbound"], [None, 0, 5], [None, 1, 9]))))
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def test_pairs_by_tiles_are_those_joined_and_judged_one_by_one(spark, zones, monkeypatch):
    monkeypatch.setattr(tiles, "LOOKED", 64)
    want = [tuple(r) for r in matching.matches(matching.candidates(zones), zones).collect()]
    got = [tuple(r) for r in matching.within_reach(zones).collect()]
    key = lambda r: (r[1], r[3])
    assert len(want) > 300 and sorted(got, key=key) == sorted(want, key=key)
    assert {r[7] for r in got} == {"TIER_1", "TIER_2"} and {r[8] for r in got} == {r[9] for r in got} == {None, False, True}
    shares = matching.within_reach(zones, ("coverage", "left_share", "right_share")).collect()
    assert all(r["coverage"] == (None if r["left_share"] is None else min(r["left_share"], r["right_share"])) for r in shares)


def test_roads_are_made_alike_as_in_sql(spark):
    rows = spark.createDataFrame([(x,) for x in [*NAMES[:-1], "State Rte 5;SR\t5", "I 7", "COUNTY ROAD\n9 East"]], "name string").select("name", normal_road(F.col("name")).alias("road")).collect()
    assert [tiles.plain_road(r["name"]) for r in rows] == [r["road"] for r in rows]


def test_a_zone_goes_to_few_tiles_and_pairs_meet_no_table(spark):
    sf = "/root/testdata/sf0.001"
    plan = merge.agg_corroboration(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("RepartitionByExpression") == 1  # the parts' names, and the tiles
    xy = np.array([x for r in merge.kept(spark, sf).filter("size(vertices) > 0").collect() for x in (r["vertices"][0], r["vertices"][-1])])
    start = np.arange(0, len(xy), 2)
    assert len(tiles.Tiles(150.0).dealt(xy, start, np.full(len(start), 2))[0]) < 2 * len(start)


def test_dates_and_sides_are_asked_for_alone(zones):
    assert matching.within_reach(zones, ("left_pos", "tier")).columns == ["left_pos", "tier"]


def test_samples_of_level_lines_are_counted_as_one_by_one():
    rng = np.random.default_rng(2)
    lat = rng.choice([0.0, 40.0, 59.98, -85.0], 20_000)
    x, y = ((rng.uniform(-0.012, 0.012, (len(lat), 2)) / np.cos(np.radians(lat))[:, None]).round(4) for _ in range(2))
    y = np.where(rng.random((len(lat), 1)) < 0.1, y[:, :1], y)  # points, too
    x, y = (np.stack([e, np.repeat(north[:, None], 2, axis=1)], axis=2) for e, north in ((x, lat), (y, lat + rng.choice([0.0, 0.001, 0.0013489, 0.002], len(lat)))))
    run = geometry.EARTH_METRES * np.radians(np.abs(x[:, 1, 0] - x[:, 0, 0])) * np.cos(np.radians(lat))
    steps = np.ceil(run / geometry.STEP).astype(np.int64)
    want = geometry.each_sample(x, y, run, steps, 150.0) / (steps + 1)
    assert (geometry.within(x, y, 150.0) == want).all() and (want == 0).any() and (want == 1).any()
