"""Rows that meet by place, waypoints for many requests, elements along routes."""

import itertools
import random

import pytest
from pyspark.sql import functions as F
from ridgeline.operators import nearby, waypoints
from ridgeline.plans import journeys

DATA = "/root/testdata/sf0.001"


def scattered(rng, n):
    """Half of the places lie in one cell."""
    return [(k, rng.uniform(0, 0.2) if k % 2 else rng.uniform(-2, 2), rng.uniform(10, 10.2) if k % 2 else rng.uniform(8, 12)) for k in range(n)]


@pytest.mark.parametrize("crowded", [3, 10_000])
def test_met_finds_all_pairs_once(spark, crowded):
    rng = random.Random(2)
    a, b = scattered(rng, 60), [(1000 + k, x, y) for k, x, y in scattered(rng, 80)] + [(5000, None, 1.0)]
    left = spark.createDataFrame(a, "a long, a_lat double, a_lng double")
    right = spark.createDataFrame(b, "b long, b_lat double, b_lng double")
    around = nearby.cells((F.col("a_lat"), F.lit(0.3)), (F.col("a_lng"), F.lit(0.3)), 0.25)
    got = nearby.met(left, around, right, nearby.cell(F.col("b_lat"), F.col("b_lng"), 0.25), ["a"], ["b"], crowded)
    near = got.where((F.abs(F.col("a_lat") - F.col("b_lat")) <= 0.3) & (F.abs(F.col("a_lng") - F.col("b_lng")) <= 0.3))
    want = sorted((p[0], q[0]) for p, q in itertools.product(a, b[:-1]) if abs(p[1] - q[1]) <= 0.3 and abs(p[2] - q[2]) <= 0.3)
    assert sorted((r["a"], r["b"]) for r in near.collect()) == want and len(want) > 1000


def test_reach_in_degrees_covers_the_distance(spark):
    """At high latitudes a reach is wide; what lies within it lies in the box."""
    from ridgeline.functions import geo

    rows = spark.createDataFrame([(lat, d) for lat in (0.0, 45.0, -60.0, 80.0) for d in (1.0, 30.0, 90.0)], "lat double, km double")
    high, wide = nearby.widened(F.col("lat"), F.col("km"))
    at = rows.select("km", geo.distance_km(F.col("lat"), F.lit(0.0), F.col("lat"), wide).alias("east"), geo.distance_km(F.col("lat"), F.lit(0.0), F.col("lat") + high, F.lit(0.0)).alias("north"))
    assert all(r["east"] >= r["km"] and r["north"] >= r["km"] for r in at.collect())


def test_spread_out_by_group(spark):
    """Each group on its own, like a plain greedy choice; a group with close candidates gets fewer."""
    import math

    rng = random.Random(5)
    found = [(g, 1 + k % 3, k, 0.0, 0.0, f"n{k}", "r", round(rng.random(), 3), rng.uniform(-math.pi, math.pi) if g else 0.1 * k) for g in range(4) for k in range(9)]
    df = spark.createDataFrame(found, "g long, origin int, id long, lat double, lng double, name string, reason string, score double, angle double")
    got = {}
    for r in waypoints.spread_out(df, 3, "g").orderBy("g", "place").collect():
        got.setdefault(r["g"], []).append(r["id"])
    for g in range(4):
        chosen = []
        for c in sorted((x for x in found if x[0] == g), key=lambda x: (-x[7], x[1], x[2])):
            if len(chosen) < 3 and all(abs((c[8] - d[8] + math.pi) % (2 * math.pi) - math.pi) >= math.radians(45) for d in chosen):
                chosen.append(c)
        assert got[g] == [c[2] for c in sorted(chosen, key=lambda x: x[8])]


def test_waypoints_plan_reads_candidates_once(spark):
    """What follows the written candidates reads them once a round, without cross joins; the names of the chosen ones come from three tables."""
    plan = journeys.f7_request_waypoints(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("ExistingRDD") <= 3 and plan.count("Relation") == 3 and "Join Cross" not in plan


@pytest.mark.parametrize("each", [7, 500])
def test_lists_hold_all_pairs_once(spark, each):
    """A key that most rows share, rows that are alike, a null; no list gets long."""
    a = spark.createDataFrame([(k % 20 and 1, k) for k in range(300)] + [(9, 9)], "key long, a long")
    b = spark.createDataFrame([(k % 10 and 1, k // 2, None if k % 3 else "x") for k in range(200)] + [(8, 8, "y")], "key long, b long, c string")
    lists = nearby.lists_met(a, b, ["key"], ["a"], ["b", "c"], each)
    got = lists.select("key", F.inline("a"), "b").select("key", "a", F.inline("b"))
    order = ["key", "a", "b", F.col("c").asc_nulls_first()]
    assert got.orderBy(*order).collect() == a.join(b, "key").select("key", "a", "b", "c").orderBy(*order).collect()
    longest = lists.select(F.max(F.greatest(F.size("a"), F.size("b")))).first()[0]
    assert lists.count() > 500 and longest <= 8 * each if each == 7 else lists.count() == 2


def test_distances_along_routes_are_short(spark, monkeypatch):
    """The condition of the join with the elements repeats little: Java does not compile methods beyond 8,000 bytes."""
    from ridgeline.operators import routes
    from ridgeline.sources import driver_tables as tables

    seen = []
    monkeypatch.setattr(routes, "settled", lambda df, *keys: seen.append(df) or df)
    routes.grouped_along(tables.route_points(spark, DATA), tables.map_elements(spark, DATA), every=True)
    joins = [line for line in seen[-1]._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line and "SQRT" in line]
    assert len(joins) == 1 and "COS" not in joins[0] and joins[0].count("*") < 80


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_elements_along_routes_by_brute_force(spark, monkeypatch, few):
    """Long lines, high latitudes; places that are broadcast and places that are not."""
    import math

    from ridgeline.operators import routes

    monkeypatch.setattr(routes, "BROADCAST_CELLS", few)
    rng = random.Random(11)
    points = [(r, k, lat + rng.uniform(-0.01, 0.01), rng.uniform(-0.02, 0.02)) for r, lat in enumerate((0.0, 45.0, -70.0)) for k in range(12)]
    around = lambda p, d: (p[2] + rng.uniform(-d, d), p[3] + rng.uniform(-3 * d, 3 * d))
    lines = [(e, [around(rng.choice(points), 0.004) for _ in range(rng.choice((1, 2, 3)))]) if e % 3 else (e, [around(rng.choice(points), 0.03), around(rng.choice(points), 0.03)]) for e in range(300)]
    lines = [(e, line) for e, line in lines if max(abs(p[0] - line[0][0]) for p in line) < 1]
    elements = spark.createDataFrame([(e, "way", line, "path", "wood", None, None, None) for e, line in lines], "element_id long, kind string, line array<struct<lat:double,lng:double>>, highway string, `natural` string, landuse string, leisure string, route string")
    got = routes.along(spark.createDataFrame(points, "route_id long, seq int, lat double, lng double"), elements)

    def away(p, a, b):
        shrink = 111.0 * math.cos(math.radians(p[2]))
        y, x, dy, dx = (p[2] - a[0]) * 111.0, (p[3] - a[1]) * shrink, (b[0] - a[0]) * 111.0, (b[1] - a[1]) * shrink
        t = min(1.0, max(0.0, (x * dx + y * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return math.hypot(x - t * dx, y - t * dy)

    near = lambda p, line, km: any(away(p, a, b) <= km for a, b in zip(line, line[1:] or line, strict=False))
    want = {(s, p[0], e) for p in points for e, line in lines for s, km in (("surface", 0.03), ("safety", 0.03), ("scenery", 0.2)) if near(p, line, km)}
    found = [(r["search"], r["route_id"], r["element_id"]) for r in got.collect()]
    assert sorted(found) == sorted(want) and len(want) > 50


def test_few_far_elements_are_measured(spark, monkeypatch):
    """A place is compared with the elements of its own surroundings, and elements are not repeated by cell."""
    from ridgeline.operators import routes

    compared, met = [], nearby.met
    monkeypatch.setattr(nearby, "met", lambda *a, **k: compared.append(met(*a, **k)) or compared[-1])
    points = spark.createDataFrame([(1, k, 38.705, -9.145) for k in range(12)], "route_id long, seq int, lat double, lng double")
    rows = [(i * 100 + j, "way", [(38.69 + i * 0.0003, -9.16 + j * 0.0003)], "path", None, None, None, None) for i in range(100) for j in range(100)]
    elements = spark.createDataFrame(rows, "element_id long, kind string, line array<struct<lat:double,lng:double>>, highway string, `natural` string, landuse string, leisure string, route string")
    assert routes.along(points, elements).count() > 0
    assert compared[0].count() < 1_500  # of 10,000 elements; two searches
