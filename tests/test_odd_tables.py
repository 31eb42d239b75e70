"""Queries against their SQL on small tables made for one oddity each."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from ridgeline.plans import catalog

from .test_queries import rows


def compared(spark, folder, name, **tables):
    """Rows of the query and of its SQL over the tables, which are written to the folder."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got, want = catalog.QUERIES[name](spark, str(folder)), con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    return rows(got.columns, got.collect()), rows(names, want.fetchall())


#: 9901 * 101 + 2 is 1000003: the first two line items of each order have one element id, and different tags.
CLASHING = {"l_orderkey": [k for k in range(40) for _ in range(3)], "l_linenumber": pa.array([1, 2, 4] * 40, pa.int32()), "l_partkey": [p for k in range(40) for p in (9901 + 7 * k, 7 * k, k)], "l_suppkey": [s for k in range(40) for s in (k + 2, k, k)]}


@pytest.mark.parametrize("name", ["d10_surface", "d11_scenic", "d13_safety", "d15_trails"])
def test_elements_of_one_id_with_different_tags(spark, tmp_path, name):
    got, want = compared(spark, tmp_path, name, lineitem=CLASHING)
    assert got == want and len(want) == 4


def test_elements_meet_each_place_once(spark):
    """Routes that stop at the same places share their distances: what meets grows with the places, not with routes."""
    from ridgeline.operators import routes

    points = spark.createDataFrame([(r, k, k * 0.01, 0.0) for r in range(200) for k in range(12)], "route_id long, seq int, lat double, lng double")
    rows = [(e, "way", [(e % 12 * 0.01, 0.0), (e % 12 * 0.01, 0.0001)], "path", None, None, None, "hiking") for e in range(600)]
    elements = spark.createDataFrame(rows, "element_id long, kind string, line array<struct<lat:double,lng:double>>, highway string, `natural` string, landuse string, leisure string, route string")
    covered, members = routes.grouped_along(points, elements)
    assert covered.count() == 2 * 200 * 12 and members.count() == 2 * 600 and members.select("search", "group").distinct().count() == 2 * 12
    assert routes.along(points, elements).count() == 2 * 200 * 600


def test_requests_that_ask_the_same_are_answered_once(spark, monkeypatch):
    """What is scored grows neither with equal requests nor with candidates of one place and kind."""
    from ridgeline.operators import waypoints

    scored, spread = [], waypoints.spread_out
    monkeypatch.setattr(waypoints, "spread_out", lambda found, *more: scored.append(found.count()) or spread(found, *more))
    requests = spark.createDataFrame([(r, 1, 38.7, -9.14, 60.0, True) for r in range(40)], "request long, athlete_id long, lat double, lng double, km double, explore boolean")
    places = spark.createDataFrame([(p, 38.75, -9.1, f"p{p}", {"natural": "peak"}) for p in range(30)], "id long, lat double, lng double, name string, tags map<string,string>")
    segments = spark.createDataFrame([(s, 38.7, -9.2, f"s{s}", 100 + s) for s in range(30)], "id long, lat double, lng double, name string, athlete_count long")
    highlights = spark.createDataFrame([(h, 38.65, -9.14, f"h{h}", "beach") for h in range(30)], "id long, lat double, lng double, name string, category string")
    ridden = spark.createDataFrame([], "athlete_id long, cell_lat long, cell_lng long, n long")
    got = waypoints.for_requests(requests, places, segments, highlights, ridden, spark.createDataFrame([], "lat double, lng double, radius double")).collect()
    assert scored == [1 + 10 + 1]
    assert sorted((r["request"], r["origin"], r["id"]) for r in got) == [(r, o, i) for r in range(40) for o, i in ((1, 0), (2, 29), (3, 0))]


def test_merged_duplicates_join_once(spark):
    """Pairs are not dealt out again for the measures of their rides."""
    from ridgeline.operators import ingest
    from ridgeline.plans import rides

    from .test_queries import DATA

    assert rides.h9_merge(spark, DATA)._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    r = rides.rides(spark, DATA)
    assert sorted(ingest.merged_duplicates(r, r, 7200).collect()) == sorted(ingest.merged_pairs(ingest.duplicate_pairs(r, r, 7200), r).collect())


def test_plans_are_not_dealt_out_by_request(spark):
    """Requests meet the answers to what they ask, each once, and their athletes' values, by broadcasts: no shuffle grows with the requests' texts."""
    from ridgeline.plans import journeys

    from .test_queries import DATA

    plan = journeys.l_plan_waypoints(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(id#" not in plan and "hashpartitioning(athlete_id#" not in plan


def test_scenery_without_a_route(spark, tmp_path):
    """Elements whose route is null have a row of their own, as in the SQL; elements are counted once."""
    orders = [None if k % 3 == 0 else k for k in CLASHING["l_orderkey"]]
    got, want = compared(spark, tmp_path, "d11_scenic", lineitem={**CLASHING, "l_orderkey": pa.array(orders, pa.int64())})
    assert got == want and len(want) == 5
    from ridgeline.plans import places

    assert "Join" not in places.d11_scenic(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


#: A line number comes twice in each order; three parts further and 303 suppliers back, its element has the same id and other tags.
LINE_TWICE = {"l_orderkey": [k for k in range(40) for _ in range(2)], "l_linenumber": pa.array([1, 1] * 40, pa.int32()), "l_partkey": [p for k in range(40) for p in (4 * (k // 10) + 1, 4 * (k // 10) + 4)], "l_suppkey": [s for k in range(40) for s in (303 + k, k)]}
NO_ORDER = {**LINE_TWICE, "l_orderkey": pa.array([None if k % 3 == 0 else k for k in LINE_TWICE["l_orderkey"]], pa.int64())}


@pytest.mark.parametrize("name", ["d13_safety", "d15_trails"])
@pytest.mark.parametrize("lineitem, routes", [(LINE_TWICE, 4), (NO_ORDER, 5)], ids=["line_twice", "no_order"])
def test_line_items_of_one_line_number(spark, tmp_path, name, lineitem, routes):
    got, want = compared(spark, tmp_path, name, lineitem=lineitem)
    assert got == want and len(want) == routes


def test_trails_do_not_deal_out_elements(spark, tmp_path):
    """Labels are made distinct as they are: neither ids nor other tags are read or compared for them."""
    from ridgeline.plans import places

    pq.write_table(pa.table(LINE_TWICE), f"{tmp_path}/lineitem.parquet")
    plan = places.d15_trails(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and "element_id" not in plan and "highway" not in plan


#: A ride of one athlete at 30.6 km/h: 17 km are reached with its 2,000th second; doubles added one by one fall short of them.
STEADY = {"event_id": list(range(2100)), "ts": pa.array([1_704_067_200_000_000 + k * 1_000_000 for k in range(2100)], pa.timestamp("us")), "user_id": [1] * 2100, "event_type": ["purchase"] * 2100, "value": [15.65] * 2100, "props": ['{"k": 10}'] * 2100}


def test_zones_of_kilometres_that_are_reached_exactly(spark, tmp_path):
    got, want = compared(spark, tmp_path, "k6_zones", events=STEADY)
    assert got == want
    seconds = [sum(k * 306 // 36000 == km for k in range(1, 2101)) for km in range(18)]
    assert sorted(r["seconds"] for r in catalog.QUERIES["k6_zones"](spark, str(tmp_path)).where("measure = 'power'").collect()) == sorted(seconds)


def test_splits_of_kilometres_that_are_reached_exactly(spark, tmp_path):
    """The last second of a kilometre counts for the next one: 117 or 118 seconds each, and their ranks follow."""
    got, want = compared(spark, tmp_path, "k8_splits", events=STEADY)
    assert got == want
    found = {r["km"]: (r["seconds"], r["slowest"]) for r in catalog.QUERIES["k8_splits"](spark, str(tmp_path)).collect()}
    seconds = {km: sum(k * 306 // 36000 == km for k in range(1, 2101)) for km in range(18)}
    assert found == {km: (n, 1 + sum(m > n for m in seconds.values())) for km, n in seconds.items()}


def test_every_place_of_every_route_is_looked_around(spark):
    """A route of 3 points, and one of 200 that has its only elements near the last: all of them are found by each search."""
    from ridgeline.operators import routes

    points = spark.createDataFrame([(1, k, k * 0.01, 0.0) for k in range(3)] + [(2, k, min(k, 199) * 0.01, 1.0) for k in range(200)], "route_id long, seq int, lat double, lng double")
    rows = [(e, kind, [(k * 0.01, at), (k * 0.01, at + 0.0001)], "path", "wood", None, None, "bicycle") for e, (kind, k, at) in enumerate([("way", 2, 0.0), ("relation", 1, 0.0), ("way", 199, 1.0), ("relation", 199, 1.0), ("way", 131, 1.0), ("way", 205, 1.0)])]
    elements = spark.createDataFrame(rows, "element_id long, kind string, line array<struct<lat:double,lng:double>>, highway string, `natural` string, landuse string, leisure string, route string")
    found = sorted((r["search"], r["route_id"], r["element_id"]) for r in routes.along(points, elements).collect())
    ways = [(1, 0), (2, 2), (2, 4)]
    assert found == sorted([(s, *w) for s in ("surface", "safety", "scenery") for w in ways] + [("trails", 1, 1), ("trails", 2, 3)])


#: Events of a user, of none, and of one with few of them.
RIDDEN = {"event_id": list(range(124)), "ts": pa.array([1_704_067_200_000_000 + k * 1_000_000 for k in range(124)], pa.timestamp("us")), "user_id": [1] * 90 + [None] * 27 + [2] * 7, "event_type": ["purchase", "click", "view"] * 41 + ["view"], "value": [15.65] * 124, "props": ['{"k": 10}'] * 124}


def test_elements_along_whole_routes(spark, tmp_path):
    """Also where ids of line items clash."""
    items = {**CLASHING, "l_orderkey": [k for k in range(12000) for _ in range(3)], "l_linenumber": pa.array([1, 2, 4] * 12000, pa.int32()), "l_partkey": [p for k in range(12000) for p in (9901 + 7 * k, 7 * k, k)], "l_suppkey": [s for k in range(12000) for s in (k + 2, k, k)]}
    got, want = compared(spark, tmp_path, "g2_along_route", events=RIDDEN, lineitem=items)
    assert got == want and len(want) > 400 and {r[2] for r in want} == {1, 2, None}
