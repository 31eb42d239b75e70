"""Rides that arrive one after the other: places, lineages, samples that follow, and the same with keyed state in a stream."""

import datetime
import json

import pytest
from pyspark.sql import functions as F
from ridgeline.operators import arrival
from ridgeline.sources import schema
from ridgeline.streaming import suppress

AT = datetime.datetime(2024, 5, 1, 8, tzinfo=datetime.UTC)
EMPTY = {f.name: None for f in schema.RIDE}


def ride(k, minutes, athlete=1, **more):
    base = {"id": k, "athlete_id": athlete, "date": AT + datetime.timedelta(minutes=minutes), "duration_s": 3600, "distance_m": 0.0, "elevation_m": 0.0, "name": f"r{k}"}
    return EMPTY | base | more


#: 1 is beaten by 2, 2 by 3 (a chain of three); 4 is weaker than 5's place; 6 starts too late; 7 is another athlete's; 8 has no start.
RIDES = [
    ride(1, 0, avg_hr=140), ride(2, 2, avg_hr=141, avg_cadence=80), ride(3, 4, avg_hr=150, avg_power=200),
    ride(5, 60, avg_power=210, avg_hr=120, distance_m=30000.0), ride(4, 61, avg_hr=99, calories=700), ride(6, 120), ride(7, 1, athlete=2), ride(8, 0) | {"date": None},
]


def table(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in schema.RIDE) for r in rows], schema.RIDE)


def test_chains_and_samples(spark):
    rides = table(spark, RIDES)
    moves = {(r["ride_id"], r["first_id"], r["final_id"]) for r in arrival.lineage(rides).collect()}
    assert moves == {(1, 1, 3), (2, 1, 3), (3, 1, 3), (5, 5, 5), (4, 5, 5)}
    kept = {r["id"]: r for r in arrival.deduplicated(rides).collect()}
    assert set(kept) == {3, 5, 6, 7, 8} and kept[3]["avg_hr"] == 150 and kept[5]["calories"] == 700
    samples = spark.createDataFrame([(k, t, 10 * k + t) for k in (1, 2, 3, 4, 5, 6, 9) for t in range(2)], "activity_id long, time_offset int, hr int")
    got = sorted(map(tuple, arrival.followed(samples, arrival.lineage(rides)).collect()))
    # the first ride's samples under the winner's id; weaker rides' samples go; others stay
    assert got == [(3, 0, 10), (3, 1, 11), (5, 0, 50), (5, 1, 51), (6, 0, 60), (6, 1, 61), (9, 0, 90), (9, 1, 91)]


def test_a_task_holds_what_is_in_reach_only():
    """A thousand rides, each within the tolerance of the next: two places are open at most."""
    state, most = arrival.Arrival(300 * 1_000_000), 0
    for k in range(1000):
        at = k * 200 * 1_000_000
        state.out_of_reach(at)
        state.arrive({"id": k, "_at": at, "duration_s": 100 + 1000 * (k % 7), "distance_m": 0.0} | {c: None for c in (*arrival.FILLED[:2], *arrival.KEPT, "elevation_m")})
        most = max(most, len(state.open))
    assert most <= 2


def test_odd_values_match_nothing():
    a = {"_at": 0, "duration_s": None, "distance_m": None}
    assert not arrival.similar(a, a | {"duration_s": 100}, 10) and not arrival.similar(a | {"_at": None}, a | {"duration_s": 100}, 10)
    assert not arrival.similar(a | {"duration_s": 100}, a | {"duration_s": 0}, 10)
    assert arrival.similar(a | {"duration_s": 100}, a | {"duration_s": 100}, 10)


@pytest.fixture
def state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, suppress.STORE)
    yield
    spark.conf.set(key, before)


def test_stream_is_the_fold(spark, tmp_path, state_store):
    """Three files, a micro-batch each: the last row of every place is what the fold over all rides gives."""
    rows = [r for r in RIDES if r["date"]] + [ride(100 + k, 24 * 60 + 2 * k, athlete=3, avg_hr=100 + k % 5, duration_s=3600 + 400 * (k % 3)) for k in range(12)]
    rows.sort(key=lambda r: (r["date"], r["id"]))
    (tmp_path / "in").mkdir()
    for k in range(3):
        part = rows[k * 7 : k * 7 + 7] if k < 2 else rows[14:]
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps(r | {"date": r["date"].isoformat()}) + "\n" for r in part))
    stream = spark.readStream.schema(schema.RIDE).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    seen = []

    def keep(df, batch):
        seen.extend((batch, r) for r in df.collect())

    query = suppress.suppressed(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    places, gone = {}, set()
    for _, r in seen:
        places[r["athlete_id"], r["first_id"]] = r["id"]
        gone.add(r["gone_id"])
    want = arrival.deduplicated(table(spark, rows)).select("id").collect()
    assert sorted(places.values()) == sorted(r["id"] for r in want)
    assert gone - {None} == {r["id"] for r in rows} - set(places.values())
    assert len({b for b, _ in seen}) == 3


def test_late_rides_are_counted(spark, tmp_path, state_store):
    """Rides behind the watermark are dropped, and the counts say how many; those within the allowed lateness are kept."""
    (tmp_path / "in").mkdir()
    files = [[ride(1, 0), ride(2, 600)], [ride(3, 630), ride(9, 640)], [ride(4, 10), ride(5, 20), ride(6, 610), ride(7, 700)]]
    for k, rows in enumerate(files):
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps(r | {"date": r["date"].isoformat()}) + "\n" for r in rows))
    stream = spark.readStream.schema(schema.RIDE).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(tmp_path / "in"))
    seen = []
    query = suppress.suppressed(stream, late="1 hour").writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(r["id"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    counts = suppress.arrival_counts(query)
    assert counts == {"landed": 8, "kept": 6, "dropped": 2} and sorted(seen) == [1, 2, 3, 6, 7, 9]
    assert sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators) == 2
