"""Classification, recordings, duplicates and merges on small examples."""

import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from ridgeline.operators import arrival, ingest
from ridgeline.plans.rides import rides
from ridgeline.sources import schema

DATA = "/root/testdata/sf0.001"
AT = datetime.datetime(2024, 5, 1, 8)


def ride(spark, **values):
    row = {f.name: None for f in schema.RIDE.fields} | {"id": 1, "athlete_id": 1, "date": AT, "duration_s": 3600, "distance_m": 0.0, "trainer": False} | values
    return spark.createDataFrame([Row(**row)], schema.RIDE)


@pytest.mark.parametrize(
    ("values", "want"),
    [
        ({"service_type": "VirtualRide"}, ("zwift", True)),
        ({"device": "zwift", "service_type": "EBikeRide"}, ("zwift", True)),
        ({"trainer": True, "device": "karoo", "service_type": "Ride", "distance_m": 9.0}, ("cycling_indoor", True)),
        ({"service_type": "EBikeRide"}, ("ebike", False)),
        ({"service_type": "Ride", "distance_m": 1.0}, ("cycling_outdoor", False)),
        ({"service_type": None}, ("cycling_indoor", True)),
    ],
)
def test_classes(spark, values, want):
    r = ingest.classified(ride(spark, **{"device": "unknown"} | values)).first()
    assert (r["sport_type"], r["is_indoor"]) == want


@pytest.mark.parametrize(
    ("name", "device", "trainer", "want"),
    [("x", "Head Karoo 2", False, "karoo"), ("x", "Apple thing", False, "watch"), ("x", "Smartwatch", True, "watch"), ("Zwift - loop", None, False, "zwift"), ("x", None, True, "zwift"), ("x", None, None, "unknown"), (None, None, None, "unknown")],
)
def test_devices(spark, name, device, trainer, want):
    df = spark.createDataFrame([(name, device, trainer)], "name string, device string, trainer boolean")
    assert df.select(ingest.device(F.col("device"), F.col("name"), F.col("trainer")).alias("d")).first()["d"] == want


def test_uneven_recordings(spark):
    full = Row(id=1, time=[0, 1, 2], heartrate=[100], watts=None, cadence=[], velocity_smooth=[10.0, None, 1.0], altitude=[1.0, 2.0, 3.0], latlng=[[38.0, -9.0], None, []])
    none = Row(id=2, time=None, heartrate=[1], watts=None, cadence=None, velocity_smooth=None, altitude=None, latlng=None)
    got = ingest.points(spark.createDataFrame([full, none], schema.RAW_STREAMS)).orderBy("time_offset").collect()
    assert [(r["hr"], r["power"], r["cadence"], r["speed_kmh"], r["lat"], r["lng"]) for r in got] == [(100, None, None, 36.0, 38.0, -9.0), (None, None, None, None, None, None), (None, None, None, 3.6, None, None)]


@pytest.mark.parametrize(("old", "new", "km", "match"), [(6978, 7704, (0.0, 0.0), True), (3600, 5400, (0.0, 0.0), False), (1000, 1250, (0.0, 0.0), True), (9000, 1000, (30000.0, 33000.0), False), (9000, 1000, (30000.0, 32900.0), True)])
def test_duplicates(spark, old, new, km, match):
    a = ride(spark, id=1, duration_s=old, distance_m=km[0])
    b = ride(spark, id=2, duration_s=new, distance_m=km[1], date=AT + datetime.timedelta(seconds=299))
    assert ingest.duplicate_pairs(a, b).count() == match
    late = b.withColumn("date", F.lit(AT + datetime.timedelta(seconds=300)))
    assert ingest.duplicate_pairs(a, late).count() == 0


def test_merge_fills_what_the_winner_lacks(spark):
    old, new = ride(spark, id=1, avg_hr=140, distance_m=900.0), ride(spark, id=2, avg_power=200, calories=500)
    both = old.unionByName(new)
    r = ingest.merged_pairs(ingest.duplicate_pairs(old, new), both).first()
    assert (r["id"], r["new_wins"], r["avg_hr"], r["avg_power"], r["distance_m"], r["calories"]) == (2, True, 140, 200, 900.0, 500)
    r = ingest.merged_pairs(ingest.duplicate_pairs(new, old), both).first()
    assert (r["id"], r["new_wins"], r["avg_hr"], r["avg_power"], r["calories"]) == (1, True, 140, 200, None)


def fold(rows, tolerance):
    """The arrival of rides one after the other."""
    kept = []
    rich = lambda r, names: sum(w for n, w in names if r[n] and r[n] > 0)
    few = (("avg_power", 3), ("avg_hr", 2), ("distance_m", 1))
    for n in sorted(rows, key=lambda r: (r["date"], r["id"])):
        for k, e in enumerate(kept):
            close = abs((e["date"] - n["date"]).total_seconds()) < tolerance
            same = abs(e["duration_s"] - n["duration_s"]) < max(300, e["duration_s"] * 0.15) or (e["distance_m"] > 0 and n["distance_m"] > 0 and abs(e["distance_m"] - n["distance_m"]) < e["distance_m"] * 0.1)
            if close and same:
                if rich(n, (*few, ("avg_cadence", 1), ("calories", 1), ("elevation_m", 1))) >= rich(e, few):
                    kept[k] = n | {c: n[c] or e[c] or n[c] for c in ("avg_hr", "avg_power", "distance_m")}
                else:
                    kept[k] = e | {c: e[c] if e[c] is not None else n[c] for c in ("suffer_score", "calories", "avg_hr", "avg_power", "max_hr", "max_power", "avg_cadence")}
                break
        else:
            kept.append(n)
    return kept


def test_arrival_by_brute_force(spark):
    r = rides(spark, DATA).withColumn("athlete_id", F.col("athlete_id") % 4)
    got = sorted((x.asDict() for x in arrival.deduplicated(r, 40_000).collect()), key=lambda x: x["id"])
    by = {}
    for x in r.collect():
        by.setdefault(x["athlete_id"], []).append(x.asDict())
    want = sorted((x for rows in by.values() for x in fold(rows, 40_000)), key=lambda x: x["id"])
    assert got == want and len(got) < r.count()


def test_upsert_keeps_dates(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, date string, v int")
    new = spark.createDataFrame([(2, "z", None), (3, "c", 3)], "id long, date string, v int")
    assert sorted(map(tuple, ingest.upserted(old, new).collect())) == [(1, "a", 1), (2, "b", None), (3, "c", 3)]
