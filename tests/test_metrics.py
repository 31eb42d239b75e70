"""Published values of the training metrics, and loops that say the same as windows."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F
from ridgeline.functions import training as tr
from ridgeline.operators import fitness, metrics


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def power_rows(spark, watts):
    rows = [(1, k, w) for k, w in enumerate(watts)]
    return spark.createDataFrame(rows, "activity_id long, time_offset int, power int")


def loop_np(watts):
    total = sum((sum(watts[max(0, k - 29) : k + 1]) / 30) ** 4 for k in range(len(watts)))
    return round((total / len(watts)) ** 0.25, 1)


@pytest.mark.parametrize("watts", [[200] * 3600, [0, 300] * 300, [200] * 60 + [0] * 60, [random.Random(4).randrange(400) for _ in range(500)]])
def test_normalised_power(spark, watts):
    r = metrics.power_metrics(power_rows(spark, watts)).first()
    assert r["np"] == pytest.approx(loop_np(watts), abs=0.051)
    assert r["work_kj"] == pytest.approx(sum(watts) / 1000, abs=0.051)


def test_short_and_powerless_rides(spark):
    assert metrics.power_metrics(power_rows(spark, [200] * 30)).count() == 0
    r = metrics.power_metrics(power_rows(spark, [0] * 120)).first()
    assert r["np"] is None and r["work_kj"] is None


def test_stress_and_ratios(spark):
    lit = F.lit
    assert value(spark, tr.heart_rate_stress(lit(3600), lit(200), lit(250))) == pytest.approx(64.0)
    assert value(spark, tr.heart_rate_stress(lit(3600), lit(0), lit(250))) == 0
    assert value(spark, tr.power_stress(lit(3600), lit(200.0), lit(200))) == pytest.approx(100.0)
    assert value(spark, tr.power_stress(lit(3600), lit(200.0), lit(0))) == 0
    assert value(spark, tr.ratio(lit(220.0), lit(150))) == 1.47
    assert value(spark, tr.ratio(lit(118.0), lit(250))) == 0.47
    assert value(spark, tr.ratio(lit(118.0), lit(109))) == 1.08
    assert value(spark, tr.ratio(lit(118.0), lit(0))) is None
    assert value(spark, tr.ratio(lit(None).cast("double"), lit(100))) is None


@pytest.mark.parametrize(("hr", "top", "rest", "want"), [([144] * 60, 175, 50, None), ([200] * 60, 175, 50, 0.64 * math.exp(1.92)), ([40, 45, 50] * 20, 175, 50, 0.0), ([140] * 60, 50, 50, 0.0)])
def test_heart_rate_load(spark, hr, top, rest, want):
    rows = spark.createDataFrame([(1, k, h) for k, h in enumerate(hr)], "activity_id long, time_offset int, hr int")
    reserve = (144 - 50) / 125
    want = 0.64 * reserve * math.exp(1.92 * reserve) if want is None else want
    assert metrics.heart_rate_loads(rows, F.lit(top), F.lit(rest)).first()["trimp"] == pytest.approx(want, abs=0.051)


def test_fitness_by_blocks_is_the_loop(spark):
    rng, start = random.Random(7), datetime.date(2015, 1, 1)
    tss = {k: rng.choice([0.0, 80.0, 70.5, 130.2]) for k in range(0, 900, 3)}
    rides = spark.createDataFrame([(1, datetime.datetime(2015, 1, 1, 8) + datetime.timedelta(days=k), t, 1000.0, None) for k, t in tss.items()], "athlete_id long, date timestamp, tss double, distance_m double, elevation_m double")
    got = {r["date"]: r for r in fitness.fitness(fitness.daily(rides), F.lit("2017-08-01").cast("date")).collect()}
    ctl = atl = 0.0
    for k in range((datetime.date(2017, 8, 1) - start).days + 1):
        ctl, atl = ctl * (1 - 1 / 42) + tss.get(k, 0) / 42, atl * (1 - 1 / 7) + tss.get(k, 0) / 7
        r = got[start + datetime.timedelta(days=k)]
        assert (r["ctl"], r["atl"], r["tsb"]) == pytest.approx((ctl, atl, ctl - atl), abs=0.0051)
        assert r["weekly_distance_m"] == 1000.0 * sum(1 for j in range(k - 6, k + 1) if j in tss) and r["weekly_elevation_m"] == 0
    assert len(got) == k + 1


def test_thresholds_without_data(spark):
    rides = spark.createDataFrame([(1, 9, None, None, None)], "id long, athlete_id long, date timestamp, max_hr int, avg_power int")
    none = spark.createDataFrame([], "activity_id long, time_offset int, power int")
    assert metrics.threshold_hr(rides).first()["threshold_hr"] == 170
    assert metrics.threshold_power(rides, none, F.lit("2024-01-01").cast("date")).first()["ftp"] == 150


def test_threshold_of_a_ride_looks_back_a_day_at_least(spark):
    day = lambda d, h: datetime.datetime(2024, 1, d, h)
    rides = spark.createDataFrame([(1, 1, day(1, 8)), (2, 1, day(2, 4)), (3, 1, day(5, 8)), (4, 2, day(5, 9))], "id long, athlete_id long, date timestamp")
    samples = spark.createDataFrame([(1, k, 200) for k in range(1250)], "activity_id long, time_offset int, power int")
    fallback = spark.createDataFrame([(1, 150), (2, 140)], "athlete_id long, ftp int")
    got = {r["id"]: r["ride_ftp"] for r in metrics.ride_threshold_power(rides, samples, fallback).collect()}
    assert got == {1: 150, 2: 150, 3: 190, 4: 140}
