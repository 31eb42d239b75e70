"""Geometry, weather, typed texts and files on small examples."""

import datetime
import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from ridgeline.functions import geo, parse, weather
from ridgeline.operators import planning, routes, waypoints
from ridgeline.plans import places
from ridgeline.sources import config, landed


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("day", "want"), [((10, 22, 65), 35), ((20, 10, 0), 100)])
def test_day_score(spark, day, want):
    temp, wind, code = day
    rain = 15 if code == 65 else 0
    assert value(spark, weather.day_score(F.lit(rain), F.lit(wind), F.lit(22 if code == 65 else temp), F.lit(code), F.lit(0))) == (want if code == 0 else 100 - 50 - 10 - 15)


def encode(points):
    out, last = "", (0, 0)
    for p in points:
        now = tuple(round(c * 1e6) for c in p)
        for d in (now[0] - last[0], now[1] - last[1]):
            v = ~(d << 1) if d < 0 else d << 1
            while v >= 0x20:
                out += chr((0x20 | v & 0x1F) + 63)
                v >>= 5
            out += chr(v + 63)
        last = now
    return out


@pytest.mark.parametrize("points", [[], [(0.0, 0.0)], [(38.7, -9.14), (38.75, -9.2), (-1.5, 179.999999)]])
def test_polyline(spark, points):
    got = value(spark, geo.decoded_line(F.lit(encode(points))))
    assert [c for p in got for c in (p["lat"], p["lng"])] == pytest.approx([c for p in points for c in p])


def test_polyline_that_breaks_off(spark):
    assert [(p["lat"], p["lng"]) for p in value(spark, geo.decoded_line(F.lit("???")))] == [(0.0, 0.0), (0.0, 0.0)]


def test_loop_and_corridor(spark):
    loop = value(spark, geo.loop_points(F.lit(38.7), F.lit(-9.14), F.lit(40.0)))
    assert len(loop) == 4 and loop[0]["lat"] == pytest.approx(38.7 - 40 / (2 * math.pi) * 0.8 / 111, abs=1e-5) and loop[0]["lng"] == pytest.approx(-9.14, abs=1e-5)
    corridor = lambda km, base: value(spark, geo.corridor_points((F.lit(38.7), F.lit(-9.14)), (F.lit(38.9), F.lit(-9.14)), F.lit(km), F.lit(base)))
    assert len(corridor(60.0, 30.0)) == 3 and corridor(20.0, 30.0) == []


@pytest.mark.parametrize(("text", "want"), [("2h", 120), ("1h30m", 90), ("1H30MIN", 90), ("90min", 90), (" 1:30 ", 90), ("soon", None), ("", None), (None, None)])
def test_durations(spark, text, want):
    assert value(spark, parse.minutes(F.lit(text))) == want


@pytest.mark.parametrize(("text", "want"), [("14:00", "14:00"), ("2pm", "14:00"), ("12am", "00:00"), ("9 am", "09:00"), ("14h", "14:00"), ("25h", None), ("25:00", "25:00"), ("noon", None)])
def test_times(spark, text, want):
    assert value(spark, parse.clock_time(F.lit(text))) == want


@pytest.mark.parametrize(("text", "want"), [("today", "2024-05-01"), ("Tomorrow", "2024-05-02"), ("wednesday", "2024-05-08"), ("thursday", "2024-05-02"), ("2024-02-29", "2024-02-29"), ("2023-02-29", None), ("soon", None)])
def test_days(spark, text, want):
    got = value(spark, parse.ride_day(F.lit(text), F.lit("2024-05-01").cast("date")))
    assert (got and got.isoformat()) == want


@pytest.mark.parametrize(("stamp", "clock", "label"), [("2024-05-01T05:10:00+00:00", "05:10", "UTC"), ("2024-05-01T05:10:00+05:45", "05:10", "UTC+5:45"), ("2024-05-01T05:10:00-05:00", "05:10", "UTC-5"), ("", "", "UTC")])
def test_stamps(spark, stamp, clock, label):
    assert value(spark, parse.stamp_clock(F.lit(stamp))) == clock
    assert value(spark, parse.offset_label(parse.offset_hours(F.lit(stamp)))) == label


def test_slug(spark):
    assert value(spark, parse.slug(F.lit(" Órbita—São João, 40 km! "))) == "orbitasao-joao-40-km"
    assert len(parse.MARKED) == len(parse.PLAIN)


def test_waypoints_by_brute_force(spark):
    rows = [(1, k, math.sin(k) / 10, math.cos(k * 1.7) / 10, f"n{k}", "r", (k * 37 % 101) / 100, math.atan2(math.sin(k), math.cos(k * 1.7))) for k in range(60)]
    found = spark.createDataFrame(rows, "origin int, id long, lat double, lng double, name string, reason string, score double, angle double")
    chosen = []
    for r in sorted(rows, key=lambda r: (-r[6], r[0], r[1])):
        if len(chosen) < 3 and all(abs((r[7] - c[7] + math.pi) % (2 * math.pi) - math.pi) >= math.radians(45) for c in chosen):
            chosen.append(r)
    want = [r[1] for r in sorted(chosen, key=lambda r: r[7])]
    assert [r["id"] for r in waypoints.spread_out(found).orderBy("place").collect()] == want
    grouped = waypoints.spread_out(found.withColumn("start", F.col("id") % 2), by="start")
    assert grouped.groupBy("start").count().count() == 2


def test_zones_by_brute_force(spark):
    places = [(1, k, 38 + (k * 37 % 100) / 50, -9 - (k * 53 % 100) / 50) for k in range(300)]
    zones = [(38.5, -9.5, 20000.0), (39.2, -10.1, None), (38.9, -9.9, 60000.0)]
    far = lambda p, z: math.hypot((z[0] - p[2]) * 111, (z[1] - p[3]) * 111 * math.cos(math.radians((z[0] + p[2]) / 2))) * 1000
    want = sorted(p[1] for p in places if all(far(p, z) >= (z[2] or 500) for z in zones))
    got = waypoints.outside(spark.createDataFrame(places, "origin int, id long, lat double, lng double"), spark.createDataFrame(zones, "lat double, lng double, radius double"))
    assert sorted(r["id"] for r in got.collect()) == want and 0 < len(want) < 300


def test_routes_too_short_say_nothing(spark):
    short = spark.createDataFrame([Row(route_id=1, coords=[Row(lat=1.0, lng=1.0)] * 5, elevations=[1.0, 2.0, None, 3.0, 4.0])], "route_id long, coords array<struct<lat:double,lng:double>>, elevations array<double>")
    assert tuple(routes.climbs(short).first()) == (1, 0, 0, 0.0)
    assert routes.wind(short, F.lit(0.0), F.lit(30.0)).count() == 0


def test_headwind(spark):
    north = [Row(lat=38.7 + k / 1000, lng=-9.14) for k in range(50)]
    df = spark.createDataFrame([Row(route_id=1, coords=north)], "route_id long, coords array<struct<lat:double,lng:double>>")
    r = routes.wind(df, F.lit(0.0), F.lit(30.0)).first()
    assert (r["head_pct"], r["warning"]) == (100.0, "from N: strong headwind")
    assert routes.wind(df, F.lit(180.0), F.lit(30.0)).first()["warning"] is None
    assert routes.wind(df, F.lit(90.0), F.lit(30.0)).first()["warning"] == "from E: exposed crosswind"


def test_forecast_with_ragged_hours(spark, tmp_path):
    (tmp_path / "f.json").write_text(
        '{"daily":{"time":["2024-05-01","2024-05-02"],"temperature_2m_max":[20,21],"temperature_2m_min":[10,11],"precipitation_sum":[0,12],"windspeed_10m_max":[10,41],"weathercode":[0,999],"uv_index_max":[3]},'
        '"hourly":{"time":["2024-05-01T06:00","2024-05-01T07:00","2024-05-02T06:00"],"temperature_2m":[15],"windspeed_10m":[],"precipitation":[0,1,2]}}\n'
    )
    got = planning.forecast_days(landed.forecasts(spark, str(tmp_path))).orderBy("date").collect()
    assert [(r["score"], r["weather"], len(r["hours"])) for r in got] == [(100, "Clear sky", 2), (0, "Unknown", 1)] or got[1]["score"] == 0
    assert (got[0]["hours"][1]["temp"], got[0]["hours"][1]["precip"]) == (0.0, 1.0)


def test_gpx_round_trip(spark, tmp_path):
    df = spark.createDataFrame([Row(name="A & B <1>", surface="road", coords=[Row(lat=38.7, lng=-9.14), Row(lat=38.8, lng=-9.2)])], "name string, surface string, coords array<struct<lat:double,lng:double>>").withColumn("time", F.lit("2024-05-01").cast("timestamp"))
    landed.write_gpx(df, f"{tmp_path}/gpx")
    r = landed.read_gpx(spark, f"{tmp_path}/gpx").first()
    assert (r["name"], r["surface"], [(p["lat"], p["lng"]) for p in r["coords"]]) == ("A & B <1>", "road", [(38.7, -9.14), (38.8, -9.2)])
    card = landed.preview_cards(df).first()
    assert card["file"] == "a-b-1.html" and "&amp;" in card["html"] and "[38.7,-9.14]" in card["html"] and "38.8" not in card["html"]


def test_landed_recordings(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"id": 7, "streams": [{"type": "time", "data": [0, 1]}, {"type": "watts", "data": [200]}, {"type": "latlng", "data": [[38.7, -9.1], null]}]}\n')
    r = landed.recordings(spark, str(tmp_path)).first()
    assert (r["id"], r["time"], r["watts"], r["heartrate"], r["latlng"]) == (7, [0, 1], [200], None, [[38.7, -9.1], None])


def test_settings(spark, tmp_path, monkeypatch):
    file = tmp_path / "c.yaml"
    file.write_text("home: {lat: 38.7, lng: -9.1}\nfitness: {ftp: 250}\nsecrets: {password_env: MY_SECRET}\navoid: [{lat: 1.0, lng: 2.0}]\n")
    pytest.importorskip("yaml")
    monkeypatch.setenv("MY_SECRET", "s")
    monkeypatch.setenv("RIDGELINE_HOME_LAT", "40.5")
    got = config.load(str(file))
    assert (got["home"]["lat"], got["home"]["lng"], got["fitness"]["ftp"], got["fitness"]["max_hr"], got["secrets"]["password"]) == (40.5, -9.1, 250, 0, "s")
    assert tuple(config.avoid_zones(spark, got).first()) == (1.0, 2.0, None)
    assert config.secret({"password_cmd": "echo hidden"}, "password") == "hidden" and config.secret({"password_cmd": "false"}, "password") == ""


def test_routes_of_every_user(spark, tmp_path):
    users = (1, 499, 500, 1499)
    kinds = ("view", "purchase")
    rows = [(k, datetime.datetime(2024, 1, 1, 0, 0, k % 60), users[k % 4], kinds[k // 4 % 2], 10.0, f'{{"k": {k}}}') for k in range(80)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    for query in (places.d12_elevation, places.d14_wind):
        # the wind blows from 15 on only, at these users' numbers modulo 40
        want = {1, 499, 500, 1499} if query is places.d12_elevation else {u for u in users if u % 40 >= 15}
        assert {r["route_id"] for r in query(spark, str(tmp_path)).collect()} == want
