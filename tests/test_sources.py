"""Landed pages, vector tiles, files of routes, broken lines."""

import datetime
import json

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from ridgeline.operators import waypoints
from ridgeline.sources import landed, pages, route_files, schema, tiles
from ridgeline.streaming import sync


def listing(folder, after, *rows_by_page):
    (folder / f"after={after}").mkdir(parents=True)
    for k, rows in enumerate(rows_by_page, 1):
        (folder / f"after={after}" / f"page-{k}.json").write_text(rows if isinstance(rows, str) else json.dumps(rows))


def ride(k, **more):
    return {"id": k, "name": f"r{k}", "distance": 1000, "start_date": "2024-05-01T08:00:00Z", "type": "Ride", "kudos": 3} | more


def test_pages(spark, tmp_path):
    spark.dataSource.register(pages.PagedRides)
    listing(tmp_path / "in", 100, [ride(1), ride(2)], [ride(3), 17], [ride(4)], [ride(99), ride(98)])  # the third page is short: it ends the listing
    listing(tmp_path / "in", 200, [ride(5), ride(6, distance="far")], "[{broken", [])
    listing(tmp_path / "in", 300, [ride(7), ride(8)])  # has not ended yet
    load = lambda r: r.format("paged_rides").option("page_rows", 2).load(str(tmp_path / "in"))
    rows = load(spark.read).collect()
    assert sorted(r["id"] for r in rows if r["id"]) == [1, 2, 3, 4, 5, 7, 8]
    assert sorted((r["after"], r["page"], r["_broken"]) for r in rows if r["_broken"]) == [(100, 2, "17"), (200, 1, json.dumps(ride(6, distance="far"))), (200, 2, "[{broken")]
    assert spark.read.format("paged_rides").option("after", 200).option("page_rows", 2).load(str(tmp_path / "in")).where("id is not null").count() == 3

    def stream():
        got = []
        q = load(spark.readStream).writeStream.foreachBatch(lambda df, n: got.extend((n, r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return got

    first = stream()
    ended = [r for r in rows if r["after"] < 300]
    assert sorted(map(str, (r for _, r in first))) == sorted(map(str, ended))
    assert stream() == []
    (tmp_path / "in" / "after=300" / "page-2.json").write_text(json.dumps([ride(9)]))
    assert sorted(r["id"] for _, r in stream()) == [7, 8, 9]
    # an offset that is asked for again gives the same rides
    reader = pages.StreamReader({"path": str(tmp_path / "in"), "page_rows": "2"})
    again = [list(reader.read(p)) for _ in range(2) for p in reader.partitions({"after": 100}, {"after": 300})]
    assert again[:2] == again[2:] and [r[0] for r in again[1]] == [7, 8, 9]
    assert reader.latestOffset() == {"after": 300}


def test_broken_lines_are_kept_and_counted(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("".join(json.dumps(ride(k, athlete_id=1, moving_time=100, start_date=f"2024-05-0{k}T08:00:00Z")) + "\n" for k in (1, 2)) + "{no ride\n")
    rows = landed.listed_rides(spark, str(tmp_path / "in")).collect()
    assert sorted((r["id"] or 0, r["_broken"]) for r in rows) == [(0, "{no ride"), (1, None), (2, None)]
    q = sync.sync(spark, str(tmp_path / "in"), str(tmp_path / "rides"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    table = sync.Table(spark, str(tmp_path / "rides"), sync.ddl(schema.RIDE))
    assert table.read().count() == 2 and table.current()["broken"] == "1"


def test_samples_follow_in_a_sync(spark, tmp_path):
    """A better recording of a ride replaces it; its samples move to the new id. A batch that comes again moves nothing."""
    raw = lambda *rows: spark.createDataFrame([tuple(r.get(f.name) for f in schema.RAW_RIDE) for r in rows], schema.RAW_RIDE)
    one = ride(1, athlete_id=1, moving_time=3600, distance=0.0) | {"average_heartrate": 140.0}
    two = ride(2, athlete_id=1, moving_time=3600, distance=0.0, start_date="2024-05-01T08:02:00Z") | {"average_watts": 200.0, "average_heartrate": 141.0}
    rides = sync.Table(spark, str(tmp_path / "rides"), sync.ddl(schema.RIDE))
    samples = sync.Table(spark, str(tmp_path / "samples"), sync.ddl(schema.SAMPLE), sync.by_ride)
    rows = [(k, t, 100 + k, None, None, None, None, None, None) for k in (1, 7) for t in range(3)]
    samples.write(spark.createDataFrame(rows, schema.SAMPLE))
    sync.sync_batch(rides, raw(one), 0, None, samples)
    for _ in range(2):
        sync.sync_batch(rides, raw(two), 1, None, samples)
        assert [r["id"] for r in rides.read().collect()] == [2]
        assert sorted((r["activity_id"], r["hr"]) for r in samples.read().collect()) == [(2, 101)] * 3 + [(7, 107)] * 3


def wire(field, body):
    return bytes([field << 3 | 2, len(body)]) + body


def tile(keys, values, features):
    return wire(3, wire(1, b"l") + b"".join(wire(2, bytes([8, n]) + wire(2, bytes(tags))) for n, tags in features) + b"".join(wire(3, k) for k in keys) + b"".join(wire(4, v) for v in values))


def test_tiles(spark):
    import struct

    values = [wire(1, "Café".encode()), bytes([25]) + struct.pack("<d", 38.5), bytes([21]) + struct.pack("<f", -9.5), bytes([0x30, 3]), bytes([0x38, 1]), bytes([0x20]) + b"\xff" * 9 + b"\x01"]
    good = tile([b"name", b"lat", b"lng", b"level", b"open", b"low"], values, [(5, [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]), (6, [0, 0])])
    rows = [(1, good), (2, good[:-3]), (3, b""), (4, None), (5, tile([b"name"], [], [(1, [0, 0])])), (6, b"\xff" * 12), (7, bytes([0x1B])), (8, good + good)]
    got = tiles.decoded(spark.createDataFrame(rows, "tile_id long, data binary"))
    by = {}
    for r in got.collect():
        by.setdefault(r["tile_id"], []).append(r)
    assert by[1][0]["tags"] == {"name": "Café", "lat": "38.5", "lng": "-9.5", "level": "-2", "open": "true", "low": "-1"} and by[1][0]["id"] == 5 and by[1][0]["layer"] == "l"
    assert all(len(by[k]) == 1 and by[k][0]["error"] for k in (2, 5, 6, 7)) and not {3, 4} & set(by) and len(by[8]) == 4
    found = waypoints.distinct_highlights(tiles.highlights(got)).collect()
    assert [(r["name"], r["lat"], r["lng"], r["category"]) for r in found] == [("Café", 38.5, -9.5, "unknown")]


def routes(spark, n=3):
    line = [(38.7 + k / 1000, -9.1) for k in range(12)]
    point = [(38.7, -9.1, "Bar <b>", 'a "fine" one')]
    rows = [(k, "Évora & back" if k < 2 else "???", "road", line, datetime.datetime(2024, 5, 1), point) for k in range(n)]
    return spark.createDataFrame(rows, "id long, name string, surface string, coords array<struct<lat:double,lng:double>>, time timestamp, waypoints array<struct<lat:double,lng:double,name:string,reason:string>>")


def test_a_file_for_each_route(spark, tmp_path):
    spark.dataSource.register(route_files.TextFiles)
    out = tmp_path / "gpx"
    route_files.named(routes(spark)).select("file", "text").repartition(2).write.format("text_files").mode("append").save(str(out))
    assert sorted(p.name for p in out.iterdir()) == ["evora-back-1.gpx", "evora-back.gpx", "route.gpx"]
    r = landed.read_gpx(spark, str(out / "evora-back.gpx")).first()
    assert r["name"] == "Évora & back" and len(r["coords"]) == 12 and r["coords"][1]["lat"] == 38.701
    route_files.named(routes(spark), "html").select("file", "text").write.format("text_files").mode("append").save(str(tmp_path / "html"))
    page = (tmp_path / "html" / "evora-back.html").read_text()
    assert "<h1>Évora &amp; back</h1>" in page and page.count("[38.7") == 4 and "Bar &lt;b&gt;</b> a &quot;fine&quot; one" in page


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    spark.dataSource.register(route_files.TextFiles)
    rows = spark.createDataFrame([("a.txt", "1"), ("b.txt", "2"), ("../c.txt", "3")], "file string, text string").repartition(3)
    with pytest.raises(PythonException, match="no file name"):
        rows.write.format("text_files").mode("append").save(str(tmp_path / "out"))
    assert list(tmp_path.iterdir()) == []
    sound = rows.where("file not like '%/%'")
    sound.write.format("text_files").mode("append").save(str(tmp_path / "out"))
    with pytest.raises(Exception, match="out"):
        sound.write.format("text_files").mode("append").save(str(tmp_path / "out"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"] and len(list((tmp_path / "out").iterdir())) == 2


def test_noon_air(spark):
    hours = [f"2024-05-0{d}T{h:02}:00" for d in (1, 2) for h in range(24)]
    row = (hours, [float(k) for k in range(48)], [1.0] * 48, [2.0] * 30)
    reports = spark.createDataFrame([(row,)], "hourly struct<time:array<string>,european_aqi:array<double>,pm2_5:array<double>,pm10:array<double>>")
    assert tuple(landed.noon_air(reports, F.lit("2024-05-02")).first()) == (36.0, 1.0, None)
    assert landed.noon_air(reports, F.lit("2024-05-03")).count() == 0
