"""Streams of landed rides end in the table that one batch would give; metrics follow."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F
from ridgeline.operators import arrival, fitness, metrics
from ridgeline.plans.rides import rides
from ridgeline.sources import driver_tables as tables
from ridgeline.sources import schema
from ridgeline.streaming import sync

DATA = "/root/testdata/sf0.001"


def land(spark, folder, name, where):
    rows = [r.asDict() for r in tables.raw_rides(spark, DATA).where(where).collect()]
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def run(spark, tmp_path, lateness=0):
    q = sync.sync(spark, str(tmp_path / "in"), str(tmp_path / "rides"), str(tmp_path / "cp"), lateness)
    assert q.awaitTermination(120)
    return sync.Table(spark, str(tmp_path / "rides"), sync.ddl(schema.RIDE))


def test_two_batches_are_one(spark, tmp_path):
    (tmp_path / "in").mkdir()
    land(spark, tmp_path / "in", "a.json", "start_date < '1998'")
    first = run(spark, tmp_path)
    early = first.read().count()
    land(spark, tmp_path / "in", "b.json", "start_date >= '1998'")
    land(spark, tmp_path / "in", "late.json", "start_date < '1998' and id % 50 = 0")
    table = run(spark, tmp_path)
    want = arrival.deduplicated(rides(spark, DATA))
    assert 0 < early < table.read().count() == want.count()
    assert table.read().select("id", "avg_hr", "avg_power").exceptAll(want.select("id", "avg_hr", "avg_power")).count() == 0
    now = table.current()
    # a batch that comes again changes nothing; rides that are no cycling move the bookmark too
    sync.sync_batch(table, tables.raw_rides(spark, DATA).limit(5), int(now["batch"]))
    assert table.current() == now
    latest = tables.raw_rides(spark, DATA).agg(F.max(F.unix_timestamp(F.try_to_timestamp("start_date"))).alias("t")).first()["t"]
    assert int(now["bookmark"]) == latest


def test_metrics_follow(spark, tmp_path):
    samples = tables.samples(spark, DATA).where("activity_id < 6")
    r = tables.sample_rides(samples).withColumn("elevation_m", F.lit(10.0))
    derived = sync.Table(spark, str(tmp_path / "derived"), sync.DERIVED)
    days = sync.Table(spark, str(tmp_path / "days"), fitness.STORED, sync.day_part)
    as_of = F.lit("2024-02-15").cast("date")
    sync.refresh(r.where("id < 4"), samples, derived, days, sync.Thresholds(), as_of)
    before = {x["id"]: x["ride_ftp"] for x in derived.read().collect()}
    sync.refresh(r, samples, derived, days, sync.Thresholds(), as_of)
    after = {x["id"]: x["ride_ftp"] for x in derived.read().collect()}
    assert before.items() <= after.items() and len(after) == 6
    # a resting heart rate that changes makes loads anew, and keeps threshold powers
    loads = {x["id"]: x["trimp"] for x in derived.read().collect()}
    sync.refresh(r, samples, derived, days, sync.Thresholds(resting_hr=60), as_of)
    assert {x["id"]: x["ride_ftp"] for x in derived.read().collect()} == after
    assert any(x["trimp"] != loads[x["id"]] for x in derived.read().collect())
    # a threshold power that changes makes the rides' own ones anew
    sync.refresh(r, samples, derived, days, sync.Thresholds(ftp=300), as_of)
    assert {x["ride_ftp"] for x in derived.read().collect()} == {300.0}
    assert days.read().agg(F.max("date").alias("d")).first()["d"].isoformat() == "2024-02-15"
    sync.reset(derived)
    assert derived.read().where("ride_ftp is not null or tss is not null").count() == 0


def test_known_rides_are_not_read_again(spark, tmp_path):
    samples = tables.samples(spark, DATA).where("activity_id < 6")
    r = tables.sample_rides(samples).withColumn("elevation_m", F.lit(10.0))
    derived = sync.Table(spark, str(tmp_path / "derived"), sync.DERIVED)
    days = sync.Table(spark, str(tmp_path / "days"), fitness.STORED, sync.day_part)
    as_of = F.lit("2024-02-15").cast("date")
    sync.refresh(r.where("id < 4"), samples, derived, days, sync.Thresholds(), as_of)
    before = {x["id"]: x.asDict() for x in derived.read().collect()}
    # without the samples of known rides
    sync.refresh(r, samples.where("activity_id >= 4"), derived, days, sync.Thresholds(), as_of)
    after = {x["id"]: x.asDict() for x in derived.read().collect()}
    assert all(after[k][c] == v[c] for k, v in before.items() for c in ("np", "work_kj", "ride_ftp", "trimp", "best"))
    whole = {x["id"]: x.asDict() for x in metrics.derived(r, samples, as_of).collect()}
    assert all(after[k][c] == whole[k][c] for k in (4, 5) for c in ("np", "work_kj", "trimp", "best", "first"))


def test_backfill_ignores_the_bookmark(spark, tmp_path):
    raw = tables.raw_rides(spark, DATA)
    table = sync.Table(spark, str(tmp_path / "rides"), sync.ddl(schema.RIDE))
    sync.sync_batch(table, raw.where("start_date >= '1998'"), 0)
    late, mark = table.read().count(), table.current()["bookmark"]
    sync.backfill(table, raw, F.lit("1998-06-01").cast("date"), months=12)
    now = table.read()
    assert now.count() > late and now.where("date < '1997-06-06'").count() == 0 and table.current()["bookmark"] == mark
    sync.backfill(table, raw, F.lit("1998-06-01").cast("date"), months=12)
    assert table.read().select("id").exceptAll(now.select("id")).count() == 0 and table.read().count() == now.count()


def data_files(tmp_path):
    return {p for p in (tmp_path / "rides" / "data").rglob("*.parquet")}


def test_a_batch_rewrites_the_parts_of_its_athletes_only(spark, tmp_path):
    raw = tables.raw_rides(spark, DATA).withColumn("athlete_id", F.col("id") % 200)
    table = sync.Table(spark, str(tmp_path / "rides"), sync.ddl(schema.RIDE))
    sync.sync_batch(table, raw.where("id % 10 <> 0"), 0, None)
    before, parts = data_files(tmp_path), table.manifest()["parts"]
    assert len(parts) > 50
    # one athlete of two hundred
    sync.sync_batch(table, raw.where("athlete_id = 10"), 1, None)
    now = table.manifest()["parts"]
    assert before <= data_files(tmp_path) and len(data_files(tmp_path) - before) == 1
    assert [k for k in now if now[k] != parts.get(k)] == [str(table.parts_of(raw.where("athlete_id = 10"))[0])]
    want = arrival.deduplicated(sync.arrived(raw.where("id % 10 <> 0 or athlete_id = 10"), None).select(table.read().columns))
    assert table.read().select("id", "avg_hr").exceptAll(want.select("id", "avg_hr")).count() == 0 and table.read().count() == want.count()
    # two versions later the replaced file is removed
    for k in (2, 3):
        sync.sync_batch(table, raw.where("athlete_id = 10"), k, None)
    assert len(data_files(tmp_path)) <= len(parts) + 2 and len(table.numbers()) == 2


def test_a_crash_before_the_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    raw = tables.raw_rides(spark, DATA)
    table = sync.Table(spark, str(tmp_path / "rides"), sync.ddl(schema.RIDE))
    sync.sync_batch(table, raw.where("start_date < '1996'"), 0)
    before, n = table.current(), table.read().count()

    def dies(self, number, manifest):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(sync.Table, "publish", dies)
        with pytest.raises(OSError, match="lost"):
            sync.sync_batch(table, raw.where("start_date >= '1996'"), 1)
    assert table.current() == before and table.read().count() == n
    sync.sync_batch(table, raw.where("start_date >= '1996'"), 1)
    assert table.current()["batch"] == "1" and table.read().count() > n


def test_days_are_continued(spark, tmp_path):
    """Random late rides: the continued series is the full one; blocks before the first changed day keep their files."""
    rng = random.Random(6)
    start = datetime.date(2020, 1, 1)
    ride = lambda a, d: (a, start + datetime.timedelta(d), float(rng.randrange(20, 150)), 1000.0 * rng.randrange(60), 10.0 * rng.randrange(80))
    rows = [ride(a, d) for a in range(5) for d in sorted(rng.sample(range(a, 500), 120))]
    frame = lambda: spark.createDataFrame(rows, "athlete_id long, date date, tss double, distance_m double, elevation_m double").groupBy("athlete_id", "date").agg(*(F.sum(c).alias(c) for c in ("tss", "distance_m", "elevation_m")))
    days = sync.Table(spark, str(tmp_path / "days"), fitness.STORED, sync.day_part, versions_kept=9)
    day = lambda n: F.lit((start + datetime.timedelta(n)).isoformat()).cast("date")
    steps = [[], [ride(1, 520), ride(3, 470)], [ride(2, 300)], [ride(4, 1)], [ride(0, 540)]]
    for k, more in enumerate(steps):
        rows += more
        before = days.manifest()["parts"]
        sync.continue_days(days, frame(), day(510 + 10 * k))
        full = {(r["athlete_id"], r["date"]): tuple(r)[2:] for r in fitness.fitness(frame(), day(510 + 10 * k)).collect()}
        got = {(r["athlete_id"], r["date"]): tuple(r)[2:] for r in days.read().select("athlete_id", *fitness.SHOWN).collect()}
        assert got == full, k
        now = days.manifest()["parts"]
        changed = {int(p) // sync.BUCKETS for p in now if now[p] != before.get(p)}
        if k in (1, 4):
            assert changed <= {3, 4} and before
        if k == 2:
            assert min(changed) == 2
