"""Rides that arrive: a stream of listed rides into the ride table, with a bookmark, duplicates merged, metrics kept up.

Tables are in parts by athlete (tables.py): a batch reads and writes the parts of the athletes that it has rides of. Batches
of the stream are idempotent: a batch that is repeated finds its own number in the table and changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arrival, fitness, ingest, metrics
from ..sources import schema
from ..sources.scratch import settled
from ..sources.landed import BROKEN, listed_rides_stream
from .tables import BUCKETS, Table, bucket

METRICS_VERSION = "1"


@dataclass
class Thresholds:
    """Configured values; 0 means estimated."""

    ftp: int = 0
    max_hr: int = 0
    resting_hr: int = 0

    def fingerprint(self) -> str:
        return f"{METRICS_VERSION}:{self.ftp}:{self.max_hr}:{self.resting_hr}"

    def changes(self, fingerprint: str | None) -> tuple[bool, bool, bool]:
        """Whether the version, the threshold power, or any threshold differs from those of a fingerprint."""
        before, now = (fingerprint or "").split(":"), self.fingerprint().split(":")
        return before[:1] != now[:1], before[1:2] != now[1:2], before[1:] != now[1:]


#: The columns of the table of derived metrics. best, first: the ride's best 20 minutes, full windows only, and shorter ones too.
DERIVED = "id long, athlete_id long, date timestamp, distance_m double, elevation_m double, np double, ef double, work_kj double, variability_index double, ride_ftp double, tss double, intensity_factor double, trimp double, best double, first double"


def ddl(struct) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in struct.fields)


def arrived(raw: DataFrame, bookmark: Column | None, lateness_s: int = 0) -> DataFrame:
    """New rides of a batch: cycling only, classified, not older than the bookmark less the allowed lateness."""
    rides = ingest.classified(ingest.cycling_only(ingest.parsed(raw)))
    return rides if bookmark is None else rides.where(F.col("date").isNull() | (F.unix_timestamp("date") > bookmark - lateness_s))


def merged(table: DataFrame, new: DataFrame) -> DataFrame:
    """The table after a batch: known ids are updated (their date stays), near-duplicates merged by athlete."""
    return arrival.deduplicated(ingest.upserted(table, new.select(table.columns)))


def arrivals(table: DataFrame, new: DataFrame) -> DataFrame:
    """All rides of the athletes with new rides, before near-duplicates are merged."""
    riders = new.select("athlete_id").distinct()
    return ingest.upserted(table.join(riders, "athlete_id", "left_semi").select(table.columns), new.select(table.columns))


def merged_batch(table: DataFrame, new: DataFrame) -> DataFrame:
    """merged(), where only athletes with new rides are compared and merged; other rides pass as they are."""
    riders = new.select("athlete_id").distinct()
    return table.join(riders, "athlete_id", "left_anti").select(table.columns).unionByName(merged(table.join(riders, "athlete_id", "left_semi").select(table.columns), new))


def sync_batch(rides: Table, raw: DataFrame, batch: int, lateness_s: int | None = 0, samples: Table | None = None) -> None:
    """One micro-batch into the ride table. lateness_s None: late rides are never dropped.

    The bookmark is the latest start of all listed rides, those that are no cycling included. Lines that are no rides are counted
    (`broken` of the table's notes). samples: a table in parts by_ride(), whose samples follow merged rides.
    """
    now = rides.current()
    if int(now.get("batch", -1)) >= batch:
        return
    before = int(now["bookmark"]) if "bookmark" in now else None
    sound = raw.where(F.col(BROKEN).isNull()) if BROKEN in raw.columns else raw
    new = arrived(sound, F.lit(before) if before is not None and lateness_s is not None else None, lateness_s or 0)
    broken = F.count(BROKEN) if BROKEN in raw.columns else F.lit(0)
    seen = raw.agg(F.max(F.unix_timestamp(F.try_to_timestamp("start_date"))).alias("latest"), broken.alias("broken")).first()
    mark = max(x for x in (before, seen["latest"], 0) if x is not None)
    lost = int(now.get("broken", 0)) + seen["broken"]
    if samples is not None and int(samples.current().get("batch", -1)) < batch:
        follow(samples, arrival.lineage(arrivals(rides.read(rides.parts_of(new)), new)), batch=str(batch))
    write_merged(rides, new, batch=str(batch), bookmark=str(mark), broken=str(lost))


def follow(samples: Table, moves: DataFrame, **notes: str) -> None:
    """Samples (in parts by activity_id) after a merge (arrival.lineage()); parts without a merged ride stay as they are."""
    moved = settled(moves.where((F.col("ride_id") != F.col("first_id")) | (F.col("ride_id") != F.col("final_id"))))
    places = settled(moves.join(moved.select("first_id").distinct(), "first_id", "left_semi").select("ride_id", "first_id", "final_id"))
    ids = places.select(F.col("ride_id").alias("activity_id")).unionByName(places.select(F.col("final_id").alias("activity_id")))
    parts = samples.parts_of(ids)
    samples.write(arrival.followed(samples.read(parts), places), parts, **notes)


def by_ride() -> Column:
    """The part of a sample."""
    return bucket("activity_id")


def write_merged(rides: Table, new: DataFrame, **notes: str) -> None:
    """New rides into the parts of their athletes; other parts are neither read nor written."""
    parts = rides.parts_of(new)
    rides.write(merged_batch(rides.read(parts), new), parts, **notes)


def backfill(rides: Table, raw: DataFrame, as_of: Column, months: int = 12) -> None:
    """All listed rides of the last `months` months of 30 days into the table, whatever the bookmark says; it moves on, never back."""
    now = rides.current()
    since = F.unix_timestamp(as_of.cast("timestamp")) - months * 30 * 86_400
    latest = raw.agg(F.max(F.unix_timestamp(F.try_to_timestamp("start_date"))).alias("t")).first()["t"]
    mark = max(x for x in (int(now.get("bookmark", 0)), latest) if x is not None)
    write_merged(rides, arrived(raw, since), batch=str(now.get("batch", -1)), bookmark=str(mark))


def reclassified(rides: DataFrame, listed: DataFrame) -> DataFrame:
    """The ride table after a new look at the service's types (id, type, trainer): rides that are no cycling go, others get their class anew.

    Rides that the service does not list any more stay as they are.
    """
    now = listed.select(F.col("id").alias("_id"), F.coalesce("type", F.lit("")).alias("_type"), F.coalesce("trainer", F.lit(False)).alias("_trainer"))
    both = rides.join(now, F.col("id") == F.col("_id"), "left")
    unknown = both.where(F.col("_id").isNull()).select(rides.columns)
    known = both.where(F.col("_id").isNotNull()).withColumns({"service_type": F.col("_type"), "trainer": F.col("_trainer")}).select(rides.columns)
    return unknown.unionByName(ingest.classified(ingest.cycling_only(known)).select(rides.columns))


def sync(spark: SparkSession, folder: str, table: str, checkpoint: str, lateness_s: int | None = 0, every: str | None = None):
    """The stream that keeps the ride table; every None: whatever is there now, then it ends."""
    rides = Table(spark, table, ddl(schema.RIDE))
    stream = listed_rides_stream(spark, folder).writeStream.foreachBatch(lambda df, n: sync_batch(rides, df, n, lateness_s)).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()


def recompute(rides: DataFrame, samples: DataFrame, derived: Table, limits: Thresholds, as_of: Column) -> DataFrame:
    """Derived metrics after new rides. Only rides that are not known have their samples read; stress is made anew for all.

    What a ride has keeps its value: a threshold power, once given, does not move with later rides. Another version starts
    from nothing. Changed thresholds make loads anew for all rides, which reads their samples; a changed threshold power
    makes the rides' own ones anew too.
    """
    now = derived.current()
    version, power, any_limit = limits.changes(now.get("fingerprint"))
    known = derived.read().limit(0) if version else derived.read()
    known = known.select("id", "np", "work_kj", "best", "first", F.lit(None).cast("double").alias("ride_ftp") if power else F.col("ride_ftp"), "trimp")
    dated = rides.where(F.col("date").isNotNull())
    own = metrics.limits(dated, limits.max_hr or None)
    todo = dated if any_limit else dated.join(known, "id", "left_anti")
    ridden = todo.select(F.col("id").alias("activity_id"), "athlete_id").join(own.select("athlete_id", "threshold_hr"), "athlete_id").drop("athlete_id")
    found = metrics.profiles(samples, ridden, limits.resting_hr or 50).withColumnRenamed("activity_id", "id")
    if any_limit:  # powers stay where they are known, loads do not
        old = known.select("id", *(F.col(c).alias("_" + c) for c in ("np", "work_kj", "best", "first", "ride_ftp")))
        both = found.join(old, "id", "full_outer")
        profile = both.select("id", *(F.coalesce("_" + c, c).alias(c) for c in ("np", "work_kj", "best", "first")), F.col("_ride_ftp").alias("ride_ftp"), "trimp")
    else:
        profile = known.unionByName(found.withColumn("ride_ftp", F.lit(None).cast("double")).select(known.columns))
    return metrics.with_thresholds(dated.join(profile, "id", "left").join(own, "athlete_id"), as_of, limits.ftp or None).select([c.split()[0] for c in DERIVED.split(", ")])


def day_part() -> Column:
    """The part of a day: the athlete's bucket and the block of days, so that later days leave the files of earlier blocks alone."""
    return bucket() + F.floor(F.col("n") / fitness.BLOCK) * BUCKETS


def refresh(rides: DataFrame, samples: DataFrame, derived: Table, days: Table, limits: Thresholds, as_of: Column) -> None:
    """Derived metrics and days after a sync; also the nightly run, as fitness decays on days without rides.

    days: a table of fitness.STORED in parts by day_part(). It is continued from the block of the first day that changed.
    """
    derived.write(recompute(rides, samples, derived, limits, as_of), fingerprint=limits.fingerprint())
    continue_days(days, fitness.daily(derived.read()), as_of, fingerprint=limits.fingerprint())


def continue_days(days: Table, now: DataFrame, as_of: Column, **notes: str) -> None:
    """Writes the parts of blocks that have changed days; their other athletes' rows stay as they are."""
    stored = days.read()
    resumed = settled(fitness.resumed_from(stored, now, as_of), "athlete_id")
    new = settled(fitness.continued(stored, now, resumed, as_of), "athlete_id")
    gone = stored.join(resumed, "athlete_id").where(F.col("n") >= F.col("from_n"))
    parts = sorted(set(days.parts_of(new)) | set(days.parts_of(gone)))
    others = days.read(parts).join(resumed, "athlete_id", "left").where(F.col("from_n").isNull() | (F.col("n") < F.col("from_n"))).select(new.columns)
    days.write(others.unionByName(new), parts, **notes)


def reset(derived: Table) -> None:
    """Forget threshold powers and stress, keep loads, as after a change of thresholds by hand."""
    known = derived.read()
    derived.write(known.withColumns({c: F.lit(None).cast("double") for c in ("ride_ftp", "tss", "intensity_factor")}), fingerprint=derived.current().get("fingerprint", ""))
