"""Rides that arrive one after the other: near-duplicates are merged as they come, and samples follow the ride that stays.

A ride is compared with kept rides that start within the tolerance only; those that no later ride can reach are
handed on at once. The same fold serves a table (rows streamed in order, `folded`) and a stream (keyed state,
streaming/suppress.py). A kept ride has a place of its own, named by the first ride there (`first_id`), whatever ride wins it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rounding import micros
from ..sources.scratch import settled

Ride = dict[str, Any]
#: What a ride is rated by, and the points; an existing ride by the first three only.
POINTS = (("avg_power", 3), ("avg_hr", 2), ("distance_m", 1), ("avg_cadence", 1), ("calories", 1), ("elevation_m", 1))
#: What a new winner takes from the old ride where it has nothing, and an old winner from the new one where it has null.
FILLED = ("avg_hr", "avg_power", "distance_m")
KEPT = ("suffer_score", "calories", "avg_hr", "avg_power", "max_hr", "max_power", "avg_cadence")
ROWS = 4096  # of a batch handed back to Spark


def rating(ride: Ride, names: tuple[tuple[str, int], ...]) -> int:
    signed = lambda name, v: v > 0 if name in ("distance_m", "elevation_m") else v != 0
    return sum(points for name, points in names if ride.get(name) is not None and signed(name, ride[name]))


def similar(kept: Ride, new: Ride, tolerance_us: int) -> bool:
    """The limits are parts of the kept ride's values; rides without a start or a duration match nothing."""
    if kept["_at"] is None or new["_at"] is None or not new["duration_s"] or abs(kept["_at"] - new["_at"]) >= tolerance_us:
        return False
    a, b = kept["distance_m"], new["distance_m"]
    lasts = kept["duration_s"] is not None and abs(kept["duration_s"] - new["duration_s"]) < max(300.0, kept["duration_s"] * 0.15)
    return lasts or (a is not None and b is not None and a > 0 and b > 0 and abs(a - b) < a * 0.10)


def merged(kept: Ride, new: Ride) -> Ride:
    """The richer record, the new one at ties, with what it lacks from the other."""
    if rating(new, POINTS) >= rating(kept, POINTS[:3]):
        return new | {c: new[c] or kept[c] or new[c] for c in FILLED}
    return kept | {c: new[c] if kept[c] is None else kept[c] for c in KEPT}


class Arrival:
    """The rides of one athlete that the next one may match, in the order of their places: (first_id, ride)."""

    def __init__(self, tolerance_us: int, open_rides: list[tuple[int, Ride]] | None = None):
        self.tolerance, self.open = tolerance_us, open_rides or []

    def out_of_reach(self, at: int | None) -> list[tuple[int, Ride]]:
        """Takes out what a ride that starts at `at` or later cannot match; None: everything."""
        gone = [x for x in self.open if at is None or x[1]["_at"] is None or x[1]["_at"] <= at - self.tolerance]
        if gone:
            names = {first for first, _ in gone}
            self.open = [x for x in self.open if x[0] not in names]
        return gone

    def arrive(self, new: Ride) -> tuple[int, Ride, Ride | None]:
        """Where the ride went: the place's name, the ride there now and the one before."""
        for k, (first, kept) in enumerate(self.open):
            if similar(kept, new, self.tolerance):
                self.open[k] = (first, merged(kept, new))
                return first, self.open[k][1], kept
        self.open.append((new["id"], new))
        return new["id"], new, None


def in_order(batches: Iterator[pa.RecordBatch], tolerance_us: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (athlete, stretch, start, id): one row for each ride that stays, and one (`member_id`) for each that came."""
    key, state, out, kind = None, Arrival(tolerance_us), [], None

    def ended(rides: list[tuple[int, Ride]]) -> None:
        out.extend(ride | {"first_id": first, "member_id": None} for first, ride in rides)

    for b in batches:
        kind = kind or pa.schema([f for f in b.schema if not f.name.startswith("_")] + [pa.field("first_id", pa.int64()), pa.field("member_id", pa.int64())])
        for ride in b.to_pylist():
            if key != (ride["athlete_id"], ride["_stretch"]):
                ended(state.out_of_reach(None))
                key = (ride["athlete_id"], ride["_stretch"])
            elif ride["_at"] is not None:
                ended(state.out_of_reach(ride["_at"]))
            first, _, _ = state.arrive(ride)
            out.append({"athlete_id": ride["athlete_id"], "first_id": first, "member_id": ride["id"]})
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
                out = []
    ended(state.out_of_reach(None))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=kind)


def stretches(rides: DataFrame, tolerance_s: int) -> tuple[DataFrame, DataFrame]:
    """Rides that no other ride of the athlete starts near to, and the others with `_at` (microseconds) and `_stretch`.

    Rides of a stretch follow each other within the tolerance; rides of different stretches cannot match.
    """
    by_start = Window.partitionBy("athlete_id").orderBy("date", "id")
    near = lambda c: F.coalesce(c < tolerance_s * 1_000_000, F.lit(False))
    before, after = near(micros("date") - micros(F.lag("date").over(by_start))), near(micros(F.lead("date").over(by_start)) - micros("date"))
    rows = rides.withColumn("_before", before).withColumn("_after", after).withColumn("_stretch", F.sum(F.when(F.col("_before"), 0).otherwise(1)).over(by_start))
    alone = ~F.col("_before") & ~F.col("_after")
    return rows.where(alone).select(rides.columns), rows.where(~alone).withColumn("_at", micros("date")).drop("_before", "_after")


def folded(close: DataFrame, tolerance_s: int) -> DataFrame:
    """in_order() over stretches: a task streams its rows, and holds the rides within the tolerance."""
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in close.schema if not f.name.startswith("_"))
    dealt = close.repartition("athlete_id", "_stretch").sortWithinPartitions("athlete_id", "_stretch", "date", "id")
    return dealt.mapInArrow(lambda batches: in_order(batches, tolerance_s * 1_000_000), f"{plain}, first_id long, member_id long")


def deduplicated(rides: DataFrame, tolerance_s: int = 300) -> DataFrame:
    """Rides after arrival in order of (date, id): each one meets the earliest kept ride of its athlete that it matches."""
    alone, close = stretches(rides, tolerance_s)
    return alone.unionByName(folded(close, tolerance_s).where(F.col("member_id").isNull()).select(rides.columns))


def lineage(rides: DataFrame, tolerance_s: int = 300) -> DataFrame:
    """ride_id, first_id, final_id of rides that started near another: the place they came to, and the ride that stays there."""
    _, close = stretches(rides, tolerance_s)
    table = settled(folded(close, tolerance_s).select("id", "first_id", "member_id"))
    finals = table.where(F.col("member_id").isNull()).select("first_id", F.col("id").alias("final_id"))
    return table.where(F.col("member_id").isNotNull()).select(F.col("member_id").alias("ride_id"), "first_id").join(finals, "first_id").select("ride_id", "first_id", "final_id")


def followed(samples: DataFrame, moves: DataFrame, key: str = "activity_id") -> DataFrame:
    """Samples after a merge: those of a place's first ride under the id of the ride that stays, those of other rides there not at all.

    moves: as of lineage(); rides that it does not name keep their samples.
    """
    to = moves.select(F.col("ride_id").alias("_ride"), (F.col("ride_id") == F.col("first_id")).alias("_first"), F.col("final_id").alias("_final"))
    both = samples.join(to, F.col(key) == F.col("_ride"), "left").where(F.col("_ride").isNull() | F.col("_first"))
    return both.withColumn(key, F.coalesce("_final", key)).select(samples.columns)
