"""From listed rides and raw recordings to rides and samples; near-duplicate rides; keyed merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rounding import half_even, micros, present
from ..functions.training import richness

#: The service's ride types that count as cycling.
CYCLING = ("Ride", "VirtualRide", "EBikeRide", "Handcycle", "Velomobile")


def device(device_name: Column, name: Column, trainer: Column) -> Column:
    """karoo, watch, zwift or unknown, from the device's and the ride's name. Any unnamed trainer ride counts as zwift."""
    d = F.lower(F.coalesce(device_name, F.lit("")))
    return F.when(d.contains("karoo"), "karoo").when(d.contains("watch") | d.contains("apple"), "watch").when(F.coalesce(trainer, F.lit(False)) | F.lower(F.coalesce(name, F.lit(""))).contains("zwift"), "zwift").otherwise("unknown")


def parsed(raw: DataFrame) -> DataFrame:
    """Rides in the engine's columns and units; missing distances, times, climbs count as 0. Fractions of whole measures are rounded."""
    whole = lambda c: F.rint(c).cast("int")
    return raw.select(
        "id",
        "athlete_id",
        F.coalesce("name", F.lit("")).alias("name"),
        F.try_to_timestamp("start_date").alias("date"),
        F.coalesce("distance", F.lit(0.0)).alias("distance_m"),
        F.coalesce("moving_time", F.lit(0)).alias("duration_s"),
        F.coalesce("total_elevation_gain", F.lit(0.0)).alias("elevation_m"),
        whole("average_heartrate").alias("avg_hr"),
        whole("max_heartrate").alias("max_hr"),
        whole("average_watts").alias("avg_power"),
        whole("max_watts").alias("max_power"),
        whole("average_cadence").alias("avg_cadence"),
        half_even(F.coalesce("average_speed", F.lit(0.0)) * F.lit(3.6), 2).alias("avg_speed_kmh"),
        whole("calories").alias("calories"),
        whole("suffer_score").alias("suffer_score"),
        device(F.col("device_name"), F.col("name"), F.col("trainer")).alias("device"),
        F.coalesce("type", F.lit("")).alias("service_type"),
        F.coalesce("trainer", F.lit(False)).alias("trainer"),
    )


def cycling_only(rides: DataFrame, type_col: str = "service_type") -> DataFrame:
    """Rides of a cycling type; a missing type passes."""
    return rides.where((F.coalesce(type_col, F.lit("")) == "") | F.col(type_col).isin(*CYCLING))


def classified(rides: DataFrame) -> DataFrame:
    """is_indoor and sport_type from type, device, trainer flag and distance, in that order."""
    kind = F.lower(F.coalesce("service_type", F.lit("")))
    virtual = (F.col("device") == "zwift") | (kind == "virtualride")
    sport = F.when(virtual, "zwift").when(F.col("trainer"), "cycling_indoor").when(kind == "ebikeride", "ebike").when(F.col("distance_m") > 0, "cycling_outdoor").otherwise("cycling_indoor")
    return rides.withColumn("sport_type", sport).withColumn("is_indoor", ~F.col("sport_type").isin("ebike", "cycling_outdoor"))


def with_details(rides: DataFrame, details: DataFrame) -> DataFrame:
    """Rides with gaps filled from a detail table (id, calories, average_heartrate, max_heartrate, suffer_score).

    Calories of a karoo are taken over whenever there are any.
    """
    d = details.select(F.col("id"), *(F.col(c).alias("_" + c) for c in ("calories", "average_heartrate", "max_heartrate", "suffer_score")))
    whole = lambda c: present(F.rint(c).cast("int"))
    filled = lambda own, other: F.coalesce(present(F.col(own)), whole(other), F.col(own))
    calories = F.when(F.col("device") == "karoo", F.coalesce(whole("_calories"), "calories")).otherwise(filled("calories", "_calories"))
    new = {"calories": calories, "avg_hr": filled("avg_hr", "_average_heartrate"), "max_hr": filled("max_hr", "_max_heartrate"), "suffer_score": filled("suffer_score", "_suffer_score")}
    return rides.join(d, "id", "left").withColumns(new).select(rides.columns)


def points(streams: DataFrame) -> DataFrame:
    """Samples of recordings kept as arrays by measure; `time` says how many. Shorter arrays give null, no `time` no samples."""
    at = lambda c: F.get(c, F.col("i"))
    rows = streams.select("*", F.posexplode("time").alias("i", "time_offset"))
    latlng = at("latlng")
    return rows.select(
        F.col("id").alias("activity_id"),
        "time_offset",
        at("heartrate").alias("hr"),
        at("watts").alias("power"),
        at("cadence").alias("cadence"),
        half_even(at("velocity_smooth") * F.lit(3.6), 2).alias("speed_kmh"),
        at("altitude").alias("altitude_m"),
        F.get(latlng, F.lit(0)).alias("lat"),
        F.get(latlng, F.lit(1)).alias("lng"),
    )


def recordings(samples: DataFrame) -> DataFrame:
    """The inverse of points(): one row of arrays a ride."""
    rows = samples.groupBy("activity_id").agg(F.sort_array(F.collect_list(F.struct("time_offset", "hr", "power", "cadence", "speed_kmh", "altitude_m", "lat", "lng"))).alias("p"))
    of = lambda f: F.transform("p", f)
    return rows.select(
        F.col("activity_id").alias("id"),
        of(lambda p: p["time_offset"]).alias("time"),
        of(lambda p: p["hr"]).alias("heartrate"),
        of(lambda p: p["power"]).alias("watts"),
        of(lambda p: p["cadence"]).alias("cadence"),
        of(lambda p: p["speed_kmh"] / F.lit(3.6)).alias("velocity_smooth"),
        of(lambda p: p["altitude_m"]).alias("altitude"),
        of(lambda p: F.when(p["lat"].isNotNull(), F.array(p["lat"], p["lng"]))).alias("latlng"),
    )


def close_rides(existing: DataFrame, new: DataFrame, tolerance_s: int, columns: Sequence[str]) -> DataFrame:
    """The columns, as e_ and n_, of rides of one athlete that start within tolerance_s and agree in duration or distance.

    The limits are parts of the existing ride's values, so the test is not symmetric. Starts are cut into buckets of four
    times tolerance_s; a new ride looks into the one or two buckets that lie within the tolerance, so the join is an equi-join.
    """
    old = existing.select(*(F.col(c).alias("e_" + c) for c in columns))
    reach = tolerance_s * 1_000_000
    bucket = lambda c, by=0: F.floor((micros(c) + by) / F.lit(4 * reach)).cast("long")
    fresh = new.select(*(F.col(c).alias("n_" + c) for c in columns))
    near = fresh.withColumn("n_bucket", F.explode(F.sequence(bucket("n_date", -reach), bucket("n_date", reach))))
    both = old.withColumn("e_bucket", bucket("e_date")).join(near, (F.col("e_athlete_id") == F.col("n_athlete_id")) & (F.col("e_bucket") == F.col("n_bucket")))
    starts = F.abs(micros("e_date") - micros("n_date")) < tolerance_s * 1_000_000
    lasts = F.abs(F.col("e_duration_s") - F.col("n_duration_s")) < F.greatest(F.lit(300.0), F.col("e_duration_s") * F.lit(0.15))
    goes = (F.col("e_distance_m") > 0) & (F.col("n_distance_m") > 0) & (F.abs(F.col("e_distance_m") - F.col("n_distance_m")) < F.col("e_distance_m") * F.lit(0.10))
    return both.where(starts & (lasts | goes) & (F.col("e_id") != F.col("n_id")))


#: What close_rides() compares.
COMPARED = ("id", "athlete_id", "date", "duration_s", "distance_m")


def duplicate_pairs(existing: DataFrame, new: DataFrame, tolerance_s: int = 300) -> DataFrame:
    """existing_id, new_id of close_rides()."""
    return close_rides(existing, new, tolerance_s, COMPARED).select(F.col("e_id").alias("existing_id"), F.col("n_id").alias("new_id"))


def ride_richness(p: str = "") -> Column:
    c = lambda n: F.col(p + n)
    nothing = lambda x: F.coalesce(x, F.lit(0))
    return richness(*(nothing(c(n)) for n in ("avg_power", "avg_hr", "distance_m", "avg_cadence", "calories", "elevation_m")))


def merged_pairs(pairs: DataFrame, rides: DataFrame) -> DataFrame:
    """Each pair's outcome: the richer record wins (ties: the new one) and takes what it lacks from the other.

    An existing ride is rated by power, heart rate and distance only. The winner that is new takes heart rate, power and
    distance; an existing winner takes eight measures.
    """
    old = rides.select(*(F.col(c).alias("e_" + c) for c in rides.columns))
    new = rides.select(*(F.col(c).alias("n_" + c) for c in rides.columns))
    return outcomes(pairs.join(old, pairs["existing_id"] == F.col("e_id")).join(new, F.col("new_id") == F.col("n_id")))


def merged_duplicates(existing: DataFrame, new: DataFrame, tolerance_s: int = 300) -> DataFrame:
    """merged_pairs() of duplicate_pairs(): rides bring their measures to the join by start, the pairs are not dealt out again."""
    return outcomes(close_rides(existing, new, tolerance_s, (*COMPARED, "elevation_m", *(c for c in MEASURES if c not in COMPARED))))


#: The measures of a pair's outcome.
MEASURES = ("avg_hr", "max_hr", "avg_power", "max_power", "avg_cadence", "calories", "suffer_score", "distance_m", "duration_s")


def outcomes(both: DataFrame) -> DataFrame:
    """merged_pairs() of rows with the columns of both rides, as e_ and n_."""
    zero = F.lit(0)
    old_score = richness(*(F.coalesce(F.col("e_" + n), zero) for n in ("avg_power", "avg_hr", "distance_m")), zero, zero, zero)
    wins = ride_richness("n_") >= old_score

    def value(c: str) -> Column:
        take_over = F.coalesce(present(F.col("n_" + c)), present(F.col("e_" + c)), F.col("n_" + c)) if c in ("avg_hr", "avg_power", "distance_m") else F.col("n_" + c)
        keep = F.coalesce("e_" + c, "n_" + c) if c in ("suffer_score", "calories", "avg_hr", "avg_power", "max_hr", "max_power", "avg_cadence") else F.col("e_" + c)
        return F.when(wins, take_over).otherwise(keep).alias(c)

    return both.select(F.col("e_id").alias("existing_id"), F.col("n_id").alias("new_id"), F.when(wins, F.col("n_id")).otherwise(F.col("e_id")).alias("id"), wins.alias("new_wins"), *map(value, MEASURES))


def upserted(table: DataFrame, new: DataFrame, key: str = "id", keep: tuple[str, ...] = ("date",)) -> DataFrame:
    """`table` with `new` merged in by key: known keys take the new row but keep the columns of `keep`, others are added.

    If `new` has a key twice the later row by (synced_at, all columns) counts.
    """
    order = [F.col("synced_at").desc_nulls_last()] if "synced_at" in new.columns else []
    latest = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order, F.xxhash64(*new.columns)))).where("_n = 1").drop("_n")
    a, b = table.alias("a"), latest.withColumn("_new", F.lit(True)).alias("b")
    taken = lambda c: F.when(F.col("b._new").isNull(), F.col(f"a.{c}")).when(F.col(f"a.{key}").isNotNull() & F.lit(c in keep), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}") if c in new.columns else F.col(f"a.{c}"))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*((F.coalesce(f"a.{key}", f"b.{key}") if c == key else taken(c)).alias(c) for c in table.columns))


def replaced(samples: DataFrame, new: DataFrame, key: str = "activity_id") -> DataFrame:
    """Samples with all those of the rides in `new` replaced."""
    return samples.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(samples.columns))
