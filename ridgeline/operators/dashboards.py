"""Panels over rides, samples and days. The panels' meaning is this library's own; all are by athlete or by ride."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rounding import half_even

#: Upper limits of the power zones 1 to 6 as shares of the threshold power.
POWER_ZONES = (0.55, 0.75, 0.90, 1.05, 1.20, 1.50)
#: Upper limits of the heart rate zones 1 to 4 as shares of the threshold heart rate.
HR_ZONES = (0.81, 0.89, 0.94, 1.0)
SPORTS = ("cycling_outdoor", "cycling_indoor", "zwift", "ebike")


def zone(share: Column, limits: Sequence[float]) -> Column:
    """1 for shares up to the first limit, and so on; null for null."""
    return F.when(share.isNotNull(), sum((F.when(share > limit, 1).otherwise(0) for limit in limits), F.lit(1)))


def cards(rides: DataFrame, as_of: Column, days: int = 30, sports: Sequence[str] | None = None, by: str = "athlete_id") -> DataFrame:
    """Twelve values of the last `days` days up to as_of, and eight changes (`delta_...`) against the same number of days before.

    sports: rides of these alone.
    """
    on = F.to_date("date")
    now = (on > F.date_sub(as_of, days)) & (on <= as_of)
    before = (on > F.date_sub(as_of, 2 * days)) & (on <= F.date_sub(as_of, days))
    measures = {"rides": F.lit(1), "distance_m": F.col("distance_m"), "duration_s": F.col("duration_s"), "elevation_m": F.col("elevation_m"), "calories": F.coalesce("calories", F.lit(0)), "tss": F.col("tss")}
    total = lambda c, when: F.coalesce(F.sum(F.when(when, c.cast("double"))), F.lit(0.0))
    active = lambda when: F.count_distinct(F.when(when, on)).cast("double")
    longest = lambda when: F.coalesce(F.max(F.when(when, F.col("distance_m"))), F.lit(0.0))
    counted = {**{n: (total(c, now), total(c, before)) for n, c in measures.items()}, "active_days": (active(now), active(before)), "longest_m": (longest(now), longest(before))}
    means = {"avg_hr": F.avg, "avg_power": F.avg, "avg_speed_kmh": F.avg}
    mine = rides.where(F.col("sport_type").isin(*sports)) if sports else rides
    return mine.where(on > F.date_sub(as_of, 2 * days)).groupBy(by).agg(
        *(half_even(a, 1).alias(n) for n, (a, _) in counted.items()),
        *(half_even(a - b, 1).alias("delta_" + n) for n, (a, b) in counted.items()),
        *(half_even(f(F.when(now, F.col(c))), 1).alias(c) for c, f in means.items()),
        F.max(F.when(now, F.col("max_hr"))).alias("max_hr"),
    )


def streaks(rides: DataFrame, as_of: Column, by: str = "athlete_id") -> DataFrame:
    """athlete_id, streak: weeks in a row with a ride up to the week of as_of (0 if that one has none), longest: of all time."""
    weeks = rides.where(F.to_date("date") <= as_of).groupBy(by, F.trunc("date", "week").alias("week")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(by).orderBy("week")
    runs = weeks.withColumn("start", F.date_sub("week", (F.row_number().over(order) * 7))).groupBy(by, "start").agg(F.count(F.lit(1)).alias("weeks"), F.max("week").alias("last"))
    return runs.groupBy(by).agg(F.coalesce(F.max(F.when(F.col("last") == F.trunc(as_of, "week"), F.col("weeks"))), F.lit(0)).alias("streak"), F.max("weeks").alias("longest"))


def fitness_change(days: DataFrame, back: int = 42, by: str = "athlete_id") -> DataFrame:
    """athlete_id, ctl of the last day and its change over `back` days."""
    order = Window.partitionBy(by).orderBy("date")
    rows = days.withColumn("before", F.lag("ctl", back).over(order))
    return rows.groupBy(by).agg(F.max_by("ctl", "date").alias("ctl"), half_even(F.max_by(F.col("ctl") - F.col("before"), "date"), 2).alias("change"))


def type_mix(rides: DataFrame, by: str = "athlete_id") -> DataFrame:
    """athlete_id, month, and the number of rides of each sport."""
    return rides.groupBy(by, F.to_date(F.trunc("date", "month")).alias("month")).pivot("sport_type", list(SPORTS)).agg(F.count(F.lit(1))).na.fill(0, list(SPORTS))


def daily_by_type(rides: DataFrame, by: str = "athlete_id") -> DataFrame:
    """athlete_id, date, and the kilometres of each sport on that day."""
    rows = rides.groupBy(by, F.to_date("date").alias("date")).pivot("sport_type", list(SPORTS)).agg(F.sum("distance_m"))
    return rows.select(by, "date", *(half_even(F.coalesce(F.col(s), F.lit(0.0)) / F.lit(1000.0), 3).alias(s) for s in SPORTS))


def weekday_frequency(rides: DataFrame, by: str = "athlete_id") -> DataFrame:
    return rides.groupBy(by, F.weekday("date").alias("weekday")).agg(F.count(F.lit(1)).alias("rides"))


def bests(rides: DataFrame, as_of: Column, days: int = 90, by: str = "athlete_id") -> DataFrame:
    """Best values of the last days and of all time."""
    now = F.to_date("date") > F.date_sub(as_of, days)
    columns = ("distance_m", "elevation_m", "avg_speed_kmh", "avg_power")
    return rides.groupBy(by).agg(*(F.max(F.when(now, F.col(c))).alias("recent_" + c) for c in columns), *(F.max(c).alias("best_" + c) for c in columns))


def with_km(samples: DataFrame) -> DataFrame:
    """Samples with `km`: the whole kilometres ridden before each (one second a row).

    Speeds count in whole millionths of a km/h: sums of doubles fall short of kilometres that are reached exactly.
    """
    order = Window.partitionBy("activity_id").orderBy("time_offset").rowsBetween(Window.unboundedPreceding, 0)
    speed = F.coalesce(F.rint(F.col("speed_kmh") * F.lit(1e6)).try_cast("long"), F.lit(0).cast("long"))
    return samples.withColumn("km", F.floor(F.try_sum(speed).over(order) / F.lit(3_600_000_000)))


def zones_by_km(samples: DataFrame, ftp: Column, threshold_hr: Column, overall: bool = False) -> DataFrame:
    """activity_id, km, measure, zone, seconds; overall: of whole rides, `km` is null."""
    rows = samples.withColumn("km", F.lit(None).cast("long")) if overall else with_km(samples)
    power = rows.select("activity_id", "km", F.lit("power").alias("measure"), zone(F.col("power") / ftp.cast("double"), POWER_ZONES).alias("zone"))
    hr = rows.select("activity_id", "km", F.lit("hr").alias("measure"), zone(F.col("hr") / threshold_hr.cast("double"), HR_ZONES).alias("zone"))
    return power.unionByName(hr).where(F.col("zone").isNotNull()).groupBy("activity_id", "km", "measure", "zone").agg(F.count(F.lit(1)).alias("seconds"))


def power_against_hr(samples: DataFrame) -> DataFrame:
    """activity_id, power, hr, seconds: the scatter of both over a ride, coasting included."""
    both = samples.where(F.col("power").isNotNull() & F.col("hr").isNotNull())
    return both.groupBy("activity_id", "power", "hr").agg(F.count(F.lit(1)).alias("seconds"))


def decoupling(samples: DataFrame) -> DataFrame:
    """activity_id, ef_first, ef_second, drift_pct: power by heart rate in both halves of a ride, coasting included."""
    both = samples.where(F.col("power").isNotNull() & F.col("hr").isNotNull())
    half = F.ntile(2).over(Window.partitionBy("activity_id").orderBy("time_offset"))
    mean = lambda c, h: F.avg(F.when(F.col("half") == h, F.col(c)))
    rows = both.withColumn("half", half).groupBy("activity_id").agg((mean("power", 1) / mean("hr", 1)).alias("a"), (mean("power", 2) / mean("hr", 2)).alias("b"))
    return rows.select("activity_id", half_even(F.col("a"), 4).alias("ef_first"), half_even(F.col("b"), 4).alias("ef_second"), half_even((F.col("a") - F.col("b")) / F.when(F.col("a") != 0, F.col("a")) * F.lit(100.0), 2).alias("drift_pct"))


def splits(samples: DataFrame) -> DataFrame:
    """activity_id, km, seconds, avg_hr, fastest, slowest: each kilometre and its rank from both ends."""
    rows = with_km(samples).groupBy("activity_id", "km").agg(F.count(F.lit(1)).alias("seconds"), half_even(F.avg("hr"), 1).alias("avg_hr"))
    ride = Window.partitionBy("activity_id")
    return rows.withColumn("fastest", F.rank().over(ride.orderBy("seconds"))).withColumn("slowest", F.rank().over(ride.orderBy(F.col("seconds").desc())))


def speed_trend(rides: DataFrame, n: int = 10, by: str = "athlete_id") -> DataFrame:
    """id, rolling (mean speed of the last n rides), trend (the regression line's value), by the ride's number."""
    order = Window.partitionBy(by).orderBy("date", "id")
    rows = rides.where(F.col("avg_speed_kmh") > 0).withColumn("k", F.row_number().over(order)).withColumn("rolling", F.avg("avg_speed_kmh").over(order.rowsBetween(1 - n, 0)))
    line = rows.groupBy(by).agg(F.regr_slope("avg_speed_kmh", "k").alias("slope"), F.regr_intercept("avg_speed_kmh", "k").alias("start"))
    return rows.join(line, by).select(by, "id", half_even(F.col("rolling"), 3).alias("rolling"), half_even(F.col("start") + F.col("slope") * F.col("k"), 3).alias("trend"))


def weekly_candles(rides: DataFrame, by: str = "athlete_id") -> DataFrame:
    """athlete_id, week, first, high, low, last: mean power of a week's rides."""
    rows = rides.where(F.col("avg_power").isNotNull()).withColumn("_at", F.struct("date", "id"))
    return rows.groupBy(by, F.to_date(F.trunc("date", "week")).alias("week")).agg(F.min_by("avg_power", "_at").alias("first"), F.max("avg_power").alias("high"), F.min("avg_power").alias("low"), F.max_by("avg_power", "_at").alias("last"))


def polarization(rides: DataFrame, thresholds: DataFrame, by: str = "athlete_id") -> DataFrame:
    """athlete_id, month, low, middle, high: hours by the zone of the mean heart rate (1-2, 3, 4-5)."""
    rows = rides.join(thresholds, by).withColumn("zone", zone(F.col("avg_hr") / F.col("threshold_hr").cast("double"), HR_ZONES))
    hours = lambda low, high: half_even(F.sum(F.when(F.col("zone").between(low, high), F.col("duration_s")).otherwise(0)) / F.lit(3600.0), 2)
    return rows.groupBy(by, F.to_date(F.trunc("date", "month")).alias("month")).agg(hours(1, 2).alias("low"), hours(3, 3).alias("middle"), hours(4, 5).alias("high"))


def cumulative(rides: DataFrame, by: str = "athlete_id") -> DataFrame:
    """Six running totals by day with a ride."""
    measures = {"rides": F.count(F.lit(1)), **{c: F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in ("distance_m", "duration_s", "elevation_m", "calories", "tss")}}
    daily = rides.groupBy(by, F.to_date("date").alias("date")).agg(*(m.alias(n) for n, m in measures.items()))
    upto = Window.partitionBy(by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(by, "date", *(half_even(F.sum(c).over(upto), 4).alias("total_" + c) for c in measures))


def annual(rides: DataFrame, by: str = "athlete_id") -> DataFrame:
    """athlete_id, year, rides, km, hours, elevation_m."""
    return rides.groupBy(by, F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("rides"), half_even(F.sum("distance_m") / F.lit(1000.0), 3).alias("km"), half_even(F.sum("duration_s") / F.lit(3600.0), 3).alias("hours"), half_even(F.sum("elevation_m"), 1).alias("elevation_m"))


def monthly_power(rides: DataFrame, peaks: DataFrame, by: str = "athlete_id") -> DataFrame:
    """athlete_id, month, ftp (95 % of the best full 20 minutes of its rides; null without) and the month's best 1, 5 and 20 minutes.

    peaks: activity_id and best_60, best_300, best_1200 of rides, as of metrics.best_means.
    """
    rows = rides.join(peaks, rides["id"] == peaks["activity_id"])
    month = rows.groupBy(by, F.to_date(F.trunc("date", "month")).alias("month")).agg(*(F.max(f"best_{n}").alias(f"best_{n}") for n in (60, 300, 1200)))
    return month.select(by, "month", F.rint(F.col("best_1200") * F.lit(0.95)).cast("int").alias("ftp"), *(half_even(F.col(f"best_{n}"), 6).alias(f"best_{n}") for n in (60, 300, 1200)))


def monthly(rides: DataFrame, by: str = "athlete_id") -> DataFrame:
    """athlete_id, month, rides, km, and the km of the same month a year before."""
    rows = rides.groupBy(by, F.to_date(F.trunc("date", "month")).alias("month")).agg(F.count(F.lit(1)).alias("rides"), (F.sum("distance_m") / F.lit(1000.0)).alias("km"))
    before = rows.select(by, F.to_date(F.add_months("month", 12)).alias("month"), F.col("km").alias("before"))
    return rows.join(before, [by, "month"], "left").select(by, "month", "rides", half_even(F.col("km"), 3).alias("km"), half_even(F.col("before"), 3).alias("km_year_before"))


def records(rides: DataFrame, by: str = "athlete_id") -> DataFrame:
    """athlete_id, record, id, value: the ride that holds each record (the earliest one at ties)."""
    columns = ("distance_m", "elevation_m", "duration_s", "avg_speed_kmh")
    best = lambda c: F.min_by("id", F.struct((-F.col(c).cast("double")).alias("v"), "date", "id"))
    wide = rides.groupBy(by).agg(*(F.struct(F.lit(c).alias("record"), best(c).alias("id"), F.max(F.col(c).cast("double")).alias("value")).alias(c) for c in columns))
    return wide.select(by, F.explode(F.array(*columns)).alias("r")).select(by, "r.record", "r.id", "r.value")
