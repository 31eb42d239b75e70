"""Metrics of rides from their samples, thresholds, and stress. `derived` reads and shuffles the samples once, by ride."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import training as tr
from ..functions.rounding import half_even, micros

TWENTY_MINUTES, LOOK_BACK_DAYS = 1200, 90
DAY_MICROS = 86_400_000_000


def in_ride(key: str = "activity_id") -> Window:
    return Window.partitionBy(key).orderBy("time_offset")


def with_means(power: DataFrame, rows: Sequence[int], order: Window | None = None) -> DataFrame:
    """power with `k` (the row's number in its ride) and for each number of rows n the sum of the last n rows' power (`sum_n`).

    Sums are differences of one running sum of whole numbers, so they are exact and cost the same for any n.
    """
    order = order if order is not None else in_ride()
    running = power.withColumn("k", F.row_number().over(order)).withColumn("upto", F.sum(F.col("power").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return running.withColumns({f"sum_{n}": F.col("upto") - F.coalesce(F.lag("upto", n).over(order), F.lit(0)) for n in rows}).drop("upto")


def best(n: int, full: bool) -> Column:
    """The best mean of n rows; not full: the first rows' shorter windows count too."""
    mean = F.col(f"sum_{n}") / F.least(F.col("k"), F.lit(n))
    return F.max(F.when(F.col("k") >= n, mean) if full else mean)


def raw_np() -> Column:
    """The fourth root of the mean fourth power of 30-row means, which divide by 30 from the first row on."""
    return F.pow(F.avg(F.pow(F.col("sum_30") / F.lit(30.0), F.lit(4.0))), F.lit(0.25))


def with_power_metrics(rides: DataFrame, least: int) -> DataFrame:
    """np and work_kj of rides with n, raw and joule; null up to `least` samples, and where the normalised power is 0."""
    np = F.when(F.col("n") > least, half_even(F.col("raw"), 1))
    return rides.withColumn("np", F.when(np > 0, np)).withColumn("work_kj", F.when(np > 0, half_even(F.col("joule") / F.lit(1000.0), 1)))


def power_metrics(samples: DataFrame, least: int = 30) -> DataFrame:
    """activity_id, np, work_kj of every ride with more than `least` power samples.

    Normalised power is null where it is 0; the work is then null as well.
    """
    power = samples.where(F.col("power").isNotNull()).select("activity_id", "time_offset", "power")
    rides = with_means(power, (30,)).groupBy("activity_id").agg(F.count(F.lit(1)).alias("n"), raw_np().alias("raw"), F.sum("power").alias("joule"))
    return with_power_metrics(rides, least).where(F.col("n") > least).select("activity_id", "np", "work_kj")


def heart_rate_loads(samples: DataFrame, max_hr: Column, resting_hr: Column) -> DataFrame:
    """activity_id, trimp of every ride with a heart rate. max_hr, resting_hr: of the sample's athlete."""
    return samples.where(F.col("hr").isNotNull()).groupBy("activity_id").agg(half_even(F.sum(tr.heart_rate_load(F.col("hr"), max_hr, resting_hr)), 1).alias("trimp"))


def best_means(samples: DataFrame, rows: Sequence[int] = (TWENTY_MINUTES,), full: bool = True) -> DataFrame:
    """activity_id and for each number of rows n the ride's best mean power over n rows in a row (`best_n`).

    full: windows of fewer rows do not count; else the first rows' shorter windows do. One sort serves all windows.
    """
    power = samples.where(F.col("power").isNotNull()).select("activity_id", "time_offset", "power")
    return with_means(power, rows).groupBy("activity_id").agg(*(best(n, full).alias(f"best_{n}") for n in rows))


def profiles(samples: DataFrame, rides: DataFrame, resting_hr: int, least: int = 30) -> DataFrame:
    """activity_id, np, work_kj, best (full windows of 20 minutes), first (shorter ones too) and trimp of each of the rides.

    rides: activity_id and threshold_hr. The samples meet their ride once; windows and sums then stay within the ride.
    """
    met = samples.select("activity_id", "time_offset", "power", "hr").join(rides, "activity_id")
    powered = F.col("power").isNotNull()
    rows = with_means(met.withColumn("powered", powered), (30, TWENTY_MINUTES), Window.partitionBy("activity_id", "powered").orderBy("time_offset"))
    of = lambda c: F.when(F.col("powered"), c)
    mean = F.col(f"sum_{TWENTY_MINUTES}") / F.least(F.col("k"), F.lit(TWENTY_MINUTES))
    fourth = F.pow(F.col("sum_30") / F.lit(30.0), F.lit(4.0))
    load = F.when(F.col("hr").isNotNull(), tr.heart_rate_load(F.col("hr"), F.col("threshold_hr"), F.lit(resting_hr)))
    sums = rows.groupBy("activity_id").agg(
        F.count_if("powered").alias("n"),
        F.pow(F.avg(of(fourth)), F.lit(0.25)).alias("raw"),
        F.sum("power").alias("joule"),
        F.max(of(F.when(F.col("k") >= TWENTY_MINUTES, mean))).alias("best"),
        F.max(of(mean)).alias("first"),
        half_even(F.sum(load), 1).alias("trimp"),
    )
    return with_power_metrics(sums, least).select("activity_id", "np", "work_kj", "best", "first", "trimp")


def measured_limit() -> Column:
    """The 95th percentile of the rides' maximum heart rates, cut to a whole number; the default without any."""
    p = F.percentile(F.when(F.col("max_hr") > 0, F.col("max_hr")), F.lit(0.95)).cast("int")
    return F.when(p > 0, p).otherwise(tr.DEFAULT_THRESHOLD_HR)


def threshold_hr(rides: DataFrame, by: str = "athlete_id") -> DataFrame:
    """athlete_id, threshold_hr."""
    return rides.groupBy(by).agg(measured_limit().alias("threshold_hr"))


def limits(rides: DataFrame, max_hr: int | None = None, by: str = "athlete_id") -> DataFrame:
    """athlete_id, threshold_hr and usual, the 95th percentile of the rides' mean power, cut to a whole number."""
    usual = F.percentile(F.when(F.col("avg_power") > 0, F.col("avg_power")), F.lit(0.95)).cast("int")
    return rides.groupBy(by).agg((F.lit(max_hr) if max_hr else measured_limit()).alias("threshold_hr"), usual.alias("usual"))


def is_recent(as_of: Column, days: int) -> Column:
    return (F.col("avg_power") > 0) & (F.col("date") >= F.date_sub(as_of, days).cast("timestamp"))


def estimated_ftp(peak: Column, usual: Column) -> Column:
    """95 % of the best mean; else the usual power, else the default."""
    watts = F.rint(peak * F.lit(0.95)).cast("int")
    return F.when(watts > 0, watts).when(usual > 0, usual).otherwise(tr.DEFAULT_FTP)


def threshold_power(rides: DataFrame, samples: DataFrame, as_of: Column, days: int = LOOK_BACK_DAYS, by: str = "athlete_id") -> DataFrame:
    """athlete_id, ftp as of a day: 95 % of the best 20-minute mean of recent rides with power.

    Short windows count (a ride's first samples too), as published. Without samples the 95th percentile of the rides'
    mean power, without that the default.
    """
    recent = rides.where(is_recent(as_of, days)).select(F.col("id").alias("activity_id"), by)
    peaks = best_means(samples.join(recent, "activity_id", "left_semi"), full=False).join(recent, "activity_id")
    found = peaks.groupBy(by).agg(F.max(f"best_{TWENTY_MINUTES}").alias("peak"))
    return limits(rides, by=by).join(found, by, "left").select(by, estimated_ftp(F.col("peak"), F.col("usual")).alias("ftp"))


def before_ride(days: int, by: str) -> Window:
    """The athlete's rides from `days` days to one day before a ride; rides have `at`, their start in microseconds."""
    return Window.partitionBy(by).orderBy("at").rangeBetween(-days * DAY_MICROS, -DAY_MICROS)


def ride_threshold_power(rides: DataFrame, samples: DataFrame, fallback: DataFrame, days: int = LOOK_BACK_DAYS, by: str = "athlete_id") -> DataFrame:
    """id, ride_ftp: 95 % of the best full 20-minute mean of the athlete's rides from `days` days to one day before, else `ftp` of fallback.

    Every ride's samples are windowed once; the look-back runs over one row a ride.
    """
    peaks = best_means(samples)
    dated = rides.where(F.col("date").isNotNull()).select("id", by, micros("date").alias("at"))
    found = dated.join(peaks, dated["id"] == peaks["activity_id"], "left").withColumn("best", F.max(f"best_{TWENTY_MINUTES}").over(before_ride(days, by)))
    return found.join(fallback, by, "left").select("id", F.coalesce(F.rint(F.col("best") * F.lit(0.95)), F.col("ftp"), F.lit(tr.DEFAULT_FTP)).cast("double").alias("ride_ftp"))


def lacking_threshold(rides: DataFrame, by: str = "athlete_id") -> DataFrame:
    """athlete_id, n: how many of the rides with a date have no threshold power yet."""
    return rides.groupBy(by).agg(F.count_if(F.col("ride_ftp").isNull() & F.col("date").isNotNull()).alias("n"))


def with_stress(rides: DataFrame) -> DataFrame:
    """tss and intensity_factor of rides with np, avg_power, avg_hr, duration_s, ride_ftp, ftp and threshold_hr.

    Normalised power comes first, then mean power, then heart rate; else the stress is 0.
    """
    ftp = F.when(F.col("ride_ftp") > 0, F.col("ride_ftp")).otherwise(F.col("ftp"))
    stress = (
        F.when(F.col("np") > 0, tr.power_stress(F.col("duration_s"), F.col("np"), ftp))
        .when(F.col("avg_power") > 0, tr.power_stress(F.col("duration_s"), F.col("avg_power"), ftp))
        .when(F.col("avg_hr") > 0, tr.heart_rate_stress(F.col("duration_s"), F.col("avg_hr"), F.col("threshold_hr")))
        .otherwise(F.lit(0.0))
    )
    return rides.withColumn("tss", half_even(stress, 1)).withColumn("intensity_factor", tr.ratio(F.col("np"), ftp))


def derived(rides: DataFrame, samples: DataFrame, as_of: Column, ftp: int | None = None, max_hr: int | None = None, resting_hr: int = tr.DEFAULT_RESTING_HR, by: str = "athlete_id") -> DataFrame:
    """All metrics of all rides with a date: id, athlete_id, date, distance_m, elevation_m and the columns of RIDE_METRICS.

    ftp, max_hr: configured values take the place of estimates for every athlete.
    """
    dated = rides.where(F.col("date").isNotNull())
    own = limits(dated, max_hr, by)
    ridden = dated.select(F.col("id").alias("activity_id"), by).join(own.select(by, "threshold_hr"), by).drop(by)
    found = profiles(samples, ridden, resting_hr).withColumnRenamed("activity_id", "id")
    return with_thresholds(dated.join(found, "id", "left").join(own, by), as_of, ftp, by)


def with_thresholds(full: DataFrame, as_of: Column, ftp: int | None = None, by: str = "athlete_id") -> DataFrame:
    """`derived` from rides with their profiles, threshold_hr and usual; a ride_ftp that a ride has already stays."""
    if ftp:
        rows = full.withColumn("ftp", F.lit(ftp)).withColumn("own_ftp", F.lit(float(ftp)))
    else:
        everything = Window.partitionBy(by)
        peak = F.max(F.when(is_recent(as_of, LOOK_BACK_DAYS), F.col("first"))).over(everything)
        rows = full.withColumn("ftp", estimated_ftp(peak, F.col("usual"))).withColumn("at", micros("date"))
        rows = rows.withColumn("own_ftp", F.coalesce(F.rint(F.max("best").over(before_ride(LOOK_BACK_DAYS, by)) * F.lit(0.95)), F.col("ftp")).cast("double"))
    rows = rows.withColumn("ride_ftp", F.coalesce("ride_ftp", "own_ftp") if "ride_ftp" in full.columns else F.col("own_ftp"))
    rows = rows.withColumn("ef", tr.ratio(F.col("np"), F.col("avg_hr"))).withColumn("variability_index", tr.ratio(F.col("np"), F.col("avg_power")))
    elevation = F.col("elevation_m") if "elevation_m" in full.columns else F.lit(0.0)
    return with_stress(rows).select("id", by, "date", "distance_m", elevation.alias("elevation_m"), "np", "ef", "work_kj", "variability_index", "ride_ftp", "tss", "intensity_factor", "trimp", "best", "first")
