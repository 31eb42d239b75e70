"""Daily fitness, fatigue and form, rolling weeks, and the alerts on them. All by athlete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rounding import half_even

FITNESS_DAYS, FATIGUE_DAYS, BLOCK = 42, 7, 128


def daily(rides: DataFrame, by: str = "athlete_id") -> DataFrame:
    """athlete_id, date, tss, distance_m, elevation_m: sums by day, nulls as 0."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0.0))).alias(c)
    return rides.where(F.col("date").isNotNull()).groupBy(by, F.to_date("date").alias("date")).agg(total("tss"), total("distance_m"), total("elevation_m"))


def every_day(days: DataFrame, as_of: Column, by: str = "athlete_id") -> DataFrame:
    """All days from the athlete's first to the last or as_of, whichever is later; `n` counts from 0. Days without rides hold 0."""
    span = days.groupBy(by).agg(F.min("date").alias("first"), F.greatest(F.max("date"), as_of).alias("last"))
    calendar = span.select(by, F.posexplode(F.sequence("first", "last")).alias("n", "date"))
    filled = calendar.join(days, [by, "date"], "left")
    return filled.select(by, "n", "date", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("tss", "distance_m", "elevation_m")))


def averaged(days: DataFrame, span: int, name: str, by: str = "athlete_id", start: Column | None = None, first_block: Column | None = None) -> DataFrame:
    """The running average x <- x (1 - 1/span) + tss/span, without a loop over days.

    Within a block of days it is a sum of scaled terms, all positive, so it keeps its precision; a fold over the ends of
    the blocks before (a few dozen in a lifetime) gives what each block starts with. It begins from 0 on the first day, or
    from `start` where the rows begin with block `first_block`.
    """
    keep = 1.0 - 1.0 / span
    place, block = F.col("n") % BLOCK, F.floor(F.col("n") / BLOCK)
    in_block, in_athlete = Window.partitionBy(by, "_block").orderBy("n"), Window.partitionBy(by).orderBy("n")
    power = lambda k: F.pow(F.lit(keep), k.cast("double"))
    local = F.sum(F.col("tss") * F.lit(1.0 / span) * power(-place)).over(in_block) * power(place)
    rows = days.withColumn("_block", block).withColumn("_local", local)
    ends = F.collect_list(F.when(place == BLOCK - 1, F.col("_local"))).over(in_athlete.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # the ends that lie before this day's block
    before = F.slice("_ends", F.lit(1), (F.col("_block") - (first_block if first_block is not None else 0)).cast("int"))
    begin = F.aggregate(before, start if start is not None else F.lit(0.0), lambda x, e: x * F.lit(keep**BLOCK) + e)
    return rows.withColumn("_ends", ends).withColumn(name, F.col("_local") + power(place + 1) * begin).drop("_block", "_local", "_ends")


#: The columns of fitness(), and of the table that it can be continued from: n counts days, x_ctl and x_atl are not rounded.
SHOWN = ("date", "tss", "ctl", "atl", "tsb", "weekly_distance_m", "weekly_elevation_m")
STORED = "athlete_id long, n int, date date, tss double, distance_m double, elevation_m double, x_ctl double, x_atl double, ctl double, atl double, tsb double, weekly_distance_m double, weekly_elevation_m double"


def rounded(rows: DataFrame, by: str = "athlete_id") -> DataFrame:
    """Days with x_ctl and x_atl, and what is shown of them."""
    week = Window.partitionBy(by).orderBy("n").rowsBetween(-6, 0)
    return rows.withColumns(
        {
            "ctl": half_even(F.col("x_ctl"), 2),
            "atl": half_even(F.col("x_atl"), 2),
            "tsb": half_even(F.col("x_ctl") - F.col("x_atl"), 2),
            "weekly_distance_m": half_even(F.sum("distance_m").over(week), 1),
            "weekly_elevation_m": half_even(F.sum("elevation_m").over(week), 1),
        }
    )


def fitness(days: DataFrame, as_of: Column, by: str = "athlete_id") -> DataFrame:
    """athlete_id, date, tss, ctl, atl, tsb, weekly_distance_m, weekly_elevation_m of every day up to as_of."""
    rows = averaged(averaged(every_day(days, as_of, by), FITNESS_DAYS, "x_ctl", by), FATIGUE_DAYS, "x_atl", by)
    return rounded(rows, by).select(by, *SHOWN)


def resumed_from(stored: DataFrame, days: DataFrame, as_of: Column, by: str = "athlete_id") -> DataFrame:
    """athlete_id, from_n: the begin of the block of the first day that is not in `stored` as it is now.

    A first ride that is earlier or later than it was moves all days: then from_n is 0. Athletes without anything new are left out.
    """
    values = ("tss", "distance_m", "elevation_m")
    old = stored.select(by, "date", *(F.col(c).alias("_" + c) for c in values), F.lit(True).alias("_known"))
    differ = lambda c: F.coalesce(F.col(c), F.lit(0.0)) != F.coalesce("_" + c, F.lit(0.0))
    both = days.join(old, [by, "date"], "full_outer")
    changed = both.where(F.col("_known").isNull() | differ(values[0]) | differ(values[1]) | differ(values[2])).groupBy(by).agg(F.min("date").alias("changed"))
    span = days.groupBy(by).agg(F.min("date").alias("first"), F.greatest(F.max("date"), as_of).alias("last"))
    was = stored.groupBy(by).agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
    rows = span.join(was, by, "left").join(changed, by, "left")
    moved = ~F.col("first").eqNullSafe(F.col("_first")) | (F.col("last") < F.col("_last"))
    new = F.least(F.col("changed"), F.when(F.col("last") > F.col("_last"), F.date_add("_last", 1)))
    n = F.when(moved, 0).otherwise(F.datediff(new, F.col("first")))
    return rows.select(by, (F.floor(n / BLOCK) * BLOCK).cast("int").alias("from_n")).where(F.col("from_n").isNotNull())


def continued(stored: DataFrame, days: DataFrame, resumed: DataFrame, as_of: Column, by: str = "athlete_id") -> DataFrame:
    """The columns of STORED for the days from each athlete's from_n on (resumed_from()), started from the stored day before."""
    before = stored.join(resumed, by).where(F.col("n") == F.col("from_n") - 1).select(by, F.col("x_ctl").alias("_ctl"), F.col("x_atl").alias("_atl"))
    rows = every_day(days, as_of, by).join(resumed, by).join(before, by, "left")
    recent = rows.where(F.col("n") >= F.col("from_n") - 6)
    first, start = F.floor(F.col("from_n") / BLOCK), lambda c: F.coalesce(c, F.lit(0.0))
    weeks = rounded(recent.withColumns({"x_ctl": F.lit(0.0), "x_atl": F.lit(0.0)}), by).where(F.col("n") >= F.col("from_n")).drop("x_ctl", "x_atl", "ctl", "atl", "tsb")
    both = averaged(averaged(weeks, FITNESS_DAYS, "x_ctl", by, start("_ctl"), first), FATIGUE_DAYS, "x_atl", by, start("_atl"), first)
    shown = both.withColumns({"ctl": half_even(F.col("x_ctl"), 2), "atl": half_even(F.col("x_atl"), 2), "tsb": half_even(F.col("x_ctl") - F.col("x_atl"), 2)})
    return shown.select([c.split()[0] for c in STORED.split(", ")])


def latest(days: DataFrame, by: str = "athlete_id") -> DataFrame:
    """Each athlete's last day."""
    return days.groupBy(by).agg(F.max("date").alias("date"), *(F.max_by(c, "date").alias(c) for c in ("ctl", "atl", "tsb")))


def alerts(days: DataFrame, rides: DataFrame, as_of: Column, by: str = "athlete_id") -> DataFrame:
    """athlete_id, lowest_tsb of the last two days, days_idle; overtraining below -25, idle above 5 days."""
    last = Window.partitionBy(by).orderBy(F.col("date").desc())
    low = days.withColumn("_n", F.row_number().over(last)).where("_n <= 2").groupBy(by).agg(F.min("tsb").alias("lowest_tsb"))
    idle = rides.groupBy(by).agg(F.datediff(as_of, F.to_date(F.max("date"))).alias("days_idle"))
    return low.join(idle, by).select(by, "lowest_tsb", "days_idle", (F.col("lowest_tsb") < -25).alias("overtrained"), (F.col("days_idle") > 5).alias("idle"))
