"""What riders ask of their past rides: usual speed, recent and recommended routes, ridden places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..functions.rounding import half_even, present

LEAST_DISTANCE_M, LEAST_RIDES = 5000, 5


def outdoor(rides: DataFrame) -> DataFrame:
    return rides.where((F.col("sport_type") == "cycling_outdoor") & (F.col("distance_m") > LEAST_DISTANCE_M))


def usual_speeds(rides: DataFrame, by: str = "athlete_id") -> DataFrame:
    """athlete_id, road, offroad, any: exact median speeds, one decimal. road: above 22 km/h, offroad: below 25; both need five rides, else any's."""
    v = F.col("avg_speed_kmh")
    parts = {"road": F.when(v > 22, v), "offroad": F.when((v > 0) & (v < 25), v), "any": F.when(v > 0, v)}
    sums = outdoor(rides).groupBy(by).agg(*(F.percentile(c, F.lit(0.5)).alias(n) for n, c in parts.items()), *(F.count(c).alias("n_" + n) for n, c in parts.items()))
    enough = lambda n: F.when(F.col("n_" + n) >= LEAST_RIDES, present(half_even(F.col(n), 1)))
    overall = present(half_even(F.col("any"), 1))
    return sums.select(by, F.coalesce(enough("road"), overall).alias("road"), F.coalesce(enough("offroad"), overall).alias("offroad"), overall.alias("any"))


def recent_routes(rides: DataFrame, n: int = 50, by: str = "athlete_id") -> DataFrame:
    """Each athlete's n latest outdoor rides above 5 km; rides without a date come first."""
    order = Window.partitionBy(by).orderBy(F.col("date").desc_nulls_first(), "id")
    return outdoor(rides).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select(by, "id", "name", "distance_m", "elevation_m", "sport_type", "date", "place")


def suggested_routes(routes: DataFrame, form: DataFrame, n: int = 3, by: str = "athlete_id") -> DataFrame:
    """Each athlete's n routes by form (athlete_id, tsb): short ones for the tired, long ones for the fresh, else the latest.

    Of routes with the same length (whole km) and climb (50 m steps) the first one stays.
    """
    tired, fresh = F.col("tsb") < -10, F.col("tsb") > 10
    order = [F.when(tired, F.col("distance_m")).when(fresh, -F.col("distance_m")), F.col("date").desc_nulls_last(), F.col("id")]
    rows = routes.join(form.select(by, "tsb"), by, "left").withColumn("km", F.rint(F.col("distance_m") / 1000)).withColumn("climb", F.rint(F.col("elevation_m") / 50) * 50)
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(by, "km", "climb").orderBy(*order))).where("_n = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= n).select(by, "place", "id", "name", "distance_m", "elevation_m", "date")


def density(samples: DataFrame, rides: DataFrame, lat: float, lng: float, radius_km: float, as_of: Column, days: int | None = 30) -> DataFrame:
    """cell_lat, cell_lng, n: every 30th second's place of the last days near a centre, counted by grid cell. days None: of all time."""
    near = geo.in_box(F.col("lat"), F.col("lng"), lat, lng, radius_km / 111.0 * 1.5, radius_km / 80.0 * 1.5)
    seen = samples.where(near & (F.col("time_offset") % 30 == 0)).select("activity_id", "lat", "lng")
    recent = rides.where(F.col("date") >= F.date_sub(as_of, days).cast("timestamp")) if days is not None else rides
    mine = seen.join(recent.select(F.col("id").alias("activity_id")), "activity_id", "left_semi")
    return mine.groupBy(geo.cell(F.col("lat")).alias("cell_lat"), geo.cell(F.col("lng")).alias("cell_lng")).agg(F.count(F.lit(1)).alias("n"))


def ridden_cells(samples: DataFrame, rides: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """athlete_id, cell_lat, cell_lng, n: density() by athlete, wherever they have ridden."""
    seen = samples.where(F.col("lat").isNotNull() & F.col("lng").isNotNull() & (F.col("time_offset") % 30 == 0)).select("activity_id", "lat", "lng")
    recent = rides.where(F.col("date") >= F.date_sub(as_of, days).cast("timestamp")).select(F.col("id").alias("activity_id"), "athlete_id")
    return seen.join(recent, "activity_id").groupBy("athlete_id", geo.cell(F.col("lat")).alias("cell_lat"), geo.cell(F.col("lng")).alias("cell_lng")).agg(F.count(F.lit(1)).alias("n"))


def with_density(places: DataFrame, cells: DataFrame) -> DataFrame:
    """`density` of each place: 0 to 1, ten visits to its cell are 1."""
    keyed = places.withColumn("cell_lat", geo.cell(F.col("lat"))).withColumn("cell_lng", geo.cell(F.col("lng")))
    return keyed.join(cells, ["cell_lat", "cell_lng"], "left").withColumn("density", F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / F.lit(10.0))).drop("n", "cell_lat", "cell_lng")
