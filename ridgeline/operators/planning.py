"""Days and hours to ride, and the week's recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, parse, training, weather
from ..functions.rounding import half_even
from . import nearby
from .history import suggested_routes
from .waypoints import BROADCAST_ANSWERS, answered

GOOD_DAY, GOOD_DAYS = 60, 3
#: How much longer a route is than the straight line, and what the routing service is asked for by surface.
ROAD_FACTOR = 1.3
COSTING = {"road": ("bicycle", "Road", 0.3), "gravel": ("bicycle", "Cross", 0.5), "mtb": ("mountain_bike", None, None)}


def forecast_days(reports: DataFrame) -> DataFrame:
    """One row per day of forecast reports: struct `daily` and struct `hourly` of parallel arrays, as services send them.

    hours: array<struct<time, temp, wind, wind_dir, precip, uv>> of that day; values that a short array lacks are 0.
    """
    at = lambda c: F.coalesce(F.get(f"daily.{c}", F.col("i")).cast("double"), F.lit(0.0))
    hour = lambda c, i: F.coalesce(F.get(f"hourly.{c}", i).cast("double"), F.lit(0.0))
    places = F.sequence(F.lit(0), F.size("hourly.time") - 1)
    hours = F.transform(
        F.when(F.size("hourly.time") > 0, places).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            F.get("hourly.time", i).alias("time"), hour("temperature_2m", i).alias("temp"), hour("windspeed_10m", i).alias("wind"), hour("winddirection_10m", i).alias("wind_dir"), hour("precipitation", i).alias("precip"), hour("uv_index", i).alias("uv")
        ),
    )
    rows = reports.withColumn("_hours", hours).select("*", F.posexplode("daily.time").alias("i", "date"))
    flat = rows.select("date", at("temperature_2m_max").alias("temp_max"), at("temperature_2m_min").alias("temp_min"), at("precipitation_sum").alias("precip"), at("windspeed_10m_max").alias("wind"), at("uv_index_max").alias("uv_max"), at("weathercode").cast("int").alias("code"), F.filter("_hours", lambda h: F.startswith(h["time"], F.col("date"))).alias("hours"))
    return scored_days(flat)


def scored_days(days: DataFrame) -> DataFrame:
    """Days with their score and the words for their weather."""
    score = weather.day_score(F.col("precip"), F.col("wind"), F.col("temp_max"), F.col("code"), F.col("uv_max"))
    return days.withColumn("score", score).withColumn("weather", weather.weather_words(F.col("code")))


def scored_hours(hours: DataFrame) -> DataFrame:
    """Daylight hours (6 to 20) with their score and their place among the hours of their day, the best first."""
    light = hours.where(F.substring("time", 12, 2).cast("int").between(6, 20))
    score = weather.hour_score(F.col("precip"), F.col("wind"), F.col("temp"), F.col("uv"))
    order = Window.partitionBy(F.substring("time", 1, 10)).orderBy(F.col("score").desc(), "time")
    return light.withColumn("score", score).withColumn("place", F.row_number().over(order))


def ride_days(days: DataFrame, start: Column, length: int = 7) -> DataFrame:
    """Of a week from `start` on: the first three days of 60 or more; without any, the best day (earliest at ties)."""
    week = days.where((F.col("date") >= start) & (F.col("date") < F.date_add(start, length)))
    good = F.col("score") >= GOOD_DAY
    by_date, by_score = Window.orderBy("date"), Window.orderBy(F.col("score").desc(), "date")
    ranked = week.withColumn("_good", F.sum(good.cast("int")).over(by_date)).withColumn("_best", F.row_number().over(by_score)).withColumn("_any", F.max(good.cast("int")).over(Window.partitionBy()))
    return ranked.where((good & (F.col("_good") <= GOOD_DAYS)) | ((F.col("_any") == 0) & (F.col("_best") == 1))).select("date", "score", "weather", F.when(F.col("_any") == 1, "good day").otherwise("least bad").alias("advice"))


def fitted_plans(form: DataFrame, speeds: DataFrame, minutes: int, surface: str, by: str = "athlete_id") -> DataFrame:
    """athlete_id, km, fitted_km, form: the distance of a ride of some minutes at the athlete's speed, cut for the tired."""
    speed = F.col("road" if surface == "road" else "offroad" if surface in ("gravel", "mtb") else "any")
    rows = form.join(speeds, by, "left").withColumn("km", training.planned_distance(F.lit(minutes), F.lit(surface), speed))
    return rows.select(by, "km", training.fitted_distance(F.col("km"), F.col("tsb")).alias("fitted_km"), training.form_word(F.col("tsb")).alias("form"))


def with_forecast(rides: DataFrame, days: DataFrame, on: str = "ride_date") -> DataFrame:
    """Rides with `weather` and `weather_score` of the forecast for their day; null without one."""
    known = days.groupBy(F.col("date").alias("_date")).agg(F.min_by("weather", "score").alias("weather"), F.min("score").alias("weather_score"))
    return rides.join(known, F.col(on) == F.col("_date"), "left").drop("_date")


def locations(start: Column, points: Column, destination: Column, loop: Column, km: Column) -> Column:
    """array<struct<lat, lng>> that a routing service is asked to connect.

    The start, the waypoints (without any, and without a destination, a circle of about km), the destination, and for
    loops the start again; without a destination every route is a loop.
    """
    some = F.size(F.coalesce(points, F.array().cast("array<struct<lat:double,lng:double>>"))) > 0
    circle = F.when(destination.isNull(), geo.loop_points(start["lat"], start["lng"], km)).otherwise(F.array().cast("array<struct<lat:double,lng:double>>"))
    back = F.when(destination.isNull() | loop, F.array(start)).otherwise(F.array().cast("array<struct<lat:double,lng:double>>"))
    end = F.when(destination.isNotNull(), F.array(destination)).otherwise(F.array().cast("array<struct<lat:double,lng:double>>"))
    return F.concat(F.array(start), F.when(some, points).otherwise(circle), end, back)


def costing(surface: Column, safety: Column) -> Column:
    """struct<costing, bicycle_type, use_roads, use_hills>: the routing service's profile; safe routes keep off roads."""
    of = lambda k: F.coalesce(*(F.when(surface == name, F.lit(v[k])) for name, v in COSTING.items()))
    known = surface.isin(*COSTING)
    roads = F.when(known, half_even(F.lit(1.0) - F.least(F.lit(1.0), F.greatest(F.lit(0.0), safety)), 1))
    return F.struct(F.coalesce(of(0), F.lit("bicycle")).alias("costing"), of(1).alias("bicycle_type"), roads.alias("use_roads"), of(2).cast("double").alias("use_hills"))


def sized(requests: DataFrame, form: DataFrame, speeds: DataFrame, by: str = "athlete_id") -> DataFrame:
    """Requests with target_km (as asked), km (cut for the tired), minutes, loop and straight (km to the destination).

    A distance counts before a duration, a duration before a destination alone; without any of them target_km is null.
    """
    minutes, km = F.col("_minutes"), F.col("_km")
    surface, destination = F.col("surface"), F.col("destination")
    rows = requests.join(form.select(by, "tsb"), by, "left").join(speeds, by, "left")
    rows = rows.withColumn("_minutes", F.when(parse.minutes(F.col("duration")) > 0, parse.minutes(F.col("duration")))).withColumn("_km", F.when(parse.kilometres(F.col("distance")) != 0, parse.kilometres(F.col("distance"))))
    own = F.when(surface == "road", F.col("road")).when(surface.isin("gravel", "mtb"), F.col("offroad")).otherwise(F.col("any"))
    rows = rows.withColumn("_speed", training.usual_speed(surface, own)).withColumn("loop", F.coalesce("loop", destination.isNull()))
    straight = geo.distance_km(F.col("start.lat"), F.col("start.lng"), F.col("destination.lat"), F.col("destination.lng"))
    turns = F.when(F.col("loop"), 2).otherwise(1)
    there = half_even(straight * F.lit(ROAD_FACTOR), 1)
    target = F.coalesce(km, training.planned_distance(minutes, surface, own), there * turns)
    lasts = F.coalesce(F.floor(km / F.col("_speed") * 60), F.when(km.isNull(), minutes), F.floor(there / F.col("_speed") * 60) * turns)
    return rows.withColumn("target_km", target).withColumn("minutes", lasts.cast("int")).withColumn("km", training.fitted_distance(F.col("target_km"), F.col("tsb"))).withColumn("straight", straight)


def planned(requests: DataFrame, form: DataFrame, speeds: DataFrame, days: DataFrame, as_of: Column, by: str = "athlete_id", answers: DataFrame | None = None) -> DataFrame:
    """Requests for a ride, worked out: distance, time, day, weather, name, and what the routing service is asked for.

    requests: id, athlete_id, duration, distance, surface, day, clock (texts), start and destination (struct<lat, lng>),
    destination_name, loop, safety, waypoints (array<struct<lat, lng>>, null without). form: athlete_id, tsb. speeds: as of
    usual_speeds. days: scored days. Without a distance, duration or destination `error` tells so. answers: the
    waypoints.answers() to requests that name none (with a column `explore`). Towards a destination that is nearer than the wanted distance the
    route makes detours instead. The waypoints' names end the ride's name.
    """
    surface, destination = F.col("surface"), F.col("destination")
    rows = sized(requests, form, speeds, by)
    detours = geo.corridor_points((F.col("start.lat"), F.col("start.lng")), (F.col("destination.lat"), F.col("destination.lng")), F.col("km"), F.col("straight") * F.lit(ROAD_FACTOR))
    points = F.when(destination.isNotNull(), detours)
    via = F.lit("")
    if answers is not None:
        rows = answered(rows, nearby.small(answers, BROADCAST_ANSWERS), {"athlete_id": F.col(by), "lat": F.col("start.lat"), "lng": F.col("start.lng"), "km": F.col("km"), "explore": F.col("explore")})
        found = F.transform("chosen", lambda p: F.struct(p["lat"].alias("lat"), p["lng"].alias("lng")))
        points = F.coalesce(F.when(F.size(points) > 0, points), found)
        via = F.when(F.col("waypoints").isNull() & (F.size("chosen") > 0), F.concat(F.lit(" via "), F.array_join("chosen.name", ", "))).otherwise("")
    points = F.coalesce("waypoints", points)
    title = F.initcap(surface)
    named = F.coalesce(
        F.when(destination.isNotNull(), F.concat(title, F.lit(" to "), F.col("destination_name"))),
        F.when(F.col("_km").isNotNull(), F.concat(F.rint("_km").cast("long").cast("string"), F.lit("km "), title)),
        F.concat(F.floor(F.col("_minutes") / 60).cast("string"), F.lit("h"), F.lpad((F.col("_minutes") % 60).cast("string"), 2, "0"), F.lit("m "), title),
    )
    error = F.when(F.col("target_km").isNull(), "give a duration, a distance or a destination")
    rows = rows.select(
        "id", by, "target_km", "km", "minutes", training.form_word(F.col("tsb")).alias("form"), parse.ride_day(F.col("day"), as_of).alias("ride_date"), parse.clock_time(F.col("clock")).alias("clock"),
        F.concat(named, via).alias("name"), F.when(error.isNull(), locations(F.col("start"), points, destination, F.col("loop"), F.col("km"))).alias("locations"), costing(surface, F.col("safety")).alias("costing"), error.alias("error"),
    )
    return with_forecast(rows, days)


def recommended(form: DataFrame, routes: DataFrame, days: DataFrame, start: Column, by: str = "athlete_id") -> DataFrame:
    """athlete_id, section, place, line: each athlete's form and routes that fit it, and the week's days to ride (athlete_id null, as they are everyone's)."""
    sign = lambda c: F.concat(F.when(c >= 0, "+").otherwise("-"), F.format_string("%d", F.rint(F.abs(c)).cast("long")))
    forms = form.where(F.col("tsb").isNotNull()).select(by, F.lit("form").alias("section"), F.lit(1).alias("place"), F.concat(training.form_word(F.col("tsb")), F.lit(" (form "), sign(F.col("tsb")), F.lit(")")).alias("line"))
    chosen = suggested_routes(routes, form)
    km = F.format_string("%.1f", half_even(F.col("distance_m") / 1000, 1))
    suggestions = chosen.select(by, F.lit("route").alias("section"), "place", F.concat("name", F.lit(", "), km, F.lit(" km, "), F.rint("elevation_m").cast("long").cast("string"), F.lit(" m up, last "), F.date_format("date", "yyyy-MM-dd")).alias("line"))
    week = ride_days(days, start).select(F.lit(None).cast(form.schema[by].dataType).alias(by), F.lit("day").alias("section"), F.row_number().over(Window.orderBy("date")).alias("place"), F.concat("advice", F.lit(": "), F.date_format("date", "yyyy-MM-dd"), F.lit(", "), "weather", F.lit(", "), F.col("score").cast("string")).alias("line"))
    return forms.unionByName(suggestions).unionByName(week)
