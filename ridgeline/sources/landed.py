"""Landed files of recording and weather services, and files for riders.

Services are asked by whatever lands their answers; the engine reads folders of JSON, in batches or as a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import schema

#: One recording as services send it: a list of measures with their values (places have two a value).
STREAM_ANSWER = "id bigint, streams array<struct<type:string,data:array<string>>>"

FORECAST_ANSWER = (
    "struct<daily:struct<time:array<string>,temperature_2m_max:array<double>,temperature_2m_min:array<double>,precipitation_sum:array<double>,windspeed_10m_max:array<double>,weathercode:array<int>,uv_index_max:array<double>>,"
    "hourly:struct<time:array<string>,temperature_2m:array<double>,windspeed_10m:array<double>,winddirection_10m:array<double>,precipitation:array<double>,uv_index:array<double>>>"
)


#: The column that holds the text of a line that is no ride.
BROKEN = "_broken"


def with_broken() -> StructType:
    return StructType([*schema.RAW_RIDE.fields, StructField(BROKEN, StringType())])


def listed_rides(spark: SparkSession, path: str) -> DataFrame:
    """Listed rides, one JSON object a line; a line that is none has its text in `_broken`."""
    return spark.read.schema(with_broken()).option("columnNameOfCorruptRecord", BROKEN).json(path)


def listed_rides_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """The same folder as a stream, at most `files` new files at a time."""
    return spark.readStream.schema(with_broken()).option("columnNameOfCorruptRecord", BROKEN).option("maxFilesPerTrigger", files).json(path)


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """Recordings with an array per measure. A measure that a ride lacks is null."""
    raw = spark.read.schema(STREAM_ANSWER).json(path)
    by_type = F.map_from_entries(F.transform(F.filter("streams", lambda s: s["type"].isNotNull()), lambda s: F.struct(s["type"], s["data"])))
    of = lambda name, kind: F.transform(F.try_element_at("m", F.lit(name)), lambda x: x.try_cast(kind))
    place = F.transform(F.try_element_at("m", F.lit("latlng")), lambda x: F.from_json(x, "array<double>"))
    rows = raw.withColumn("m", by_type)
    return rows.select(
        "id", of("time", "int").alias("time"), of("heartrate", "int").alias("heartrate"), of("watts", "int").alias("watts"), of("cadence", "int").alias("cadence"), of("velocity_smooth", "double").alias("velocity_smooth"), of("altitude", "double").alias("altitude"), place.alias("latlng")
    )


def forecasts(spark: SparkSession, path: str) -> DataFrame:
    """Forecast answers: structs `daily` and `hourly` of parallel arrays. One answer a line."""
    return spark.read.text(path).select(F.from_json("value", FORECAST_ANSWER).alias("f")).where(F.col("f").isNotNull()).select("f.*")


def noon_air(reports: DataFrame, date: Column) -> DataFrame:
    """aqi, pm25, pm10 at noon of a day; reports have a struct `hourly` of parallel arrays. No row without that hour."""
    at = F.array_position(F.transform("hourly.time", lambda t: F.startswith(t, date) & t.contains("T12:")), True)
    of = lambda c: F.get(f"hourly.{c}", (F.col("i") - 1).cast("int"))
    return reports.withColumn("i", at).where(F.col("i") > 0).select(of("european_aqi").alias("aqi"), of("pm2_5").alias("pm25"), of("pm10").alias("pm10"))


def escaped(text: Column) -> Column:
    out = text
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def gpx(coords: Column, name: Column, surface: Column, time: Column) -> Column:
    """A GPX 1.1 text of a route (array<struct<lat, lng>>)."""
    points = F.array_join(F.transform(coords, lambda p: F.concat(F.lit('<trkpt lat="'), p["lat"].cast("string"), F.lit('" lon="'), p["lng"].cast("string"), F.lit('" />'))), "")
    stamp = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<gpx xmlns="http://www.topografix.com/GPX/1/1" version="1.1" creator="ridgeline"><metadata><name>'), escaped(name), F.lit("</name><time>"), stamp,
        F.lit("</time></metadata><trk><name>"), escaped(name), F.lit("</name><type>"), escaped(surface), F.lit("</type><trkseg>"), points, F.lit("</trkseg></trk></gpx>"),
    )


def write_gpx(routes: DataFrame, path: str) -> None:
    """One line of text a route (name, surface, coords, time), in files of `path`."""
    routes.select(F.replace(gpx(F.col("coords"), F.col("name"), F.col("surface"), F.col("time")), F.lit("\n"), F.lit("")).alias("value")).write.mode("overwrite").text(path)


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """name, surface, coords of written routes."""
    point = "array<struct<_lat:double,_lon:double>>"
    rows = spark.read.format("xml").option("rowTag", "trk").schema(f"name string, type string, trkseg struct<trkpt:{point}>").load(path)
    return rows.select("name", F.col("type").alias("surface"), F.transform("trkseg.trkpt", lambda p: F.struct(p["_lat"].alias("lat"), p["_lon"].alias("lng"))).alias("coords"))


def preview_cards(routes: DataFrame) -> DataFrame:
    """name, file and html of a route's card: the escaped name and every fifth place."""
    from ..functions.parse import slug

    path = F.array_join(F.transform(F.filter("coords", lambda _, i: i % 5 == 0), lambda p: F.concat(F.lit("["), p["lat"].cast("string"), F.lit(","), p["lng"].cast("string"), F.lit("]"))), ",")
    html = F.concat(F.lit('<section class="route"><h1>'), escaped(F.col("name")), F.lit('</h1><div class="map" data-path="['), path, F.lit(']"></div></section>'))
    return routes.select("name", F.concat(slug(F.col("name")), F.lit(".html")).alias("file"), html.alias("html"))


def preview_page(name: Column, coords: Column, waypoints: Column) -> Column:
    """An HTML page of a route: its name, every fifth place as a line's points, and a marker for each waypoint with name and reason."""
    place = lambda p: F.concat(F.lit("["), p["lat"].cast("string"), F.lit(","), p["lng"].cast("string"), F.lit("]"))
    path = F.array_join(F.transform(F.filter(coords, lambda _, i: i % 5 == 0), place), ",")
    marker = lambda w: F.concat(F.lit('<li class="waypoint" data-at="'), place(w), F.lit('"><b>'), escaped(F.coalesce(w["name"], F.lit(""))), F.lit("</b> "), escaped(F.coalesce(w["reason"], F.lit(""))), F.lit("</li>"))
    listed = F.coalesce(F.array_join(F.transform(waypoints, marker), ""), F.lit(""))
    title = escaped(name)
    return F.concat(
        F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>'), title, F.lit('</title></head><body><h1>'), title, F.lit('</h1><div class="map" data-path="['), path, F.lit(']"></div><ul>'), listed, F.lit("</ul></body></html>\n")
    )
