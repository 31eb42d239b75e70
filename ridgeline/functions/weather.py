"""Scores of days and hours for riding, and the words for weather codes."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The meteorological codes and their words.
WEATHER_CODES = {
    0: "Clear sky", 1: "Mainly clear", 2: "Partly cloudy", 3: "Overcast", 45: "Foggy", 48: "Depositing rime fog",
    51: "Light drizzle", 53: "Moderate drizzle", 55: "Dense drizzle", 56: "Light freezing drizzle", 57: "Dense freezing drizzle",
    61: "Slight rain", 63: "Moderate rain", 65: "Heavy rain", 66: "Light freezing rain", 67: "Heavy freezing rain",
    71: "Slight snow", 73: "Moderate snow", 75: "Heavy snow", 77: "Snow grains",
    80: "Slight rain showers", 81: "Moderate rain showers", 82: "Violent rain showers", 85: "Slight snow showers", 86: "Heavy snow showers",
    95: "Thunderstorm", 96: "Thunderstorm + slight hail", 99: "Thunderstorm + heavy hail",
}

#: Penalties, the first limit that is passed counts.
DAY_RAIN, HOUR_RAIN = ((10, 50), (5, 35), (1, 20), (0, 5)), ((2, 40), (0.5, 20), (0, 5))
WIND = ((40, 40), (30, 25), (20, 10))
DAY_UV, HOUR_UV = ((11, 20), (8, 10), (6, 5)), ((11, 25), (8, 15), (6, 5))
#: Colder than, hotter than, penalty.
DAY_TEMPERATURE, HOUR_TEMPERATURE = ((5, 38, 30), (10, 35, 15), (13, None, 5)), ((5, 38, 30), (10, 35, 20), (13, 30, 10))
BAD_CODES = ((61, 15), (45, 10))


def penalty(x: Column, limits: Sequence[tuple[float, int]], reached: bool = False) -> Column:
    """Of the first limit that x is above (or has reached); 0 below all, and for null."""
    out = F.lit(0)
    for limit, points in reversed(limits):
        out = F.when(x >= limit if reached else x > limit, points).otherwise(out)
    return out


def discomfort(t: Column, limits: Sequence[tuple[float, float | None, int]]) -> Column:
    out = F.lit(0)
    for cold, hot, points in reversed(limits):
        out = F.when((t < cold) | (t > hot) if hot is not None else t < cold, points).otherwise(out)
    return out


def day_score(precip: Column, wind: Column, temp_max: Column, code: Column, uv_max: Column) -> Column:
    """0 to 100 for a day."""
    lost = penalty(precip, DAY_RAIN) + penalty(wind, WIND) + discomfort(temp_max, DAY_TEMPERATURE) + penalty(uv_max, DAY_UV, True) + penalty(code, BAD_CODES, True)
    return F.greatest(F.lit(0), F.lit(100) - lost)


def hour_score(precip: Column, wind: Column, temp: Column, uv: Column) -> Column:
    """0 to 100 for an hour."""
    lost = penalty(precip, HOUR_RAIN) + penalty(wind, WIND) + discomfort(temp, HOUR_TEMPERATURE) + penalty(uv, HOUR_UV, True)
    return F.greatest(F.lit(0), F.lit(100) - lost)


def weather_words(code: Column) -> Column:
    words = F.create_map(*(F.lit(x) for pair in WEATHER_CODES.items() for x in pair))
    return F.coalesce(F.try_element_at(words, code.cast("int")), F.lit("Unknown"))


def whole(x: Column) -> Column:
    """A number without decimals, as text."""
    return F.rint(x).cast("long").cast("string")


def day_line(words: Column, temp_min: Column, temp_max: Column, wind: Column, uv_max: Column, precip: Column) -> Column:
    """One day in words; high UV and rain only where there are any."""
    return F.concat_ws(
        ", ",
        words,
        F.concat(whole(temp_min), F.lit("-"), whole(temp_max), F.lit("°C")),
        F.concat(F.lit("wind "), whole(wind), F.lit(" km/h")),
        F.when(uv_max >= 6, F.concat(F.lit("UV "), whole(uv_max))),
        F.when(precip > 0, F.concat(F.lit("rain "), F.format_string("%.1f", precip), F.lit("mm"))),
    )


def day_warnings(wind: Column, precip: Column, uv: Column, temp_max: Column, air: Column) -> Column:
    """array<string>: what to mind on a day; air is the air quality index. Limits and texts."""
    whole = lambda c: F.format_string("%d", F.rint(c).cast("long"))
    texts = [
        F.when(wind > 30, "High wind — consider a sheltered route"),
        F.when(precip > 5, "Rain expected — check conditions"),
        F.when(uv >= 8, F.concat(F.lit("Very high UV ("), whole(uv), F.lit(") — wear sunscreen, ride early or late"))).when(uv >= 6, F.concat(F.lit("High UV ("), whole(uv), F.lit(") — sunscreen recommended"))),
        F.when(temp_max > 35, "Extreme heat — ride before 9am or after 6pm").when(temp_max > 30, "Hot day — consider an early morning ride"),
        F.when(air > 100, F.concat(F.lit("Poor air quality (AQI "), whole(air), F.lit(") — consider indoor ride"))).when(air > 50, F.concat(F.lit("Moderate air quality (AQI "), whole(air), F.lit(")"))),
    ]
    return F.array_compact(F.array(*texts))
