"""Texts that people type - durations, distances, times, days, places - as column expressions. Unreadable texts give null."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def part(text: Column, pattern: str, group: int) -> Column:
    """A group of a pattern; null where it matched nothing."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


#: The forms in which riders type durations and times; other forms are unreadable.
DURATION_UNITS, DURATION_CLOCK = r"^(?:(\d+)h)?(?:(\d+)m(?:in)?)?$", r"^(\d+):(\d{2})$"
TIME_EXACT, TIME_SPOKEN = r"^(\d{1,2}):(\d{2})$", r"^(\d{1,2})\s*(am|pm|h)$"


def tidy(text: Column) -> Column:
    return F.lower(F.trim(text))


def minutes(text: Column) -> Column:
    """2h, 1h30m, 90min, 1:30."""
    s = tidy(text)
    units, clock = DURATION_UNITS, DURATION_CLOCK
    number = lambda p, g: part(s, p, g).cast("int")
    by_units = F.when(s.rlike(units) & (s != ""), F.coalesce(number(units, 1), F.lit(0)) * 60 + F.coalesce(number(units, 2), F.lit(0)))
    return F.coalesce(by_units, number(clock, 1) * 60 + number(clock, 2))


def kilometres(text: Column) -> Column:
    """30, 50km, 25.5; letters k and m at the end count for nothing."""
    return F.trim(F.regexp_replace(tidy(text), "[km]+$", "")).try_cast("double")


def clock_time(text: Column) -> Column:
    """HH:MM of 14:00, 2pm, 9am, 14h. Hours above 23 are unreadable, but not in the form with minutes."""
    s = tidy(text)
    exact, spoken = TIME_EXACT, TIME_SPOKEN
    hour, suffix = part(s, spoken, 1).cast("int"), part(s, spoken, 2)
    turned = F.when((suffix == "pm") & (hour < 12), hour + 12).when((suffix == "am") & (hour == 12), 0).otherwise(hour)
    padded = lambda h: F.lpad(h.cast("string"), 2, "0")
    return F.coalesce(F.concat(padded(part(s, exact, 1).cast("int")), F.lit(":"), part(s, exact, 2)), F.when(turned <= 23, F.concat(padded(turned), F.lit(":00"))))


def ride_day(text: Column, as_of: Column) -> Column:
    """today, tomorrow, the next such weekday after as_of, or a date."""
    s = tidy(text)
    wanted = F.array_position(F.array(*map(F.lit, DAYS)), s)
    ahead = F.pmod(wanted - 1 - F.weekday(as_of), F.lit(7))
    return (
        F.when(s == "today", as_of)
        .when(s == "tomorrow", F.date_add(as_of, 1))
        .when(wanted > 0, F.date_add(as_of, F.when(ahead == 0, 7).otherwise(ahead).cast("int")))
        .otherwise(F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s.try_cast("date")))
    )


def coordinates(text: Column) -> Column:
    """struct<lat, lng> of "lat,lng" within bounds."""
    parts = F.split(F.trim(text), ",")
    lat, lng = (F.trim(F.get(parts, F.lit(k))).try_cast("double") for k in (0, 1))
    return F.when((F.size(parts) == 2) & lat.between(-90, 90) & lng.between(-180, 180), F.struct(lat.alias("lat"), lng.alias("lng")))


def offset_hours(stamp: Column) -> Column:
    """The hours that a time stamp's own offset says (5.5 for +05:30); 0 without one."""
    p = r"([+-])(\d{2}):?(\d{2})$"
    sign = F.when(part(stamp, p, 1) == "-", F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.coalesce(sign * (part(stamp, p, 2).cast("double") + part(stamp, p, 3).cast("double") / F.lit(60.0)), F.lit(0.0))


def offset_label(hours: Column) -> Column:
    """UTC, UTC+2, UTC+5:30."""
    size = F.abs(hours)
    left = F.rint((size - F.floor(size)) * 60).cast("int")
    return F.when(hours == 0, "UTC").otherwise(F.concat(F.lit("UTC"), F.when(hours > 0, "+").otherwise("-"), F.floor(size).cast("string"), F.when(left > 0, F.concat(F.lit(":"), F.lpad(left.cast("string"), 2, "0"))).otherwise("")))


def stamp_clock(stamp: Column) -> Column:
    """HH:MM as the stamp writes it; its zone is kept, not converted."""
    return F.when(stamp == "", "").otherwise(F.coalesce(part(stamp, r"^\d{4}-\d{2}-\d{2}[T ](\d{2}:\d{2})", 1), stamp))


def epoch(stamp: Column) -> Column:
    """Seconds since 1970 of an ISO 8601 time with zone."""
    return F.unix_timestamp(F.try_to_timestamp(stamp))


#: Latin letters with marks, and the letter each one loses its mark to.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def slug(name: Column, most: int = 80) -> Column:
    """A file name part: letters without marks, other signs become single dashes."""
    plain = F.regexp_replace(F.translate(name, MARKED, PLAIN), r"[^\x00-\x7F]", "")
    return F.substring(F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), F.lit("-")), 1, most)
