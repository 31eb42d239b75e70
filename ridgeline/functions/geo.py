"""Places, distances, grids and simple route shapes as column expressions."""

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import half_even

KM_PER_DEGREE = 111.0
CELL = 0.005  # degrees, about 500 m


def distance_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Plane distance with the longitudes shrunk at the mean latitude; good for rides."""
    shrink = F.cos(F.radians((lat1 + lat2) / F.lit(2.0)))
    dlat, dlng = (lat2 - lat1) * F.lit(KM_PER_DEGREE), (lng2 - lng1) * F.lit(KM_PER_DEGREE) * shrink
    return F.sqrt(dlat * dlat + dlng * dlng)


def shrink(lat: Column) -> Column:
    """Kilometres of a degree of longitude."""
    return F.cos(F.radians(lat)) * F.lit(KM_PER_DEGREE)


def piece_distance_km(at: Sequence[Column], a: Sequence[Column], along: Sequence[Column], wide: Column) -> Column:
    """From a place to the nearest point of a straight piece from a (`along`: how far its end lies from a, in degrees), on the plane around the place.

    wide: shrink() of the place. It and `along` should be columns of the sides of a join whose condition this is: what a condition
    repeats is not shared, and Java does not compile a long one.
    """
    y, x = (at[0] - a[0]) * F.lit(KM_PER_DEGREE), (at[1] - a[1]) * wide
    dy, dx = along[0] * F.lit(KM_PER_DEGREE), along[1] * wide
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x * dx + y * dy) / square))).otherwise(F.lit(0.0))
    return F.sqrt(F.pow(x - t * dx, F.lit(2.0)) + F.pow(y - t * dy, F.lit(2.0)))


def cell(degrees: Column, size: float = CELL) -> Column:
    """The whole number of the grid line next to a coordinate (ties to even)."""
    return F.rint(degrees / F.lit(size)).cast("long")


def in_box(lat: Column, lng: Column, center_lat: float, center_lng: float, dlat: float, dlng: float) -> Column:
    """Strictly within; plain comparisons with numbers, which reach a Parquet scan."""
    return (lat > center_lat - dlat) & (lat < center_lat + dlat) & (lng > center_lng - dlng) & (lng < center_lng + dlng)


def tile(lat: Column, lng: Column, zoom: int = 11) -> tuple[Column, Column]:
    """x and y of the web map tile that holds a place."""
    n = F.lit(float(1 << zoom))
    x = (lng + F.lit(180.0)) / F.lit(360.0) * n
    y = (F.lit(1.0) - F.ln(F.tan(F.radians(lat)) + F.lit(1.0) / F.cos(F.radians(lat))) / F.lit(math.pi)) / F.lit(2.0) * n
    return x.cast("long"), y.cast("long")


def tiles_around(lat: Column, lng: Column, radius_km: Column, zoom: int = 11) -> Column:
    """array<struct<x, y>> of the square of tiles around a place; a tile counts as 15 km."""
    x, y = tile(lat, lng, zoom)
    r = F.greatest(F.lit(1), (radius_km / F.lit(15.0)).cast("int")).cast("long")
    steps = F.sequence(-r, r)
    return F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.struct((x + i).alias("x"), (y + j).alias("y")))))


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Degrees from north, 0 to 360, on the plane of degrees."""
    return F.pmod(F.degrees(F.atan2(lng2 - lng1, lat2 - lat1)), F.lit(360.0))


def angle_apart(a: Column, b: Column, full: float = 360.0) -> Column:
    """The smaller angle between two directions."""
    half = F.lit(full / 2)
    return F.abs(F.pmod(a - b + half, F.lit(full)) - half)


def compass(degrees: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("N", "NE", "E", "SE", "S", "SW", "W", "NW"))), (F.floor(F.pmod(degrees + F.lit(22.5), F.lit(360.0)) / F.lit(45.0)) + 1).cast("int"))


def loop_points(lat: Column, lng: Column, km: Column, n: int = 4) -> Column:
    """array<struct<lat, lng>>: n places on a circle whose routed length comes near km; the first one lies due south."""
    radius = km / F.lit(2 * math.pi) * F.lit(0.8)
    dlat = radius / F.lit(KM_PER_DEGREE)
    dlng = radius / (F.lit(KM_PER_DEGREE) * F.cos(F.radians(lat)))

    def point(i: Column) -> Column:
        turn = F.lit(2 * math.pi) * i / F.lit(float(n)) - F.lit(math.pi / 2)
        return F.struct(half_even(lat + dlat * F.sin(turn), 5).alias("lat"), half_even(lng + dlng * F.cos(turn), 5).alias("lng"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point)


def corridor_points(start: Sequence[Column], dest: Sequence[Column], target_km: Column, baseline_km: Column, n: int = 3) -> Column:
    """array<struct<lat, lng>>: detours on alternating sides of the straight line, so that the route gets longer.

    Empty where the route is long enough, or start and destination are less than 1 km apart. The offset adds the sine of
    the turned bearing to the latitude and its cosine to the longitude, as published; due north it runs along the line.
    """
    (lat, lng), (to_lat, to_lng) = start, dest
    shrink = F.cos(F.radians((lat + to_lat) / F.lit(2.0)))
    dlat, dlng = to_lat - lat, to_lng - lng
    straight = F.sqrt(F.pow(dlat * F.lit(111.0), F.lit(2.0)) + F.pow(dlng * F.lit(111.0) * shrink, F.lit(2.0)))
    offset = (target_km - baseline_km) / F.lit(2.0 * n) * F.lit(1.2)
    turned = F.atan2(dlng, dlat) + F.lit(math.pi / 2)

    def point(i: Column) -> Column:
        t = i / F.lit(n + 1.0)
        side = F.when(i % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        return F.struct(
            half_even(lat + dlat * t + side * offset / F.lit(111.0) * F.sin(turned), 5).alias("lat"),
            half_even(lng + dlng * t + side * offset / (F.lit(111.0) * shrink) * F.cos(turned), 5).alias("lng"),
        )

    none = F.array().cast("array<struct<lat:double,lng:double>>")
    return F.when((baseline_km >= target_km) | (straight < 1), none).otherwise(F.transform(F.sequence(F.lit(1), F.lit(n)), point))


def every_nth(points: Column, most: int) -> Column:
    """At most `most` of an array's elements, at even steps from the first."""
    step = F.greatest(F.lit(1), F.floor(F.size(points) / F.lit(most))).cast("int")
    return F.slice(F.filter(points, lambda _, i: i % step == 0), 1, most)


def decoded_line(text: Column) -> Column:
    """array<struct<lat, lng>> of a polyline with six decimals, in one pass over its characters.

    The running state holds the bits read of the current number; a character without the continuation bit ends a number,
    every second number ends a point. A text that breaks off within a number ends with what was read of it, and a point
    without longitude repeats the last one.
    """
    characters = F.filter(F.split(text, ""), lambda c: c != "")
    point = "struct<lat:double,lng:double>"
    start = F.struct(F.lit(0).cast("long").alias("bits"), F.lit(0).alias("shift"), F.lit(0).cast("long").alias("lat"), F.lit(0).cast("long").alias("lng"), F.lit(False).alias("second"), F.array().cast(f"array<{point}>").alias("out"))
    signed = lambda bits: F.when(bits % 2 == 1, -F.shiftright(bits, 1) - 1).otherwise(F.shiftright(bits, 1))

    def place(lat: Column, lng: Column) -> Column:
        return F.struct((lat / F.lit(1e6)).alias("lat"), (lng / F.lit(1e6)).alias("lng")).cast(point)

    def read(s: Column, c: Column) -> Column:
        v = F.ascii(c) - 63
        bits = s["bits"] + (v.bitwiseAND(F.lit(31)).cast("long") * F.pow(F.lit(2.0), s["shift"]).cast("long"))
        more, delta = v >= 32, signed(bits)
        lat, lng = F.when(~more & ~s["second"], s["lat"] + delta).otherwise(s["lat"]), F.when(~more & s["second"], s["lng"] + delta).otherwise(s["lng"])
        return F.struct(
            F.when(more, bits).otherwise(F.lit(0).cast("long")).alias("bits"),
            F.when(more, s["shift"] + 5).otherwise(F.lit(0)).alias("shift"),
            lat.alias("lat"),
            lng.alias("lng"),
            F.when(more, s["second"]).otherwise(~s["second"]).alias("second"),
            F.when(~more & s["second"], F.concat(s["out"], F.array(place(lat, lng)))).otherwise(s["out"]).alias("out"),
        )

    def close(s: Column) -> Column:
        rest = signed(s["bits"])
        open_point = s["second"] | (s["shift"] > 0)
        last = place(F.when(s["second"], s["lat"]).otherwise(s["lat"] + rest), F.when(s["second"], s["lng"] + rest).otherwise(s["lng"]))
        return F.when(open_point, F.concat(s["out"], F.array(last))).otherwise(s["out"])

    return F.aggregate(characters, start, read, close)
