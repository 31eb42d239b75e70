"""Queries over places, routes, weather and typed texts. Each comes with SQL that says the same."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, parse, weather
from ..functions.rounding import half_even
from ..operators import fitness, history, planning, routes, waypoints
from ..sources import driver_tables as tables
from ..sources import tiles
from . import oracle_tables as sql
from .rides import FITNESS, days, rides

HOME, TARGET_KM = (38.7, -9.14), 120.0
RADIUS = waypoints.radius_for(TARGET_KM)
WEEK = "1998-06-01"


def six(c: Column | str) -> Column:
    return half_even(F.col(c) if isinstance(c, str) else c, 6)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.samples(spark, sf_dir)
    return history.density(s, tables.sample_rides(s), *HOME, RADIUS, F.lit("2024-01-31").cast("date"))


def all_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waypoints.candidates(
        waypoints.tagged_places(tables.places(spark, sf_dir)), waypoints.popular_segments(tables.segments(spark, sf_dir), *HOME, RADIUS), waypoints.distinct_highlights(tables.highlights(spark, sf_dir))
    )


def all_scored(spark: SparkSession, sf_dir: str, explore: bool = True) -> DataFrame:
    return waypoints.scored(all_candidates(spark, sf_dir), *HOME, RADIUS, cells(spark, sf_dir), explore)


def a13_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waypoints.places_around(tables.places(spark, sf_dir), *HOME, 15.0)


def a14_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waypoints.popular_segments(tables.segments(spark, sf_dir), *HOME, 10.0)


def a15_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = waypoints.distinct_highlights(tables.highlights(spark, sf_dir))
    x, y = geo.tile(F.col("lat"), F.col("lng"))
    return h.select("name", "category", x.alias("x"), y.alias("y"))


def a15_tile_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highlights read from the bytes of vector tiles, one by name."""
    return waypoints.distinct_highlights(tiles.highlights(tiles.decoded(tables.tile_bytes(spark, sf_dir)))).select("id", "name", "category", six("lat").alias("lat"), six("lng").alias("lng"))


def a15_tile_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tiles.decoded(tables.tile_bytes(spark, sf_dir))
    return found.groupBy("tile_id").agg(F.count("id").alias("n"), F.count("error").alias("malformed"))


def a15_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    around = geo.tiles_around(F.col("lat"), F.col("lng"), F.lit(32.0))
    return tables.segments(spark, sf_dir).select("id", F.explode(around).alias("t")).select("id", "t.x", "t.y")


def h5_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.places(spark, sf_dir).select("id", six(geo.distance_km(F.lit(HOME[0]), F.lit(HOME[1]), F.col("lat"), F.col("lng"))).alias("km"))


def d9_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir)


def k5_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.samples(spark, sf_dir)
    return history.density(s, tables.sample_rides(s), *HOME, 20.0, F.lit("2024-01-31").cast("date"), days=None)


def c8_density_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.with_density(tables.places(spark, sf_dir).select("id", "lat", "lng"), cells(spark, sf_dir)).select("id", "density")


def g1_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_candidates(spark, sf_dir).select("origin", "id", "name", "reason", "kind")


def h19_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_scored(spark, sf_dir).select("origin", "id", six("distance_km").alias("km"), six("score").alias("score"))


def h19_scores_familiar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_scored(spark, sf_dir, explore=False).select("origin", "id", six("score").alias("score"))


def c9_avoid_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waypoints.outside(all_candidates(spark, sf_dir), tables.zones(spark, sf_dir)).select("origin", "id")


def f7_waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    free = waypoints.outside(all_scored(spark, sf_dir), tables.zones(spark, sf_dir))
    return waypoints.spread_out(free).select("place", "origin", "id", "name", "reason", six("score").alias("score"))


def h17_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = geo.loop_points(F.col("lat"), F.col("lng"), F.col("athlete_count") / F.lit(100.0))
    return tables.segments(spark, sf_dir).select("id", F.posexplode(points).alias("k", "p")).select("id", "k", "p.lat", "p.lng")


def h18_corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("athlete_count") / F.lit(200.0)
    points = geo.corridor_points((F.lit(HOME[0]), F.lit(HOME[1])), (F.col("lat"), F.col("lng")), F.lit(40.0), base)
    return tables.segments(spark, sf_dir).select("id", F.posexplode(points).alias("k", "p")).select("id", "k", "p.lat", "p.lng")


def d10_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = F.array_join(F.transform("surfaces", lambda p: F.concat(p["surface"], F.lit(" "), p["pct"].cast("string"), F.lit("%"))), ", ")
    return routes.surfaces(tables.ways(spark, sf_dir), "gravel").select("route_id", "match_pct", shares.alias("surfaces"), "warning")


def d11_scenic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.scenery(tables.ways(spark, sf_dir))


def d12_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.climbs(routes.thinned(tables.route_points(spark, sf_dir)))


def d13_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.safety(tables.ways(spark, sf_dir))


def d14_wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.wind(routes.thinned(tables.route_points(spark, sf_dir)), (F.col("route_id") * 37 % 360).cast("double"), (F.col("route_id") % 40).cast("double"))


def d15_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.trails(tables.ways(spark, sf_dir))


def g2_along_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map elements near every route, by search."""
    return routes.along(tables.route_points(spark, sf_dir), tables.map_elements(spark, sf_dir), "element_id", "kind")


def l_route_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.report(tables.route_points(spark, sf_dir), tables.map_elements(spark, sf_dir), "gravel", (F.col("route_id") * 37 % 360).cast("double"), (F.col("route_id") % 40).cast("double"))


def l_day_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = planning.scored_days(tables.forecast(spark, sf_dir))
    air = (F.dayofyear("date") * 7 % 130).cast("double")
    return d.select("date", F.array_join(weather.day_warnings(F.col("wind"), F.col("precip"), F.col("uv_max"), F.col("temp_max"), air), "; ").alias("warnings"))


def h6_day_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.scored_days(tables.forecast(spark, sf_dir)).select("date", "score", "weather")


def h7_best_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.scored_hours(tables.hours(spark, sf_dir)).select("time", "score", "place")


def f6_ride_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.ride_days(planning.scored_days(tables.forecast(spark, sf_dir)), F.lit(WEEK).cast("date"))


def h21_day_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = weather.day_line(F.col("weather"), F.col("temp_min"), F.col("temp_max"), F.col("wind"), F.col("uv_max"), F.col("precip"))
    return planning.scored_days(tables.forecast(spark, sf_dir)).select("date", line.alias("line"))


def h10_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.fitted_plans(fitness.latest(days(spark, sf_dir)), history.usual_speeds(rides(spark, sf_dir)), 150, "road")


TYPED = """WITH t AS (SELECT o_orderkey AS id, o_orderkey % 13 AS k, CAST(o_orderkey % 70 AS VARCHAR) AS a, CAST(o_custkey % 30 AS VARCHAR) AS b, right('0' || CAST(o_orderkey % 60 AS VARCHAR), 2) AS m, o_orderdate FROM orders)"""


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("id"), (k % 13).alias("k"), (k % 70).cast("string").alias("a"), (F.col("o_custkey") % 30).cast("string").alias("b"), F.lpad((k % 60).cast("string"), 2, "0").alias("m"), "o_orderdate")


def chosen(*forms: Column) -> Column:
    """A form of text by the row's k."""
    return F.element_at(F.array(*forms), (F.col("k") % len(forms) + 1).cast("int"))


def h12_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    text = chosen(F.concat(a, F.lit("h")), F.concat(b, F.lit("h"), a, F.lit("m")), F.concat(a, F.lit("MIN ")), F.concat(b, F.lit(":"), m), F.lit("soon"), F.lit(""), F.concat(b, F.lit("h"), a, F.lit("min")))
    return typed(spark, sf_dir).select("id", parse.minutes(text).alias("minutes"))


def h13_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    text = chosen(a, F.concat(a, F.lit("km")), F.concat(a, F.lit("."), b), F.concat(F.lit(" "), b, F.lit(" KM")), F.lit("far"))
    return typed(spark, sf_dir).select("id", parse.kilometres(text).alias("km"))


def h14_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, m = F.col("b"), F.col("m")
    text = chosen(F.concat(b, F.lit(":"), m), F.concat(b, F.lit("pm")), F.concat(b, F.lit(" AM")), F.concat(b, F.lit("h")), F.lit("noon"))
    return typed(spark, sf_dir).select("id", parse.clock_time(text).alias("clock"))


def h15_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.to_date("o_orderdate")
    text = chosen(F.lit("today"), F.lit("Tomorrow"), *map(F.lit, parse.DAYS), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("some day"))
    return typed(spark, sf_dir).select("id", parse.ride_day(text, as_of).alias("day"))


def h16_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    text = chosen(F.concat(a, F.lit(","), b), F.concat(F.lit("-"), a, F.lit("."), b, F.lit(" , -"), b), F.concat(F.lit("1"), a, F.lit(","), b), F.lit("Lisbon"), F.concat(a, F.lit(","), b, F.lit(","), b))
    return typed(spark, sf_dir).select("id", parse.coordinates(text).alias("p")).select("id", "p.lat", "p.lng")


def a19_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = chosen(*map(F.lit, ("+00:00", "+02:00", "-05:00", "+05:30", "+05:45", "")))
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T06:"), F.col("m"), F.lit(":00"), zone)
    return typed(spark, sf_dir).select("id", parse.stamp_clock(stamp).alias("clock"), parse.offset_hours(stamp).alias("hours"), parse.offset_label(parse.offset_hours(stamp)).alias("label"))


def h22_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the documents' texts, as they hold letters with marks."""
    return tables.table(spark, sf_dir, "documents").select("doc_id", parse.slug(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 .,éèàâêîôûçñüöäáíóú-]", "-")).alias("slug"))


def h23_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.raw_rides(spark, sf_dir).select("id", parse.epoch(F.col("start_date")).alias("epoch"))


def a22_polyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded texts made of names: any characters from ? on are digits of the code."""
    return tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), geo.decoded_line(F.translate("p_name", " ", "_")).alias("line")).select("id", F.posexplode("line").alias("k", "p")).select("id", "k", "p.lat", "p.lng")


QUERIES = {f.__name__: f for f in (a15_tile_features, a15_tile_errors, a13_places, a14_segments, a15_highlights, a15_tiles, a19_offsets, a22_polyline, c8_density_at, c9_avoid_zones, d9_density, d10_surface, d11_scenic, d12_elevation, d13_safety, d14_wind, d15_trails, f6_ride_days, f7_waypoints, g1_candidates, g2_along_route, l_route_report, l_day_warnings, h5_distance, h6_day_score, h7_best_hours, h10_plans, h12_durations, h13_distances, h14_times, h15_dates, h16_locations, h17_loop, h18_corridor, h19_scores, h19_scores_familiar, h21_day_lines, h22_slugs, h23_epochs, k5_heatmap)}


PI = f"{math.pi!r}::DOUBLE"


def away(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return f"sqrt(pow(({lat2} - {lat1}) * 111.0::DOUBLE, 2) + pow(({lng2} - {lng1}) * 111.0::DOUBLE * cos(radians(({lat1} + {lat2}) / 2.0::DOUBLE)), 2))"


FROM_HOME = away("38.7::DOUBLE", "(-9.14::DOUBLE)", "lat", "lng")
CELL = "CAST(round_even(lat / 0.005::DOUBLE, 0) AS BIGINT) AS cell_lat, CAST(round_even(lng / 0.005::DOUBLE, 0) AS BIGINT) AS cell_lng"


def box(radius: float) -> str:
    return f"lat > {38.7 - radius / 111.0 * 1.5!r}::DOUBLE AND lat < {38.7 + radius / 111.0 * 1.5!r}::DOUBLE AND lng > {-9.14 - radius / 80.0 * 1.5!r}::DOUBLE AND lng < {-9.14 + radius / 80.0 * 1.5!r}::DOUBLE"


CELLS = f"""{sql.samples()}, {sql.SAMPLE_RIDES}, cells AS (
  SELECT {CELL}, count(*) AS n FROM samples WHERE time_offset % 30 = 0 AND {box(RADIUS)} AND activity_id IN (SELECT id FROM sample_rides WHERE date >= DATE '2024-01-31' - INTERVAL 30 DAYS) GROUP BY 1, 2
)"""


def near_segments(radius: float, n: int = 10) -> str:
    lng = radius / (111.0 * math.cos(math.radians(38.7)))
    return f"SELECT * FROM segments WHERE lat BETWEEN {38.7 - radius / 111.0!r}::DOUBLE AND {38.7 + radius / 111.0!r}::DOUBLE AND lng BETWEEN {-9.14 - lng!r}::DOUBLE AND {-9.14 + lng!r}::DOUBLE ORDER BY athlete_count DESC, id LIMIT {n}"


def cases(column: str, weights: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in weights.items()) + " ELSE 0.5::DOUBLE END"


CANDIDATES = f"""{sql.PLACES}, {sql.SEGMENTS}, {sql.HIGHLIGHTS}, near_segments AS ({near_segments(RADIUS)}), candidates AS (
  SELECT 1 AS origin, id, lat, lng, name, 'POI: ' || split_part(type, '=', 2) AS reason, {cases('type', waypoints.PLACE_WEIGHTS)} AS kind FROM pois
  UNION ALL SELECT 2, id, lat, lng, name, 'Popular segment (' || athlete_count || ' cyclists)', least(1.0::DOUBLE, athlete_count / 500.0::DOUBLE) FROM near_segments
  UNION ALL SELECT 3, id, lat, lng, name, 'Highlight: ' || replace(category, '_', ' '), {cases('category', waypoints.HIGHLIGHT_WEIGHTS)} FROM highlights
)"""


def scores(explore: bool) -> str:
    past = "1.0::DOUBLE - density" if explore else "density"
    return f"""{CELLS}, {CANDIDATES}, far AS (
  SELECT *, {CELL}, {FROM_HOME} AS km FROM candidates
), scored AS (
  SELECT f.*, near * CASE origin WHEN 1 THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END + kind * CASE origin WHEN 1 THEN 0.3::DOUBLE ELSE 0.4::DOUBLE END + ({past}) * 0.3::DOUBLE AS score, atan2(lat - 38.7::DOUBLE, lng + 9.14::DOUBLE) AS angle
  FROM (SELECT far.*, greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(km - {RADIUS * 0.7!r}::DOUBLE) / {RADIUS!r}::DOUBLE) AS near, least(1.0::DOUBLE, coalesce(n, 0) / 10.0::DOUBLE) AS density
    FROM far LEFT JOIN cells USING (cell_lat, cell_lng) WHERE km <= {RADIUS * 1.5!r}::DOUBLE) f
)"""


FREE = f"NOT EXISTS (SELECT 1 FROM zones z WHERE {away('c.lat', 'c.lng', 'z.lat', 'z.lng')} * 1000.0::DOUBLE < z.radius)"
APART = f"abs(((c.angle - {{o}}.angle + {PI}) - floor((c.angle - {{o}}.angle + {PI}) / {2 * math.pi!r}::DOUBLE) * {2 * math.pi!r}::DOUBLE) - {PI}) >= {math.radians(45)!r}::DOUBLE"

SURFACE_SQL = f""", counts AS (SELECT route_id, coalesce(surface, 'unknown') AS surface, count(*) AS n FROM ways GROUP BY 1, 2), sums AS (
  SELECT route_id, sum(n) AS total, coalesce(sum(n) FILTER (WHERE surface IN ('gravel', 'compacted', 'fine_gravel', 'dirt', 'earth', 'ground', 'grass', 'sand', 'unpaved')), 0) AS fit FROM counts GROUP BY 1
), shares AS (
  SELECT route_id, surface, n, CAST({sql.r('fit / total::DOUBLE * 100.0::DOUBLE')} AS INTEGER) AS match_pct, CAST({sql.r('n / total::DOUBLE * 100.0::DOUBLE')} AS INTEGER) AS pct FROM sums JOIN counts USING (route_id)
), told AS (SELECT route_id, any_value(match_pct) AS match_pct, list(surface || ' ' || pct || '%' ORDER BY n DESC, surface) AS parts, first(surface || ' (' || pct || '%)' ORDER BY n DESC, surface) AS top FROM shares GROUP BY 1)
SELECT route_id, match_pct, array_to_string(parts, ', ') AS surfaces, CASE WHEN match_pct < 50 THEN 'Route is mostly ' || top || ' — requested gravel' WHEN match_pct < 75 THEN 'Mixed surface: ' || array_to_string(parts[1:3], ', ') END AS warning FROM told"""

SCENIC_SQL = f""", tags AS (SELECT route_id, unnest(["natural", landuse, leisure]) AS feature FROM ways), counts AS (SELECT route_id, feature, count(*) AS n FROM tags WHERE feature IS NOT NULL GROUP BY 1, 2)
SELECT route_id, CAST(least(100, sum(CASE feature WHEN 'coastline' THEN 15 WHEN 'water' THEN 12 WHEN 'beach' THEN 10 WHEN 'cliff' THEN 10 WHEN 'peak' THEN 8 WHEN 'forest' THEN 8 WHEN 'wood' THEN 8 WHEN 'park' THEN 6 ELSE 3 END * least(n, 3))) AS INTEGER) AS scenic_score,
  array_to_string((list(feature || ' (' || n || ')' ORDER BY n DESC, feature))[1:5], ', ') AS features FROM counts GROUP BY 1"""

SAFETY_SQL = f""", s AS (
  SELECT route_id, count(*) FILTER (WHERE cycleway IS NOT NULL OR highway IN ('cycleway', 'path', 'track')) / count(*)::DOUBLE * 100.0::DOUBLE AS b, count(*) FILTER (WHERE try_cast(maxspeed AS INTEGER) <= 30) / count(*)::DOUBLE * 100.0::DOUBLE AS s,
    count(*) FILTER (WHERE traffic_calming IS NOT NULL OR highway = 'living_street') / count(*)::DOUBLE * 100.0::DOUBLE AS c FROM ways GROUP BY 1)
SELECT route_id, CAST(least(100, floor(b * 0.5::DOUBLE + s * 0.3::DOUBLE + c * 0.2::DOUBLE)) AS INTEGER) AS safety_score, CAST({sql.r('b')} AS INTEGER) AS bike_pct, CAST({sql.r('s')} AS INTEGER) AS slow_pct, CAST({sql.r('c')} AS INTEGER) AS calm_pct FROM s"""

TRAILS_SQL = f""" SELECT route_id, string_agg(label, ', ' ORDER BY label) AS trails FROM (SELECT DISTINCT route_id, coalesce(name || ' (' || ref || ')', name, ref) AS label FROM ways) WHERE label IS NOT NULL GROUP BY 1"""

CLIMBS_SQL = f""", p AS (
  SELECT route_id, len(lats) AS size, i, lats[i + 1] AS lat, lngs[i + 1] AS lng, elevations[i + 1] AS e FROM (SELECT *, unnest(range(0, len(lats))) AS i FROM routes) WHERE i % greatest(1, len(lats) // 50) = 0
), q AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY i) <= 50), k AS (
  SELECT *, lag(e) OVER w AS e0, lag(lat) OVER w AS lat0, lag(lng) OVER w AS lng0 FROM q WHERE e IS NOT NULL AND size >= 10 WINDOW w AS (PARTITION BY route_id ORDER BY i)
), g AS (SELECT route_id, e - e0 AS rise, {away('lat0', 'lng0', 'lat', 'lng')} * 1000.0::DOUBLE AS run FROM k WHERE e0 IS NOT NULL), s AS (
  SELECT route_id, sum(greatest(rise, 0)) AS up, sum(greatest(-rise, 0)) AS down, max(CASE WHEN run > 10 THEN abs(rise) / run * 100.0::DOUBLE ELSE 0.0::DOUBLE END) AS steep FROM g GROUP BY 1)
SELECT route_id, CAST({sql.r('coalesce(up, 0)')} AS BIGINT) AS total_climb, CAST({sql.r('coalesce(down, 0)')} AS BIGINT) AS total_descent, coalesce({sql.r('steep', 1)}, 0.0::DOUBLE) AS max_gradient FROM routes LEFT JOIN s USING (route_id)"""

WIND_SQL = f""", w AS (SELECT *, CAST(route_id * 37 % 360 AS DOUBLE) AS d, CAST(route_id % 40 AS DOUBLE) AS v, greatest(1, len(lats) // 50) AS step FROM routes WHERE len(lats) >= 10), e AS (
  SELECT route_id, d, v, lats[i + 1] AS lat1, lngs[i + 1] AS lng1, lats[i + step + 1] AS lat2, lngs[i + step + 1] AS lng2 FROM (SELECT *, unnest(range(0, len(lats))) AS i FROM w WHERE v >= 15) WHERE i % step = 0 AND i + step < len(lats)
), t AS (SELECT route_id, d, v, degrees(atan2(lng2 - lng1, lat2 - lat1)) - d + 180.0::DOUBLE AS x FROM e WHERE abs(lng2 - lng1) >= 1e-7 OR abs(lat2 - lat1) >= 1e-7), a AS (
  SELECT route_id, d, v, abs(x - floor(x / 360.0::DOUBLE) * 360.0::DOUBLE - 180.0::DOUBLE) AS a FROM t
), s AS (SELECT route_id, any_value(d) AS d, any_value(v) AS v, count(*) FILTER (WHERE a < 45) / count(*)::DOUBLE * 100.0::DOUBLE AS h, count(*) FILTER (WHERE a BETWEEN 45 AND 135) / count(*)::DOUBLE * 100.0::DOUBLE AS c FROM a GROUP BY 1), u AS (
  SELECT *, concat_ws(', ', CASE WHEN h > 40 AND v > 25 THEN 'strong headwind' WHEN h > 30 AND v > 20 THEN 'headwind' END, CASE WHEN c > 50 AND v > 25 THEN 'exposed crosswind' END) AS said FROM s)
SELECT route_id, {sql.r('h', 1)} AS head_pct, {sql.r('c', 1)} AS cross_pct,
  CASE WHEN said <> '' THEN 'from ' || (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[CAST(floor(((d + 22.5::DOUBLE) - floor((d + 22.5::DOUBLE) / 360) * 360) / 45) AS INTEGER) + 1] || ': ' || said END AS warning FROM u"""

#: Points of a route that a search of the report looks around.
STOPS = """stops AS (
  SELECT search, route_id, lats[i + 1] AS y, lngs[i + 1] AS x, reach FROM (SELECT *, unnest(range(0, len(lats))) AS i FROM routes WHERE len(lats) >= 10), (VALUES ('surface', 30, 0.03::DOUBLE), ('scenery', 15, 0.2::DOUBLE), ('trails', 10, 0.1::DOUBLE), ('safety', 20, 0.03::DOUBLE)) q(search, most, reach)
  WHERE i % greatest(1, len(lats) // most) = 0 AND i < greatest(1, len(lats) // most) * most
)"""
#: All points of all routes, for each search.
EVERYWHERE = """stops AS (
  SELECT search, route_id, lats[i + 1] AS y, lngs[i + 1] AS x, reach FROM (SELECT *, unnest(range(0, len(lats))) AS i FROM routes), (VALUES ('surface', 0.03::DOUBLE), ('scenery', 0.2::DOUBLE), ('trails', 0.1::DOUBLE), ('safety', 0.03::DOUBLE)) q(search, reach)
)"""
#: The elements near these points; both in cells of 0.02 degrees.
NEAR = """listed AS (
  SELECT *, unnest(range(CAST(floor((least(a_lat, b_lat) - 0.003::DOUBLE) * 50) AS BIGINT), CAST(floor((greatest(a_lat, b_lat) + 0.003::DOUBLE) * 50) AS BIGINT) + 1)) AS ci FROM elements
), cells AS (
  SELECT *, unnest(range(CAST(floor((least(a_lng, b_lng) - 0.004::DOUBLE) * 50) AS BIGINT), CAST(floor((greatest(a_lng, b_lng) + 0.004::DOUBLE) * 50) AS BIGINT) + 1)) AS cj FROM listed
), met AS (
  SELECT s.*, c.*, (y - a_lat) * 111.0::DOUBLE AS v, (x - a_lng) * 111.0::DOUBLE * cos(radians(y)) AS u, (b_lat - a_lat) * 111.0::DOUBLE AS dv, (b_lng - a_lng) * 111.0::DOUBLE * cos(radians(y)) AS du
  FROM stops s JOIN cells c ON ci = CAST(floor(y * 50) AS BIGINT) AND cj = CAST(floor(x * 50) AS BIGINT)
  WHERE CASE search WHEN 'trails' THEN kind = 'relation' AND route = 'bicycle' WHEN 'scenery' THEN coalesce(kind = 'node' AND "natural" IN ('water', 'beach', 'cliff', 'peak'), false) OR (kind = 'way' AND (coalesce("natural" IN ('water', 'coastline', 'wood'), false) OR coalesce(landuse = 'forest', false) OR coalesce(leisure = 'park', false)))
    ELSE kind = 'way' AND highway IS NOT NULL END
), along AS (
  SELECT DISTINCT search, route_id, element_id, kind, highway, surface, "natural", landuse, leisure, cycleway, maxspeed, traffic_calming, name, ref
  FROM (SELECT *, CASE WHEN du * du + dv * dv > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, (u * du + v * dv) / (du * du + dv * dv))) ELSE 0.0::DOUBLE END AS t FROM met)
  WHERE sqrt((u - t * du) * (u - t * du) + (v - t * dv) * (v - t * dv)) <= reach
)"""

ALONG = f"{STOPS}, {NEAR}"


def found(search: str) -> str:
    return f"ways AS (SELECT * FROM along WHERE search = '{search}')"


ORACLE_SQL = {
    "a13_places": f"WITH {sql.PLACES} SELECT id, lat, lng, name, type FROM pois WHERE {FROM_HOME} <= 15",
    "a14_segments": f"WITH {sql.SEGMENTS} {near_segments(10.0)}",
    "a15_highlights": f"""WITH {sql.HIGHLIGHTS} SELECT name, category, CAST(trunc((lng + 180.0::DOUBLE) / 360.0::DOUBLE * 2048.0::DOUBLE) AS BIGINT) AS x,
  CAST(trunc((1.0::DOUBLE - ln(tan(radians(lat)) + 1.0::DOUBLE / cos(radians(lat))) / {PI}) / 2.0::DOUBLE * 2048.0::DOUBLE) AS BIGINT) AS y FROM highlights""",
    "a15_tile_features": f"""WITH {sql.HIGHLIGHTS} SELECT id, name, category, {sql.r('lat', 6)} AS lat, {sql.r('lng', 6)} AS lng FROM highlights0 WHERE (id // 50) % 7 <> 3 QUALIFY row_number() OVER (PARTITION BY name ORDER BY id) = 1""",
    "a15_tile_errors": f"""WITH {sql.HIGHLIGHTS} SELECT id // 50 AS tile_id, count(*) FILTER (WHERE (id // 50) % 7 <> 3) AS n, CAST(max((id // 50) % 7 = 3)::INTEGER AS BIGINT) AS malformed FROM highlights0 GROUP BY 1""",
    "a15_tiles": f"""WITH {sql.SEGMENTS}, t AS (SELECT id, CAST(trunc((lng + 180.0::DOUBLE) / 360.0::DOUBLE * 2048.0::DOUBLE) AS BIGINT) AS x,
  CAST(trunc((1.0::DOUBLE - ln(tan(radians(lat)) + 1.0::DOUBLE / cos(radians(lat))) / {PI}) / 2.0::DOUBLE * 2048.0::DOUBLE) AS BIGINT) AS y FROM segments)
SELECT id, x + i AS x, y + j AS y FROM t, range(-2, 3) a(i), range(-2, 3) b(j)""",
    "a19_offsets": f"""{TYPED}, z AS (SELECT *, (['+00:00', '+02:00', '-05:00', '+05:30', '+05:45', ''])[k % 6 + 1] AS zone FROM t)
SELECT id, '06:' || m AS clock, CASE zone WHEN '+02:00' THEN 2.0::DOUBLE WHEN '-05:00' THEN -5.0::DOUBLE WHEN '+05:30' THEN 5.5::DOUBLE WHEN '+05:45' THEN 5.75::DOUBLE ELSE 0.0::DOUBLE END AS hours,
  CASE zone WHEN '+02:00' THEN 'UTC+2' WHEN '-05:00' THEN 'UTC-5' WHEN '+05:30' THEN 'UTC+5:30' WHEN '+05:45' THEN 'UTC+5:45' ELSE 'UTC' END AS label FROM z""",
    "c8_density_at": f"""WITH {CELLS}, {sql.PLACES} SELECT id, least(1.0::DOUBLE, coalesce(n, 0) / 10.0::DOUBLE) AS density FROM (SELECT id, {CELL} FROM places) LEFT JOIN cells USING (cell_lat, cell_lng)""",
    "c9_avoid_zones": f"WITH {CANDIDATES}, {sql.ZONES} SELECT origin, id FROM candidates c WHERE {FREE}",
    "d9_density": f"WITH {CELLS} SELECT * FROM cells",
    "k5_heatmap": f"WITH {sql.samples()} SELECT {CELL}, count(*) AS n FROM samples WHERE time_offset % 30 = 0 AND {box(20.0)} GROUP BY 1, 2",
    "d10_surface": f"WITH {sql.WAYS}{SURFACE_SQL}",
    "d11_scenic": f"WITH {sql.WAYS}{SCENIC_SQL}",
    "d12_elevation": f"WITH {sql.ROUTES}{CLIMBS_SQL}",
    "d13_safety": f"WITH {sql.WAYS}{SAFETY_SQL}",
    "d14_wind": f"WITH {sql.ROUTES}{WIND_SQL}",
    "d15_trails": f"WITH {sql.WAYS}{TRAILS_SQL}",
    "f6_ride_days": f"""WITH {sql.FORECAST}, week AS (SELECT * FROM day_scores WHERE date >= DATE '{WEEK}' AND date < DATE '{WEEK}' + INTERVAL 7 DAYS), good AS (SELECT date, score, weather, 'good day' AS advice FROM week WHERE score >= 60 ORDER BY date LIMIT 3)
SELECT * FROM good UNION ALL (SELECT date, score, weather, 'least bad' FROM week WHERE NOT EXISTS (SELECT 1 FROM good) ORDER BY score DESC, date LIMIT 1)""",
    "f7_waypoints": f"""WITH {scores(True)}, {sql.ZONES}, free AS (SELECT * FROM scored c WHERE {FREE}),
one AS (SELECT * FROM free ORDER BY score DESC, origin, id LIMIT 1),
two AS (SELECT c.* FROM free c, one WHERE {APART.format(o='one')} ORDER BY c.score DESC, c.origin, c.id LIMIT 1),
three AS (SELECT c.* FROM free c, one, two WHERE {APART.format(o='one')} AND {APART.format(o='two')} ORDER BY c.score DESC, c.origin, c.id LIMIT 1)
SELECT CAST(row_number() OVER (ORDER BY angle, origin, id) AS INTEGER) AS place, origin, id, name, reason, {sql.r('score', 6)} AS score FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three)""",
    "g2_along_route": f"WITH {sql.ROUTES}, {sql.ELEMENTS}, {EVERYWHERE}, {NEAR} SELECT search, route_id, element_id, kind FROM along",
    "l_route_report": f"""WITH {sql.ROUTES}, {sql.ELEMENTS}, {ALONG}
SELECT r.route_id, len(lats) AS points, coalesce(match_pct, 100) AS match_pct, coalesce(surfaces, '') AS surfaces, s.warning AS surface_warning, coalesce(scenic_score, 0) AS scenic_score, coalesce(features, '') AS features, coalesce(trails, '') AS trails,
  coalesce(safety_score, 0) AS safety_score, coalesce(bike_pct, 0) AS bike_pct, coalesce(slow_pct, 0) AS slow_pct, coalesce(calm_pct, 0) AS calm_pct, total_climb, total_descent, max_gradient, head_pct, cross_pct, w.warning AS wind_warning
FROM routes r LEFT JOIN (WITH {found('surface')}{SURFACE_SQL}) s USING (route_id) LEFT JOIN (WITH {found('scenery')}{SCENIC_SQL}) c USING (route_id) LEFT JOIN (WITH {found('trails')}{TRAILS_SQL}) t USING (route_id)
  LEFT JOIN (WITH {found('safety')}{SAFETY_SQL}) f USING (route_id) LEFT JOIN (WITH none AS (SELECT 1){CLIMBS_SQL}) e USING (route_id) LEFT JOIN (WITH none AS (SELECT 1){WIND_SQL}) w USING (route_id)""",
    "l_day_warnings": f"""WITH {sql.FORECAST}, d AS (SELECT *, dayofyear(date) * 7 % 130 AS air FROM forecast)
SELECT date, concat_ws('; ', CASE WHEN wind > 30 THEN 'High wind — consider a sheltered route' END, CASE WHEN precip > 5 THEN 'Rain expected — check conditions' END,
  CASE WHEN uv_max >= 8 THEN 'Very high UV (' || CAST(uv_max AS BIGINT) || ') — wear sunscreen, ride early or late' WHEN uv_max >= 6 THEN 'High UV (' || CAST(uv_max AS BIGINT) || ') — sunscreen recommended' END,
  CASE WHEN temp_max > 35 THEN 'Extreme heat — ride before 9am or after 6pm' WHEN temp_max > 30 THEN 'Hot day — consider an early morning ride' END,
  CASE WHEN air > 100 THEN 'Poor air quality (AQI ' || air || ') — consider indoor ride' WHEN air > 50 THEN 'Moderate air quality (AQI ' || air || ')' END) AS warnings FROM d""",
    "g1_candidates": f"WITH {CANDIDATES} SELECT origin, id, name, reason, kind FROM candidates",
    "h5_distance": f"WITH {sql.PLACES} SELECT id, {sql.r(FROM_HOME, 6)} AS km FROM places",
    "h6_day_score": f"WITH {sql.FORECAST} SELECT date, score, weather FROM day_scores",
    "h7_best_hours": f"""WITH {sql.HOURS}, s AS (SELECT time, CAST(greatest(0, 100 - CASE WHEN temp < 5 OR temp > 38 THEN 30 WHEN temp < 10 OR temp > 35 THEN 20 WHEN temp < 13 OR temp > 30 THEN 10 ELSE 0 END
  - CASE WHEN wind > 40 THEN 40 WHEN wind > 30 THEN 25 WHEN wind > 20 THEN 10 ELSE 0 END - CASE WHEN uv >= 11 THEN 25 WHEN uv >= 8 THEN 15 WHEN uv >= 6 THEN 5 ELSE 0 END
  - CASE WHEN precip > 2 THEN 40 WHEN precip > 0.5::DOUBLE THEN 20 WHEN precip > 0 THEN 5 ELSE 0 END) AS INTEGER) AS score FROM hours WHERE CAST(substr(time, 12, 2) AS INTEGER) BETWEEN 6 AND 20)
SELECT time, score, CAST(row_number() OVER (PARTITION BY substr(time, 1, 10) ORDER BY score DESC, time) AS INTEGER) AS place FROM s""",
    "h10_plans": f"""WITH RECURSIVE {FITNESS}, form AS (SELECT athlete_id, tsb FROM days QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY date DESC) = 1), o AS (
  SELECT athlete_id, avg_speed_kmh AS v FROM rides WHERE sport_type = 'cycling_outdoor' AND distance_m > 5000
), s AS (
  SELECT athlete_id, CASE WHEN count(*) FILTER (WHERE v > 22) >= 5 THEN quantile_cont(v, 0.5) FILTER (WHERE v > 22) END AS a, quantile_cont(v, 0.5) FILTER (WHERE v > 0) AS c FROM o GROUP BY 1
), p AS (SELECT athlete_id, tsb, {sql.r(f"150 / 60.0::DOUBLE * coalesce(nullif({sql.r('a', 1)}, 0), nullif({sql.r('c', 1)}, 0), 27.0::DOUBLE)", 1)} AS km FROM form LEFT JOIN s USING (athlete_id))
SELECT athlete_id, km, CASE WHEN tsb <= -10 THEN {sql.r('km * 0.8::DOUBLE', 1)} ELSE km END AS fitted_km, CASE WHEN tsb > 10 THEN 'fresh' WHEN tsb > -10 THEN 'neutral' WHEN tsb IS NOT NULL THEN 'fatigued' END AS form FROM p""",
    "h12_durations": f"""{TYPED} SELECT id, CASE k % 7 WHEN 0 THEN CAST(a AS INTEGER) * 60 WHEN 1 THEN CAST(b AS INTEGER) * 60 + CAST(a AS INTEGER) WHEN 2 THEN CAST(a AS INTEGER) WHEN 3 THEN CAST(b AS INTEGER) * 60 + CAST(m AS INTEGER)
  WHEN 6 THEN CAST(b AS INTEGER) * 60 + CAST(a AS INTEGER) END AS minutes FROM t""",
    "h13_distances": f"""{TYPED} SELECT id, CASE k % 5 WHEN 0 THEN CAST(a AS DOUBLE) WHEN 1 THEN CAST(a AS DOUBLE) WHEN 2 THEN CAST(a || '.' || b AS DOUBLE) WHEN 3 THEN CAST(b AS DOUBLE) END AS km FROM t""",
    "h14_times": f"""{TYPED}, h AS (SELECT *, CAST(b AS INTEGER) AS h FROM t), u AS (SELECT *, CASE k % 5 WHEN 1 THEN CASE WHEN h < 12 THEN h + 12 ELSE h END WHEN 2 THEN CASE WHEN h = 12 THEN 0 ELSE h END WHEN 3 THEN h END AS hour FROM h)
SELECT id, CASE WHEN k % 5 = 0 THEN lpad(b, 2, '0') || ':' || m WHEN hour <= 23 THEN lpad(CAST(hour AS VARCHAR), 2, '0') || ':00' END AS clock FROM u""",
    "h15_dates": f"""{TYPED}, d AS (SELECT id, k % 11 AS f, CAST(o_orderdate AS DATE) AS day FROM t) SELECT id, CASE WHEN f = 0 OR f = 9 THEN day WHEN f = 1 THEN CAST(day + INTERVAL 1 DAY AS DATE)
  WHEN f BETWEEN 2 AND 8 THEN CAST(day + to_days(CAST(CASE WHEN (f - 2 - (isodow(day) - 1) + 7) % 7 = 0 THEN 7 ELSE (f - 2 - (isodow(day) - 1) + 7) % 7 END AS INTEGER)) AS DATE) END AS day FROM d""",
    "h16_locations": f"""{TYPED}, p AS (SELECT id, CASE k % 5 WHEN 0 THEN CAST(a AS DOUBLE) WHEN 1 THEN CAST('-' || a || '.' || b AS DOUBLE) WHEN 2 THEN CAST('1' || a AS DOUBLE) END AS lat, CASE k % 5 WHEN 0 THEN CAST(b AS DOUBLE) WHEN 1 THEN -CAST(b AS DOUBLE) WHEN 2 THEN CAST(b AS DOUBLE) END AS lng FROM t)
SELECT id, CASE WHEN lat BETWEEN -90 AND 90 THEN lat END AS lat, CASE WHEN lat BETWEEN -90 AND 90 THEN lng END AS lng FROM p""",
    "h17_loop": f"""WITH {sql.SEGMENTS}, p AS (SELECT id, k, lat, lng, athlete_count / 100.0::DOUBLE / {2 * math.pi!r}::DOUBLE * 0.8::DOUBLE AS r, {2 * math.pi!r}::DOUBLE * k / 4.0::DOUBLE - {PI} / 2 AS a FROM segments, range(0, 4) t(k))
SELECT id, CAST(k AS INTEGER) AS k, {sql.r('lat + r / 111.0::DOUBLE * sin(a)', 5)} AS lat, {sql.r('lng + r / (111.0::DOUBLE * cos(radians(lat))) * cos(a)', 5)} AS lng FROM p""",
    "h18_corridor": f"""WITH {sql.SEGMENTS}, p AS (SELECT id, k, lat - 38.7::DOUBLE AS y, lng + 9.14::DOUBLE AS x, cos(radians((38.7::DOUBLE + lat) / 2.0::DOUBLE)) AS f, (40.0::DOUBLE - athlete_count / 200.0::DOUBLE) / 6.0::DOUBLE * 1.2::DOUBLE AS o, k / 4.0::DOUBLE AS t, CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END AS s
  FROM segments, range(1, 4) r(k) WHERE athlete_count / 200.0::DOUBLE < 40)
SELECT id, CAST(k - 1 AS INTEGER) AS k, {sql.r(f'38.7::DOUBLE + y * t + s * o / 111.0::DOUBLE * sin(atan2(x, y) + {PI} / 2)', 5)} AS lat, {sql.r(f'-9.14::DOUBLE + x * t + s * o / (111.0::DOUBLE * f) * cos(atan2(x, y) + {PI} / 2)', 5)} AS lng
FROM p WHERE sqrt(pow(y * 111.0::DOUBLE, 2) + pow(x * 111.0::DOUBLE * f, 2)) >= 1""",
    "h19_scores": f"WITH {scores(True)} SELECT origin, id, {sql.r('km', 6)} AS km, {sql.r('score', 6)} AS score FROM scored",
    "h19_scores_familiar": f"WITH {scores(False)} SELECT origin, id, {sql.r('score', 6)} AS score FROM scored",
    "h21_day_lines": f"""WITH {sql.FORECAST} SELECT date, concat_ws(', ', weather, CAST(temp_min AS INTEGER) || '-' || CAST(temp_max AS INTEGER) || '°C', 'wind ' || CAST(wind AS INTEGER) || ' km/h', CASE WHEN uv_max >= 6 THEN 'UV ' || CAST(uv_max AS INTEGER) END,
  CASE WHEN precip > 0 THEN 'rain ' || printf('%.1f', precip) || 'mm' END) AS line FROM day_scores""",
    "h22_slugs": """SELECT doc_id, left(trim(regexp_replace(regexp_replace(lower(strip_accents(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 .,éèàâêîôûçñüöäáíóú-]', '-', 'g'))), '[^a-z0-9]+', '-', 'g'), '-+', '-', 'g'), '-'), 80) AS slug FROM documents""",
    "h23_epochs": f"WITH {sql.RAW} SELECT id, CAST(epoch(start) AS BIGINT) AS epoch FROM raw",
}
