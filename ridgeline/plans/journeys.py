"""Queries of compositions: planned rides, the week's recommendation, places by name, types looked up anew."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.rounding import half_even
from ..operators import fitness, history, metrics, nearby, planning, waypoints
from ..sources import driver_tables as tables
from ..sources.scratch import settled
from ..streaming import sync
from . import oracle_tables as sql
from .places import APART, FREE, HOME, PI, WEEK, away, cases
from .rides import ATHLETES_AT_ONCE, FITNESS, days, rides


def scored_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.scored_days(tables.forecast(spark, sf_dir))


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rides(spark, sf_dir)
    return planning.planned(tables.requests(spark, sf_dir), fitness.latest(days(spark, sf_dir)), history.usual_speeds(r), scored_days(spark, sf_dir), F.col("as_of"))


def l_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(spark, sf_dir).select("id", "athlete_id", "target_km", "km", "minutes", "form", "ride_date", "clock", "name", "error", "weather", "weather_score", F.col("costing.costing").alias("costing"), F.col("costing.bicycle_type").alias("bicycle_type"), F.col("costing.use_roads").alias("use_roads"), F.col("costing.use_hills").alias("use_hills"), F.size("locations").alias("stops"))


def form_and_speeds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A row an athlete each, worked out once: all reads of the requests see the same values, and are not dealt out by athlete while these are few."""
    form, speeds = settled(fitness.latest(days(spark, sf_dir))), settled(history.usual_speeds(rides(spark, sf_dir)))
    return nearby.small(form, ATHLETES_AT_ONCE), nearby.small(speeds, ATHLETES_AT_ONCE)


def request_waypoints(spark: SparkSession, sf_dir: str, asks: DataFrame, found: Callable[..., DataFrame] = waypoints.for_requests) -> DataFrame:
    """Waypoints for all requests (as sized) from the places, segments and highlights around their own starts."""
    s = tables.samples(spark, sf_dir)
    ridden = history.ridden_cells(s, tables.sample_rides(s).withColumn("athlete_id", F.col("id") % tables.ATHLETES), F.lit("2024-01-31").cast("date"))
    rows = asks.where(F.col("waypoints").isNull()).select(F.col("id").alias("request"), "athlete_id", F.col("start.lat").alias("lat"), F.col("start.lng").alias("lng"), "km", "explore")
    return found(rows, tables.places(spark, sf_dir), tables.segments(spark, sf_dir), tables.highlights(spark, sf_dir), ridden, tables.zones(spark, sf_dir))


def f7_request_waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    form, speeds = form_and_speeds(spark, sf_dir)
    chosen = request_waypoints(spark, sf_dir, planning.sized(tables.travelling_requests(spark, sf_dir), form, speeds))
    return chosen.select("request", "place", "origin", "id", "name", "reason", half_even(F.col("score"), 6).alias("score"))


def l_plan_waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that name no waypoints get those of their surroundings; `route`: what the routing service is asked to connect.

    Requests are read twice, first for what they ask; nothing is dealt out or written by request.
    """
    asked = tables.travelling_requests(spark, sf_dir)
    form, speeds = form_and_speeds(spark, sf_dir)
    answers = request_waypoints(spark, sf_dir, planning.sized(asked, form, speeds), waypoints.answers)
    plans = planning.planned(asked, form, speeds, scored_days(spark, sf_dir), F.col("as_of"), answers=answers)
    route = F.array_join(F.transform("locations", lambda p: F.format_string("%.5f,%.5f", p["lat"], p["lng"])), " ")
    return plans.select("id", "athlete_id", "km", "name", "error", route.alias("route"))


def a21_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the routing service is asked for on the way to each segment, or around home."""
    s, place = tables.segments(spark, sf_dir), lambda lat, lng: F.struct(lat.alias("lat"), lng.alias("lng"))
    home = place(F.lit(HOME[0]), F.lit(HOME[1]))
    points = F.when(F.col("id") % 5 == 0, F.array(place(F.lit(38.8), F.lit(-9.2))))
    asked = planning.locations(home, points, F.when(F.col("id") % 3 != 0, place(F.col("lat"), F.col("lng"))), F.col("id") % 2 == 0, F.col("athlete_count") / F.lit(100.0))
    return s.select("id", F.posexplode(asked).alias("k", "p")).select("id", "k", "p.lat", "p.lng")


def c10_ride_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rides(spark, sf_dir).select("id", F.date_add(F.to_date("date"), (F.col("id") % 400).cast("int")).alias("ride_date"))
    return planning.with_forecast(r, scored_days(spark, sf_dir))


def a12_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    asked = o.select(k.alias("id"), F.concat(F.lit(" place "), (F.col("o_custkey") % 900).cast("string")).alias("place"), (F.lit(38.7) + k % 5).alias("near_lat"), F.lit(-9.14).alias("near_lng"))
    return waypoints.located(asked, tables.highlights(spark, sf_dir))


def l_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rides(spark, sf_dir)
    return planning.recommended(fitness.latest(days(spark, sf_dir)), history.recent_routes(r), scored_days(spark, sf_dir), F.lit(WEEK).cast("date"))


def d6_lacking_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rides(spark, sf_dir).withColumn("ride_ftp", F.when(F.col("id") % 3 == 0, F.lit(200.0)))
    return metrics.lacking_threshold(r)


def i10_reclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The service now calls some rides runs or e-bike rides, and lists others no more."""
    k = F.col("id")
    raw = tables.raw_rides(spark, sf_dir)
    now = raw.where(k % 7 != 0).select("id", F.when(k % 5 == 0, "Run").when(k % 5 == 1, "EBikeRide").otherwise(F.col("type")).alias("type"), (k % 4 == 0).alias("trainer"))
    return sync.reclassified(rides(spark, sf_dir), now).select("id", "service_type", "trainer", "sport_type", "is_indoor")


def h5_straight_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the planned destinations lie from the start."""
    r = tables.requests(spark, sf_dir).where(F.col("destination").isNotNull())
    return r.select("id", F.round(geo.distance_km(F.col("start.lat"), F.col("start.lng"), F.col("destination.lat"), F.col("destination.lng")), 6).alias("km"))


QUERIES = {f.__name__: f for f in (l_plan, f7_request_waypoints, l_plan_waypoints, a21_locations, c10_ride_weather, a12_located, l_recommend, d6_lacking_threshold, i10_reclassified, h5_straight_lines)}



def requests_sql(lat0: str = "38.7::DOUBLE", lng0: str = "-9.14::DOUBLE") -> str:
    """requests and straight: the requests, their start, and the straight line to their destination."""
    return f"""requests AS (
  SELECT o_orderkey AS id, o_orderkey AS k, o_custkey AS c, o_custkey % 20 AS athlete_id, CAST(o_orderdate AS DATE) AS as_of, {lat0} AS lat0, {lng0} AS lng0, o_orderkey % 3 <> 0 AS explore,
    CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 8 = 3 THEN (o_orderkey % 5 + 1) * 60 + o_orderkey % 60 END AS mins, CASE WHEN o_orderkey % 4 = 1 THEN (o_orderkey % 80 + 10)::DOUBLE END AS dist,
    (['road', 'gravel', 'mtb', 'city'])[o_orderkey % 4 + 1] AS surface, o_orderkey % 4 = 2 OR o_orderkey % 8 = 3 AS away, (o_orderkey % 6 = 0 OR NOT (o_orderkey % 4 = 2 OR o_orderkey % 8 = 3)) AS loop,
    38.7::DOUBLE + (o_orderkey * 29 % 500 - 250) / 1250.0::DOUBLE AS lat, -9.14::DOUBLE + (o_orderkey * 43 % 500 - 250) / 1250.0::DOUBLE AS lng FROM orders
), straight AS (
  SELECT *, CASE WHEN away THEN {away('lat0', 'lng0', 'lat', 'lng')} END AS line FROM requests
)"""


REQUESTS = requests_sql()
TRAVELLING = requests_sql("38.7::DOUBLE + (o_custkey * 37 % 300 - 150) / 100.0::DOUBLE", "-9.14::DOUBLE + (o_custkey * 53 % 300 - 150) / 100.0::DOUBLE")
SPEEDS = f"""o AS (SELECT athlete_id, avg_speed_kmh AS v FROM rides WHERE sport_type = 'cycling_outdoor' AND distance_m > 5000), speeds AS (
  SELECT athlete_id, nullif({sql.r("quantile_cont(v, 0.5) FILTER (WHERE v > 0)", 1)}, 0) AS any_speed,
    CASE WHEN count(*) FILTER (WHERE v > 22) >= 5 THEN nullif({sql.r("quantile_cont(v, 0.5) FILTER (WHERE v > 22)", 1)}, 0) END AS road,
    CASE WHEN count(*) FILTER (WHERE v > 0 AND v < 25) >= 5 THEN nullif({sql.r("quantile_cont(v, 0.5) FILTER (WHERE v > 0 AND v < 25)", 1)}, 0) END AS offroad FROM o GROUP BY 1
)"""
FORM = "form AS (SELECT athlete_id, tsb FROM days QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY date DESC) = 1)"

#: a, b, g: requests with their speed, target, minutes, fitted distance and day.
SIZED = f"""a AS (
  SELECT q.*, f.tsb, coalesce(CASE surface WHEN 'road' THEN coalesce(s.road, s.any_speed) WHEN 'city' THEN s.any_speed ELSE coalesce(s.offroad, s.any_speed) END, CASE surface WHEN 'road' THEN 27.0::DOUBLE WHEN 'mtb' THEN 17.0::DOUBLE ELSE 22.0::DOUBLE END) AS speed,
    {sql.r('line * 1.3::DOUBLE', 1)} AS there FROM straight q LEFT JOIN form f USING (athlete_id) LEFT JOIN speeds s USING (athlete_id)
), b AS (
  SELECT *, coalesce(dist, {sql.r('mins / 60.0::DOUBLE * speed', 1)}, there * CASE WHEN loop THEN 2 ELSE 1 END) AS target_km,
    CAST(coalesce(floor(dist / speed * 60), CASE WHEN dist IS NULL THEN mins END, floor(there / speed * 60) * CASE WHEN loop THEN 2 ELSE 1 END) AS INTEGER) AS minutes FROM a
), g AS (
  SELECT *, CASE WHEN tsb <= -10 THEN {sql.r('target_km * 0.8::DOUBLE', 1)} ELSE target_km END AS km,
    (CASE c % 4 WHEN 0 THEN as_of WHEN 1 THEN as_of + 1 WHEN 2 THEN as_of END)::DATE AS ride_date FROM b
)"""
NAMED = """CASE WHEN away THEN upper(surface[1]) || surface[2:] || ' to Place ' || (k % 100) WHEN dist IS NOT NULL THEN CAST(dist AS BIGINT) || 'km ' || upper(surface[1]) || surface[2:]
    WHEN mins IS NOT NULL THEN (mins // 60) || 'h' || right('0' || (mins % 60), 2) || 'm ' || upper(surface[1]) || surface[2:] END"""
RADIUS_BY_ROW = f"km / {2 * math.pi!r}::DOUBLE * 1.2::DOUBLE"
NEAR = "greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(km_off - radius * 0.7::DOUBLE) / radius)"
COLUMNS = "request, athlete_id, lat0, lng0, radius, explore, origin, id, lat, lng, name, reason, kind, km_off"


def best(n: int, apart_from: tuple[str, ...]) -> str:
    """The request's best candidate that lies apart from those chosen before."""
    joined = "".join(f" LEFT JOIN {o} ON {o}.request = c.request" for o in apart_from)
    tests = " AND ".join(f"({o}.angle IS NULL OR {APART.format(o=o)})" for o in apart_from) or "true"
    return f"SELECT c.* FROM scored c{joined} WHERE {tests} QUALIFY row_number() OVER (PARTITION BY c.request ORDER BY c.score DESC, c.origin, c.id) = 1"


CHOSEN = f"""{sql.samples()}, {sql.SAMPLE_RIDES}, cells AS (
  SELECT activity_id % 20 AS athlete_id, CAST(round_even(lat / 0.005::DOUBLE, 0) AS BIGINT) AS cell_lat, CAST(round_even(lng / 0.005::DOUBLE, 0) AS BIGINT) AS cell_lng, count(*) AS n
  FROM samples WHERE lat IS NOT NULL AND time_offset % 30 = 0 AND activity_id IN (SELECT id FROM sample_rides WHERE date >= DATE '2024-01-31' - INTERVAL 30 DAYS) GROUP BY 1, 2, 3
), {sql.PLACES}, {sql.SEGMENTS}, {sql.HIGHLIGHTS}, {sql.ZONES}, asks AS (
  SELECT id AS request, athlete_id, lat0, lng0, {RADIUS_BY_ROW} AS radius, explore FROM g WHERE k % 10 <> 0 AND km > 0
), spots AS (
  SELECT * FROM (
    SELECT 1 AS origin, id, lat, lng, name, 'POI: ' || split_part(type, '=', 2) AS reason, {cases('type', waypoints.PLACE_WEIGHTS)} AS kind FROM pois
    UNION ALL SELECT 3, id, lat, lng, name, 'Highlight: ' || replace(category, '_', ' '), {cases('category', waypoints.HIGHLIGHT_WEIGHTS)} FROM highlights
  ) c WHERE {FREE}
), popular AS (
  SELECT a.*, s.* FROM asks a JOIN segments s ON abs(s.lat - lat0) <= radius / 111.0::DOUBLE AND abs(s.lng - lng0) <= radius / (111.0::DOUBLE * cos(radians(lat0)))
  QUALIFY row_number() OVER (PARTITION BY request ORDER BY athlete_count DESC, id) <= 10
), near AS (
  SELECT {COLUMNS} FROM (SELECT a.*, s.*, {away('lat0', 'lng0', 'lat', 'lng')} AS km_off FROM asks a JOIN spots s ON abs(s.lat - lat0) <= radius * 0.014::DOUBLE)
  WHERE km_off <= CASE origin WHEN 1 THEN radius ELSE radius * 1.5::DOUBLE END
  UNION ALL
  SELECT {COLUMNS} FROM (SELECT *, 2 AS origin, 'Popular segment (' || athlete_count || ' cyclists)' AS reason, least(1.0::DOUBLE, athlete_count / 500.0::DOUBLE) AS kind, {away('lat0', 'lng0', 'lat', 'lng')} AS km_off FROM popular) c
  WHERE km_off <= radius * 1.5::DOUBLE AND {FREE}
), ridden AS (
  SELECT request FROM asks a WHERE EXISTS (SELECT 1 FROM cells x WHERE x.athlete_id = a.athlete_id AND abs(x.cell_lat * 0.005::DOUBLE - lat0) < radius * 1.5::DOUBLE / 111.0::DOUBLE AND abs(x.cell_lng * 0.005::DOUBLE - lng0) < radius * 1.5::DOUBLE / 80.0::DOUBLE)
), weighed AS (
  SELECT f.*, least(1.0::DOUBLE, coalesce(x.n, 0) / 10.0::DOUBLE) AS density, f.request IN (SELECT request FROM ridden) AS known
  FROM near f LEFT JOIN cells x ON x.athlete_id = f.athlete_id AND x.cell_lat = CAST(round_even(lat / 0.005::DOUBLE, 0) AS BIGINT) AND x.cell_lng = CAST(round_even(lng / 0.005::DOUBLE, 0) AS BIGINT)
), scored AS (
  SELECT *, CASE WHEN known THEN {NEAR} * CASE origin WHEN 1 THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END + kind * CASE origin WHEN 1 THEN 0.3::DOUBLE ELSE 0.4::DOUBLE END + CASE WHEN explore THEN 1.0::DOUBLE - density ELSE density END * 0.3::DOUBLE
    ELSE {NEAR} * CASE origin WHEN 1 THEN 0.6::DOUBLE WHEN 2 THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END + kind * CASE origin WHEN 1 THEN 0.4::DOUBLE WHEN 2 THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END END AS score, atan2(lat - lat0, lng - lng0) AS angle FROM weighed
), one AS ({best(1, ())}), two AS ({best(2, ('one',))}), three AS ({best(3, ('one', 'two'))}), chosen AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY request ORDER BY angle, origin, id) AS INTEGER) AS place FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three)
)"""

ORACLE_SQL = {
    "l_plan": f"""WITH RECURSIVE {FITNESS}, {FORM}, {SPEEDS}, {REQUESTS}, {sql.FORECAST}, {SIZED}
SELECT g.id, athlete_id, target_km, km, minutes, CASE WHEN tsb > 10 THEN 'fresh' WHEN tsb > -10 THEN 'neutral' WHEN tsb IS NOT NULL THEN 'fatigued' END AS form, ride_date,
  (['14:00', '14:00', '09:00', NULL])[(c + k) % 4 + 1] AS clock,
  {NAMED} AS name,
  CASE WHEN target_km IS NULL THEN 'give a duration, a distance or a destination' END AS error, d.weather, d.score AS weather_score,
  CASE surface WHEN 'mtb' THEN 'mountain_bike' ELSE 'bicycle' END AS costing, CASE surface WHEN 'road' THEN 'Road' WHEN 'gravel' THEN 'Cross' END AS bicycle_type,
  CASE WHEN surface <> 'city' THEN {sql.r('1.0::DOUBLE - k % 11 / 10.0::DOUBLE', 1)} END AS use_roads, CASE surface WHEN 'road' THEN 0.3::DOUBLE WHEN 'gravel' THEN 0.5::DOUBLE END AS use_hills,
  CASE WHEN target_km IS NOT NULL THEN 1 + CASE WHEN k % 10 = 0 THEN 1 WHEN NOT away THEN 4 WHEN line * 1.3::DOUBLE >= km OR line < 1 THEN 0 ELSE 3 END + CASE WHEN away THEN 1 ELSE 0 END + CASE WHEN loop OR NOT away THEN 1 ELSE 0 END END AS stops
FROM g LEFT JOIN day_scores d ON d.date = g.ride_date""",
    "f7_request_waypoints": f"""WITH RECURSIVE {FITNESS}, {FORM}, {SPEEDS}, {TRAVELLING}, {SIZED}, {CHOSEN}
SELECT request, place, origin, id, name, reason, {sql.r('score', 6)} AS score FROM chosen""",
    "l_plan_waypoints": f"""WITH RECURSIVE {FITNESS}, {FORM}, {SPEEDS}, {TRAVELLING}, {SIZED}, {CHOSEN}, w AS (
  SELECT request, array_to_string(list(printf('%.5f,%.5f', lat, lng) ORDER BY place), ' ') AS points, array_to_string(list(name ORDER BY place), ', ') AS names FROM chosen GROUP BY 1
), m AS (
  SELECT id, array_to_string(list(printf('%.5f,%.5f', {sql.r(f'lat0 + y * t + s * o / 111.0::DOUBLE * sin(atan2(x, y) + {PI} / 2)', 5)}, {sql.r(f'lng0 + x * t + s * o / (111.0::DOUBLE * f) * cos(atan2(x, y) + {PI} / 2)', 5)}) ORDER BY i), ' ') AS points
  FROM (SELECT *, lat - lat0 AS y, lng - lng0 AS x, cos(radians((lat0 + lat) / 2.0::DOUBLE)) AS f, (km - line * 1.3::DOUBLE) / 6.0::DOUBLE * 1.2::DOUBLE AS o, i / 4.0::DOUBLE AS t, CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END AS s FROM g, range(1, 4) r(i) WHERE away AND line * 1.3::DOUBLE < km AND line >= 1)
  GROUP BY id
), l AS (
  SELECT id, array_to_string(list(printf('%.5f,%.5f', {sql.r('lat0 + r / 111.0::DOUBLE * sin(a)', 5)}, {sql.r('lng0 + r / (111.0::DOUBLE * cos(radians(lat0))) * cos(a)', 5)}) ORDER BY i), ' ') AS points
  FROM (SELECT *, km / {2 * math.pi!r}::DOUBLE * 0.8::DOUBLE AS r, {2 * math.pi!r}::DOUBLE * i / 4.0::DOUBLE - {PI} / 2 AS a FROM g, range(0, 4) t(i) WHERE NOT away) GROUP BY id
)
SELECT g.id, athlete_id, km, {NAMED} || CASE WHEN k % 10 <> 0 AND w.names IS NOT NULL THEN ' via ' || w.names ELSE '' END AS name, CASE WHEN target_km IS NULL THEN 'give a duration, a distance or a destination' END AS error,
  CASE WHEN target_km IS NOT NULL THEN concat_ws(' ', printf('%.5f,%.5f', lat0, lng0), CASE WHEN k % 10 = 0 THEN '38.80000,-9.20000' ELSE coalesce(m.points, w.points, l.points) END,
    CASE WHEN away THEN printf('%.5f,%.5f', lat, lng) END, CASE WHEN loop OR NOT away THEN printf('%.5f,%.5f', lat0, lng0) END) END AS route
FROM g LEFT JOIN w ON w.request = g.id LEFT JOIN m ON m.id = g.id LEFT JOIN l ON l.id = g.id""",
    "a21_locations": f"""WITH {sql.SEGMENTS}, p AS (
  SELECT id, -1 AS o, 0 AS k, 38.7::DOUBLE AS lat, -9.14::DOUBLE AS lng FROM segments
  UNION ALL SELECT id, 0, 0, 38.8::DOUBLE, -9.2::DOUBLE FROM segments WHERE id % 5 = 0
  UNION ALL SELECT id, 0, k, {sql.r('38.7::DOUBLE + r / 111.0::DOUBLE * sin(a)', 5)}, {sql.r('-9.14::DOUBLE + r / (111.0::DOUBLE * cos(radians(38.7::DOUBLE))) * cos(a)', 5)} FROM (
    SELECT id, k, athlete_count / 100.0::DOUBLE / (2 * pi()) * 0.8::DOUBLE AS r, 2 * pi() * k / 4.0::DOUBLE - pi() / 2 AS a FROM segments, range(0, 4) t(k) WHERE id % 5 <> 0 AND id % 3 = 0)
  UNION ALL SELECT id, 1, 0, lat, lng FROM segments WHERE id % 3 <> 0
  UNION ALL SELECT id, 2, 0, 38.7::DOUBLE, -9.14::DOUBLE FROM segments WHERE id % 3 = 0 OR id % 2 = 0
) SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY o, k) - 1 AS INTEGER) AS k, lat, lng FROM p""",
    "c10_ride_weather": f"WITH {sql.RIDES}, {sql.FORECAST} SELECT r.id, ride_date, d.weather, d.score AS weather_score FROM (SELECT id, CAST(CAST(date AS DATE) + CAST(id % 400 AS INTEGER) AS DATE) AS ride_date FROM rides) r LEFT JOIN day_scores d ON d.date = r.ride_date",
    "a12_located": f"""WITH {sql.HIGHLIGHTS}, a AS (SELECT o_orderkey AS id, 'place ' || (o_custkey % 900) AS place, 38.7::DOUBLE + o_orderkey % 5 AS y, -9.14::DOUBLE AS x FROM orders)
SELECT a.id, h.lat, h.lng, h.name FROM a JOIN highlights0 h ON lower(h.name) = a.place QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY NOT (abs(h.lat - y) <= 1 AND abs(h.lng - x) <= 1),
  sqrt(pow((h.lat - y) * 111.0::DOUBLE, 2) + pow((h.lng - x) * 111.0::DOUBLE * cos(radians((h.lat + y) / 2.0::DOUBLE)), 2)), h.id) = 1""",
    "l_recommend": f"""WITH RECURSIVE {FITNESS}, {FORM}, {sql.FORECAST}, recent AS (
  SELECT r.*, f.tsb FROM rides r LEFT JOIN form f USING (athlete_id) WHERE sport_type = 'cycling_outdoor' AND distance_m > 5000 QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY date DESC NULLS FIRST, id) <= 50
), ranked AS (SELECT *, CASE WHEN tsb < -10 THEN distance_m WHEN tsb > 10 THEN -distance_m END AS o FROM recent), firsts AS (
  SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY athlete_id, {sql.r('distance_m / 1000')}, {sql.r('elevation_m / 50')} ORDER BY o, date DESC NULLS LAST, id) = 1
), chosen AS (SELECT *, CAST(row_number() OVER (PARTITION BY athlete_id ORDER BY o, date DESC NULLS LAST, id) AS INTEGER) AS place FROM firsts QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY o, date DESC NULLS LAST, id) <= 3
), week AS (SELECT * FROM day_scores WHERE date >= DATE '{WEEK}' AND date < DATE '{WEEK}' + INTERVAL 7 DAYS), good AS (SELECT *, 'good day' AS advice FROM week WHERE score >= 60 ORDER BY date LIMIT 3
), advised AS (SELECT * FROM good UNION ALL (SELECT *, 'least bad' FROM week WHERE NOT EXISTS (SELECT 1 FROM good) ORDER BY score DESC, date LIMIT 1))
SELECT athlete_id, 'form' AS section, 1 AS place, CASE WHEN tsb > 10 THEN 'fresh' WHEN tsb > -10 THEN 'neutral' ELSE 'fatigued' END || ' (form ' || CASE WHEN tsb >= 0 THEN '+' ELSE '-' END || CAST(round_even(abs(tsb), 0) AS BIGINT) || ')' AS line FROM form WHERE tsb IS NOT NULL
UNION ALL SELECT athlete_id, 'route', place, name || ', ' || printf('%.1f', {sql.r('distance_m / 1000', 1)}) || ' km, ' || CAST(round_even(elevation_m, 0) AS BIGINT) || ' m up, last ' || strftime(date, '%Y-%m-%d') FROM chosen
UNION ALL SELECT NULL, 'day', CAST(row_number() OVER (ORDER BY date) AS INTEGER), advice || ': ' || strftime(date, '%Y-%m-%d') || ', ' || weather || ', ' || score FROM advised""",
    "d6_lacking_threshold": f"WITH {sql.RIDES} SELECT athlete_id, count(*) FILTER (WHERE id % 3 <> 0) AS n FROM rides GROUP BY 1",
    "i10_reclassified": f"""WITH {sql.RIDES}, now AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'Run' WHEN id % 5 = 1 THEN 'EBikeRide' ELSE type END AS type, id % 4 = 0 AS trainer FROM raw WHERE id % 7 <> 0), b AS (
  SELECT r.id, coalesce(n.type, r.service_type) AS service_type, coalesce(n.trainer, r.trainer) AS trainer, r.device, r.distance_m, r.sport_type AS old, n.id IS NOT NULL AS listed FROM rides r LEFT JOIN now n USING (id)
), s AS (SELECT *, CASE WHEN NOT listed THEN old WHEN device = 'zwift' OR lower(service_type) = 'virtualride' THEN 'zwift' WHEN trainer THEN 'cycling_indoor' WHEN lower(service_type) = 'ebikeride' THEN 'ebike' WHEN distance_m > 0 THEN 'cycling_outdoor' ELSE 'cycling_indoor' END AS sport_type
  FROM b WHERE NOT listed OR service_type IN ('', 'Ride', 'VirtualRide', 'EBikeRide', 'Handcycle', 'Velomobile'))
SELECT id, service_type, trainer, sport_type, sport_type NOT IN ('ebike', 'cycling_outdoor') AS is_indoor FROM s""",
    "h5_straight_lines": f"WITH {REQUESTS} SELECT id, round(line, 6) AS km FROM straight WHERE away",
}
