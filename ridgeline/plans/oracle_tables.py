"""The tables of sources/driver_tables.py in the SQL of the reference engine that results are compared with."""


def r(x: str, digits: int = 0) -> str:
    """functions.rounding.half_even."""
    return f"(round_even(({x})::DOUBLE * 1e{digits}::DOUBLE, 0) / 1e{digits}::DOUBLE)"


def floor_long(x: str) -> str:
    return f"CAST(floor({x}) AS BIGINT)"


def samples(by_days: bool = False, name: str = "samples") -> str:
    ride = "CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 432000.0::DOUBLE) AS BIGINT) + user_id // 500 * 1000" if by_days else "user_id"
    return f"""{name} AS (
  SELECT activity_id, CAST(row_number() OVER (PARTITION BY activity_id ORDER BY ts, event_id) - 1 AS INTEGER) AS time_offset,
    CASE WHEN event_type <> 'error' THEN k + 90 END AS hr,
    CASE WHEN event_type <> 'signup' THEN CAST(floor(value * 4) AS INTEGER) END AS power,
    CASE WHEN event_type <> 'view' THEN k % 50 + 60 END AS cadence,
    15.0::DOUBLE + (CAST(floor(value * 10) AS BIGINT) % 200) / 10.0::DOUBLE AS speed_kmh,
    100.0::DOUBLE + k * 7 % 90 AS altitude_m,
    CASE WHEN event_type <> 'click' THEN 38.7::DOUBLE + (event_id * 37 % 400 - 200) / 2000.0::DOUBLE END AS lat,
    CASE WHEN event_type <> 'click' THEN -9.14::DOUBLE + (event_id * 53 % 400 - 200) / 2000.0::DOUBLE END AS lng,
    ts
  FROM (SELECT *, {ride} AS activity_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""


SAMPLE_RIDES = """sample_rides AS (
  SELECT activity_id AS id, min(ts) AS date, CAST(count(*) AS INTEGER) AS duration_s, CAST(floor(avg(hr)) AS INTEGER) AS avg_hr, max(hr) AS max_hr,
    CAST(floor(avg(power)) AS INTEGER) AS avg_power, sum(speed_kmh / 3.6::DOUBLE) AS distance_m, activity_id % 2 AS athlete_id
  FROM samples GROUP BY activity_id
)"""

RAW = """raw0 AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderdate, o_orderstatus, o_orderpriority,
    1800 + o_orderkey * 7919 % 14400 AS moving,
    CASE WHEN o_orderkey % 11 = 0 THEN 0.0::DOUBLE ELSE o_totalprice / 4 END AS distance,
    CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey % 60 + 110 AS DOUBLE) END AS hr,
    CASE WHEN NOT starts_with(o_orderpriority, '1') AND NOT starts_with(o_orderpriority, '5') THEN CAST(o_orderkey % 180 + 120 AS DOUBLE) END AS watts
  FROM orders
), raw AS (
  SELECT k AS id, c % 20 AS athlete_id, 'Ride ' || k || CASE WHEN k % 17 = 0 THEN ' on Zwift' ELSE '' END AS name,
    o_orderdate + to_seconds(c * 7919 % 86400) AS start, distance, CAST(moving AS INTEGER) AS moving_time, CAST(k * 31 % 1500 AS DOUBLE) AS total_elevation_gain,
    CASE WHEN k % 13 <> 0 THEN distance / moving END AS average_speed, hr AS average_heartrate, hr + 20 + k % 15 AS max_heartrate,
    watts AS average_watts, watts * 2 + k % 90 AS max_watts, CASE WHEN k % 4 <> 0 THEN CAST(k % 40 + 60 AS DOUBLE) END AS average_cadence,
    CASE WHEN k % 5 <> 0 THEN CAST(k % 900 AS DOUBLE) END AS calories, CASE WHEN k % 6 <> 0 THEN CAST(k % 200 AS DOUBLE) END AS suffer_score,
    (['Head Unit Karoo 3', 'Apple Watch', 'Phone', NULL, 'Smartwatch'])[k % 5 + 1] AS device_name,
    (['Ride', 'VirtualRide', 'EBikeRide', 'Run', 'Ride', '', 'Handcycle'])[c % 7 + 1] AS type, k % 9 = 0 AS trainer
  FROM raw0
)"""

PARSED = (
    RAW
    + f""", parsed AS (
  SELECT id, athlete_id, name, start AS date, distance AS distance_m, moving_time AS duration_s, total_elevation_gain AS elevation_m,
    CAST(average_heartrate AS INTEGER) AS avg_hr, CAST(max_heartrate AS INTEGER) AS max_hr, CAST(average_watts AS INTEGER) AS avg_power, CAST(max_watts AS INTEGER) AS max_power,
    CAST(average_cadence AS INTEGER) AS avg_cadence, {r("coalesce(average_speed, 0.0::DOUBLE) * 3.6::DOUBLE", 2)} AS avg_speed_kmh,
    CAST(calories AS INTEGER) AS calories, CAST(suffer_score AS INTEGER) AS suffer_score,
    CASE WHEN contains(lower(coalesce(device_name, '')), 'karoo') THEN 'karoo'
      WHEN contains(lower(coalesce(device_name, '')), 'watch') OR contains(lower(coalesce(device_name, '')), 'apple') THEN 'watch'
      WHEN trainer OR contains(lower(name), 'zwift') THEN 'zwift' ELSE 'unknown' END AS device,
    type AS service_type, trainer
  FROM raw
)"""
)

RIDES = (
    PARSED
    + """, rides AS (
  SELECT *, sport_type NOT IN ('ebike', 'cycling_outdoor') AS is_indoor FROM (
    SELECT *, CASE WHEN device = 'zwift' OR lower(service_type) = 'virtualride' THEN 'zwift' WHEN trainer THEN 'cycling_indoor'
      WHEN lower(service_type) = 'ebikeride' THEN 'ebike' WHEN distance_m > 0 THEN 'cycling_outdoor' ELSE 'cycling_indoor' END AS sport_type
    FROM parsed WHERE service_type = '' OR service_type IN ('Ride', 'VirtualRide', 'EBikeRide', 'Handcycle', 'Velomobile'))
)"""
)

PLACES = """places AS (
  SELECT p_partkey AS id, 38.7::DOUBLE + (p_partkey * 41 % 600 - 300) / 1500.0::DOUBLE AS lat, -9.14::DOUBLE + (p_partkey * 67 % 600 - 300) / 1500.0::DOUBLE AS lng,
    CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS name,
    CASE WHEN p_partkey % 6 = 5 AND p_partkey % 5 = 0 THEN 'natural' ELSE (['tourism', 'natural', 'amenity', 'amenity', 'amenity', 'shop'])[p_partkey % 6 + 1] END AS tag,
    CASE WHEN p_partkey % 6 = 5 AND p_partkey % 5 = 0 THEN 'peak' ELSE (['viewpoint', 'peak', 'cafe', 'drinking_water', 'bicycle_repair_station', 'books'])[p_partkey % 6 + 1] END AS value FROM part
), pois AS (
  SELECT id, lat, lng, coalesce(name, CASE value WHEN 'viewpoint' THEN 'Viewpoint' WHEN 'peak' THEN 'Peak' WHEN 'cafe' THEN 'Cafe' WHEN 'drinking_water' THEN 'Drinking Water' ELSE 'Bicycle Repair Station' END) AS name,
    tag || '=' || value AS type FROM places WHERE value <> 'books'
)"""

SEGMENTS = """segments AS (
  SELECT s_suppkey AS id, 38.7::DOUBLE + (s_suppkey * 29 % 500 - 250) / 1250.0::DOUBLE AS lat, -9.14::DOUBLE + (s_suppkey * 43 % 500 - 250) / 1250.0::DOUBLE AS lng,
    s_name AS name, CAST(floor(abs(s_acctbal)) AS BIGINT) AS athlete_count FROM supplier
)"""

HIGHLIGHTS = """highlights0 AS (
  SELECT c_custkey AS id, 38.7::DOUBLE + (c_custkey * 31 % 800 - 400) / 2000.0::DOUBLE AS lat, -9.14::DOUBLE + (c_custkey * 47 % 800 - 400) / 2000.0::DOUBLE AS lng,
    'Place ' || (c_custkey // 2) AS name,
    (['viewpoint', 'trail', 'cycle_way', 'bridge', 'historical_site', 'man_made_monument', 'beach', 'settlement', 'other_man_made', 'harbour'])[c_custkey % 10 + 1] AS category FROM customer
), highlights AS (
  SELECT * FROM highlights0 QUALIFY row_number() OVER (PARTITION BY name ORDER BY id) = 1
)"""

ZONES = """zones AS (
  SELECT 38.7::DOUBLE + (n_nationkey * 17 % 50 - 25) / 150.0::DOUBLE AS lat, -9.14::DOUBLE + (n_nationkey * 23 % 50 - 25) / 150.0::DOUBLE AS lng,
    coalesce(CASE WHEN n_nationkey % 3 <> 0 THEN CAST(n_nationkey * 100 + 200 AS DOUBLE) END, 500.0::DOUBLE) AS radius FROM nation
)"""

ROUTES = (
    samples()
    + """, routes AS (
  SELECT activity_id AS route_id, list(lat ORDER BY time_offset) AS lats, list(lng ORDER BY time_offset) AS lngs, list(CASE WHEN hr IS NOT NULL THEN altitude_m END ORDER BY time_offset) AS elevations
  FROM samples WHERE lat IS NOT NULL GROUP BY activity_id
)"""
)

WAYS = """ways AS (
  SELECT DISTINCT l_orderkey // 10 AS route_id, (l_orderkey * 10 + l_linenumber) * 1000003 + l_partkey * 101 + l_suppkey AS element_id,
    (['residential', 'cycleway', 'path', 'track', 'living_street', 'primary'])[l_partkey % 6 + 1] AS highway,
    (['asphalt', 'gravel', 'dirt', NULL, 'concrete', 'rock', 'sett', 'compacted'])[(l_partkey + l_orderkey) % 8 + 1] AS surface,
    (['water', NULL, 'wood', 'coastline', NULL, 'cliff', 'scree'])[l_partkey % 7 + 1] AS "natural",
    ([NULL, 'forest', NULL])[l_orderkey % 3 + 1] AS landuse, (['park', NULL, NULL, NULL])[l_partkey % 4 + 1] AS leisure,
    ([NULL, 'lane', NULL, NULL])[(l_partkey + l_suppkey) % 4 + 1] AS cycleway, (['50', '30', NULL, '20', 'walk', 'RO:urban'])[l_partkey % 6 + 1] AS maxspeed,
    ([NULL, NULL, 'hump'])[l_suppkey % 3 + 1] AS traffic_calming, (['River Way', NULL, 'Coast Path'])[l_partkey % 3 + 1] AS name, ([NULL, 'EV1', 'N2', NULL])[l_partkey % 4 + 1] AS ref
  FROM lineitem
)"""

ELEMENTS = """elements AS (
  SELECT *, CASE WHEN kind = 'node' THEN a_lat ELSE a_lat + (e * 7 % 41 - 20) / 10000.0::DOUBLE END AS b_lat, CASE WHEN kind = 'node' THEN a_lng ELSE a_lng + (e * 11 % 41 - 20) / 10000.0::DOUBLE END AS b_lng FROM (
    SELECT e, e AS element_id, CASE WHEN e % 5 = 0 THEN 'node' WHEN e % 7 = 0 THEN 'relation' ELSE 'way' END AS kind, 38.7::DOUBLE + (e * 31 % 4800 - 2400) / 20000.0::DOUBLE AS a_lat, -9.14::DOUBLE + (e * 47 % 4801 - 2400) / 20000.0::DOUBLE AS a_lng,
      (['residential', 'cycleway', 'path', 'track', 'living_street', 'primary', NULL])[l_partkey % 7 + 1] AS highway,
      (['asphalt', 'gravel', 'dirt', NULL, 'concrete', 'rock', 'sett', 'compacted'])[(l_partkey + e) % 8 + 1] AS surface,
      (['water', NULL, 'wood', 'coastline', NULL, 'cliff', 'scree', 'beach', 'peak'])[l_partkey % 9 + 1] AS "natural",
      ([NULL, 'forest', NULL])[e % 3 + 1] AS landuse, (['park', NULL, NULL, NULL])[l_partkey % 4 + 1] AS leisure, (['bicycle', 'hiking'])[l_partkey % 2 + 1] AS route,
      ([NULL, 'lane', NULL, NULL])[(l_partkey + l_suppkey) % 4 + 1] AS cycleway, (['50', '30', NULL, '20', 'walk', 'RO:urban'])[l_partkey % 6 + 1] AS maxspeed,
      ([NULL, NULL, 'hump'])[l_suppkey % 3 + 1] AS traffic_calming, (['River Way', NULL, 'Coast Path'])[e % 3 + 1] AS name, ([NULL, 'EV1', 'N2', NULL])[l_partkey % 4 + 1] AS ref
    FROM (SELECT *, (l_orderkey * 10 + l_linenumber) * 1000003 + l_partkey * 101 + l_suppkey AS e FROM lineitem))
)"""

FORECAST = """forecast AS (
  SELECT date, CAST(s % 45 AS DOUBLE) AS temp_max, CAST(s % 45 - 8 AS DOUBLE) AS temp_min, CASE WHEN s % 3 = 0 THEN (s % 30) / 2.0::DOUBLE ELSE 0.0::DOUBLE END AS precip,
    CAST(s * 7 % 55 AS DOUBLE) AS wind, CAST(s * 3 % 13 AS DOUBLE) AS uv_max, ([0, 1, 2, 3, 45, 51, 61, 63, 71, 80, 95, 100])[(s + n) % 12 + 1] AS code
  FROM (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n, CAST(sum(o_custkey % 97) AS BIGINT) AS s FROM orders GROUP BY 1)
), day_scores AS (
  SELECT *, CAST(greatest(0, 100 - CASE WHEN precip > 10 THEN 50 WHEN precip > 5 THEN 35 WHEN precip > 1 THEN 20 WHEN precip > 0 THEN 5 ELSE 0 END
    - CASE WHEN wind > 40 THEN 40 WHEN wind > 30 THEN 25 WHEN wind > 20 THEN 10 ELSE 0 END
    - CASE WHEN temp_max < 5 OR temp_max > 38 THEN 30 WHEN temp_max < 10 OR temp_max > 35 THEN 15 WHEN temp_max < 13 THEN 5 ELSE 0 END
    - CASE WHEN uv_max >= 11 THEN 20 WHEN uv_max >= 8 THEN 10 WHEN uv_max >= 6 THEN 5 ELSE 0 END
    - CASE WHEN code >= 61 THEN 15 WHEN code >= 45 THEN 10 ELSE 0 END) AS INTEGER) AS score,
    CASE code WHEN 0 THEN 'Clear sky' WHEN 1 THEN 'Mainly clear' WHEN 2 THEN 'Partly cloudy' WHEN 3 THEN 'Overcast' WHEN 45 THEN 'Foggy' WHEN 51 THEN 'Light drizzle'
      WHEN 61 THEN 'Slight rain' WHEN 63 THEN 'Moderate rain' WHEN 71 THEN 'Slight snow' WHEN 80 THEN 'Slight rain showers' WHEN 95 THEN 'Thunderstorm' ELSE 'Unknown' END AS weather
  FROM forecast
)"""

HOURS = """hours AS (
  SELECT time, CAST(s % 45 AS DOUBLE) AS temp, CAST(s * 7 % 50 AS DOUBLE) AS wind, CAST(s * 3 % 13 AS DOUBLE) AS uv, CASE WHEN s % 3 = 0 THEN (s % 9) / 3.0::DOUBLE ELSE 0.0::DOUBLE END AS precip
  FROM (SELECT strftime(ts, '%Y-%m-%dT%H:00') AS time, CAST(sum(event_id % 89) AS BIGINT) AS s FROM events GROUP BY 1)
)"""
