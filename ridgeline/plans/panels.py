"""Queries of the dashboard panels. Each comes with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import half_even
from ..operators import dashboards, metrics
from ..sources import driver_tables as tables
from . import oracle_tables as sql
from .rides import FITNESS, STRESS, best, day, days, rides, stressed

LATE = "2001-07-31"


def k1_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.cards(stressed(spark, sf_dir), day(LATE))


def k1_cards_outdoor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.cards(stressed(spark, sf_dir), day(LATE), sports=("cycling_outdoor",))


def k2_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.streaks(rides(spark, sf_dir), day(LATE))


def k2_fitness_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.fitness_change(days(spark, sf_dir))


def k3_type_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.type_mix(rides(spark, sf_dir))


def k3_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.daily_by_type(rides(spark, sf_dir))


def k3_weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.weekday_frequency(rides(spark, sf_dir))


def k4_bests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.bests(rides(spark, sf_dir), day(LATE))


def k6_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.zones_by_km(tables.samples(spark, sf_dir, by_days=True), F.lit(800), F.lit(170))


def k6_zones_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.zones_by_km(tables.samples(spark, sf_dir), F.lit(800), F.lit(170), overall=True).drop("km")


def k7_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.power_against_hr(tables.samples(spark, sf_dir))


def k7_decoupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.decoupling(tables.samples(spark, sf_dir))


def k8_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.splits(tables.samples(spark, sf_dir, by_days=True))


def k10_speed_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.speed_trend(rides(spark, sf_dir))


def k11_bests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1, 5 and 20 minutes of each long ride."""
    peaks = metrics.best_means(tables.samples(spark, sf_dir, by_days=True), (60, 300, 1200))
    return peaks.select("activity_id", *(half_even(F.col(c), 6).alias(c) for c in peaks.columns[1:]))


def k11_monthly_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.samples(spark, sf_dir, by_days=True)
    return dashboards.monthly_power(tables.sample_rides(s), metrics.best_means(s, (60, 300, 1200)))


def k12_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.weekly_candles(rides(spark, sf_dir))


def k13_polarization(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rides(spark, sf_dir)
    return dashboards.polarization(r, metrics.threshold_hr(r))


def k14_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.cumulative(stressed(spark, sf_dir))


def k15_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.annual(rides(spark, sf_dir))


def k15_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.monthly(rides(spark, sf_dir))


def k15_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.records(rides(spark, sf_dir))


QUERIES = {f.__name__: f for f in (k1_cards, k1_cards_outdoor, k2_streaks, k2_fitness_change, k3_type_mix, k3_daily, k3_weekdays, k4_bests, k6_zones, k6_zones_overall, k7_scatter, k7_decoupling, k8_splits, k10_speed_trend, k11_bests, k11_monthly_power, k12_candles, k13_polarization, k14_cumulative, k15_annual, k15_monthly, k15_records)}

MEASURES = {"rides": "1", "distance_m": "distance_m", "duration_s": "duration_s", "elevation_m": "elevation_m", "calories": "coalesce(calories, 0)", "tss": "tss"}
NOW = f"CAST(date AS DATE) > DATE '{LATE}' - 30 AND CAST(date AS DATE) <= DATE '{LATE}'"
BEFORE = f"CAST(date AS DATE) > DATE '{LATE}' - 60 AND CAST(date AS DATE) <= DATE '{LATE}' - 30"


def total(c: str, when: str) -> str:
    return f"coalesce(sum(({c})::DOUBLE) FILTER (WHERE {when}), 0.0::DOUBLE)"


def zone(share: str, limits: tuple[float, ...]) -> str:
    return "1 + " + " + ".join(f"CASE WHEN {share} > {x}::DOUBLE THEN 1 ELSE 0 END" for x in limits)


def cards(where: str) -> str:
    both = lambda f: (f(NOW), f(BEFORE))
    counted = {**{n: both(lambda w, c=c: total(c, w)) for n, c in MEASURES.items()}, "active_days": both(lambda w: f"count(DISTINCT CAST(date AS DATE)) FILTER (WHERE {w})"), "longest_m": both(lambda w: f"coalesce(max(distance_m) FILTER (WHERE {w}), 0.0::DOUBLE)")}
    means = ", ".join(f"{sql.r(f'avg({c}) FILTER (WHERE {NOW})', 1)} AS {c}" for c in ("avg_hr", "avg_power", "avg_speed_kmh"))
    return f"""WITH {STRESS} SELECT athlete_id, {', '.join(f"{sql.r(a, 1)} AS {n}, {sql.r(f'{a} - {b}', 1)} AS delta_{n}" for n, (a, b) in counted.items())},
  {means}, max(max_hr) FILTER (WHERE {NOW}) AS max_hr FROM stressed WHERE {where} AND CAST(date AS DATE) > DATE '{LATE}' - 60 GROUP BY athlete_id"""


LONG_BESTS = f"""{sql.samples(True)}, m AS (SELECT activity_id, {', '.join(f"avg(power) OVER (o ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS m_{n}, count(*) OVER (o ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS n_{n}" for n in (60, 300, 1200))}
  FROM samples WHERE power IS NOT NULL WINDOW o AS (PARTITION BY activity_id ORDER BY time_offset))"""
KM = "floor(sum(coalesce(speed_kmh, 0.0::DOUBLE)) OVER (PARTITION BY activity_id ORDER BY time_offset ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 3600.0::DOUBLE)"
ZONED = zone("avg_hr / threshold_hr::DOUBLE", dashboards.HR_ZONES)

ORACLE_SQL = {
    "k1_cards": cards("true"),
    "k1_cards_outdoor": cards("sport_type = 'cycling_outdoor'"),
    "k2_streaks": f"""WITH {sql.RIDES}, w AS (SELECT DISTINCT athlete_id, CAST(date_trunc('week', date) AS DATE) AS week FROM rides WHERE CAST(date AS DATE) <= DATE '{LATE}'), g AS (
  SELECT athlete_id, week, week - CAST(row_number() OVER (PARTITION BY athlete_id ORDER BY week) * 7 AS INTEGER) AS start FROM w), r AS (SELECT athlete_id, start, count(*) AS weeks, max(week) AS last FROM g GROUP BY 1, 2)
SELECT athlete_id, coalesce(max(weeks) FILTER (WHERE last = CAST(date_trunc('week', DATE '{LATE}') AS DATE)), 0) AS streak, max(weeks) AS longest FROM r GROUP BY 1""",
    "k2_fitness_change": f"""WITH RECURSIVE {FITNESS} SELECT athlete_id, ctl, {sql.r('ctl - lag(ctl, 42) OVER w', 2)} AS change FROM days WINDOW w AS (PARTITION BY athlete_id ORDER BY date) QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY date DESC) = 1""",
    "k3_type_mix": f"""WITH {sql.RIDES} SELECT athlete_id, CAST(date_trunc('month', date) AS DATE) AS month, {', '.join(f"count(*) FILTER (WHERE sport_type = '{s}') AS {s}" for s in dashboards.SPORTS)} FROM rides GROUP BY 1, 2""",
    "k3_daily": f"""WITH {sql.RIDES} SELECT athlete_id, CAST(date AS DATE) AS date, {', '.join(f"{sql.r(f"coalesce(sum(distance_m) FILTER (WHERE sport_type = '{s}'), 0.0::DOUBLE) / 1000.0::DOUBLE", 3)} AS {s}" for s in dashboards.SPORTS)} FROM rides GROUP BY 1, 2""",
    "k3_weekdays": f"WITH {sql.RIDES} SELECT athlete_id, CAST(isodow(date) - 1 AS INTEGER) AS weekday, count(*) AS rides FROM rides GROUP BY 1, 2",
    "k4_bests": f"""WITH {sql.RIDES} SELECT athlete_id, {', '.join(f"max({c}) FILTER (WHERE CAST(date AS DATE) > DATE '{LATE}' - 90) AS recent_{c}, max({c}) AS best_{c}" for c in ('distance_m', 'elevation_m', 'avg_speed_kmh', 'avg_power'))} FROM rides GROUP BY 1""",
    "k6_zones": f"""WITH {sql.samples(True)}, s AS (SELECT *, CAST({KM} AS BIGINT) AS km FROM samples), z AS (
  SELECT activity_id, km, 'power' AS measure, {zone('power / 800.0::DOUBLE', dashboards.POWER_ZONES)} AS zone FROM s WHERE power IS NOT NULL UNION ALL SELECT activity_id, km, 'hr', {zone('hr / 170.0::DOUBLE', dashboards.HR_ZONES)} FROM s WHERE hr IS NOT NULL)
SELECT activity_id, km, measure, zone, count(*) AS seconds FROM z GROUP BY 1, 2, 3, 4""",
    "k6_zones_overall": f"""WITH {sql.samples()}, z AS (
  SELECT activity_id, 'power' AS measure, {zone('power / 800.0::DOUBLE', dashboards.POWER_ZONES)} AS zone FROM samples WHERE power IS NOT NULL UNION ALL SELECT activity_id, 'hr', {zone('hr / 170.0::DOUBLE', dashboards.HR_ZONES)} FROM samples WHERE hr IS NOT NULL)
SELECT activity_id, measure, zone, count(*) AS seconds FROM z GROUP BY 1, 2, 3""",
    "k7_scatter": f"WITH {sql.samples()} SELECT activity_id, power, hr, count(*) AS seconds FROM samples WHERE power IS NOT NULL AND hr IS NOT NULL GROUP BY 1, 2, 3",
    "k11_bests": f"WITH {LONG_BESTS} SELECT activity_id, {', '.join(best(n) for n in (60, 300, 1200))} FROM m GROUP BY 1",
    "k11_monthly_power": f"""WITH {LONG_BESTS}, {sql.SAMPLE_RIDES}, b AS (SELECT activity_id, {', '.join(f"max(m_{n}) FILTER (WHERE n_{n} >= {n}) AS b_{n}" for n in (60, 300, 1200))} FROM m GROUP BY 1)
SELECT athlete_id, CAST(date_trunc('month', date) AS DATE) AS month, CAST(round_even(max(b_1200) * 0.95::DOUBLE, 0) AS INTEGER) AS ftp, {', '.join(f"{sql.r(f'max(b_{n})', 6)} AS best_{n}" for n in (60, 300, 1200))} FROM sample_rides JOIN b ON b.activity_id = id GROUP BY 1, 2""",
    "k7_decoupling": f"""WITH {sql.samples()}, h AS (SELECT *, ntile(2) OVER (PARTITION BY activity_id ORDER BY time_offset) AS half FROM samples WHERE power IS NOT NULL AND hr IS NOT NULL), e AS (
  SELECT activity_id, avg(power) FILTER (WHERE half = 1) / avg(hr) FILTER (WHERE half = 1) AS a, avg(power) FILTER (WHERE half = 2) / avg(hr) FILTER (WHERE half = 2) AS b FROM h GROUP BY 1)
SELECT activity_id, {sql.r('a', 4)} AS ef_first, {sql.r('b', 4)} AS ef_second, {sql.r('(a - b) / nullif(a, 0) * 100.0::DOUBLE', 2)} AS drift_pct FROM e""",
    "k8_splits": f"""WITH {sql.samples(True)}, s AS (SELECT *, CAST({KM} AS BIGINT) AS km FROM samples), g AS (SELECT activity_id, km, count(*) AS seconds, {sql.r('avg(hr)', 1)} AS avg_hr FROM s GROUP BY 1, 2)
SELECT *, CAST(rank() OVER (PARTITION BY activity_id ORDER BY seconds) AS INTEGER) AS fastest, CAST(rank() OVER (PARTITION BY activity_id ORDER BY seconds DESC) AS INTEGER) AS slowest FROM g""",
    "k10_speed_trend": f"""WITH {sql.RIDES}, s AS (SELECT athlete_id, id, avg_speed_kmh AS v, row_number() OVER w AS k, avg(avg_speed_kmh) OVER (PARTITION BY athlete_id ORDER BY date, id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rolling
  FROM rides WHERE avg_speed_kmh > 0 WINDOW w AS (PARTITION BY athlete_id ORDER BY date, id)), l AS (SELECT athlete_id, regr_slope(v, k) AS slope, regr_intercept(v, k) AS start FROM s GROUP BY 1)
SELECT athlete_id, id, {sql.r('rolling', 3)} AS rolling, {sql.r('start + slope * k', 3)} AS trend FROM s JOIN l USING (athlete_id)""",
    "k12_candles": f"""WITH {sql.RIDES} SELECT athlete_id, CAST(date_trunc('week', date) AS DATE) AS week, arg_min(avg_power, (date, id)) AS "first", max(avg_power) AS high, min(avg_power) AS low, arg_max(avg_power, (date, id)) AS "last" FROM rides WHERE avg_power IS NOT NULL GROUP BY 1, 2""",
    "k13_polarization": f"""WITH {STRESS}, z AS (SELECT r.*, CASE WHEN avg_hr IS NOT NULL THEN {ZONED} END AS zone FROM rides r JOIN limits USING (athlete_id))
SELECT athlete_id, CAST(date_trunc('month', date) AS DATE) AS month, {', '.join(f"{sql.r(f'sum(CASE WHEN zone BETWEEN {a} AND {b} THEN duration_s ELSE 0 END) / 3600.0::DOUBLE', 2)} AS {n}" for n, a, b in (('low', 1, 2), ('middle', 3, 3), ('high', 4, 5)))} FROM z GROUP BY 1, 2""",
    "k14_cumulative": f"""WITH {STRESS}, d AS (SELECT athlete_id, CAST(date AS DATE) AS date, count(*) AS rides, {', '.join(f"sum(coalesce({c}, 0)::DOUBLE) AS {c}" for c in ('distance_m', 'duration_s', 'elevation_m', 'calories', 'tss'))} FROM stressed GROUP BY 1, 2)
SELECT athlete_id, date, {', '.join(f"{sql.r(f'sum({c}) OVER w', 4)} AS total_{c}" for c in ('rides', 'distance_m', 'duration_s', 'elevation_m', 'calories', 'tss'))} FROM d WINDOW w AS (PARTITION BY athlete_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "k15_annual": f"""WITH {sql.RIDES} SELECT athlete_id, CAST(year(date) AS INTEGER) AS year, count(*) AS rides, {sql.r('sum(distance_m) / 1000.0::DOUBLE', 3)} AS km, {sql.r('sum(duration_s) / 3600.0::DOUBLE', 3)} AS hours, {sql.r('sum(elevation_m)', 1)} AS elevation_m FROM rides GROUP BY 1, 2""",
    "k15_monthly": f"""WITH {sql.RIDES}, m AS (SELECT athlete_id, CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS rides, sum(distance_m) / 1000.0::DOUBLE AS km FROM rides GROUP BY 1, 2)
SELECT a.athlete_id, a.month, a.rides, {sql.r('a.km', 3)} AS km, {sql.r('b.km', 3)} AS km_year_before FROM m a LEFT JOIN m b ON b.athlete_id = a.athlete_id AND b.month + INTERVAL 12 MONTHS = a.month""",
    "k15_records": f"""WITH {sql.RIDES}, u AS (SELECT athlete_id, id, date, unnest(['distance_m', 'elevation_m', 'duration_s', 'avg_speed_kmh']) AS record, unnest([distance_m, elevation_m, duration_s::DOUBLE, avg_speed_kmh]) AS value FROM rides)
SELECT athlete_id, record, id, value FROM u QUALIFY row_number() OVER (PARTITION BY athlete_id, record ORDER BY value DESC, date, id) = 1""",
}

