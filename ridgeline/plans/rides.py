"""Queries over rides and samples: ingest, metrics, thresholds, fitness, history. Each comes with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import training
from ..functions.rounding import half_even
from ..operators import arrival, fitness, history, ingest, metrics, nearby
from ..sources import driver_tables as tables
from ..sources.scratch import settled
from . import oracle_tables as sql

AS_OF, AS_OF_SAMPLES = "2001-08-31", "2024-02-15"
#: Athletes whose limits, form and speeds (about 50 bytes each) are broadcast at most.
ATHLETES_AT_ONCE = 200_000


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.classified(ingest.cycling_only(ingest.parsed(tables.raw_rides(spark, sf_dir))))


def stressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides with the stress of their mean power or heart rate, by each athlete's thresholds."""
    r = rides(spark, sf_dir)
    # few athletes' limits are broadcast: rides are not dealt out to so few keys
    limits = nearby.small(settled(metrics.threshold_hr(r)), ATHLETES_AT_ONCE).withColumn("ftp", F.lit(200))
    return metrics.with_stress(r.join(limits, "athlete_id").withColumn("np", F.lit(None).cast("double")).withColumn("ride_ftp", F.lit(None).cast("double")))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitness.fitness(settled(fitness.daily(stressed(spark, sf_dir))), day(AS_OF))


# ---- ingest


def a7_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rides(spark, sf_dir).select("id", "date", "name", "distance_m", "avg_hr")
    old, new = r.where(F.col("id") % 3 != 0), r.where(F.col("id") % 2 == 0).withColumn("distance_m", F.col("distance_m") + 1).withColumn("date", F.lit("2020-01-01").cast("timestamp"))
    return ingest.upserted(old, new)


def a8_replace_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.samples(spark, sf_dir).select("activity_id", "time_offset", "power")
    new = s.where((F.col("activity_id") % 4 == 0) & (F.col("time_offset") < 10)).withColumn("power", F.lit(1))
    return ingest.replaced(s, new).groupBy("activity_id").agg(F.count(F.lit(1)).alias("n"), F.sum("power").alias("power"))


def b1_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.parsed(tables.raw_rides(spark, sf_dir))


def b2_explode_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings with arrays of uneven length: each third ride lacks its last five heart rates, each fifth has no power."""
    s = ingest.recordings(tables.samples(spark, sf_dir))
    cut = F.when(F.col("id") % 3 == 0, F.slice("heartrate", F.lit(1), F.greatest(F.lit(0), F.size("heartrate") - 5))).otherwise(F.col("heartrate"))
    return ingest.points(s.withColumn("heartrate", cut).withColumn("watts", F.when(F.col("id") % 5 != 0, F.col("watts"))))


def b3_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rides(spark, sf_dir)
    details = tables.raw_rides(spark, sf_dir).where(F.col("id") % 3 == 0).select("id", (F.col("id") % 7 * 100.0).alias("calories"), F.lit(141.0).alias("average_heartrate"), F.lit(None).cast("double").alias("max_heartrate"), F.lit(33.0).alias("suffer_score"))
    return ingest.with_details(r, details).select("id", "calories", "avg_hr", "max_hr", "suffer_score")


def b4_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.parsed(tables.raw_rides(spark, sf_dir)).groupBy("device").agg(F.count(F.lit(1)).alias("n"))


def b5_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rides(spark, sf_dir).select("id", "sport_type", "is_indoor")


def b6_cycling_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.cycling_only(ingest.parsed(tables.raw_rides(spark, sf_dir))).groupBy("service_type").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("bookmark"))


def c7_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rides(spark, sf_dir)
    return ingest.duplicate_pairs(r, r, 7200)


def h8_richness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rides(spark, sf_dir).select("id", ingest.ride_richness().alias("richness"))


def h9_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rides(spark, sf_dir)
    return ingest.merged_duplicates(r, r, 7200)


def i5_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrival.deduplicated(rides(spark, sf_dir), 7200).groupBy("athlete_id").agg(F.count(F.lit(1)).alias("n"), F.sum("avg_hr").alias("hr"), F.sum("avg_power").alias("power"))


# ---- metrics


def d3_np_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.power_metrics(tables.samples(spark, sf_dir))


def d4_trimp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.heart_rate_loads(tables.samples(spark, sf_dir), F.lit(170), F.lit(50))


def e2_best_20min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_best(metrics.best_means(tables.samples(spark, sf_dir, by_days=True)))


def e1_best_20min_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_best(metrics.best_means(tables.samples(spark, sf_dir, by_days=True), full=False))


def rounded_best(peaks: DataFrame) -> DataFrame:
    return peaks.select("activity_id", *(half_even(F.col(c), 6).alias(c) for c in peaks.columns[1:]))


def k9_power_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_best(metrics.best_means(tables.samples(spark, sf_dir), (5, 30, 60)))


def d1_threshold_hr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold_hr(rides(spark, sf_dir))


def d2_estimated_ftp(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.samples(spark, sf_dir, by_days=True)
    return metrics.threshold_power(tables.sample_rides(s), s, day(AS_OF_SAMPLES))


def c5_ride_ftp(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.samples(spark, sf_dir, by_days=True)
    r = tables.sample_rides(s)
    return metrics.ride_threshold_power(r, s, r.select("athlete_id").distinct().withColumn("ftp", F.lit(150)))


def h3_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.samples(spark, sf_dir)
    both = tables.sample_rides(s).join(metrics.power_metrics(s).withColumnRenamed("activity_id", "id"), "id")
    return both.select("id", training.ratio(F.col("np"), F.col("avg_hr")).alias("ef"), training.ratio(F.col("np"), F.lit(210)).alias("intensity"), training.ratio(F.col("np"), F.col("avg_power")).alias("vi"))


def h4_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stressed(spark, sf_dir).select("id", "tss")


def l_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of the rides that the samples belong to."""
    s = tables.samples(spark, sf_dir, by_days=True)
    return metrics.derived(tables.sample_rides(s), s, day(AS_OF_SAMPLES)).select("id", "np", "ef", "work_kj", "variability_index", "ride_ftp", "tss", "intensity_factor", "trimp")


# ---- fitness


def d7_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fitness.daily(stressed(spark, sf_dir))
    return d.select("athlete_id", "date", *(half_even(F.col(c), 4).alias(c) for c in ("tss", "distance_m", "elevation_m")))


def e4_ctl_atl_tsb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days(spark, sf_dir).select("athlete_id", "date", "ctl", "atl", "tsb")


def e5_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days(spark, sf_dir).select("athlete_id", "date", "weekly_distance_m", "weekly_elevation_m")


def f1_latest_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitness.latest(days(spark, sf_dir))


def d16_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitness.alerts(days(spark, sf_dir), rides(spark, sf_dir), day(AS_OF))


def d8_usual_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.usual_speeds(rides(spark, sf_dir))


def f2_recent_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.recent_routes(rides(spark, sf_dir))


def f3_suggested_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = spark.range(tables.ATHLETES).select(F.col("id").alias("athlete_id"), (F.col("id") * 3 - 30).cast("double").alias("tsb"))
    return history.suggested_routes(history.recent_routes(rides(spark, sf_dir)), form)


QUERIES = {f.__name__: f for f in (a7_upsert, a8_replace_samples, b1_parse, b2_explode_streams, b3_details, b4_device, b5_classify, b6_cycling_filter, c7_duplicate_pairs, h8_richness, h9_merge, i5_deduplicated, d3_np_work, d4_trimp, e1_best_20min_partial, e2_best_20min, k9_power_duration, d1_threshold_hr, d2_estimated_ftp, c5_ride_ftp, h3_ratios, h4_stress, l_derived, d7_daily, e4_ctl_atl_tsb, e5_weekly, f1_latest_fitness, d16_alerts, d8_usual_speeds, f2_recent_routes, f3_suggested_routes)}

PAIRS = """pairs AS (
  SELECT e.id AS existing_id, n.id AS new_id FROM rides e JOIN rides n ON e.athlete_id = n.athlete_id AND e.id <> n.id
    AND n.date > e.date - INTERVAL 7200 SECONDS AND n.date < e.date + INTERVAL 7200 SECONDS
  WHERE abs(e.duration_s - n.duration_s) < greatest(300.0::DOUBLE, e.duration_s * 0.15::DOUBLE)
    OR (e.distance_m > 0 AND n.distance_m > 0 AND abs(e.distance_m - n.distance_m) < e.distance_m * 0.1::DOUBLE)
)"""

THRESHOLDS = """limits AS (
  SELECT athlete_id, CASE WHEN CAST(trunc(quantile_cont(max_hr, 0.95) FILTER (WHERE max_hr > 0)) AS INTEGER) > 0 THEN CAST(trunc(quantile_cont(max_hr, 0.95) FILTER (WHERE max_hr > 0)) AS INTEGER) ELSE 170 END AS threshold_hr
  FROM rides GROUP BY athlete_id
)"""

STRESS = f"""{sql.RIDES}, {THRESHOLDS}, stressed AS (
  SELECT r.*, {sql.r('''CASE WHEN avg_power > 0 AND duration_s <> 0 THEN duration_s / 3600.0::DOUBLE * (avg_power / 200.0::DOUBLE) * (avg_power / 200.0::DOUBLE) * 100.0::DOUBLE
    WHEN avg_hr > 0 AND duration_s <> 0 THEN duration_s / 3600.0::DOUBLE * (avg_hr / threshold_hr::DOUBLE) * (avg_hr / threshold_hr::DOUBLE) * 100.0::DOUBLE ELSE 0.0::DOUBLE END''', 1)} AS tss
  FROM rides r JOIN limits USING (athlete_id)
)"""

DAILY = f"""{STRESS}, daily AS (
  SELECT athlete_id, CAST(date AS DATE) AS date, sum(tss) AS tss, sum(distance_m) AS distance_m, sum(elevation_m) AS elevation_m FROM stressed GROUP BY 1, 2
), span AS (
  SELECT athlete_id, min(date) AS first, greatest(max(date), DATE '{AS_OF}') AS last FROM daily GROUP BY 1
), calendar AS (
  SELECT athlete_id, CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS date FROM span
), dense AS (
  SELECT c.athlete_id, c.date, row_number() OVER (PARTITION BY c.athlete_id ORDER BY c.date) AS n, coalesce(d.tss, 0.0::DOUBLE) AS tss, coalesce(d.distance_m, 0.0::DOUBLE) AS distance_m, coalesce(d.elevation_m, 0.0::DOUBLE) AS elevation_m
  FROM calendar c LEFT JOIN daily d ON c.athlete_id = d.athlete_id AND c.date = d.date
)"""

FITNESS = f"""{DAILY}, walk(athlete_id, n, date, c, a) AS (
  SELECT athlete_id, n, date, tss / 42.0::DOUBLE, tss / 7.0::DOUBLE FROM dense WHERE n = 1
  UNION ALL
  SELECT w.athlete_id, d.n, d.date, c * (1.0::DOUBLE - 1.0::DOUBLE / 42.0::DOUBLE) + d.tss / 42.0::DOUBLE, a * (1.0::DOUBLE - 1.0::DOUBLE / 7.0::DOUBLE) + d.tss / 7.0::DOUBLE
  FROM walk w JOIN dense d ON d.athlete_id = w.athlete_id AND d.n = w.n + 1
), days AS (
  SELECT athlete_id, date, {sql.r('c', 2)} AS ctl, {sql.r('a', 2)} AS atl, {sql.r('c - a', 2)} AS tsb FROM walk
)"""

LOAD = "CASE WHEN hr > 50 THEN 1.0::DOUBLE / 60.0::DOUBLE * least((hr - 50) / ({limit})::DOUBLE, 1.0::DOUBLE) * 0.64::DOUBLE * exp(1.92::DOUBLE * least((hr - 50) / ({limit})::DOUBLE, 1.0::DOUBLE)) ELSE 0.0::DOUBLE END"

POWER = f"""power AS (
  SELECT activity_id, {sql.r('raw', 1)} AS np, {sql.r('joule / 1000.0::DOUBLE', 1)} AS work_kj FROM (
    SELECT activity_id, count(*) AS n, pow(avg(pow(m, 4.0::DOUBLE)), 0.25::DOUBLE) AS raw, sum(power)::DOUBLE AS joule FROM (
      SELECT activity_id, power, sum(power) OVER (PARTITION BY activity_id ORDER BY time_offset ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) / 30.0::DOUBLE AS m FROM samples WHERE power IS NOT NULL)
    GROUP BY activity_id) WHERE n > 30
)"""

PEAKS = """peaks AS (
  SELECT activity_id, max(m) FILTER (WHERE n >= 1200) AS best, max(m) AS best_any FROM (
    SELECT activity_id, avg(power) OVER w AS m, count(*) OVER w AS n FROM samples WHERE power IS NOT NULL WINDOW w AS (PARTITION BY activity_id ORDER BY time_offset ROWS BETWEEN 1199 PRECEDING AND CURRENT ROW))
  GROUP BY activity_id
)"""


def best(n: int) -> str:
    return f"{sql.r(f'max(m_{n}) FILTER (WHERE n_{n} >= {n})', 6)} AS best_{n}"


def frame(n: int) -> str:
    w = f"(PARTITION BY activity_id ORDER BY time_offset ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"avg(power) OVER {w} AS m_{n}, count(*) OVER {w} AS n_{n}"


FTP = f"""ftp AS (
  SELECT athlete_id, CASE WHEN peak > 0 THEN peak WHEN usual > 0 THEN usual ELSE 150 END AS ftp FROM (
    SELECT athlete_id, CAST({sql.r("max(best_any) FILTER (WHERE avg_power > 0 AND date >= DATE '" + AS_OF_SAMPLES + "' - INTERVAL 90 DAYS) * 0.95::DOUBLE")} AS INTEGER) AS peak,
      CAST(trunc(quantile_cont(avg_power, 0.95) FILTER (WHERE avg_power > 0)) AS INTEGER) AS usual
    FROM sample_rides LEFT JOIN peaks ON activity_id = id GROUP BY athlete_id)
)"""

MERGED = ("avg_hr", "max_hr", "avg_power", "max_power", "avg_cadence", "calories", "suffer_score", "distance_m", "duration_s")


def merged(c: str) -> str:
    new = f"coalesce(nullif(n.{c}, 0), nullif(e.{c}, 0), n.{c})" if c in ("avg_hr", "avg_power", "distance_m") else f"n.{c}"
    old = f"e.{c}" if c in ("distance_m", "duration_s") else f"coalesce(e.{c}, n.{c})"
    return f"CASE WHEN new_wins THEN {new} ELSE {old} END AS {c}"


RICH = "CASE WHEN {p}avg_power <> 0 THEN 3 ELSE 0 END + CASE WHEN {p}avg_hr <> 0 THEN 2 ELSE 0 END + CASE WHEN {p}distance_m > 0 THEN 1 ELSE 0 END"
RICHER = RICH + " + CASE WHEN {p}avg_cadence <> 0 THEN 1 ELSE 0 END + CASE WHEN {p}calories <> 0 THEN 1 ELSE 0 END + CASE WHEN {p}elevation_m > 0 THEN 1 ELSE 0 END"

ORACLE_SQL = {
    "a7_upsert": f"""WITH {sql.RIDES}, old AS (SELECT id, date, name, distance_m, avg_hr FROM rides WHERE id % 3 <> 0),
new AS (SELECT id, TIMESTAMP '2020-01-01' AS date, name, distance_m + 1 AS distance_m, avg_hr FROM rides WHERE id % 2 = 0)
SELECT coalesce(o.id, n.id) AS id, coalesce(o.date, n.date) AS date, coalesce(n.name, o.name) AS name, CASE WHEN n.id IS NULL THEN o.distance_m ELSE n.distance_m END AS distance_m, CASE WHEN n.id IS NULL THEN o.avg_hr ELSE n.avg_hr END AS avg_hr
FROM old o FULL JOIN new n ON o.id = n.id""",
    "a8_replace_samples": f"""WITH {sql.samples()}
SELECT activity_id, count(*) AS n, CAST(sum(CASE WHEN activity_id % 4 = 0 THEN 1 ELSE power END) AS BIGINT) AS power FROM samples WHERE activity_id % 4 <> 0 OR time_offset < 10 GROUP BY activity_id""",
    "b1_parse": f"WITH {sql.PARSED} SELECT * FROM parsed",
    "b2_explode_streams": f"""WITH {sql.samples()}
SELECT activity_id, time_offset, CASE WHEN activity_id % 3 = 0 AND time_offset >= count(*) OVER (PARTITION BY activity_id) - 5 THEN NULL ELSE hr END AS hr,
  CASE WHEN activity_id % 5 <> 0 THEN power END AS power, cadence, {sql.r('speed_kmh / 3.6::DOUBLE * 3.6::DOUBLE', 2)} AS speed_kmh, altitude_m, lat, lng FROM samples""",
    "b3_details": f"""WITH {sql.RIDES}
SELECT id, CASE WHEN id % 3 <> 0 OR id % 7 = 0 THEN calories WHEN device = 'karoo' OR coalesce(calories, 0) = 0 THEN CAST(id % 7 * 100 AS INTEGER) ELSE calories END AS calories,
  CASE WHEN id % 3 = 0 AND coalesce(avg_hr, 0) = 0 THEN 141 ELSE avg_hr END AS avg_hr, max_hr, CASE WHEN id % 3 = 0 AND coalesce(suffer_score, 0) = 0 THEN 33 ELSE suffer_score END AS suffer_score FROM rides""",
    "b4_device": f"WITH {sql.PARSED} SELECT device, count(*) AS n FROM parsed GROUP BY device",
    "b5_classify": f"WITH {sql.RIDES} SELECT id, sport_type, is_indoor FROM rides",
    "b6_cycling_filter": f"WITH {sql.RIDES} SELECT service_type, count(*) AS n, max(date) AS bookmark FROM rides GROUP BY 1",
    "c7_duplicate_pairs": f"WITH {sql.RIDES}, {PAIRS} SELECT * FROM pairs",
    "h8_richness": f"WITH {sql.RIDES} SELECT id, {RICHER.format(p='')} AS richness FROM rides",
    "h9_merge": f"""WITH {sql.RIDES}, {PAIRS}, won AS (
  SELECT p.*, ({RICHER.format(p='n.')}) >= ({RICH.format(p='e.')}) AS new_wins FROM pairs p JOIN rides e ON e.id = existing_id JOIN rides n ON n.id = new_id)
SELECT existing_id, new_id, CASE WHEN new_wins THEN new_id ELSE existing_id END AS id, new_wins, {', '.join(map(merged, MERGED))} FROM won JOIN rides e ON e.id = existing_id JOIN rides n ON n.id = new_id""",
    "d3_np_work": f"WITH {sql.samples()}, {POWER} SELECT activity_id, CASE WHEN np > 0 THEN np END AS np, CASE WHEN np > 0 THEN work_kj END AS work_kj FROM power",
    "d4_trimp": f"WITH {sql.samples()} SELECT activity_id, {sql.r('sum(' + LOAD.format(limit='120') + ')', 1)} AS trimp FROM samples WHERE hr IS NOT NULL GROUP BY activity_id",
    "e1_best_20min_partial": f"WITH {sql.samples(True)}, {PEAKS} SELECT activity_id, {sql.r('best_any', 6)} AS best_1200 FROM peaks",
    "e2_best_20min": f"WITH {sql.samples(True)}, {PEAKS} SELECT activity_id, {sql.r('best', 6)} AS best_1200 FROM peaks",
    "k9_power_duration": f"WITH {sql.samples()} SELECT activity_id, {best(5)}, {best(30)}, {best(60)} FROM (SELECT activity_id, {frame(5)}, {frame(30)}, {frame(60)} FROM samples WHERE power IS NOT NULL) GROUP BY activity_id",
    "d1_threshold_hr": f"WITH {sql.RIDES}, {THRESHOLDS} SELECT * FROM limits",
    "d2_estimated_ftp": f"WITH {sql.samples(True)}, {sql.SAMPLE_RIDES}, {PEAKS}, {FTP} SELECT * FROM ftp",
    "c5_ride_ftp": f"""WITH {sql.samples(True)}, {sql.SAMPLE_RIDES}, {PEAKS}
SELECT a.id, coalesce({sql.r('max(p.best) * 0.95::DOUBLE')}, 150.0::DOUBLE) AS ride_ftp FROM sample_rides a
LEFT JOIN sample_rides b ON a.athlete_id = b.athlete_id AND b.date BETWEEN a.date - INTERVAL 90 DAYS AND a.date - INTERVAL 1 DAY LEFT JOIN peaks p ON p.activity_id = b.id GROUP BY a.id""",
    "h3_ratios": f"""WITH {sql.samples()}, {sql.SAMPLE_RIDES}, {POWER}
SELECT id, {sql.r('np / avg_hr::DOUBLE', 2)} AS ef, {sql.r('np / 210.0::DOUBLE', 2)} AS intensity, {sql.r('np / avg_power::DOUBLE', 2)} AS vi FROM sample_rides JOIN power ON activity_id = id""",
    "h4_stress": f"WITH {STRESS} SELECT id, tss FROM stressed",
    "l_derived": f"""WITH {sql.samples(True)}, {sql.SAMPLE_RIDES}, {PEAKS}, {FTP}, {POWER}, rides AS (SELECT * FROM sample_rides), {THRESHOLDS}, loads AS (
  SELECT activity_id, {sql.r('sum(' + LOAD.format(limit='threshold_hr - 50') + ')', 1)} AS trimp FROM samples JOIN sample_rides ON id = activity_id JOIN limits USING (athlete_id) WHERE hr IS NOT NULL GROUP BY activity_id
), before AS (
  SELECT a.id, coalesce({sql.r('max(p.best) * 0.95::DOUBLE')}, max(f.ftp)::DOUBLE) AS ride_ftp FROM sample_rides a JOIN ftp f ON f.athlete_id = a.athlete_id
  LEFT JOIN sample_rides b ON a.athlete_id = b.athlete_id AND b.date BETWEEN a.date - INTERVAL 90 DAYS AND a.date - INTERVAL 1 DAY LEFT JOIN peaks p ON p.activity_id = b.id GROUP BY a.id
)
SELECT s.id, np, {sql.r('np / avg_hr::DOUBLE', 2)} AS ef, work_kj, {sql.r('np / avg_power::DOUBLE', 2)} AS variability_index, ride_ftp,
  {sql.r('duration_s / 3600.0::DOUBLE * (coalesce(np, avg_power) / ride_ftp) * (coalesce(np, avg_power) / ride_ftp) * 100.0::DOUBLE', 1)} AS tss, {sql.r('np / ride_ftp', 2)} AS intensity_factor, trimp
FROM sample_rides s JOIN before USING (id) LEFT JOIN power p ON p.activity_id = s.id LEFT JOIN loads l ON l.activity_id = s.id""",
    "d7_daily": f"WITH {DAILY} SELECT athlete_id, date, {sql.r('tss', 4)} AS tss, {sql.r('distance_m', 4)} AS distance_m, {sql.r('elevation_m', 4)} AS elevation_m FROM daily",
    "e4_ctl_atl_tsb": f"WITH RECURSIVE {FITNESS} SELECT * FROM days",
    "e5_weekly": f"""WITH {DAILY} SELECT athlete_id, date, {sql.r('sum(distance_m) OVER w', 1)} AS weekly_distance_m, {sql.r('sum(elevation_m) OVER w', 1)} AS weekly_elevation_m FROM dense
WINDOW w AS (PARTITION BY athlete_id ORDER BY n ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "f1_latest_fitness": f"WITH RECURSIVE {FITNESS} SELECT * FROM days QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY date DESC) = 1",
    "d16_alerts": f"""WITH RECURSIVE {FITNESS}, low AS (SELECT athlete_id, min(tsb) AS lowest_tsb FROM (SELECT * FROM days QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY date DESC) <= 2) GROUP BY 1),
idle AS (SELECT athlete_id, CAST(date_diff('day', CAST(max(date) AS DATE), DATE '{AS_OF}') AS INTEGER) AS days_idle FROM rides GROUP BY 1)
SELECT athlete_id, lowest_tsb, days_idle, lowest_tsb < -25 AS overtrained, days_idle > 5 AS idle FROM low JOIN idle USING (athlete_id)""",
    "d8_usual_speeds": f"""WITH {sql.RIDES}, o AS (SELECT athlete_id, avg_speed_kmh AS v FROM rides WHERE sport_type = 'cycling_outdoor' AND distance_m > 5000), s AS (
  SELECT athlete_id, quantile_cont(v, 0.5) FILTER (WHERE v > 22) AS a, count(*) FILTER (WHERE v > 22) AS na, quantile_cont(v, 0.5) FILTER (WHERE v > 0 AND v < 25) AS b, count(*) FILTER (WHERE v > 0 AND v < 25) AS nb, quantile_cont(v, 0.5) FILTER (WHERE v > 0) AS c FROM o GROUP BY 1)
SELECT athlete_id, coalesce(CASE WHEN na >= 5 THEN {sql.r('a', 1)} END, {sql.r('c', 1)}) AS road, coalesce(CASE WHEN nb >= 5 THEN {sql.r('b', 1)} END, {sql.r('c', 1)}) AS offroad, {sql.r('c', 1)} AS "any" FROM s""",
    "f2_recent_routes": f"""WITH {sql.RIDES} SELECT athlete_id, id, name, distance_m, elevation_m, sport_type, date, CAST(row_number() OVER w AS INTEGER) AS place FROM rides WHERE sport_type = 'cycling_outdoor' AND distance_m > 5000
WINDOW w AS (PARTITION BY athlete_id ORDER BY date DESC NULLS FIRST, id) QUALIFY row_number() OVER w <= 50""",
    "f3_suggested_routes": f"""WITH {sql.RIDES}, recent AS (
  SELECT *, CAST(athlete_id * 3 - 30 AS DOUBLE) AS tsb FROM rides WHERE sport_type = 'cycling_outdoor' AND distance_m > 5000 QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY date DESC NULLS FIRST, id) <= 50
), o AS (SELECT *, CASE WHEN tsb < -10 THEN distance_m WHEN tsb > 10 THEN -distance_m END AS k FROM recent), f AS (
  SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY athlete_id, {sql.r('distance_m / 1000')}, {sql.r('elevation_m / 50')} ORDER BY k, date DESC NULLS LAST, id) = 1)
SELECT athlete_id, CAST(row_number() OVER w AS INTEGER) AS place, id, name, distance_m, elevation_m, date FROM f WINDOW w AS (PARTITION BY athlete_id ORDER BY k, date DESC NULLS LAST, id) QUALIFY row_number() OVER w <= 3""",
}
