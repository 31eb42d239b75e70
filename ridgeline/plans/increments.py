"""Queries of the incremental side: rides that arrive in batches end in the table that one batch would give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arrival, ingest
from ..sources import driver_tables as tables
from ..streaming import sync
from . import oracle_tables as sql
from .rides import rides


def i1_incremental_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches in order of start, each sees the bookmark of the ones before."""
    raw = tables.raw_rides(spark, sf_dir)
    at = F.unix_timestamp(F.try_to_timestamp("start_date"))
    bounds = [0, 852076800, 946684800, 4102444800]  # 1997-01-01, 2000-01-01
    table = rides(spark, sf_dir).limit(0)
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        batch = raw.where((at > low) & (at <= high))
        table = ingest.upserted(table, sync.arrived(batch, F.lit(low)).select(table.columns))
    return table.groupBy("athlete_id").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("latest"), F.sum("avg_power").alias("power"))


def i3_late_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a bookmark at 2000-01-01 lets in: later rides only; with a year's lateness more."""
    raw = tables.raw_rides(spark, sf_dir)
    mark = F.lit(946684800)
    strict, relaxed = sync.arrived(raw, mark), sync.arrived(raw, mark, 365 * 86400)
    return strict.groupBy(F.lit("strict").alias("policy")).agg(F.count(F.lit(1)).alias("n")).unionByName(relaxed.groupBy(F.lit("relaxed").alias("policy")).agg(F.count(F.lit(1)).alias("n")))


def l_merged_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides merged at two hours' tolerance, and what samples each ride has then; a sample is a line item."""
    li = tables.table(spark, sf_dir, "lineitem")
    samples = li.select(F.col("l_orderkey").alias("activity_id"), F.col("l_linenumber").cast("int").alias("time_offset"), F.floor("l_quantity").cast("int").alias("hr"))
    kept = arrival.followed(samples, arrival.lineage(rides(spark, sf_dir), 7200))
    return kept.groupBy("activity_id").agg(F.count(F.lit(1)).alias("n"), F.sum("hr").alias("hr"))


def i5_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrival.lineage(rides(spark, sf_dir), 7200)


QUERIES = {f.__name__: f for f in (i5_lineage, l_merged_samples, i1_incremental_upserts, i3_late_rides)}

MEASURES = ("avg_hr", "max_hr", "avg_power", "max_power", "avg_cadence", "calories", "suffer_score", "distance_m", "elevation_m", "duration_s")
TAKEN = ", ".join(f"{c} := " + (f"coalesce(nullif(n.{c}, 0), nullif(e.{c}, 0), n.{c})" if c in arrival.FILLED else f"n.{c}") for c in MEASURES)
STAYING = ", ".join(f"{c} := " + (f"coalesce(e.{c}, n.{c})" if c in arrival.KEPT else f"e.{c}") for c in MEASURES)


def rated(r: str, names: tuple[tuple[str, int], ...]) -> str:
    return " + ".join(f"CASE WHEN coalesce({r}.{c}, 0) {'>' if c in ('distance_m', 'elevation_m') else '<>'} 0 THEN {points} ELSE 0 END" for c, points in names)


#: The fold as recursion: step k lets the k-th ride of every stretch arrive; `kept` is the list of places.
FOLD = f"""{sql.RIDES}, gaps AS (
  SELECT *, CASE WHEN epoch(date) - epoch(lag(date) OVER w) < 7200 THEN 0 ELSE 1 END AS begins FROM rides WINDOW w AS (PARTITION BY athlete_id ORDER BY date, id)
), numbered AS (SELECT *, sum(begins) OVER (PARTITION BY athlete_id ORDER BY date, id) AS stretch FROM gaps), lists AS (
  SELECT athlete_id, stretch, list(struct_pack(first_id := id, members := [id], id := id, at := epoch(date), {", ".join(f"{c} := {c}" for c in MEASURES)}) ORDER BY date, id) AS arriving FROM numbered GROUP BY 1, 2
), fold(athlete_id, stretch, k, kept, arriving) AS (
  SELECT athlete_id, stretch, 1, [arriving[1]], arriving FROM lists
  UNION ALL
  SELECT athlete_id, stretch, k + 1, CASE WHEN found IS NULL THEN list_append(kept, n) ELSE list_transform(kept, lambda e, i: CASE WHEN i <> found THEN e
      WHEN {rated('n', arrival.POINTS)} >= {rated('e', arrival.POINTS[:3])} THEN struct_pack(first_id := e.first_id, members := list_append(e.members, n.id), id := n.id, at := n.at, {TAKEN})
      ELSE struct_pack(first_id := e.first_id, members := list_append(e.members, n.id), id := e.id, at := e.at, {STAYING}) END) END, arriving
  FROM (SELECT *, list_position(list_transform(kept, lambda e: coalesce(abs(e.at - n.at) < 7200 AND n.duration_s <> 0 AND (abs(e.duration_s - n.duration_s) < greatest(300.0::DOUBLE, e.duration_s * 0.15::DOUBLE)
    OR (e.distance_m > 0 AND n.distance_m > 0 AND abs(e.distance_m - n.distance_m) < e.distance_m * 0.10::DOUBLE)), false)), true) AS found FROM (SELECT *, arriving[k + 1] AS n FROM fold WHERE k < len(arriving)))
), staying AS (SELECT athlete_id, len(arriving) AS came, unnest(kept) AS r FROM fold WHERE k = len(arriving)
), lineage AS (SELECT unnest(r.members) AS ride_id, r.first_id AS first_id, r.id AS final_id FROM staying WHERE came > 1)"""

ORACLE_SQL = {
    "i5_deduplicated": f"WITH RECURSIVE {FOLD} SELECT athlete_id, count(*) AS n, CAST(sum(r.avg_hr) AS BIGINT) AS hr, CAST(sum(r.avg_power) AS BIGINT) AS power FROM staying GROUP BY 1",
    "i5_lineage": f"WITH RECURSIVE {FOLD} SELECT ride_id, first_id, final_id FROM lineage",
    "l_merged_samples": f"""WITH RECURSIVE {FOLD}, s AS (SELECT coalesce(final_id, l_orderkey) AS activity_id, CAST(floor(l_quantity) AS INTEGER) AS hr FROM lineitem LEFT JOIN lineage ON ride_id = l_orderkey WHERE ride_id IS NULL OR ride_id = first_id)
SELECT activity_id, count(*) AS n, CAST(sum(hr) AS BIGINT) AS hr FROM s GROUP BY 1""",
    "i1_incremental_upserts": f"WITH {sql.RIDES} SELECT athlete_id, count(*) AS n, max(date) AS latest, CAST(sum(avg_power) AS BIGINT) AS power FROM rides GROUP BY athlete_id",
    "i3_late_rides": f"""WITH {sql.RIDES} SELECT 'strict' AS policy, count(*) AS n FROM rides WHERE epoch(date) > 946684800 UNION ALL SELECT 'relaxed', count(*) FROM rides WHERE epoch(date) > 946684800 - 31536000""",
}
