"""The tables of the ride engine."""

from pyspark.sql import types as T


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


_long, _int, _double, _text, _flag, _time = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.TimestampType()

#: A ride as a recording service lists it.
RAW_RIDE = _table(
    id=_long, athlete_id=_long, name=_text, start_date=_text, distance=_double, moving_time=_int, total_elevation_gain=_double, average_speed=_double,
    average_heartrate=_double, max_heartrate=_double, average_watts=_double, max_watts=_double, average_cadence=_double, calories=_double, suffer_score=_double,
    device_name=_text, type=_text, trainer=_flag,
)

#: A ride's recordings, an array by measure.
RAW_STREAMS = _table(
    id=_long, time=T.ArrayType(_int), heartrate=T.ArrayType(_int), watts=T.ArrayType(_int), cadence=T.ArrayType(_int),
    velocity_smooth=T.ArrayType(_double), altitude=T.ArrayType(_double), latlng=T.ArrayType(T.ArrayType(_double)),
)

#: A ride as the engine keeps it; athlete_id divides the data, no operator looks across athletes.
RIDE = _table(
    id=_long, athlete_id=_long, name=_text, date=_time, distance_m=_double, duration_s=_int, elevation_m=_double, avg_hr=_int, max_hr=_int, avg_power=_int, max_power=_int,
    avg_cadence=_int, avg_speed_kmh=_double, calories=_int, suffer_score=_int, device=_text, service_type=_text, trainer=_flag, is_indoor=_flag, sport_type=_text,
)

#: What is derived of a ride.
RIDE_METRICS = _table(id=_long, np=_double, ef=_double, work_kj=_double, variability_index=_double, ride_ftp=_double, tss=_double, intensity_factor=_double, trimp=_double)

#: One telemetry sample.
SAMPLE = _table(activity_id=_long, time_offset=_int, hr=_int, power=_int, cadence=_int, speed_kmh=_double, altitude_m=_double, lat=_double, lng=_double)

#: One day of an athlete.
DAY = _table(athlete_id=_long, date=T.DateType(), ctl=_double, atl=_double, tsb=_double, weekly_distance_m=_double, weekly_elevation_m=_double)

#: A key and its value, such as the bookmark of the last sync.
STATE = _table(key=_text, value=_text, last_synced_at=_time)

#: A route of the old kind; read, never written.
ROUTE = _table(id=_int, tour_id=_long, name=_text, distance_m=_double, elevation_m=_double, sport=_text, last_ridden_at=T.DateType(), ride_count=_int)
