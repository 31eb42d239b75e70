"""Rides, samples and places made from the tables of TESTDATA.md, for queries and benchmarks.

Everything is arithmetic on keys, so that SQL can say the same.
"""

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ATHLETES = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str, by_days: bool = False) -> DataFrame:
    """One sample per event. A ride is a user's events, or with by_days those of five hundred users on five days (long rides)."""
    e = table(spark, sf_dir, "events")
    ride = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / F.lit(432000)) + F.floor(F.col("user_id") / 500) * 1000 if by_days else F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("int")
    offset = F.row_number().over(Window.partitionBy("activity_id").orderBy("ts", "event_id")) - 1
    kind = F.col("event_type")
    return e.withColumn("activity_id", ride.cast("long")).select(
        "activity_id",
        offset.alias("time_offset"),
        F.when(kind != "error", k + 90).alias("hr"),
        F.when(kind != "signup", F.floor(F.col("value") * 4).cast("int")).alias("power"),
        F.when(kind != "view", k % 50 + 60).alias("cadence"),
        (F.lit(15.0) + F.floor(F.col("value") * 10) % 200 / F.lit(10.0)).alias("speed_kmh"),
        (F.lit(100.0) + k * 7 % 90).alias("altitude_m"),
        F.when(kind != "click", F.lit(38.7) + (F.col("event_id") * 37 % 400 - 200) / F.lit(2000.0)).alias("lat"),
        F.when(kind != "click", F.lit(-9.14) + (F.col("event_id") * 53 % 400 - 200) / F.lit(2000.0)).alias("lng"),
        F.col("ts"),
    )


def sample_rides(points: DataFrame) -> DataFrame:
    """The rides that samples belong to, summed up."""
    whole = lambda c: F.floor(F.avg(c)).cast("int")
    return points.groupBy(F.col("activity_id").alias("id")).agg(
        F.min("ts").alias("date"), F.count(F.lit(1)).cast("int").alias("duration_s"), whole("hr").alias("avg_hr"), F.max("hr").alias("max_hr"), whole("power").alias("avg_power"), F.sum(F.col("speed_kmh") / F.lit(3.6)).alias("distance_m")
    ).withColumn("athlete_id", F.col("id") % 2)


def raw_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listed ride per order."""
    o = table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderkey": "k", "o_custkey": "c"})
    k, c = F.col("k"), F.col("c")
    moving = F.lit(1800) + k * 7919 % 14400
    start = F.timestamp_seconds(F.unix_timestamp("o_orderdate") + c * 7919 % 86400)
    pick = lambda by, *names: F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))
    distance = F.when(k % 11 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice") / 4)
    hr = F.when(F.col("o_orderstatus") != "P", (c % 60 + 110).cast("double"))
    watts = F.when(~F.col("o_orderpriority").startswith("1") & ~F.col("o_orderpriority").startswith("5"), (k % 180 + 120).cast("double"))
    return o.select(
        k.alias("id"),
        (c % ATHLETES).alias("athlete_id"),
        F.concat(F.lit("Ride "), k.cast("string"), F.when(k % 17 == 0, " on Zwift").otherwise("")).alias("name"),
        F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start_date"),
        distance.alias("distance"),
        moving.cast("int").alias("moving_time"),
        (k * 31 % 1500).cast("double").alias("total_elevation_gain"),
        F.when(k % 13 != 0, distance / moving).alias("average_speed"),
        hr.alias("average_heartrate"),
        (hr + 20 + k % 15).alias("max_heartrate"),
        watts.alias("average_watts"),
        (watts * 2 + k % 90).alias("max_watts"),
        F.when(k % 4 != 0, (k % 40 + 60).cast("double")).alias("average_cadence"),
        F.when(k % 5 != 0, (k % 900).cast("double")).alias("calories"),
        F.when(k % 6 != 0, (k % 200).cast("double")).alias("suffer_score"),
        pick(k, "Head Unit Karoo 3", "Apple Watch", "Phone", None, "Smartwatch").alias("device_name"),
        pick(c, "Ride", "VirtualRide", "EBikeRide", "Run", "Ride", "", "Handcycle").alias("type"),
        (k % 9 == 0).alias("trainer"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of interest: one per part. About a sixth have a first tag that riders do not look for, some of these a second that they do."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    keys = F.array(*map(F.lit, ("tourism", "natural", "amenity", "amenity", "amenity", "shop")))
    values = F.array(*map(F.lit, ("viewpoint", "peak", "cafe", "drinking_water", "bicycle_repair_station", "books")))
    at = (k % 6 + 1).cast("int")
    first = F.struct(F.element_at(keys, at).alias("key"), F.element_at(values, at).alias("value"))
    second = F.struct(F.lit("natural").alias("key"), F.lit("peak").alias("value"))
    return p.select(
        k.alias("id"),
        (F.lit(38.7) + (k * 41 % 600 - 300) / F.lit(1500.0)).alias("lat"),
        (F.lit(-9.14) + (k * 67 % 600 - 300) / F.lit(1500.0)).alias("lng"),
        F.when(k % 7 != 0, F.col("p_name")).alias("name"),
        F.map_from_entries(F.when((k % 5 == 0) & (k % 6 != 1), F.array(first, second)).otherwise(F.array(first))).alias("tags"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.alias("id"), (F.lit(38.7) + (k * 29 % 500 - 250) / F.lit(1250.0)).alias("lat"), (F.lit(-9.14) + (k * 43 % 500 - 250) / F.lit(1250.0)).alias("lng"), F.col("s_name").alias("name"), F.floor(F.abs("s_acctbal")).cast("long").alias("athlete_count"))


def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    names = ("viewpoint", "trail", "cycle_way", "bridge", "historical_site", "man_made_monument", "beach", "settlement", "other_man_made", "harbour")
    return c.select(
        k.alias("id"),
        (F.lit(38.7) + (k * 31 % 800 - 400) / F.lit(2000.0)).alias("lat"),
        (F.lit(-9.14) + (k * 47 % 800 - 400) / F.lit(2000.0)).alias("lng"),
        F.concat(F.lit("Place "), F.floor(k / 2).cast("string")).alias("name"),
        F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int")).alias("category"),
    )


def tile_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile_id, data: vector tiles of fifty highlights each, with name, category and place as tags; every seventh breaks off."""

    def number(n: int) -> bytes:
        out = b""
        while n >= 128:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def part(field: int, body: bytes) -> bytes:
        return number(field << 3 | 2) + number(len(body)) + body

    def tile(rows: list[dict]) -> bytes:
        keys, values, made = ["name", "category", "lat", "lng"], {}, []
        for r in rows:
            own = [part(1, r["name"].encode()), part(1, r["category"].encode()), number(3 << 3 | 1) + struct.pack("<d", r["lat"]), number(3 << 3 | 1) + struct.pack("<d", r["lng"])]
            tags = b"".join(number(k) + number(values.setdefault(v, len(values))) for k, v in enumerate(own))
            made.append(number(1 << 3) + number(r["id"]) + part(2, tags))
        layer = part(1, b"highlights") + b"".join(part(2, f) for f in made) + b"".join(part(3, k.encode()) for k in keys) + b"".join(part(4, v) for v in values)
        return part(3, layer)

    def encode(batches):
        for b in batches:
            data = [tile(rows)[: -7 if t % 7 == 3 else None] for t, rows in zip(b.column("tile_id").to_pylist(), b.column("rows").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("tile_id"), pa.array(data, pa.binary())], names=["tile_id", "data"])

    lists = highlights(spark, sf_dir).groupBy(F.floor(F.col("id") / 50).alias("tile_id")).agg(F.sort_array(F.collect_list(F.struct("id", "name", "category", "lat", "lng"))).alias("rows"))
    return lists.mapInArrow(encode, "tile_id long, data binary")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places to avoid; without a radius for every third."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select((F.lit(38.7) + (k * 17 % 50 - 25) / F.lit(150.0)).alias("lat"), (F.lit(-9.14) + (k * 23 % 50 - 25) / F.lit(150.0)).alias("lng"), F.when(k % 3 != 0, (k * 100 + 200).cast("double")).alias("radius"))


def route_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """route_id, seq, lat, lng, elevation: the located samples of every user, a route each."""
    s = samples(spark, sf_dir).where(F.col("lat").isNotNull())
    return s.select(F.col("activity_id").alias("route_id"), F.col("time_offset").alias("seq"), "lat", "lng", F.when(F.col("hr").isNotNull(), F.col("altitude_m")).alias("elevation"))


def map_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """element_id, kind, line and tags of a map: one element per line item; nodes have one place, others two, 300 m apart at most."""
    li = table(spark, sf_dir, "lineitem")
    p = F.col("l_partkey")
    e = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000003 + p * 101 + F.col("l_suppkey")
    pick = lambda by, *names: F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))
    lat, lng = F.lit(38.7) + (e * 31 % 4800 - 2400) / F.lit(20000.0), F.lit(-9.14) + (e * 47 % 4801 - 2400) / F.lit(20000.0)
    place = lambda y, x: F.struct(y.alias("lat"), x.alias("lng"))
    kind = F.when(e % 5 == 0, "node").when(e % 7 == 0, "relation").otherwise("way")
    return li.select(
        e.alias("element_id"),
        kind.alias("kind"),
        F.when(e % 5 == 0, F.array(place(lat, lng))).otherwise(F.array(place(lat, lng), place(lat + (e * 7 % 41 - 20) / F.lit(10000.0), lng + (e * 11 % 41 - 20) / F.lit(10000.0)))).alias("line"),
        pick(p, "residential", "cycleway", "path", "track", "living_street", "primary", None).alias("highway"),
        pick(p + e, "asphalt", "gravel", "dirt", None, "concrete", "rock", "sett", "compacted").alias("surface"),
        pick(p, "water", None, "wood", "coastline", None, "cliff", "scree", "beach", "peak").alias("natural"),
        pick(e, None, "forest", None).alias("landuse"),
        pick(p, "park", None, None, None).alias("leisure"),
        pick(p, "bicycle", "hiking").alias("route"),
        pick(p + F.col("l_suppkey"), None, "lane", None, None).alias("cycleway"),
        pick(p, "50", "30", None, "20", "walk", "RO:urban").alias("maxspeed"),
        pick(F.col("l_suppkey"), None, None, "hump").alias("traffic_calming"),
        pick(e, "River Way", None, "Coast Path").alias("name"),
        pick(p, None, "EV1", "N2", None).alias("ref"),
    )


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """route_id, element_id and tags: the map elements near each route; one per line item of an order.

    Elements with a surface come twice, as from two selectors of one search.
    """
    li = table(spark, sf_dir, "lineitem")
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    pick = lambda by, *names: F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))
    tags = {
        "highway": pick(p, "residential", "cycleway", "path", "track", "living_street", "primary"),
        "surface": pick(p + k, "asphalt", "gravel", "dirt", None, "concrete", "rock", "sett", "compacted"),
        "natural": pick(p, "water", None, "wood", "coastline", None, "cliff", "scree"),
        "landuse": pick(k, None, "forest", None),
        "leisure": pick(p, "park", None, None, None),
        "cycleway": pick(p + F.col("l_suppkey"), None, "lane", None, None),
        "maxspeed": pick(p, "50", "30", None, "20", "walk", "RO:urban"),
        "traffic_calming": pick(F.col("l_suppkey"), None, None, "hump"),
        "name": pick(p, "River Way", None, "Coast Path"),
        "ref": pick(p, None, "EV1", "N2", None),
    }
    element = (k * 10 + F.col("l_linenumber")) * 1000003 + p * 101 + F.col("l_suppkey")
    rows = li.select(F.floor(k / 10).alias("route_id"), element.alias("element_id"), *(v.alias(n) for n, v in tags.items()))
    times = F.when(F.col("surface").isNotNull(), 2).otherwise(1)
    return rows.withColumn("time", F.explode(F.array_repeat(F.lit(0), times))).drop("time")


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, temp_max, temp_min, precip, wind, uv_max, code of one day per order date."""
    o = table(spark, sf_dir, "orders")
    d = o.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_custkey") % 97).alias("s"))
    n, s = F.col("n"), F.col("s")
    codes = F.array(*map(F.lit, (0, 1, 2, 3, 45, 51, 61, 63, 71, 80, 95, 100)))
    return d.select(
        "date",
        (s % 45).cast("double").alias("temp_max"),
        (s % 45 - 8).cast("double").alias("temp_min"),
        F.when(s % 3 == 0, s % 30 / F.lit(2.0)).otherwise(F.lit(0.0)).alias("precip"),
        (s * 7 % 55).cast("double").alias("wind"),
        (s * 3 % 13).cast("double").alias("uv_max"),
        F.element_at(codes, ((s + n) % 12 + 1).cast("int")).alias("code"),
    )


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """time (ISO text), temp, wind, uv, precip of the hours that have events."""
    e = table(spark, sf_dir, "events")
    h = e.groupBy(F.date_format("ts", "yyyy-MM-dd'T'HH:00").alias("time")).agg(F.sum(F.col("event_id") % 89).alias("s"))
    s = F.col("s")
    return h.select("time", (s % 45).cast("double").alias("temp"), (s * 7 % 50).cast("double").alias("wind"), (s * 3 % 13).cast("double").alias("uv"), F.when(s % 3 == 0, s % 9 / F.lit(3.0)).otherwise(F.lit(0.0)).alias("precip"))


def requests(spark: SparkSession, sf_dir: str, start: Column | None = None) -> DataFrame:
    """Requests for rides, one per order, with the order's day as `as_of`; every eighth gives neither time nor length nor place. All start at home, or from `start`."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda x: x.cast("string")
    pick = lambda by, *names: F.element_at(F.array(*names), (by % len(names) + 1).cast("int"))
    place = lambda lat, lng: F.struct(lat.alias("lat"), lng.alias("lng"))
    there = place(F.lit(38.7) + (k * 29 % 500 - 250) / F.lit(1250.0), F.lit(-9.14) + (k * 43 % 500 - 250) / F.lit(1250.0))
    return o.select(
        k.alias("id"),
        (c % ATHLETES).alias("athlete_id"),
        F.when((k % 4 == 0) | (k % 8 == 3), F.concat(text(k % 5 + 1), F.lit("h"), text(k % 60), F.lit("m"))).alias("duration"),
        F.when(k % 4 == 1, F.concat(text(k % 80 + 10), F.lit("km"))).alias("distance"),
        pick(k, *map(F.lit, ("road", "gravel", "mtb", "city"))).alias("surface"),
        pick(c, F.lit("today"), F.lit("Tomorrow"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("some day")).alias("day"),
        pick(c + k, *map(F.lit, ("14:00", "2pm", "9h", "dawn"))).alias("clock"),
        (place(F.lit(38.7), F.lit(-9.14)) if start is None else start).alias("start"),
        F.when((k % 4 == 2) | (k % 8 == 3), there).alias("destination"),
        F.concat(F.lit("Place "), text(k % 100)).alias("destination_name"),
        F.when(k % 6 == 0, F.lit(True)).alias("loop"),
        (k % 11 / F.lit(10.0)).alias("safety"),
        F.when(k % 10 == 0, F.array(place(F.lit(38.8), F.lit(-9.2)))).alias("waypoints"),
        F.to_date("o_orderdate").alias("as_of"),
    )


def travelling_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """requests() of athletes who start from places of their own, up to 1.5 degrees from home; two of three want to explore."""
    c = F.col("o_custkey")
    start = F.struct((F.lit(38.7) + (c * 37 % 300 - 150) / F.lit(100.0)).alias("lat"), (F.lit(-9.14) + (c * 53 % 300 - 150) / F.lit(100.0)).alias("lng"))
    return requests(spark, sf_dir, start).withColumn("explore", F.col("id") % 3 != 0)
