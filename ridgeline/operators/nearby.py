"""Rows that meet by place: grid cells are the keys of an equi-join, crowded cells are dealt out, exact distances come after."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_DEGREE
from ..sources.scratch import settled

#: Rows of one side that a cell holds before it is dealt out.
CROWDED = 4096
#: Rows of a key that meet as one list, about.
LISTED = 500


def lines(c: Column, reach: Column, size: float) -> Column:
    """Numbers of the grid lines from c - reach to c + reach."""
    return F.sequence(F.floor((c - reach) / F.lit(size)), F.floor((c + reach) / F.lit(size)))


def widened(lat: Column, reach_km: Column) -> tuple[Column, Column]:
    """A reach in degrees of latitude and of longitude, a little more than it takes."""
    high = reach_km / F.lit(KM_PER_DEGREE) * F.lit(1.01)
    return high, high / F.greatest(F.cos(F.radians(F.abs(lat) + high)), F.lit(0.01))


def cells(lat: tuple[Column, Column], lng: tuple[Column, Column], size: float) -> Column:
    """array<struct<i, j>>: the cells of a box; lat and lng are (centre, reach) in degrees."""
    return F.flatten(F.transform(lines(*lat, size), lambda i: F.transform(lines(*lng, size), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def cell(lat: Column, lng: Column, size: float) -> Column:
    return F.struct(F.floor(lat / F.lit(size)).alias("i"), F.floor(lng / F.lit(size)).alias("j"))


def met(listed: DataFrame, around: Column, placed: DataFrame, at: Column, listed_key: Sequence[str], placed_key: Sequence[str], crowded: int = CROWDED, same: Sequence[str] = (), few: int = 0, few_placed: int = 0) -> DataFrame:
    """Rows of both sides that share a cell: `around` lists a row's cells, `at` is the one cell of a placed row.

    `same`: columns of both sides that must agree too. `few`: where the listed side has so many rows and cells at most, it is broadcast;
    `few_placed`: the same for the rows of the placed side.

    A cell with more than `crowded` rows of a side is cut: its rows are dealt over pieces by the hash of their key, and go to
    every piece of the other side. Column names of the sides must differ; rows without a place meet nothing.
    """
    spread = lambda df: df.withColumn("_i", F.col("_cell.i")).withColumn("_j", F.col("_cell.j")).drop("_cell")
    a = spread(listed.withColumn("_cell", F.explode(around))).where(F.col("_i").isNotNull() & F.col("_j").isNotNull())
    b = spread(placed.withColumn("_cell", at)).where(F.col("_i").isNotNull() & F.col("_j").isNotNull())
    keys = ["_i", "_j", *same]
    if few:
        a = settled(a)
        if a.limit(few + 1).count() <= few:
            return b.join(F.broadcast(a), keys).drop("_i", "_j")
    if few_placed:
        b = settled(b)
        if b.limit(few_placed + 1).count() <= few_placed:
            return a.join(F.broadcast(b), keys).drop("_i", "_j")
    return joined(a, b, keys, listed_key, placed_key, crowded).drop("_i", "_j")


def small(df: DataFrame, few: int, of: DataFrame | None = None) -> DataFrame:
    """df, to be broadcast if it has so many rows at most; it should be settled, or be made of `of`, which is and has no fewer rows."""
    return F.broadcast(df) if (df if of is None else of).limit(few + 1).count() <= few else df


def joined(a: DataFrame, b: DataFrame, keys: Sequence[str], a_key: Sequence[str], b_key: Sequence[str], crowded: int = CROWDED) -> DataFrame:
    """a.join(b, keys); a key with more than `crowded` rows of a side is cut as met() says, by the hashes of a_key and b_key."""
    busy = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(crowded)).cast("int").alias(name))
    # a key that only one side holds has no pairs; one row for each crowded key
    cut = busy(a, "_m").join(busy(b, "_n"), keys).where((F.col("_m") > 1) | (F.col("_n") > 1))
    some = lambda c: F.coalesce(F.col(c), F.lit(1))
    own = lambda key, c: F.pmod(F.xxhash64(*key), some(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), some(c) - 1))
    a = a.join(cut, keys, "left").withColumn("_a", own(a_key, "_m")).withColumn("_b", every("_n")).drop("_m", "_n")
    b = b.join(cut, keys, "left").withColumn("_b", own(b_key, "_n")).withColumn("_a", every("_m")).drop("_m", "_n")
    return a.join(b, [*keys, "_a", "_b"]).drop("_a", "_b")


def lists_met(a: DataFrame, b: DataFrame, keys: Sequence[str], a_columns: Sequence[str], b_columns: Sequence[str], each: int = LISTED) -> DataFrame:
    """a.join(b, keys) as lists: the keys, `a` and `b` (arrays of structs of the columns), every pair of rows in one row's lists.

    For keys that many rows of both sides share: rows of a key are cut into lists of about `each` by the hash of their columns, and the
    pairs of lists are dealt out evenly. Each stands for up to each * each pairs of rows, which are made where they are used.
    """

    def listed(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
        sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(each)).alias("_lists"))
        part = F.pmod(F.xxhash64(*columns), F.col("_lists")).alias("_" + name)
        return df.join(sizes, keys).groupBy(*keys, part).agg(F.collect_list(F.struct(*columns)).alias(name))

    tasks = 4 * max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), a.sparkSession.sparkContext.defaultParallelism)
    both = listed(a, a_columns, "a").join(listed(b, b_columns, "b"), keys)
    return both.repartition(tasks, *keys, "_a", "_b").drop("_a", "_b")
