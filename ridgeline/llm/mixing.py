"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of the wanted words. Each of its documents is taken
whole copies first (the whole part of target / size). For the words that are missing
then, documents have inclusion probabilities that grow with the square root of their
size, so that they add up to the missing words; documents whose probability reaches 1
are taken for certain. The others are ranked by the odds of a random number divided by
the odds of their inclusion, and the first ones are taken until their words come
nearest to what is still missing.

The random number is a hash of the id: reruns agree. A document's size is its number
of words; null and empty texts have size 0, get whole copies only, and carry no words.
A null source is a source of its own and comes last. Equal ranks, such as those of rows
with equal ids and sizes, are put in order by id, then by a hash of the text. Repeated
rows are rows of their own. Other columns than id, text and source are not returned.

The cut is found from sums by narrow ranges of rank, twice refined; only the last
range's documents are put in order, so that a source may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._text import kept

WEIGHTS, SHARE, MOST_COPIES = (5, 2, 1), 1.5, 2.0
RANGES = 1024


def words(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(id_col: Column, seed: str) -> Column:
    """A number between 0 and 1 from the id alone."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def numbered(sizes: DataFrame) -> DataFrame:
    """sizes and `place`: the place of each source, from 0, in order of code points, null last.

    Sources are dealt out by ranges; only the ranges' counts come to the driver.
    """
    by_name = F.col("source").asc_nulls_last()
    dealt = kept(sizes.repartitionByRange(by_name).withColumn("range", F.spark_partition_id()))
    counts = {r["range"]: r["count"] for r in dealt.groupBy("range").count().collect()}
    before, offsets = 0, []
    for k in range(max(counts, default=0) + 1):
        offsets.append(F.lit(before))
        before += counts.get(k, 0)
    within = F.row_number().over(Window.partitionBy("range").orderBy(by_name)) - 1
    return dealt.select("source", "source_size", (F.get(F.array(*offsets), F.col("range")) + within).alias("place"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size -> also target: weights repeat over the sources in order; no target is above most * size.

    What sources at their limit leave is shared by weight among the others, in rounds of one sum each, until none is above.
    """
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("place"), F.lit(len(weights))).cast("int"))
    rows = numbered(sizes).select("source", "source_size", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("most"))
    full, level = -1, 0.0
    while True:
        over = F.col("weight") * F.lit(level) > F.col("most")
        r = rows.agg(F.sum("source_size").alias("words"), F.sum(F.when(over, F.col("most"))).alias("given"), F.sum(F.when(~over, F.col("weight"))).alias("weights"), F.count_if(over).alias("full")).first()
        if not r["weights"] or r["full"] == full:
            return rows.select("source", "source_size", F.when(over, F.col("most")).otherwise(F.least(F.col("most"), F.lit(level) * F.col("weight"))).alias("target"))
        full, level = r["full"], (share * r["words"] - (r["given"] or 0.0)) / r["weights"]


def inclusion(sums: DataFrame, plan: DataFrame) -> DataFrame:
    """plan and, by source, `step` (inclusion probability by unit of measure) and `certain` (words of the documents that are taken for certain).

    sums: the words of each source by measure, of which it has four times the square root of its largest size, at most.
    """
    placed = sums.where("measure > 0").join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).where("missing > 1e-6")
    larger = Window.partitionBy("source").orderBy(F.col("measure").desc()).rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.partitionBy("source").orderBy(F.col("measure").desc()).rowsBetween(0, Window.unboundedFollowing)
    before, rest = F.coalesce(F.sum("words").over(larger), F.lit(0)), F.sum(F.col("measure") * F.col("words")).over(smaller)
    steps = placed.select("source", "measure", before.alias("before"), ((F.col("missing") - before) / rest).alias("step")).where(F.col("step") * F.col("measure") < 1)
    first = steps.groupBy(F.col("source").alias("_source")).agg(F.max_by("step", "measure").alias("step"), F.max_by("before", "measure").alias("certain"))
    return plan.join(first, F.col("source").eqNullSafe(F.col("_source")), "left").select(*plan.columns, F.coalesce("step", F.lit(0.0)).alias("step"), F.coalesce("certain", F.lit(0)).alias("certain"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies, expected and h (xxhash64 of the text) of every row of docs.

    copies: whole numbers, `most` at most (a whole number too); expected: whole copies and the inclusion probability of one more.
    """
    sized = kept(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), uniform(F.col(id_col), seed).alias("u"), F.xxhash64(text_col).alias("h")).withColumn("measure", F.floor(F.lit(4.0) * F.sqrt(F.col("size").cast("double")))))
    sums = kept(sized.groupBy("source", "measure").agg(F.sum("size").alias("words")))
    plan = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(rate)).withColumn("missing", F.col("target") - F.floor(rate) * F.col("source_size"))
    plan = kept(inclusion(sums, plan))
    part = F.least(F.lit(1.0), F.col("step") * F.col("measure"))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("part") / (1 - F.col("part")))
    same = sized["source"].eqNullSafe(plan["source"])
    met = sized.join(plan, same).select(sized["*"], "source_size", "target", "whole", (F.col("missing") - F.col("certain")).alias("missing"), part.alias("part"))
    everything = met.withColumn("rank", F.when((F.col("part") > 0) & (F.col("part") < 1), odds / (1 + odds)))
    rows = everything.where("rank IS NOT NULL")
    sure = everything.where("rank IS NULL").withColumn("one", (F.col("part") >= 1).cast("int"))
    fine = F.least(F.floor(F.col("rank") * (RANGES * RANGES)), F.lit(RANGES * RANGES - 1)).cast("long")
    rows = rows.withColumn("fine", fine).withColumn("coarse", F.floor(F.col("fine") / RANGES))

    def cut(of: DataFrame, range_col: str, base: Column) -> DataFrame:
        """source, the range in which the missing words are reached, and the words before it."""
        sums = of.groupBy("source", "missing", base.alias("base"), range_col).agg(F.sum("size").alias("n"))
        running = sums.withColumn("upto", F.col("base") + F.sum("n").over(Window.partitionBy("source").orderBy(range_col)))
        return running.where(F.col("upto") > F.col("missing")).groupBy(F.col("source").alias("_source")).agg(F.min(range_col).alias("at_" + range_col), F.min(F.struct(F.col(range_col), (F.col("upto") - F.col("n")).alias("n")))["n"].alias("before_" + range_col))

    first = kept(cut(rows, "coarse", F.lit(0)))
    narrowed = rows.join(first, rows["source"].eqNullSafe(first["_source"]), "left").drop("_source")
    second = kept(cut(narrowed.where(F.col("coarse") == F.col("at_coarse")), "fine", F.col("before_coarse")))
    placed = narrowed.join(second, narrowed["source"].eqNullSafe(second["_source"]), "left").drop("_source")
    on_cut = F.coalesce(F.col("fine") == F.col("at_fine"), F.lit(False))
    in_order = Window.partitionBy("source").orderBy("rank", "id", "h", "size").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("before_fine") + F.coalesce(F.sum("size").over(in_order), F.lit(0)) + F.col("size") / 2
    # without a cut the missing words are never passed: all are taken, unless nothing is missing
    clear = F.when(F.col("at_fine").isNotNull(), F.col("fine") < F.col("at_fine")).otherwise(F.col("missing") > 0)
    more = placed.where(~on_cut).withColumn("one", clear.cast("int")).unionByName(placed.where(on_cut).withColumn("one", (middle <= F.col("missing")).cast("int"))).unionByName(sure, allowMissingColumns=True)
    copies = (F.col("whole") + F.col("one")).cast("int")
    return more.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), (F.col("whole") + F.col("part")).alias("expected"), "h")
