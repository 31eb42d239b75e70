"""A training corpus from raw documents: language, near copies, private values, the mix of sources, sequences.

STAGES are applied in order; each is written as Parquet and read again as the next one's
documents. All but the last return the columns of their input.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.llm._text import fresh, shared_folder
from ridgeline.llm.entries import pseudonym_key, tokenizer_definition
from ridgeline.llm.language import UNKNOWN, identify
from ridgeline.llm.mixing import mix
from ridgeline.llm.neardup import near_duplicates
from ridgeline.llm.packing import pack
from ridgeline.llm.private import pseudonymise

#: A document goes if its most likely language has less than this probability.
LEAST_SCORE = 0.4


def row_key(*columns: Column) -> Column:
    """One text that equal rows share; nulls are values of their own."""
    return F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("\0")) for c in columns))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with text in a learnt language; a null `lang` becomes the predicted one.

    Null texts, texts without a letter and undecided ones go.
    """
    language, score = fresh(docs.columns, "language", "score")
    found = identify(docs, F.lit(True), names=(language, score))
    clear = (F.col(language) != UNKNOWN) & (F.col(score) >= LEAST_SCORE)
    return found.where(clear).withColumn("lang", F.coalesce("lang", language)).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every group of near copies; of rows that agree in id and text, one."""
    key, wanted_key = fresh(docs.columns, "key", "wanted_key")
    found = near_duplicates(docs.select("doc_id", "text"))
    wanted = found.where("kept").select(row_key(F.col("doc_id"), F.col("h")).alias(wanted_key))
    marked = docs.withColumn(key, row_key(F.col("doc_id"), F.xxhash64("text")))
    return marked.join(wanted, F.col(key) == F.col(wanted_key), "left_semi").dropDuplicates([key]).select(docs.columns)


def without_private_values(spark: SparkSession, docs: DataFrame, sf_dir: str, key: str | None = None) -> DataFrame:
    """All documents, their private values replaced by pseudonyms of the same format, under the key given or the session's.

    Without any a public key is used, which is right for invented tables only; a warning says so.
    """
    if key is None and spark.conf.get("ridgeline.pseudonym.key", None) is None:
        warnings.warn("no ridgeline.pseudonym.key is set: pseudonyms under a public key can be undone by anyone", stacklevel=2)
    return pseudonymise(docs, key or pseudonym_key(spark), found_col=fresh(docs.columns, "private")[0]).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: never, once or twice."""
    key, taken_key, copies, rows, row, copy = fresh(docs.columns, "key", "taken_key", "copies", "rows", "row", "copy")
    found = mix(docs.select("doc_id", "text", "source"))
    taken = found.groupBy(row_key(F.col("doc_id"), F.col("h"), F.col("source")).alias(taken_key)).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows))
    marked = docs.withColumn(key, row_key(F.col("doc_id"), F.xxhash64("text"), F.col("source")))
    # rows with one key share its copies
    placed = marked.join(taken.where(F.col(copies) > 0), F.col(key) == F.col(taken_key)).withColumn(row, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    upto = lambda k: F.floor(F.col(copies) * k / F.col(rows))
    times = (upto(F.col(row)) - upto(F.col(row) - 1)).cast("int")
    return placed.withColumn(copy, F.explode(F.array_repeat(F.lit(0), times))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents by sequence and offset, with their token ids."""
    return pack(docs, tokenizer_definition(), with_ids=True)


Stages = list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]]


def stages(key: str) -> Stages:
    """The stages for a corpus of one's own, with pseudonyms under this key."""
    return [(name, partial(stage, key=key) if name == "private" else stage) for name, stage in STAGES]


STAGES: Stages = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("private", without_private_values),
    ("mix", mixed),
    ("pack", packed),
]

#: SQL can't train the network of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, steps: Stages | None = None) -> DataFrame:
    """The last stage's rows for the table `documents`."""
    steps = steps or STAGES
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "corpus")
    for name, stage in steps[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return steps[-1][1](spark, docs, sf_dir)
