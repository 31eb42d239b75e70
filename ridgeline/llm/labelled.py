"""Bounded samples of labelled rows, and the fold a row belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts (`text`) and labels (`y`, 0 or 1) of `limit` labelled rows at most, by order of a hash of the id.

    The chosen label rows are bounded by `limit` (16 bytes each), so they are broadcast to the scan of the texts.
    Rows with a null label are left out; a label given twice counts twice.
    """
    chosen = (
        labels.where(learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y"))
        .orderBy(F.xxhash64(F.lit("labelled sample"), "_id"), "_id", "y")
        .limit(limit)
    )
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id").select("_id", "text", "y")
