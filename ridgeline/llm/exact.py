"""Exact duplicates by sorting contents, in DataFrame expressions only.

Texts are normalised (A-Z become a-z, null counts as empty). Spark samples splitters of
(the beginning of the normalised bytes, their digest, piece) and deals the rows out by range;
within a range the external sort puts equal texts side by side, and the window compares the
full texts of neighbours. A text whose copies hold more than a fraction of a range is cut into
pieces by id beforehand, so no range holds it alone; the first row of each piece carries the
text on, and the pieces are put together by comparing these.

Of equal texts the row with the largest id stays (`keep="largest"`) or the one with the
smallest. Rows with null ids stay only where all rows of their text have none. Of rows that
agree in text and id one stays. An empty table gives no rows. Columns other than the id and
the text are not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._text import kept, let_go

HEAD = 48  # characters of a text that splitters hold
SHARE = 4  # a text is cut once its copies hold more than a range's rows or bytes divided by this


def normalised(text):
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def frequent(keyed: DataFrame, ranges: int) -> tuple[DataFrame, DataFrame]:
    """digest, pieces of the texts whose copies are to be cut: at most 2 * SHARE * ranges rows; and the table they come from."""
    sizes = (F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("norm")).alias("bytes"))
    copied = kept(keyed.groupBy("digest").agg(*sizes).where("n > 1"))
    total = keyed.agg(*sizes).first()
    part = lambda c: F.ceil(F.col(c) * (SHARE * ranges) / F.lit(float(max(1, total[c] or 0))))
    return copied.select("digest", F.greatest(part("n"), part("bytes")).cast("int").alias("pieces")).where("pieces > 1"), copied


def neighbours(rows: DataFrame, largest: bool) -> DataFrame:
    """Rows (id, norm, digest, pieces) dealt out by range and sorted: n, best id and place among the equal texts of a piece.

    The window's groups lie whole within the ranges, so this is the only exchange. `text` is left for texts in pieces only.
    """
    piece = F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("id"), F.col("pieces"))).otherwise(F.lit(0)).cast("int")
    ranged = rows.withColumn("head", F.substring("norm", 1, HEAD)).withColumn("piece", piece).repartitionByRange("head", "digest", "piece")
    equal = Window.partitionBy("head", "digest", "piece", "norm").orderBy(F.desc_nulls_last("id") if largest else F.asc_nulls_last("id"))
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    values = {"probe": F.xxhash64("norm"), "n": F.count(F.lit(1)).over(whole), "best": F.first("id").over(whole), "place": F.row_number().over(equal), "text": F.when(F.col("pieces") > 1, F.col("norm"))}
    return ranged.select("id", "digest", "piece", *(v.alias(k) for k, v in values.items()))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """id_col, keep_id, group_size, kept, text_sha256: a row for each row of docs."""
    largest = {"largest": True, "smallest": False}[keep]
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm")).withColumn("digest", F.sha2("norm", 256))
    cut, copied = frequent(keyed, ranges)
    met = neighbours(keyed.join(F.broadcast(cut), "digest", "left"), largest)  # 2 * SHARE * ranges rows at most are sent
    rows = kept(met.withColumn("text", F.when(F.col("place") == 1, F.col("text"))))
    let_go(copied)
    # SHARE * ranges pieces for rows, as many for bytes, and one for each text at most
    best = F.max("best") if largest else F.min("best")
    pieces = rows.where(F.col("text").isNotNull()).groupBy("text").agg(F.sum("n").alias("all_n"), best.alias("all_best"), F.collect_list(F.struct("digest", "piece", "probe")).alias("of"))
    joined = pieces.select("all_n", "all_best", F.explode("of").alias("p")).select("all_n", "all_best", "p.*")
    found = rows.drop("text").join(F.broadcast(joined), ["digest", "piece", "probe"], "left")
    size, winner = F.coalesce("all_n", "n"), F.when(F.col("all_n").isNull(), F.col("best")).otherwise(F.col("all_best"))
    return found.select(F.col("id").alias(id_col), winner.alias("keep_id"), size.cast("long").alias("group_size"), ((F.col("place") == 1) & F.col("best").eqNullSafe(winner)).alias("kept"), F.col("digest").alias("text_sha256"))
