"""SimHash fingerprints of whole documents, and a search within a Hamming radius.

Terms are pairs of neighbouring words (the word itself where a text has one word),
weighted by their letters; each term's hash votes with its weight on 128 signed bits.
The search cuts fingerprints into blocks; two fingerprints within the radius agree on
enough whole blocks, so permuted tables keyed by combinations of blocks find them all.

Null texts count as empty; texts without words have the fingerprint of 32 zeros.
Rows with equal ids are put in order by text; null ids come first, in order of a hash of
their texts. Repeated rows give as many rows. Bytes that are no UTF-8 are read as
replacement characters. An empty table gives no rows; columns other than the id and the text are
not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import hash_spans, kept, mix, slices, word_spans

BITS = 128
ROWS_BY_RANGE = 4096
RADIUS, BLOCKS = 3, 5
HEAVY = 1024  # fingerprints under one block key before it is cut


def fingerprints(texts: pa.Array) -> np.ndarray:
    """A row of BITS / 8 bytes for each text."""
    body, starts, lengths, of_doc = word_spans(texts)
    n = np.diff(of_doc)
    doc = np.repeat(np.arange(len(n)), n)
    key = hash_spans(body, starts, lengths)
    with np.errstate(over="ignore"):
        follows = (doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, bool)
        alone = np.flatnonzero((n == 1)[doc]) if len(doc) else np.zeros(0, np.int64)
        left = np.flatnonzero(follows)
        term = np.r_[mix(key[left] * np.uint64(0x9E3779B97F4A7C15) + key[left + 1]), key[alone]]
        at = np.r_[left, alone]
        weight = np.r_[np.minimum(lengths[left] + lengths[left + 1], 24), np.minimum(lengths[alone], 24)].astype(np.float32)
        order = np.argsort(at, kind="stable") if len(alone) else slice(None)
        term, weight, owner = term[order], weight[order], doc[at][order]
        votes = np.zeros((len(n), BITS), np.float32)
        for k in range(0, len(term), 1 << 13):
            t, w, d = term[k : k + (1 << 13)], weight[k : k + (1 << 13)], owner[k : k + (1 << 13)]
            bits = np.unpackbits(np.column_stack([t, mix(t ^ np.uint64(0x5851F42D4C957F2D))]).view(np.uint8), axis=1)
            cuts = np.r_[0, np.flatnonzero(np.diff(d)) + 1]
            ends = np.r_[cuts[1:], len(d)]
            signed = bits.astype(np.float32)
            for a, b in zip(cuts.tolist(), ends.tolist(), strict=True):
                votes[d[a]] += w[a:b] @ signed[a:b] * 2 - w[a:b].sum()
    return np.packbits(votes > 0, axis=1)


def readable(texts: pa.Array) -> pa.Array:
    """Texts without nulls, as UTF-8."""
    texts = pc.fill_null(texts, "")
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        return pa.array([b.decode("utf-8", "replace") for b in texts.cast(pa.binary()).to_pylist()], pa.string())
    return texts


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 minus the share of differing bits."""
    return 1 - np.bitwise_count(a ^ b).sum(1) / BITS


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (its last quarter replaced by the beginning of the next document).

    Ranges of ids, from a pass over the ids alone, are the unit of work: each range holds its rows in order and a copy
    of the row that follows its last. The texts are shuffled once. Rows with null ids have ranges of their own, by a
    hash of their texts, from a pass over these rows. The number of ranges follows the rows.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    number = lambda rows: max(1, math.ceil(rows / ROWS_BY_RANGE))
    ids, nulls = keyed.select("id").where(F.col("id").isNotNull()), keyed.where(F.col("id").isNull()).select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("id"))
    begins_at = lambda of, n: sorted(r[0] for r in of.repartitionByRange(n, "id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("least")).select("least").collect())
    n_nulls = nulls.count()
    first = np.array(begins_at(nulls, number(n_nulls)) if n_nulls else [], np.int64)
    then = np.array(begins_at(ids, number(ids.count())), np.int64)
    ranges = max(1, len(first) + len(then))
    last = ranges - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            doc, key = b.column("id"), b.column("key").to_numpy()
            null = np.array(doc.is_null())
            home = np.where(null, np.searchsorted(first, key, side="right") - 1, len(first) + np.searchsorted(then, key, side="right") - 1)
            # the rows that begin a range are also wanted at the end of the range before it, or of the last one
            begins = np.flatnonzero(key == np.r_[first, then][home])
            take = pa.array(np.r_[np.arange(len(doc)), begins])
            text = readable(b.column("text"))
            print_ = pa.array([p.tobytes() for p in fingerprints(text)], pa.binary())
            place = np.r_[home, np.where(home[begins] > 0, home[begins] - 1, last)]
            tail = np.r_[np.zeros(len(doc), bool), np.ones(len(begins), bool)]
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(tail), b.column("key").take(take), doc.take(take), text.take(take), print_.take(take)], names=["place", "tail", "key", "id", "text", "print"])

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in itertools.chain(slices(batches, "text"), [None]):
            rows_now = held + (list(zip(*(b.column(c).to_pylist() for c in ("place", "tail", "id", "text", "print")), strict=True)) if b is not None else [])
            out = []
            for now, after in itertools.pairwise(rows_now):
                if not now[1] and now[0] == after[0]:
                    out.append((now, after))
            held = rows_now[-1:]
            if not out:
                continue
            n = [len(a[3]) for a, _ in out]
            edited = [a[3][: k - k // 4] + c[3][: k // 4] for (a, c), k in zip(out, n, strict=True)]
            as_bytes = lambda rows: np.frombuffer(b"".join(rows), np.uint8).reshape(len(out), -1)
            own, following = as_bytes([a[4] for a, _ in out]), as_bytes([c[4] for _, c in out])
            changed = fingerprints(pa.array(edited, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[2] for a, _ in out], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                    pa.array([a[4].hex() for a, _ in out]),
                    pa.array([c.tobytes().hex() for c in changed]),
                    pa.array(likeness(own, changed)),
                    pa.array(likeness(own, following)),
                ],
                names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    placed = keyed.withColumn("key", F.coalesce("id", F.xxhash64(F.coalesce("text", F.lit(""))))).mapInArrow(deal, "place int, tail boolean, key long, id long, text string, print binary")
    in_order = placed.repartition(ranges, "place").sortWithinPartitions("place", "tail", "key", "text")
    return in_order.mapInArrow(edit, f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def block_keys(fingerprint: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """Keys of the permuted tables: one for each combination of blocks - radius whole blocks of the hex digits."""
    digits = BITS // 4
    cuts = [k * digits // blocks for k in range(blocks + 1)]
    parts = [F.substring(fingerprint, a + 1, b - a) for a, b in itertools.pairwise(cuts)]
    return F.array(*(F.concat(F.lit(f"{k}:"), *(parts[i] for i in chosen)) for k, chosen in enumerate(itertools.combinations(range(blocks), blocks - radius))))


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints in hex."""
    half = lambda c, k: F.conv(F.substring(c, 1 + 8 * k, 8), 16, 10).cast("long")
    return sum((F.bit_count(half(a, k).bitwiseXOR(half(b, k))) for k in range(BITS // 32)), F.lit(0))


def finer_keys(key: Column, fingerprint: Column, radius: int = RADIUS) -> Column:
    """Keys below a crowded one: the fingerprint in radius + 1 pieces. Two within the radius agree on one of them."""
    digits, n = BITS // 4, radius + 1
    cuts = [k * digits // n for k in range(n + 1)]
    return F.array(*(F.concat(key, F.lit(f"/{k}:"), F.substring(fingerprint, a + 1, b - a)) for k, (a, b) in enumerate(itertools.pairwise(cuts))))


def within(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, heavy: int = HEAVY) -> DataFrame:
    """query (distinct), n: how many rows of `prints` lie within the radius. Both inputs have one column `fingerprint`.

    Equal fingerprints are counted before the tables are built, so a large group of copies is one entry. A block key with more
    than `heavy` entries is cut by finer keys, which lose no pair.
    """
    keys = lambda c: F.explode(block_keys(F.col(c), radius, blocks)).alias("key")
    counted = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"))
    table = counted.select("fingerprint", "copies", keys("fingerprint"))
    crowded = table.groupBy("key").agg(F.count(F.lit(1)).alias("entries")).where(F.col("entries") > heavy).select(F.col("key").alias("crowded"))
    finer = lambda df, c: df.join(crowded, F.col("key") == F.col("crowded"), "left").withColumn("key", F.explode(F.when(F.col("crowded").isNull(), F.array("key")).otherwise(finer_keys(F.col("key"), F.col(c), radius)))).drop("crowded")
    asked = queries.distinct().select(F.col("fingerprint").alias("query"), keys("fingerprint"))
    near = finer(asked, "query").join(finer(table, "fingerprint"), "key").where(distance(F.col("query"), F.col("fingerprint")) <= radius)
    return near.groupBy("query", "fingerprint").agg(F.first("copies").alias("copies")).groupBy("query").agg(F.sum("copies").alias("n"))


def report(docs: DataFrame, asked: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """with_edits(), and for the rows that `asked` names how many other documents lie within the radius (else null)."""
    found = kept(with_edits(docs, id_col, text_col))
    mine = found.where(asked)
    near = within(mine.select("fingerprint"), found.select("fingerprint"))
    counted = mine.join(near, mine["fingerprint"] == near["query"], "left").select(*(mine[c] for c in found.columns), (F.col("n") - 1).alias("n_within"))
    return counted.unionByName(found.where(~F.coalesce(asked, F.lit(False))).withColumn("n_within", F.lit(None).cast("long")))
