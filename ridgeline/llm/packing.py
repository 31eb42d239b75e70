"""Best-fit-decreasing packing of tokenised documents into windows of a fixed number of tokens.

A task tokenises whole texts (each distinct word of a slice once), cuts overlong
documents into full windows and keeps one short piece per document at most. The
pieces - small rows - are dealt evenly to bins of bounded size, and each bin is
packed by itself: longest piece first, into the tightest open window, which a
segment tree indexed by remaining capacity finds.

Null and empty texts are documents of one token (the end id). Repeated rows are
packed as often as they stand. An empty table gives an empty result. Columns
other than the two named ones are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import WordTokens
from ._text import kept, ranges, slices

WINDOW, END_ID, BIN_ROWS = 4096, 2, 8192
BIN_ROWS_WITH_IDS = 2048  # the ids of a bin are held at a time
SLICE_BYTES = 2 << 20  # of text that is tokenised at a time; bounds a task's memory


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (, ids): every document's ids, cut into full windows and a rest.

    ids: little-endian 32-bit numbers, compressed by zstd (they are written and shuffled).
    tokenizer: the definition (JSON text) of a word-splitting tokenizer; a few MB, shipped with the task.
    """
    fields = f"{id_col} long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, codec = WordTokens(tokenizer), pa.Codec("zstd", compression_level=1)
        for b in slices(batches, text_col, SLICE_BYTES):
            ids, off = words.ids(b.column(text_col), end_id)
            n = np.diff(off)
            count = -(-n // window)
            start = ranges(count) * window
            length = np.minimum(window, np.repeat(n, count) - start)
            first = np.repeat(off[:-1], count) + start
            view = memoryview(ids.tobytes())
            parts = [view[4 * a : 4 * (a + k)] for a, k in zip(first.tolist(), length.tolist(), strict=True)]
            crc = np.fromiter(map(zlib.crc32, parts), np.int64, len(parts))
            doc = b.column(id_col).cast(pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), count)))
            out = [doc, *map(pa.array, (start, length, crc, np.repeat(n, count)))]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                out, names = [*out, pa.array([codec.compress(p, asbytes=True) for p in parts], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(id_col, text_col).mapInArrow(cut, fields)


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; pieces are placed longest first, each in the tightest open window.

    The tree's leaf c says whether a window with c free tokens is open; an inner node, whether any below it is.
    """
    leaves = 1 << window.bit_length()
    tree = bytearray(2 * leaves)
    open_at: list[list[int]] = [[] for _ in range(window + 1)]

    def mark(c: int, on: int) -> None:
        i = leaves + c
        tree[i] = on
        while i > 1:
            i >>= 1
            now = tree[2 * i] | tree[2 * i + 1]
            if tree[i] == now:
                break
            tree[i] = now

    def tightest(c: int) -> int:
        """The smallest open capacity of at least c, or -1."""
        i = leaves + c
        if tree[i]:
            return c
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < leaves:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - leaves
            i >>= 1
        return -1

    window_of, offset_of = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        free = tightest(n)
        if free < 0:
            at, free, opened = opened, window, opened + 1
        else:
            at = open_at[free].pop()
            if not open_at[free]:
                mark(free, 0)
        window_of[k], offset_of[k] = at, window - free
        rest = free - n
        if rest:
            open_at[rest].append(at)
            if len(open_at[rest]) == 1:
                mark(rest, 1)
    return window_of, offset_of


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, bin_rows: int | None = None) -> DataFrame:
    """The pieces of `docs` with sequence_id and offset (and ids, 32-bit little-endian). Sequences hold `window` tokens at most, without gaps.

    bin_rows: pieces that one task packs at a time; bounds its memory and leaves a part of a window unfilled per bin.
    """
    cut = kept(pieces(docs, tokenizer, window, end_id, id_col, text_col, with_ids))
    bins = max(1, math.ceil(cut.count() / (bin_rows or (BIN_ROWS_WITH_IDS if with_ids else BIN_ROWS))))
    # rows are dealt by their place in the written table, so that repeated rows spread as others do
    dealt = cut.withColumn("_bin", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(bins)))
    fields = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes) + ", sequence_id long, offset long"

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([id_col, "start", "ids_crc32"], kind="stable")
        at, offset = best_fit(rows["length"].to_numpy(), window)
        if with_ids:
            codec = pa.Codec("zstd")
            rows["ids"] = [codec.decompress(i, decompressed_size=4 * n, asbytes=True) for i, n in zip(rows["ids"], rows["length"].tolist(), strict=True)]
        return rows.drop(columns="_bin").assign(sequence_id=at * bins + int(rows["_bin"].iat[0]), offset=offset)

    return dealt.groupBy("_bin").applyInPandas(fill, fields)
