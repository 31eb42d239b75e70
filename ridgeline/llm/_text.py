"""Helpers that tasks share: slices of bounded size, words, hashes, storage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 6 << 20
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `limit` bytes of `column`, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // limit
        edges = np.r_[0, np.flatnonzero(np.diff(group)) + 1, batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(a, b - a)


def plain(array: pa.Array) -> pa.Array:
    """Strings without nulls, in an array that starts at its buffers' beginning."""
    array = pc.fill_null(array, "")
    return pa.concat_arrays([array]) if array.offset == 0 else pa.concat_arrays([array, array.slice(0, 0)])


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array without nulls, and its n + 1 offsets from 0."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, off - off[0]


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of all texts in a row, and n + 1 offsets by text. Only A-Z are lower-cased."""
    texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, off = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    keep = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not keep.all():
        flat = flat.filter(pa.array(keep))
        off = np.r_[0, np.cumsum(keep)][off]
    return flat, off


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (a fixed bijection)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _MIX1
        h = (h ^ (h >> np.uint64(27))) * _MIX2
        return h ^ (h >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd constant, mod 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 2 * len(_POWERS)) - 1, _BASE, np.uint64)])
    return _POWERS[:n]


def hash_strings(array: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string's bytes: a polynomial over mixed byte values."""
    body, off = raw(array)
    n = np.diff(off)
    out = np.zeros(len(n), np.uint64)
    if len(body):
        with np.errstate(over="ignore"):
            at = np.arange(len(body)) - np.repeat(off[:-1], n)
            terms = mix(np.arange(1, 257, dtype=np.uint64))[body] * powers(int(n.max()))[at]
            full = n > 0
            out[full] = np.add.reduceat(terms, off[:-1][full])
    return mix(out + n.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, in a row."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TERMS = mix(np.arange(1, 257, dtype=np.uint64))
_WORD_TERMS = np.where(_SPACE, np.uint64(0), _TERMS)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, where each word starts and how long it is, and n + 1 word offsets by text.

    Words are `[^\\x20\\x09-\\x0D]+`; they do not cross texts. lower: A-Z become a-z.
    """
    body, off = raw(pc.fill_null(texts, ""))
    if lower:
        body = _LOWER[body]
    inside = ~_SPACE[body]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = off[:-1][np.diff(off) > 0]
    begins[edge] = inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    starts = np.flatnonzero(begins)
    return body, starts, np.flatnonzero(ends) + 1 - starts, np.searchsorted(starts, off)


def hash_spans(body: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word (not of white space between words)."""
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(starts), 1 << 14):  # pieces that stay in the processor's cache
            s, n = starts[k : k + (1 << 14)], lengths[k : k + (1 << 14)]
            part, s = body[s[0] : s[-1] + n[-1]], s - s[0]
            at = np.arange(len(part), dtype=np.int32) - np.repeat(s.astype(np.int32), np.diff(np.r_[s, len(part)]))
            terms = _WORD_TERMS[part] * powers(1 << 16)[at & 0xFFFF]
            if n.max() > 1 << 16:
                terms *= mix((at >> 16).astype(np.uint64) + np.uint64(1)) | np.uint64(1)
            out[k : k + len(s)] = np.add.reduceat(terms, s) + n.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    return mix(out)


def cut_spans(body: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the given words only, in a row, and their n + 1 offsets."""
    return body[np.repeat(starts, lengths) + ranges(lengths)], np.r_[0, np.cumsum(lengths)]


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums between offsets, 0 for empty stretches."""
    return np.diff(np.r_[np.zeros(1, values.dtype), np.cumsum(values)][offsets])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which the driver and all executors reach.

    Where none is set, a session that runs in one process takes a temporary folder; on a cluster that is an error.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/ridgeline-shared"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


#: Folders of tables that kept() has written since the innermost passing() began.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def kept(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder, as Parquet, and go on from the table; the lineage before it is cut."""
    folder = shared_folder(df.sparkSession, "kept")
    df.write.parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    table.kept_in = folder
    if (folders := _PASSING.get()) is not None:
        folders.append(folder)
    return table


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that kept() writes within are removed at the end. What is yielded writes a result that stays."""
    folders: list[str] = []
    before = _PASSING.set(folders)

    def result(df: DataFrame) -> DataFrame:
        table = kept(df)
        folders.remove(table.kept_in)
        return table

    try:
        yield result
    finally:
        _PASSING.reset(before)
        for folder in folders:
            remove(spark, folder)


def let_go(*tables: DataFrame) -> None:
    """Remove tables of kept(), once all that was made of them has been written."""
    folders = _PASSING.get()
    for df in tables:
        remove(df.sparkSession, df.kept_in)
        if folders is not None and df.kept_in in folders:
            folders.remove(df.kept_in)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from all columns."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
