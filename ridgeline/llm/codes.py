"""Vectors compressed to codes of short codebooks: product quantisation by Lloyd's rounds with heaps.

A vector is cut into PARTS equal consecutive parts, each with a codebook of ENTRIES entries.
Vectors lie in blocks; a block keeps, for each entry, a heap of the parts assigned to it,
keyed by slack: the lower bound of the distance to any other entry less the upper bound of
the distance to its own. Entries move after a round; instead of new bounds for all parts each
entry has a cumulative drift (its own moves and the largest moves of others), which is added
to the key of what enters its heap. A round pops only parts whose key the drift has reached,
rescans them exactly and pushes them onto the heap of their entry; the others keep theirs.

A block's state is written as Parquet after every round. A block tells the sums of what moved
only; Spark adds them up, and entries, sums and drifts - as large as the codebooks - are all
that comes to the driver.

Components become floor(scale * x), held at +-2**50; all arithmetic on them is exact. Vectors that
are null or hold null or non-finite components take no part, nor do those of another length
than the one with the smallest id, or of a length that PARTS does not divide. Null ids come after
all others when the first entries are chosen, equal ids are ordered by their vectors; repeated
rows count as often as they come. An empty table gives no rows. Columns besides the id, the
vector and the label are not looked at; the label may be of any type that can be compared.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import kept, let_go

PARTS, ENTRIES, ROUNDS = 16, 64, 2
BLOCK_ROWS = 4096
LIMIT = float(1 << 50)
STATE = "numbers binary, codes binary, keys binary, items binary, sizes binary, moved binary"
SMALL_LABELS = 100_000  # label totals that are broadcast; beyond, Spark joins by shuffle


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: float, parts: int) -> DataFrame:
    """row (struct of id and label) and v (whole doubles) of vectors that take part."""
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    held = lambda y: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), y))
    numbers = F.transform(F.col(vector_col), lambda x: F.floor(held(F.lit(float(scale)) * x.cast("double"))).cast("double"))
    cut = (F.size(vector_col) > 0) & (F.size(vector_col) % parts == 0)
    rows = vectors.where(F.col(vector_col).isNotNull() & finite & cut)
    return rows.select(F.struct(F.col(id_col).alias("id"), F.col(label_col).alias("label")).alias("row"), numbers.alias("v"))


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of three widths, which the first byte tells."""
    top = np.abs(numbers).max(initial=0)
    kind = np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64
    return bytes([np.dtype(kind).itemsize]) + numbers.astype(kind).tobytes()


def unpacked(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.int64}[data[0]], offset=1).astype(np.int64).reshape(-1, dim)


def blocks(vectors: DataFrame) -> DataFrame:
    """rows (array of id and label) and state of up to BLOCK_ROWS vectors; nothing is assigned yet."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, BLOCK_ROWS):
                piece = b.slice(k, BLOCK_ROWS)
                v = pa.compute.list_flatten(piece.column("v")).to_numpy(zero_copy_only=False).astype(np.int64).reshape(piece.num_rows, -1)
                rows = pa.concat_arrays([piece.column("row")])
                one = pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), rows)
                yield pa.RecordBatch.from_arrays([one, pa.array([packed(v)], pa.binary()), *(pa.array([b""], pa.binary()) for _ in range(5))], names=["rows", *(c.split()[0] for c in STATE.split(", "))])

    kind = vectors.schema["row"].dataType.simpleString()
    return vectors.mapInArrow(pack, f"rows array<{kind}>, {STATE}")


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, exact: in 64 bits, or in Python's integers where these could overflow."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.int64 if x.shape[-1] * 4 * top * top < 2**63 else object
    apart = x[:, None, :].astype(kind) - entries[None].astype(kind)
    return (apart * apart).sum(-1)


def bounded(squared: np.ndarray, up: bool) -> np.ndarray:
    """Roots of squared distances, rounded to the safe side."""
    root = np.sqrt(squared.astype(np.float64))
    return root * (1 + 1e-12) if up else root * (1 - 1e-12)


def scanned(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (ties to the lower index) and its slack."""
    d = distances(x, entries)
    nearest = d.argmin(1)
    if len(entries) == 1:
        return nearest, np.full(len(x), np.inf)
    rest = np.where(np.arange(len(entries))[None] == nearest[:, None], d.max(1, keepdims=True), d).min(1)
    return nearest, bounded(rest, False) - bounded(d[np.arange(len(x)), nearest], True)


class Block:
    """The heaps of a block: for each part position and entry a list of (key, row), the least key first."""

    def __init__(self, numbers: bytes, codes: bytes, keys: bytes, items: bytes, sizes: bytes, book: np.ndarray):
        self.parts, self.entries, self.width = book.shape
        self.x = unpacked(numbers, self.parts * self.width)
        self.fresh = not codes
        self.codes = np.zeros((len(self.x), self.parts), np.uint8) if self.fresh else np.frombuffer(codes, np.uint8).reshape(-1, self.parts).copy()
        self.keys, self.items = np.frombuffer(keys, np.float64), np.frombuffer(items, np.int32)
        self.sizes = np.zeros((self.parts, self.entries), np.int64) if self.fresh else np.frombuffer(sizes, np.int32).astype(np.int64).reshape(self.parts, self.entries)
        self.first = np.r_[0, np.cumsum(self.sizes.ravel())][:-1].reshape(self.parts, self.entries)
        self.opened: dict[tuple[int, int], list[tuple[float, int]]] = {}

    def part(self, p: int) -> np.ndarray:
        return self.x[:, p * self.width : (p + 1) * self.width]

    def heap(self, p: int, e: int) -> list[tuple[float, int]]:
        if (p, e) not in self.opened:
            a, n = self.first[p, e], self.sizes[p, e]
            self.opened[p, e] = list(zip(self.keys[a : a + n].tolist(), self.items[a : a + n].tolist(), strict=True))
        return self.opened[p, e]

    def popped(self, p: int, drift: np.ndarray) -> np.ndarray:
        """Rows whose bounds the drift has violated; they leave their heaps."""
        if self.fresh:
            return np.arange(len(self.x))
        held = np.flatnonzero(self.sizes[p])
        out = []
        for e in held[self.keys[self.first[p, held]] <= drift[p, held]].tolist():
            heap = self.heap(p, e)
            while heap and heap[0][0] <= drift[p, e]:
                out.append(heapq.heappop(heap)[1])
        return np.array(out, np.int64)

    def round(self, book: np.ndarray, drift: np.ndarray) -> np.ndarray:
        """Reassign what the drift has reached; returns sums and counts of what entered and left each entry."""
        moved = np.zeros((self.parts, self.entries, self.width + 1), np.int64)
        for p in range(self.parts):
            rows = self.popped(p, drift)
            x, before = self.part(p)[rows], self.codes[rows, p].astype(np.int64)
            now, slack = scanned(x, book[p])
            key = slack + drift[p, now]
            if self.fresh:
                for e in np.unique(now).tolist():
                    at = np.flatnonzero(now == e)
                    heap = list(zip(key[at].tolist(), rows[at].tolist(), strict=True))
                    heapq.heapify(heap)
                    self.opened[p, e] = heap
            else:
                for k, row, e in zip(key.tolist(), rows.tolist(), now.tolist(), strict=True):
                    heapq.heappush(self.heap(p, e), (k, row))
            self.codes[rows, p] = now
            change = np.ones(len(rows), bool) if self.fresh else now != before
            counted = np.column_stack([x, np.ones(len(x), np.int64)])[change]
            np.add.at(moved[p], now[change], counted)
            if not self.fresh:
                np.subtract.at(moved[p], before[change], counted)
        return moved

    def state(self) -> tuple[bytes, bytes, bytes, bytes]:
        """codes, keys, items, sizes after a round: opened heaps anew, the others as they were."""
        keys, items, sizes = [], [], self.sizes.copy()
        for p in range(self.parts):
            for e in range(self.entries):
                heap = self.opened.get((p, e))
                a, n = self.first[p, e], self.sizes[p, e]
                keys.append(self.keys[a : a + n] if heap is None else np.array([h[0] for h in heap], np.float64))
                items.append(self.items[a : a + n] if heap is None else np.array([h[1] for h in heap], np.int32))
                sizes[p, e] = len(items[-1])
        return self.codes.tobytes(), np.concatenate(keys).tobytes(), np.concatenate(items).tobytes(), sizes.astype(np.int32).tobytes()

    def error(self, book: np.ndarray) -> np.ndarray:
        """The squared distance of each vector to its entries."""
        total = np.zeros(len(self.x), object)
        for p in range(self.parts):
            apart = self.part(p).astype(object if np.abs(self.x).max(initial=0) >= 2**28 else np.int64) - book[p][self.codes[:, p]]
            total = total + (apart * apart).sum(1)
        return total


def after_round(table: DataFrame, book: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The blocks after one round, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                numbers, codes, keys, items, sizes = (one.column(c)[0].as_py() for c in ("numbers", "codes", "keys", "items", "sizes"))
                block = Block(numbers, codes, keys, items, sizes, book)
                moved = block.round(book, drift)
                yield pa.RecordBatch.from_arrays([one.column("rows"), one.column("numbers"), *(pa.array([x], pa.binary()) for x in (*block.state(), moved.tobytes()))], names=b.schema.names)

    return kept(table.mapInArrow(run, table.schema))


def sums_moved(table: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """All blocks' changes of sums and counts: added within tasks, then by place; no more numbers than the codebooks have."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, object).ravel()
        for b in batches:
            for data in b.column("moved").to_pylist():
                total = total + np.frombuffer(data, np.int64)
        at = np.flatnonzero(total != 0)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([str(x) for x in total[at]])], names=["place", "n"])

    rows = table.select("moved").mapInArrow(add, "place int, n string").groupBy("place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    out = np.zeros(shape, object).ravel()
    for r in rows:
        out[r["place"]] = int(r["n"])
    return out.reshape(shape)


def moves(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    """What a round adds to the drifts: how far each entry moved, and the farthest of the others."""
    apart = (now.astype(object) - before.astype(object)) ** 2
    own = bounded(apart.sum(-1), True)
    if own.shape[1] < 2:
        return own
    order = np.sort(own, axis=1)
    return own + np.where(own == order[:, -1:], order[:, -2:-1], order[:, -1:])


def with_label_error(found: DataFrame) -> DataFrame:
    """label_error: the sum of `error` over rows of a label (nulls together); as `error` itself it stops at the limit of 64 bits."""
    summed = F.sum(F.col("error").cast("decimal(38,0)"))
    totals = found.groupBy("label").agg(F.least(summed, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("label_error"))
    totals = totals.select(F.col("label").alias("_label"), "label_error")
    small = totals.limit(SMALL_LABELS + 1).count() <= SMALL_LABELS
    return found.join(F.broadcast(totals) if small else totals, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """id_col, label, code (two hex digits a part), error, label_error, codebooks_sha256 of every vector that takes part."""
    whole = whole_vectors(vectors, id_col, vector_col, label_col, scale, parts)
    order = [F.col("row.id").asc_nulls_last(), "v"]
    lead = whole.orderBy(*order).limit(1).collect()
    shape = f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, label {vectors.schema[label_col].dataType.simpleString()}, code string, error long"
    if not lead:
        none = vectors.sparkSession.createDataFrame([], shape)
        return none.withColumn("label_error", F.lit(None).cast("long")).withColumn("codebooks_sha256", F.lit(None).cast("string"))
    dim = len(lead[0]["v"])
    whole = whole.where(F.size("v") == dim)
    first = np.array([r["v"] for r in whole.orderBy(*order).limit(entries).collect()], np.float64).astype(np.int64)
    book = first.reshape(len(first), parts, dim // parts).transpose(1, 0, 2).copy()

    drift = np.zeros(book.shape[:2])
    total = np.zeros((*book.shape[:2], book.shape[2] + 1), object)
    table = kept(blocks(whole))
    for _ in range(rounds):
        after = after_round(table, book, drift)
        let_go(table)
        table = after
        total = total + sums_moved(table, total.shape)
        used = total[..., -1:] > 0
        now = np.where(used, total[..., :-1] // np.where(used, total[..., -1:], 1), book).astype(np.int64)
        drift = (drift + moves(book, now)) * (1 + 1e-12)
        book = now
    text = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                block = Block(*(one.column(c)[0].as_py() for c in ("numbers", "codes", "keys", "items", "sizes")), book)
                block.round(book, drift)
                rows = pa.compute.list_flatten(one.column("rows"))
                error = pa.array([min(int(e), 2**63 - 1) for e in block.error(book)], pa.int64())
                yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array([c.tobytes().hex() for c in block.codes]), error], names=[id_col, "label", "code", "error"])

    found = kept(table.mapInArrow(last, shape))
    let_go(table)
    return with_label_error(found).withColumn("codebooks_sha256", F.lit(text))
