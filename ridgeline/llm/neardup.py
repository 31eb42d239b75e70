"""Near-duplicate groups: bottom-k sketches of word shingles, inverted lists, and exact Jaccard similarity.

1. Every text becomes its set of distinct shingles (64-bit hashes). Equal sets are one
   node; a group of exact copies costs one grouping and nothing more.
2. One hash function orders shingles; a node keeps its least SKETCH of them. The least
   KEYS of those are the keys of inverted lists, rare ones first: two sets over the
   threshold share so many keys that their rare-first prefixes meet, so frequent
   passages make few lists.
3. In each list nodes are first compared with hubs of the list, not with each other.
   The similarity is estimated from the sketch of the union; pairs that can reach the
   threshold are verified on their full sets. Verified links give components.
4. Lists that still hold several components are finished exactly: nodes outside the
   list's largest component meet all others, block by block, overlaps counted by inverted lists of their sketches. Pairs of different
   components whose estimate can reach the threshold are verified within their block, on
   full sets; a block hands on a forest of links, so nothing grows with its pairs.

Texts without words have no set, no links, and are kept. With fewer words than a
shingle, the whole sequence is the only shingle. Rows with equal ids are rows of their
own. Null ids: the component's id is the least id that is not null; where all are
null it is null, and all its rows are kept.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._text import hash_spans, kept, let_go, mix, passing, ranges, raw, slices, word_spans

WORDS, PERCENT = 5, 75
SKETCH, KEYS = 64, 32
SHARED_KEYS = 0.375  # of KEYS that two sets over the threshold share: 12 of 32, five deviations below the mean
LEAST_ESTIMATE = 0.50  # of SKETCH values: more than four deviations below the threshold
HUBS = 3
SIDE = 1024  # nodes of a block
MATRIX = 4096  # pairs of a cell from which on inverted lists count its overlaps
BITMAP = 1 << 24
CELL_HASHES = 4 << 20  # of full sets that one group of a cell's pairs is verified on


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingle hashes in ascending order."""
    body, starts, lengths, offsets = word_spans(texts)
    key = hash_spans(body, starts, lengths)
    with np.errstate(over="ignore"):
        factors = mix(np.arange(101, 101 + words, dtype=np.uint64)) | np.uint64(1)
        full = max(0, len(key) - words + 1)
        total = sum((key[j : j + full] * factors[j] for j in range(words)), np.zeros(full, np.uint64))
        total = mix(total + np.uint64(words))
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(total[a : b - words + 1]))
            elif b > a:
                out.append(mix(np.array([(key[a:b] * factors[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)


def signature(hashes: np.ndarray, seed: int) -> int:
    """64 bits of a whole set."""
    with np.errstate(over="ignore"):
        return int(mix(hashes ^ np.uint64(seed)).sum(dtype=np.uint64).view(np.int64))


def described(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """id, h (the text's hash), n, a, b (128 bits of the whole set) and sketch (its least SKETCH hashes) of each row."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), words)
            n = np.array([len(s) for s in sets], np.int64)
            signs = [np.array([signature(s, seed) for s in sets], np.int64) for seed in SEEDS]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(n), *map(pa.array, signs), pa.array([s[:SKETCH].tobytes() for s in sets], pa.binary())], names=["id", "h", "n", "a", "b", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return rows.mapInArrow(describe, "id long, h long, n long, a long, b long, sketch binary")


def lists(nodes: DataFrame, shared_keys: float = SHARED_KEYS) -> DataFrame:
    """v, node: each node's keys that its rare-first prefix holds and that some other node has too."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(s, np.int64)[:KEYS] for s in batch.column("sketch").to_pylist()]
            m = np.array([len(h) for h in held], np.int64)
            if len(m):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), pa.array(np.repeat(batch.column("node").to_numpy(), m)), pa.array(np.repeat(m, m).astype(np.int32))], names=["v", "node", "m"])

    rows = nodes.select("node", "sketch").mapInArrow(keys, "v long, node long, m int")
    common = rows.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    by_node = rows.join(common, "v").groupBy("node").agg(F.first("m").alias("m"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("keys"))
    wanted = F.col("m") - F.greatest(F.lit(1), F.floor(F.col("m") * shared_keys)) + 1  # the prefix; keys of this node alone come first in it
    length = F.greatest(F.lit(0), wanted - (F.col("m") - F.size("keys"))).cast("int")
    return by_node.select("node", F.explode(F.slice("keys", F.lit(1), length)).alias("key")).select(F.col("key.v").alias("v"), "node")


#: What sketches of the two sides of a pair are filled up with; no hash of a sketch is as large.
PADS = (np.uint64(2**64 - 1), np.uint64(2**64 - 2))
PAIRS = 1 << 13  # that are compared at a time


def padded(sketches: pa.Array, pad: np.uint64 | np.ndarray) -> np.ndarray:
    """A row of SKETCH values for each sketch, filled up with `pad` (one value, or one a row)."""
    values, off = raw(sketches)
    size = np.diff(off) // 8
    out = np.repeat(np.broadcast_to(np.asarray(pad, np.uint64), len(size))[:, None], SKETCH, axis=1)
    out[np.repeat(np.arange(len(size)), size), ranges(size)] = np.frombuffer(values.tobytes(), np.uint64)
    return out


def estimates(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Similarity of pairs of sets from their padded sketches: the share of the union's least values (`most` of them) that both hold."""
    both = np.concatenate([x, y], axis=1)
    both.sort(axis=1)
    double = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] < PADS[1])
    rank = np.cumsum(np.concatenate([np.ones((len(both), 1), bool), ~double], axis=1), axis=1, dtype=np.int16)
    size = np.minimum(most, (both < PADS[1]).sum(1) - double.sum(1))
    return (double & (rank[:, 1:] <= size[:, None])).sum(1) / np.maximum(size, 1)


def estimated(pairs: DataFrame, nodes: DataFrame, least_estimate: float = LEAST_ESTIMATE) -> DataFrame:
    """x, y, sure: pairs that can reach the threshold. sure: decided already, as both sketches are whole sets."""
    x = nodes.select(F.col("node").alias("x"), F.col("sketch").alias("sx"), F.col("n").alias("nx"))
    y = nodes.select(F.col("node").alias("y"), F.col("sketch").alias("sy"), F.col("n").alias("ny"))
    near = F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * PERCENT

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = np.maximum(batch.column("nx").to_numpy(), batch.column("ny").to_numpy()) <= SKETCH
            x, y = padded(batch.column("sx"), PADS[0]), padded(batch.column("sy"), PADS[1])
            e = np.concatenate([estimates(x[k : k + PAIRS], y[k : k + PAIRS], np.where(whole[k : k + PAIRS], 2 * SKETCH, SKETCH)) for k in range(0, max(1, len(x)), PAIRS)])
            ok = np.where(whole, e * 100 >= PERCENT - 1e-9, e >= least_estimate)
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(whole)], names=["x", "y", "sure"]).filter(pa.array(ok))

    return pairs.join(x, "x").join(y, "y").where(near).select("x", "y", "sx", "sy", "nx", "ny").mapInArrow(estimate, "x long, y long, sure boolean")


def id_bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (BITMAP bits) that marks the hashes of all ids; it spares the shuffle of most other texts."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITMAP, bool)
        for batch in batches:
            bits[(mix(batch.column("id").fill_null(0).to_numpy().astype(np.uint64)) % np.uint64(BITMAP)).astype(np.int64)] = True
        pieces = np.packbits(bits).reshape(64, -1)
        some = np.flatnonzero(pieces.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([pieces[k].tobytes() for k in some], pa.binary())], names=["piece", "bits"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in rows["bits"]])
        return pd.DataFrame({"piece": rows["piece"].head(1), "bits": [total.tobytes()]})

    found = ids.mapInArrow(mark, "piece int, bits binary").groupBy("piece").applyInPandas(add, "piece int, bits binary").collect()
    out = np.zeros((64, BITMAP // 512), np.uint8)
    for r in found:
        out[r["piece"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.reshape(-1)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """x, y of the pairs whose full sets reach the threshold. Texts are read again, for the nodes in question only."""
    sure = pairs.where("sure").select("x", "y")
    ask = pairs.where(~F.col("sure")).select("x", "y")
    who = nodes.select("node", "id", "a")
    named = kept(ask.join(who.select(F.col("node").alias("x"), F.col("id").alias("ix"), F.col("a").alias("ax")), "x").join(who.select(F.col("node").alias("y"), F.col("id").alias("iy"), F.col("a").alias("ay")), "y"))
    shipped = docs.sparkSession.sparkContext.broadcast(id_bitmap(named.select(F.col("ix").alias("id")).unionByName(named.select(F.col("iy").alias("id")))))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shipped.value
        for batch in batches:
            at = (mix(batch.column("id").fill_null(0).to_numpy().astype(np.uint64)) % np.uint64(BITMAP)).astype(np.int64)
            yield batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(wanted, "id long, text string")
    tx = texts.select(F.col("id").alias("tid"), F.col("text").alias("tx"))
    first = named.join(tx, named["ix"].eqNullSafe(tx["tid"])).drop("tid")
    ty = texts.select(F.col("id").alias("tid"), F.col("text").alias("ty"))
    both = first.join(ty, first["iy"].eqNullSafe(ty["tid"])).select("x", "y", "ax", "ay", "tx", "ty")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "tx", 3 << 20), "ty", 3 << 20):
            ok = np.zeros(batch.num_rows, bool)
            sx, sy = shingle_sets(batch.column("tx"), words), shingle_sets(batch.column("ty"), words)
            for k, (p, q, ap, aq) in enumerate(zip(sx, sy, batch.column("ax").to_pylist(), batch.column("ay").to_pylist(), strict=True)):
                if min(len(p), len(q)) * 100 < PERCENT * max(len(p), len(q)):
                    continue
                if any(signature(s, SEEDS[0]) != sign for s, sign in ((p, ap), (q, aq))):  # rows with equal ids may bring other texts
                    continue
                both_ = np.concatenate([p, q])
                both_.sort()
                inter = int((both_[1:] == both_[:-1]).sum())
                ok[k] = 100 * inter >= PERCENT * (len(both_) - inter)
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(ok))

    return sure.unionByName(both.mapInArrow(verify, "x long, y long")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of x, y: large-star and small-star steps until nothing changes. root is the least node."""

    def same(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = kept(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u > v").distinct())
    state = same(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = kept(small.distinct())
        let_go(edges)
        edges, now = new, same(new)
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now


def hub_pairs(keyed: DataFrame) -> DataFrame:
    """x, y: each node with the hubs that share most of its lists; a list's hubs are its least node and the least by hash."""
    mixed = F.xxhash64(F.lit("hub"), "node")
    # written, so that the join that follows can split a list with many nodes
    of_list = kept(keyed.groupBy("v").agg(F.min("node").alias("h1"), F.min(F.struct(mixed.alias("h"), "node"))["node"].alias("h2"), F.count(F.lit(1)).alias("size")).where(F.col("size") > 1))
    met = keyed.join(of_list, "v").select("node", F.explode(F.array_distinct(F.array("h1", "h2"))).alias("hub")).where(F.col("node") != F.col("hub"))
    counted = met.groupBy("node", "hub").agg(F.count(F.lit(1)).alias("lists"))
    first = counted.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy(F.col("lists").desc(), "hub"))).where(F.col("k") <= HUBS)
    return first.select(F.least("node", "hub").alias("x"), F.greatest("node", "hub").alias("y")).distinct()


def band(n: Column) -> Column:
    """Sets whose sizes allow the threshold lie in one band or in neighbouring ones."""
    return F.floor(F.ln(n) / F.lit(math.log(100 / PERCENT))).cast("int")


def open_cells(keyed: DataFrame, roots: DataFrame, nodes: DataFrame, least_estimate: float = LEAST_ESTIMATE) -> DataFrame:
    """v, s, i, j, part, x, y, sure, near: cells of lists that hold several components, and what in them has to be verified.

    In each list nodes outside its largest component (left) meet all nodes (right) in cells of about SIDE x SIDE nodes; a
    task compares the pairs of many cells at once. A list with more nodes is cut by bands of sizes first (s): right nodes are in
    their own band, left ones in their own and the two beside it. A pair counts in the list of its least common key alone. x, y:
    pairs whose components differ and whose estimate reaches the threshold (sure: decided already), as bytes of 64-bit
    numbers; near: their nodes. A cell whose nodes' full sets are large has several rows (part).
    """
    side = SIDE
    placed = keyed.join(roots, "node", "left").select("v", "node", F.coalesce("root", "node").alias("root"))
    parts = placed.groupBy("v", "root").agg(F.count(F.lit(1)).alias("c"))
    of_list = parts.groupBy("v").agg(F.count(F.lit(1)).alias("roots"), F.sum("c").alias("size"), F.max(F.struct("c", "root")).alias("top")).where(F.col("roots") > 1)
    # written, so that the join that follows can split a list with many nodes
    shape = kept(of_list.select("v", F.col("top.root").alias("top"), (F.col("size") > side).alias("cut"), (F.col("size") - F.col("top.c")).alias("outside"), "size"))
    rows = placed.join(shape, "v").withColumn("out", F.col("root") != F.col("top"))
    # how many nodes of each band a cut list has: a row for each list and band
    own = band(F.col("n"))
    sized = rows.where("cut").join(nodes.select("node", "n"), "node").groupBy("v", own.alias("b")).agg(F.count(F.lit(1)).alias("rights"), F.count_if("out").alias("outs"))
    beside = Window.partitionBy("v").orderBy("b").rangeBetween(-1, 1)
    bands = kept(sized.withColumn("lefts", F.sum("outs").over(beside)).groupBy("v").agg(F.map_from_entries(F.collect_list(F.struct("b", F.struct(F.ceil(F.col("lefts") / side).cast("int").alias("lefts"), F.ceil(F.col("rights") / side).cast("int").alias("rights"))))).alias("bands")))
    whole = F.struct(F.ceil(F.col("outside") / side).cast("int").alias("lefts"), F.ceil(F.col("size") / side).cast("int").alias("rights"))
    rows = rows.join(bands, "v", "left").join(with_marks(nodes, keyed), "node")
    spread = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    columns = ("v", "s", "i", "j", "side", "node", "root", "n", "out", "sketch", "marks")
    cell = lambda s, i, j, which: F.struct(s.alias("s"), i.alias("i"), j.alias("j"), F.lit(which).alias("side"))

    # a right node goes to every block of left ones, a left node to every block of right ones
    def right(s: Column, size: Column) -> Column:
        return F.when(size["lefts"] > 0, F.transform(F.sequence(F.lit(0), size["lefts"] - 1), lambda i: cell(s, i, spread(size["rights"]), 1)))

    def left(s: Column, size: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), size["rights"] - 1), lambda j: cell(s, spread(size["lefts"]), j, 0))

    none, no_band = F.array().cast("array<struct<s:int,i:int,j:int,side:int>>"), F.lit(-1)
    of_band = lambda k: F.try_element_at("bands", own + k)
    in_bands = F.concat(*(F.coalesce(left(own + k, of_band(k)), none) for k in (-1, 0, 1)))
    meets = F.when(F.col("cut"), F.concat(F.coalesce(right(own, of_band(0)), none), F.when(F.col("out"), in_bands).otherwise(none))).otherwise(F.concat(F.coalesce(right(no_band, whole), none), F.when(F.col("out"), left(no_band, whole)).otherwise(none)))
    cells = rows.withColumn("at", F.explode(meets)).select("*", "at.s", "at.i", "at.j", "at.side").select(*columns).repartition("v", "s", "i", "j").sortWithinPartitions("v", "s", "i", "j", "side")
    return cells.mapInArrow(lambda batches: met_in_cells(batches, least_estimate), "v long, s int, i int, j int, part int, x binary, y binary, sure binary, near array<long>")


def with_marks(nodes: DataFrame, keyed: DataFrame) -> DataFrame:
    """node, n, sketch and marks: bit k tells that the node is in the list of its k-th key."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(s, np.int64)[:KEYS] for s in batch.column("sketch").to_pylist()]
            marks = [int((np.isin(h, k).astype(np.int64) << np.arange(len(h))).sum()) for h, k in zip(held, batch.column("keys").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "n", "sketch")), pa.array(marks, pa.int64())], names=["node", "n", "sketch", "marks"])

    of_node = keyed.groupBy("node").agg(F.collect_list("v").alias("keys"))
    return nodes.select("node", "n", "sketch").join(of_node, "node").mapInArrow(mark, "node long, n long, sketch binary, marks long")


def met_in_cells(batches: Iterator[pa.RecordBatch], least_estimate: float = LEAST_ESTIMATE) -> Iterator[pa.RecordBatch]:
    """The candidates of each cell (v, s, i, j): its left nodes (side 0) against its right ones. Rows come in order of cell and side."""
    waiting: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            waiting.append(batch)
            if sum(w.num_rows for w in waiting) < 4096:
                continue
        if not waiting:
            continue
        rows = pa.Table.from_batches(waiting)
        keys = [rows.column(c).to_numpy() for c in ("v", "s", "i", "j")]
        starts = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        waiting = []
        if batch is not None:  # the last cell may go on
            waiting = rows.slice(int(starts[-1])).to_batches()
            rows, starts = rows.slice(0, int(starts[-1])), starts[:-1]
        if len(starts):
            yield from met_in_rows(rows, starts, least_estimate)


def overlaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many values each row of x shares with each row of y (padded sketches): values are looked up in inverted lists."""
    out = np.zeros((len(x), len(y)), np.float32)
    common = np.intersect1d(x, y)
    if not len(common):
        return out
    xs, ys = np.searchsorted(common, x), np.searchsorted(common, y)
    xs[common[np.minimum(xs, len(common) - 1)] != x] = -1
    ys[common[np.minimum(ys, len(common) - 1)] != y] = -1
    (xr, xc), (yr, yc) = np.nonzero(xs >= 0), np.nonzero(ys >= 0)
    xv, yv = xs[xr, xc], ys[yr, yc]
    nx, ny = np.bincount(xv, minlength=len(common)), np.bincount(yv, minlength=len(common))
    often = np.flatnonzero(nx * ny > 64)
    for k in range(0, len(often), 4096):  # long lists: a product of incidence matrices
        place = np.full(len(common), -1)
        place[often[k : k + 4096]] = np.arange(len(often[k : k + 4096]))
        a, b = (np.zeros((n, min(4096, len(often) - k)), np.float32) for n in (len(x), len(y)))
        for m, row, value in ((a, xr, xv), (b, yr, yv)):
            some = place[value] >= 0
            m[row[some], place[value][some]] = 1
        out += a @ b.T
    rare = (nx * ny <= 64)[xv]  # short lists: their pairs one by one
    order = np.argsort(yv, kind="stable")
    first = np.cumsum(ny) - ny
    times = ny[xv[rare]]
    right = yr[order][np.repeat(first[xv[rare]], times) + ranges(times)]
    out += np.bincount(np.repeat(xr[rare], times) * len(y) + right, minlength=out.size).reshape(out.shape)
    return out


def met_in_rows(rows: pa.Table, starts: np.ndarray, least_estimate: float = LEAST_ESTIMATE) -> Iterator[pa.RecordBatch]:
    v, s, i, j, side, node, root, n, out, marks = (rows.column(c).to_numpy() for c in ("v", "s", "i", "j", "side", "node", "root", "n", "out", "marks"))
    sketch = padded(pa.concat_arrays(rows.column("sketch").chunks), np.where(side == 0, *PADS))
    cell = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(side)]))
    rights = np.bincount(cell, side, len(starts)).astype(np.int64)
    first_right = np.r_[starts[1:], len(side)] - rights
    large = (first_right - starts) * rights > MATRIX
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        # two nodes outside the largest component meet twice: once is enough
        use = (root[a] != root[b]) & ~(out[b] & (node[a] > node[b])) & (np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * PERCENT)
        a, b = a[use], b[use]
        whole = np.maximum(n[a], n[b]) <= SKETCH
        ok = np.zeros(len(a), bool)
        for k in range(0, len(a), PAIRS):
            p, q, w = a[k : k + PAIRS], b[k : k + PAIRS], whole[k : k + PAIRS]
            e = estimates(sketch[p], sketch[q], np.where(w, 2 * SKETCH, SKETCH))
            ok[k : k + PAIRS] = np.where(w, e * 100 >= PERCENT - 1e-9, e >= least_estimate)
        a, b, whole = a[ok], b[ok], whole[ok]
        mine = least_common(sketch[:, :KEYS], marks, a, b) == v[a].view(np.uint64)
        found.append((a[mine], b[mine], whole[mine]))

    for c in np.flatnonzero(large):
        a, b = np.arange(starts[c], first_right[c]), np.arange(first_right[c], first_right[c] + rights[c])
        for k in range(0, len(a), SIDE):
            p = a[k : k + SIDE]
            shared = overlaps(sketch[p], sketch[b])
            # what any pair over the threshold shares: of whole sets 3/7 of both sizes, of sketches the least estimate
            least = np.where(np.maximum(n[p][:, None], n[b]) <= SKETCH, (n[p][:, None] + n[b]) * (PERCENT / (100 + PERCENT)) - 1e-3, least_estimate * SKETCH)
            left, right = np.nonzero((shared >= least) & (root[p][:, None] != root[b]))
            keep(p[left], b[right])
    lefts = np.flatnonzero((side == 0) & ~large[cell])
    partners = rights[cell[lefts]]
    upto = np.cumsum(partners)
    at = 0
    while at < len(lefts):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS * 16, side="right")))
        keep(np.repeat(lefts[at:to], partners[at:to]), np.repeat(first_right[cell[lefts[at:to]]], partners[at:to]) + ranges(partners[at:to]))
        at = to
    if not found:
        return
    a, b, whole = (np.concatenate([f[k] for f in found]) for k in range(3))
    if not len(a):
        return
    x, y = np.where(node[a] < node[b], (a, b), (b, a))  # rows of the lesser and the greater node
    group = parted(cell[a], node[x], node[y], np.where(whole, 0, n[x]), np.where(whole, 0, n[y]))
    order = np.lexsort((group, cell[a]))
    a, x, y, whole, group = a[order], x[order], y[order], whole[order], group[order]
    at = np.flatnonzero(np.r_[True, (cell[a][1:] != cell[a][:-1]) | (group[1:] != group[:-1])])
    to = np.r_[at[1:], len(a)]
    bytes_of = lambda values: pa.array([values[p:q].tobytes() for p, q in zip(at, to, strict=True)], pa.binary())
    near = pa.array([np.unique(np.r_[node[x[p:q]][~whole[p:q]], node[y[p:q]][~whole[p:q]]]).tolist() for p, q in zip(at, to, strict=True)], pa.list_(pa.int64()))
    head = starts[cell[a[at]]]
    yield pa.RecordBatch.from_arrays([pa.array(v[head]), pa.array(s[head]), pa.array(i[head]), pa.array(j[head]), pa.array(group[at].astype(np.int32)), bytes_of(node[x]), bytes_of(node[y]), bytes_of(whole), near], names=["v", "s", "i", "j", "part", "x", "y", "sure", "near"])


def parted(cell: np.ndarray, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, most: int | None = None) -> np.ndarray:
    """Groups of the pairs of each cell: both sides' nodes are taken in order, and a group's distinct nodes have at most about `most` hashes a side."""
    most = most or CELL_HASHES // 2

    def chunks(nodes: np.ndarray, size: np.ndarray) -> np.ndarray:
        order = np.lexsort((size, nodes, cell))
        c, d, n = cell[order], nodes[order], size[order]
        last = np.r_[(c[1:] != c[:-1]) | (d[1:] != d[:-1]), True]  # of a node's rows in a cell, the one with its size
        total = np.cumsum(np.where(last, n, 0)) - np.where(last, n, 0)
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        total -= np.repeat(total[first], np.diff(np.r_[first, len(c)]))
        out = np.zeros(len(nodes), np.int64)
        out[order] = total // most
        return out

    return chunks(x, nx) * (1 << 15) + chunks(y, ny)


def least_common(keys: np.ndarray, marks: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of rows, the least key that is marked in both (each row's keys are in order)."""
    out = np.zeros(len(a), np.uint64)
    place = np.arange(keys.shape[1])
    for k in range(0, len(a), PAIRS):
        take = lambda r, pad: np.where(marks[r][:, None] >> place & 1, keys[r], pad)
        both = np.concatenate([take(a[k : k + PAIRS], PADS[0]), take(b[k : k + PAIRS], PADS[1])], axis=1)
        both.sort(axis=1)
        double = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] < PADS[1])
        out[k : k + PAIRS] = np.where(double, both[:, 1:], PADS[0]).min(1)
    return out


CELL = ("v", "s", "i", "j", "part")


def linked_in_cells(cells: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """x, y: links between different components, verified on full sets. Each part of a cell hands on a forest of its links."""
    wanted = kept(cells.select(*(F.col(c).alias("m" + c) for c in CELL), F.explode("near").alias("node")).join(nodes.select("node", "id", "a"), "node"))
    sets = full_sets(wanted.select("node", "id", "a").distinct(), docs, words, id_col, text_col)
    members = wanted.select(*("m" + c for c in CELL), "node").join(sets, "node")

    def link(key: tuple, pairs: pa.Table, sets: pa.Table) -> pa.Table:
        number = {m: k for k, m in enumerate(sets.column("node").to_pylist())}
        held = [np.frombuffer(h, np.uint64) for h in sets.column("hashes").to_pylist()]
        forest: dict[int, int] = {}

        def top(m: int) -> int:
            while forest.get(m, m) != m:
                forest[m] = m = forest.get(forest[m], forest[m])
            return m

        out: list[tuple[int, int]] = []
        for xs, ys, sure in zip(*(pairs.column(c).to_pylist() for c in ("x", "y", "sure")), strict=True):
            of = zip(np.frombuffer(xs, np.int64).tolist(), np.frombuffer(ys, np.int64).tolist(), np.frombuffer(sure, bool).tolist(), strict=True)
            for x, y, known in sorted(of, key=lambda p: not p[2]):
                if top(x) == top(y):
                    continue
                if not known:
                    if x not in number or y not in number:
                        raise ValueError(f"the texts of nodes {x} and {y} were not found again: the documents changed between two passes")
                    p, q = held[number[x]], held[number[y]]
                    inter = len(np.intersect1d(p, q, assume_unique=True))
                    if 100 * inter < PERCENT * (len(p) + len(q) - inter):
                        continue
                forest[top(x)] = top(y)
                out.append((x, y))
        return pa.table({"x": pa.array([o[0] for o in out], pa.int64()), "y": pa.array([o[1] for o in out], pa.int64())})

    return cells.select(*CELL, "x", "y", "sure").groupBy(*CELL).cogroup(members.groupBy(*("m" + c for c in CELL))).applyInArrow(link, "x long, y long").distinct()


def full_sets(wanted: DataFrame, docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """node, hashes: the whole sets of the wanted nodes (node, id, a). Texts are read again, for these nodes only."""
    shipped = docs.sparkSession.sparkContext.broadcast(id_bitmap(wanted.select("id")))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shipped.value
        for batch in batches:
            at = (mix(batch.column("id").fill_null(0).to_numpy().astype(np.uint64)) % np.uint64(BITMAP)).astype(np.int64)
            some = batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))
            for part in slices([some], "text"):
                sets = shingle_sets(part.column("text"), words)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([signature(s, SEEDS[0]) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "a", "hashes"])

    sets = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(measure, "id long, a long, hashes binary")
    # rows with equal ids may hold other texts; of rows that are equal in full one is enough
    own = sets.withColumnsRenamed({"id": "_id", "a": "_a"})
    return wanted.join(own, wanted["id"].eqNullSafe(own["_id"]) & (wanted["a"] == own["_a"])).groupBy("node").agg(F.first("hashes").alias("hashes"))


def near_duplicates(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and h (xxhash64 of the text, which tells rows with equal ids apart) of every row of docs.

    exact: both gates are open - one common key is enough, and all pairs that have one are verified, whatever their estimate. An
    empty table gives no rows; columns besides the id and the text are not looked at. Of the tables that are written
    on the way only the result stays.
    """
    shared, least = (0.0, 0.0) if exact else (SHARED_KEYS, LEAST_ESTIMATE)
    with passing(docs.sparkSession) as result:
        table = kept(described(docs, words, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
        sets = table.where("n > 0").groupBy("a", "b").agg(F.min("row").alias("node"), F.min("id").alias("least"))
        nodes = kept(table.join(sets.select(F.col("node").alias("row"), "least"), "row").select(F.col("row").alias("node"), "id", "least", "n", "a", "b", "sketch"))
        keyed = kept(lists(nodes, shared))
        links = kept(verified(kept(estimated(hub_pairs(keyed), nodes, least)), nodes, docs, words, id_col, text_col))
        roots = components(links)
        rest = kept(open_cells(keyed, roots, nodes, least))
        if not rest.isEmpty():
            more = linked_in_cells(rest, nodes, docs, words, id_col, text_col)
            roots = components(more.unionByName(roots.where("node <> root").select(F.col("node").alias("x"), F.col("root").alias("y"))))
        placed = nodes.select("node", "a", "b", "least").join(roots, "node", "left").select("a", "b", "least", F.coalesce("root", "node").alias("root"))
        names = kept(placed.groupBy("root").agg(F.min("least").alias("component_id")))
        named = kept(placed.join(names, "root").select("a", "b", "component_id"))
        grouped = table.where("n > 0").select("id", "h", "n", "a", "b").join(named, ["a", "b"]).select("id", "h", "n", "component_id")
        alone = table.where("n = 0").select("id", "h", "n", F.col("id").alias("component_id"))
        kept_one = F.when(F.col("component_id").isNull(), True).otherwise(F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
        return result(grouped.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept_one.alias("kept"), "h"))
