"""Exact search for the highest integer inner products.

Vectors are packed into blocks: tiles of queries, shards of all vectors. A group of
tiles meets a group of shards in one cell; a task holds the cell's tiles and streams its
shards past them, so a block is sent once for each group of the other side. Each tile and
shard are one matrix product, of which every query keeps its best by partial selection.
A query's lists are merged within its cell, then over cells as a tree of FAN_IN branches.

Rows whose vector is null, or holds null or non-finite components, take no part.
Only vectors of equal length are compared. Ties go to the smaller id. Rows that carry
a query's id count as its own; a query row that is repeated exactly is asked once.
Products beyond 64 bits are held at the limits of 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._text import kept

SHARD_ROWS, TILE_ROWS = 4096, 1024
SHARDS_IN_GROUP, TILES_IN_GROUP = 32, 16
FAN_IN = 64  # lists of a query that are merged at a time


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id and floor(scale * x) of every component, as whole doubles; only vectors that take part."""
    numbers = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), numbers.alias("v"))


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """dim, ids, numbers: up to `rows` vectors of equal length in one row, in order of id."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            parts = waiting.pop(dim)
            ids, v = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(ids, kind="stable")
            small = not v.size or np.abs(v).max() < 2**31
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids[order].tobytes()], pa.binary()), pa.array([v[order].astype(np.int32 if small else np.float64).tobytes()], pa.binary())], names=["dim", "ids", "numbers"])

        for b in batches:
            ids, lists = b.column("id").to_numpy(), b.column("v")
            flat, size = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            start = np.cumsum(size) - size
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                for k in range(0, len(at), rows):
                    some = at[k : k + rows]
                    waiting.setdefault(dim, []).append((ids[some], flat[start[some][:, None] + np.arange(dim)].reshape(len(some), dim)))
                    if sum(len(p[0]) for p in waiting[dim]) >= rows:
                        yield flush(dim)
        for dim in list(waiting):
            yield flush(dim)

    return vectors.mapInArrow(pack, "dim int, ids binary, numbers binary")


def unpack(ids: bytes, numbers: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    of = np.frombuffer(ids, np.int64)
    wide = len(numbers) == 8 * dim * len(of) and dim > 0
    return of, np.frombuffer(numbers, np.float64 if wide else np.int32).astype(np.float64).reshape(len(of), dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by doubles while every partial sum stays below 2**53, else by Python's integers."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a).dot(whole(b).T), -(2**63), 2**63 - 1).astype(np.int64)


def best(score: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (query row, column) of each query's k best; columns are in order of id, so earlier ones win ties."""
    own = ids[None] == query_ids[:, None]
    n = len(ids)
    take = min(n, k + int(own.sum(1).max(initial=0)))
    cut = np.partition(score, n - take, axis=1)[:, n - take]
    rows, columns = np.nonzero((score >= cut[:, None]) & ~own)
    keep = first_of_each(rows, rows, score[rows, columns], columns, k)
    return rows[keep], columns[keep]


def first_of_each(tile: np.ndarray, place: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The rows of each query's (tile, place) k best, ties to the smaller id."""
    order = np.lexsort((ids, np.invert(score), place, tile))  # ~score falls where score rises, without overflow
    new = np.r_[True, (np.diff(tile[order]) != 0) | (np.diff(place[order]) != 0)] if len(order) else np.zeros(0, bool)
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[rank < k]


def met_in_cells(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Each cell's k best for each of its queries. Rows come in order of cell, tiles (side 0) before shards."""
    cell, tiles, lists = None, [], []

    def merged() -> None:
        if len(lists) > 1:
            columns = [np.concatenate([x[c] for x in lists]) for c in range(5)]
            keep = first_of_each(columns[0], columns[1], columns[3], columns[4], k)
            lists[:] = [tuple(c[keep] for c in columns)]

    def out() -> Iterator[pa.RecordBatch]:
        merged()
        for tile, place, query, score, ids in lists:
            yield pa.RecordBatch.from_arrays([pa.array(tile), pa.array(place), pa.array(np.full(len(tile), cell[2], np.int32)), pa.array(query), pa.array(ids), pa.array(score)], names=["tile", "place", "group", "query_id", "vec_id", "score"])
        lists.clear()

    for b in batches:
        for r in range(b.num_rows):
            one = {c: b.column(c)[r].as_py() for c in b.schema.names}
            if cell != (one["dim"], one["tiles"], one["group"]):
                yield from out()
                cell, tiles = (one["dim"], one["tiles"], one["group"]), []
            if one["side"] == 0:
                tiles.append((one["tile"], *unpack(one["ids"], one["numbers"], one["dim"])))
                continue
            ids, v = unpack(one["ids"], one["numbers"], one["dim"])
            for tile, q_ids, q in tiles:
                for a in range(0, len(q), 128):
                    score = products(q[a : a + 128], v)
                    row, column = best(score, q_ids[a : a + 128], ids, k)
                    lists.append((np.full(len(row), tile), (row + a).astype(np.int32), q_ids[a : a + 128][row], score[row, column], ids[column]))
            if len(lists) > 1024:
                merged()
    yield from out()


def top_k(vectors: DataFrame, asked: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row that `asked` names."""
    queries = usable(vectors.where(asked), id_col, vector_col, scale).dropDuplicates(["id", "v"])
    block = F.monotonically_increasing_id()
    shards = kept(blocks(usable(vectors, id_col, vector_col, scale), SHARD_ROWS).withColumn("block", block))
    tiles = kept(blocks(queries.repartition(max(1, math.ceil(queries.count() / TILE_ROWS))), TILE_ROWS).withColumn("block", block))
    # a group count for each length of vectors
    groups = lambda of, size: {r["dim"]: math.ceil(r["count"] / size) for r in of.groupBy("dim").count().collect()}
    tile_groups, shard_groups = groups(tiles, TILES_IN_GROUP), groups(shards, SHARDS_IN_GROUP)
    count = lambda by: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for item in by.items() for x in item)), F.col("dim")), F.lit(0)) if by else F.lit(0)
    own = lambda by: F.pmod(F.xxhash64("block"), F.greatest(count(by), F.lit(1))).cast("int")
    every = lambda by: F.explode(F.when(count(by) > 0, F.sequence(F.lit(0), count(by) - 1)).otherwise(F.array().cast("array<int>")))
    columns = ("dim", "tiles", "group", "side", "tile", "ids", "numbers")
    left = tiles.withColumn("tiles", own(tile_groups)).withColumn("group", every(shard_groups)).withColumn("side", F.lit(0)).withColumn("tile", F.col("block"))
    right = shards.withColumn("group", own(shard_groups)).withColumn("tiles", every(tile_groups)).withColumn("side", F.lit(1)).withColumn("tile", F.lit(-1).cast("long"))
    cells = left.select(*columns).unionByName(right.select(*columns)).repartition("dim", "tiles", "group").sortWithinPartitions("dim", "tiles", "group", "side")
    lists = cells.mapInArrow(lambda batches: met_in_cells(batches, k), "tile long, place int, group int, query_id long, vec_id long, score long")
    order = [F.col("score").desc(), F.col("vec_id")]
    branches = max(shard_groups.values(), default=1)
    while branches > 1:
        branches = math.ceil(branches / FAN_IN)
        lists = lists.withColumn("group", F.floor(F.col("group") / FAN_IN).cast("int"))
        lists = lists.withColumn("r", F.row_number().over(Window.partitionBy("tile", "place", "group").orderBy(*order))).where(F.col("r") <= k).drop("r")
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("tile", "place").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
