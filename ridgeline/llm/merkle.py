"""A hash tree over documents: subroots by language, one root, and proofs that show which rows were changed.

Leaves are hashed in SQL expressions, numbered within their tree (a language) by a range
partitioning, and met by supersteps over RDDs: every node sends its digest to its parent's
key; a parent that has heard all of its children (the size of the level says how many)
hashes them in order and goes on to the next superstep. Trees whose level has one node are
done; their roots are the leaves of one more tree. The reverse supersteps send paths down:
a node passes to each child its own path with the child's siblings in front. The last one
goes to the groups of up to FAN leaves that the first superstep made, so paths are moved for
groups, not for leaves, and each leaf's fold runs where its group is.

Every superstep's nodes are written to the shared folder, which cuts the lineage; a task
sees FAN messages of a node at most. Only a level count and the root come to the driver.

Rows with null values are leaves like others (a null is hashed as `-`); null ids come
first, rows with equal ids are ordered by their leaf. A null language is a tree of its own. An empty table
gives no rows. Columns besides `fields` are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import string
from binascii import hexlify
from collections.abc import Iterator, Sequence

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._text import kept, let_go, remove, shared_folder

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES_BY_TASK = 1 << 14


def sha(digests: bytes) -> bytes:
    """The hash of digests in a row, each as hex text."""
    return hashlib.sha256(hexlify(digests)).digest()


def leaf(values: Sequence[Column]) -> Column:
    """Lower-case hex SHA-256 of values in a row: `-` for null, else the UTF-8 byte count, a colon and the value."""
    text = lambda c: c.cast("string")
    one = lambda c: F.coalesce(F.concat(text(F.octet_length(text(c))), F.lit(":"), text(c)), F.lit("-"))
    return F.sha2(F.concat(*map(one, values)), 256)


def numbered(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """rows with `place` (from 0, in order) and `n`, both within a tree. Each range counts its own; no task sees a whole tree."""
    stamp = kept(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("stamp", F.monotonically_increasing_id()))
    part = F.shiftright("stamp", 33)
    runs = stamp.groupBy(tree, part.alias("part")).agg(F.min("stamp").alias("first"), F.count(F.lit(1)).alias("rows"))
    # one row for each range that a tree reaches
    before = F.sum("rows").over(Window.partitionBy(tree).orderBy("part")) - F.col("rows") - F.col("first")
    runs = runs.select(tree, "part", before.alias("shift"), F.sum("rows").over(Window.partitionBy(tree)).alias("n"))
    placed = kept(stamp.withColumn("part", part).join(runs, [tree, "part"]).select(*rows.columns, (F.col("stamp") + F.col("shift")).alias("place"), "n"))
    let_go(stamp)
    return placed


class Supersteps:
    """Settled levels of trees and the folders that hold them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def settled(self, rdd: RDD) -> RDD:
        folder = shared_folder(self.spark, "superstep")
        rdd.saveAsPickleFile(folder)
        self.folders.append(folder)
        return self.spark.sparkContext.pickleFile(folder)

    def tasks(self, nodes: float) -> int:
        return max(1, math.ceil(nodes / NODES_BY_TASK))

    def up(self, leaves: RDD, most: int, count: int) -> list[RDD]:
        """Levels above leaves ((tree, place), (n, digest, data)): ((tree, place), (n, digest, children's digests, their data)).

        most: the largest n; count: how many leaves there are. A tree of one leaf has no level above it.
        """
        levels, level = [], leaves
        while most > 1:
            level = self.settled(parents(level, self.tasks(count / FAN)))
            levels.append(level)
            level = level.mapValues(lambda v: (v[0], v[1], None))
            most, count = math.ceil(most / FAN), count / FAN
        return levels

    def done(self) -> None:
        for folder in self.folders:
            remove(self.spark, folder)


def dealt(pairs: RDD, tasks: int) -> RDD:
    """pairs by key. Partitions of a shuffle are put together before Python sees them: one pass of a worker a task, however many there are."""
    return pairs.partitionBy(tasks).coalesce(tasks)


def gathered(pairs: RDD, tasks: int) -> RDD:
    """(key, list) with the lists of a key put together; a task holds its share of a level."""

    def merge(items):
        found = {}
        for key, some in items:
            found.setdefault(key, []).extend(some)
        return iter(found.items())

    return dealt(pairs.mapPartitions(merge), tasks).mapPartitions(merge)


def matched(a: RDD, b: RDD, tasks: int) -> RDD:
    """(key, (value of a, value of b)) of all pairs that share a key."""

    def match(items):
        found = {}
        for key, (side, value) in items:
            found.setdefault(key, ([], []))[side].append(value)
        return ((key, (v, w)) for key, (x, y) in found.items() for v in x for w in y)

    return dealt(a.map(lambda p: (p[0], (0, p[1]))).union(b.map(lambda p: (p[0], (1, p[1])))), tasks).mapPartitions(match)


def parents(nodes: RDD, tasks: int) -> RDD:
    """One superstep upwards. Small levels have few tasks, whatever the number of partitions they are shuffled by."""

    def message(node):
        (tree, place), (n, digest, data) = node
        return (tree, place // FAN), [(place % FAN, n, digest, data)]

    def complete(node):
        (tree, place), children = node
        children.sort(key=lambda c: c[0])
        n = children[0][1]
        if len(children) != min(FAN, n - FAN * place):
            raise ValueError(f"node {place} of {tree!r} has heard {len(children)} children of {min(FAN, n - FAN * place)}")
        digests = b"".join(c[2] for c in children)
        data = None if children[0][3] is None else [c[3] for c in children]
        return (tree, place), (math.ceil(n / FAN), sha(digests), digests, data)

    return gathered(nodes.filter(lambda v: v[1][0] > 1).map(message), tasks).map(complete)


def others(digests: bytes, slot: int) -> bytes:
    return digests[: 32 * slot] + digests[32 * slot + 32 :]


def paths_down(level: RDD, inbox: RDD, tasks: int) -> RDD:
    """One superstep downwards: messages ((tree, place), (of tree, path)) of a level's nodes become those of their children."""

    def tell(node):
        (tree, place), ((_, _, digests, _), (of, path)) = node
        for slot in range(len(digests) // 32):
            yield (tree, FAN * place + slot), (of, [(slot, others(digests, slot)), *path])

    return matched(level, inbox, tasks).flatMap(tell)


def starts_at(starts: RDD, height: int) -> RDD:
    """Messages to the roots of trees of this height."""
    return starts.filter(lambda s: s[1][0] == height).map(lambda s: ((s[0], 0), s[1][1]))


def folded(current: bytes, path: list[tuple[int, bytes]]) -> bytes:
    for slot, siblings in path:
        current = sha(siblings[: 32 * slot] + current + siblings[32 * slot :])
    return current


def height_of(n: int) -> int:
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def manifest(docs: DataFrame, changed: Column, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", tree_col: str = "lang", text_col: str = "text") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: a row for each row of docs.

    changed (boolean): rows whose text's A-Z are lower-cased before they are verified against the tree of the unchanged rows.
    proof_sha256: the hash of all siblings from the leaf to the root. folded_root: the root that a row and its siblings give.
    """
    spark = docs.sparkSession
    lowered = F.translate(text_col, string.ascii_uppercase, string.ascii_lowercase)
    values = [F.col(c) for c in fields]
    tree = F.when(F.col(tree_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col(tree_col).cast("string")))
    now = F.when(F.coalesce(changed, F.lit(False)), leaf([lowered if c == text_col else v for c, v in zip(fields, values, strict=True)]))
    rows = numbered(docs.select(F.col(id_col).alias("id"), tree.alias("tree"), leaf(values).alias("leaf"), now.alias("now")), "tree", ["id", "leaf"])
    shape = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    size = rows.agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("count")).first()
    if not size["count"]:
        return spark.createDataFrame([], shape)

    steps = Supersteps(spark)
    raw = bytes.fromhex
    leaves = rows.select("tree", "place", "n", "leaf", "id", "now").coalesce(steps.tasks(size["count"])).rdd.map(lambda r: ((r[0], r[1]), (r[2], raw(r[3]), (r[4], raw(r[5]) if r[5] else None))))
    levels = steps.up(leaves, size["most"], size["count"])
    single = leaves.filter(lambda v: v[1][0] == 1)
    roots = spark.sparkContext.union([single.map(lambda v: (v[0][0], 0, v[1][1].hex()))] + [x.filter(lambda v: v[1][0] == 1).map(lambda v, h=h: (v[0][0], h, v[1][1].hex())) for h, x in enumerate(levels, 1)])

    # one more tree, of the subroots in order of language
    top = numbered(spark.createDataFrame(roots, "name string, height int, digest string").withColumn("tree", F.lit("")), "tree", ["name"])
    trees = top.count()
    subroots = top.coalesce(steps.tasks(trees)).rdd.map(lambda r: ((r["tree"], r["place"]), (r["n"], raw(r["digest"]), (r["name"], r["height"]))))
    top_levels = steps.up(subroots, trees, trees)
    root = (top_levels[-1].filter(lambda v: v[1][0] == 1) if top_levels else subroots).first()[1][1]

    inbox = starts_at(spark.sparkContext.parallelize([("", (len(top_levels), (None, [])))], 1), len(top_levels))
    for k, level in zip(range(len(top_levels), 0, -1), reversed(top_levels), strict=True):
        inbox = paths_down(level, inbox, steps.tasks(trees / FAN**k))
    told = matched(subroots, inbox, steps.tasks(trees))
    # (tree, (height, (subroot, path)))
    starts = steps.settled(told.map(lambda v: (v[1][0][2][0], (v[1][0][2][1], (v[1][0][1], v[1][1][1])))))

    def shown(subroot: bytes, digest: bytes, data: tuple, path: list[tuple[int, bytes]]) -> tuple:
        doc, altered = data
        back = folded(altered or digest, path)
        return doc, digest.hex(), subroot.hex(), root.hex(), sha(b"".join(s for _, s in path)).hex(), back.hex(), back == root

    def leaves_of(node) -> Iterator[tuple]:
        (_, (_, _, digests, data)), (subroot, path) = node[0], node[1]
        for slot, one in enumerate(data):
            yield shown(subroot, digests[32 * slot : 32 * slot + 32], one, [(slot, others(digests, slot)), *path])

    inbox = None
    for k in range(len(levels), 0, -1):
        here = starts_at(starts, k)
        inbox = here if inbox is None else inbox.union(here)
        if k > 1:
            inbox = steps.settled(paths_down(levels[k - 1], inbox, steps.tasks(size["count"] / FAN**k)))
    alone = matched(single, starts_at(starts, 0), steps.tasks(trees)).map(lambda v: shown(v[1][1][0], v[1][0][1], v[1][0][2], v[1][1][1]))
    groups = steps.tasks(size["count"] / FAN)
    grouped = matched(levels[0], inbox, groups).map(lambda v: ((v[0], v[1][0]), v[1][1])).flatMap(leaves_of) if levels else None
    found = kept(spark.createDataFrame(alone if grouped is None else alone.union(grouped), shape))
    steps.done()
    let_go(rows, top)
    return found
