"""Exact duplicates, the hash tree and the vector codes against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from ridgeline.llm import codes, entries, exact, merkle
from ridgeline.llm._text import shared_folder
from ridgeline.llm.entries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
LONG = "Word " * 60_000
ROWS = [
    (1, "One two", "en", "a", 7),
    (1, "One two", "en", "a", 7),  # repeated
    (1, "another text", "en", "b", None),  # the same id
    (2, None, "de", None, 0),
    (3, "", None, "a", 0),
    (4, "", None, "a", 0),
    (None, "one TWO", "en", "a", 7),
    (None, None, None, None, None),
    (None, "only without id", "", "a", 1),
    (None, "Only without id", "", "a", 1),
    (5, LONG, "en", "b", 1),
    (6, LONG.lower(), "en", "b", 1),
    (7, "ÜNÏCÖDÉ ß", "de", "c", 9),
    (8, "ünïcödé ß", "de", "c", 9),
]
CLASH = ("keep_id", "kept", "digest", "piece", "norm", "id", "tree", "place", "n", "leaf", "stamp", "v", "row", "code", "numbers", "rows", "error")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def docs_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("other") for c in CLASH})


@pytest.mark.parametrize("name", ["op11_heap_lloyd", "op12_merkle_manifest", "op13_exact_duplicates"])
def test_same_as_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = QUERIES[name](spark, DATA)
    want = db.execute(ORACLE_SQL[name])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def plain_duplicates(rows, largest=True):
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r[1] or "")].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if largest else min)(known) if known else None
        out += [(i, best, len(ids), sha(text)) for i in ids]
    return sorted(out, key=str), len(groups)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_duplicates(spark, keep):
    rng = random.Random(3)
    rows = ROWS + [(k, "Copied text " * 40 if rng.random() < 0.4 else f"text {rng.randrange(60)}", "en", "s", 1) for k in range(100, 600)]
    got = exact.exact_duplicates(docs_of(spark, rows).repartition(7), keep=keep).collect()
    want, groups = plain_duplicates(rows, keep == "largest")
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    stays = [r for r in got if r["kept"]]
    assert len(stays) == groups and all(r["doc_id"] == r["keep_id"] for r in stays)
    assert exact.exact_duplicates(docs_of(spark, [])).count() == 0


def test_large_groups_are_cut(spark):
    """The text that holds most rows, and the few rows that hold most bytes, are cut into pieces; others are not."""
    rows = [(k, "many copies" if k % 3 else f"text {k}", "en", "s", 1) for k in range(900)] + [(1000 + k, LONG, "en", "s", 1) for k in range(4)]
    keyed = docs_of(spark, rows).select(F.col("doc_id").alias("id"), exact.normalised(F.col("text")).alias("norm")).withColumn("digest", F.sha2("norm", 256))
    cut, _ = exact.frequent(keyed, 4)
    found = {r["digest"]: r["pieces"] for r in cut.collect()}
    assert found == {sha("many copies"): math.ceil(600 * 16 / 904), sha(lowered(LONG)): 16}
    got = exact.exact_duplicates(docs_of(spark, rows)).where("kept").collect()
    assert Counter(r["group_size"] for r in got) == {600: 1, 4: 1, 1: 300} and max(r["doc_id"] for r in got) == 1003


def test_exact_plan_deals_rows_out_once(spark):
    """The window works on the ranges: no exchange besides the one by range, and no Python."""
    keyed = docs_of(spark, ROWS).select(F.col("doc_id").alias("id"), exact.normalised(F.col("text")).alias("norm"), F.length("text").alias("pieces")).withColumn("digest", F.sha2("norm", 256))
    plan = exact.neighbours(keyed, True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan and "Python" not in plan


# --- the hash tree


def leaf_of(r, change=False):
    doc_id, text, lang, source, n = r
    text = lowered(text) if change and text is not None else text
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, place):
    for level in levels[:-1]:
        run = level[place // 8 * 8 : place // 8 * 8 + 8]
        yield run[: place % 8], run[place % 8 + 1 :]
        place //= 8


def plain_manifest(rows):
    altered = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        trees[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    low = {x: levels_of([leaf_of(r) for r in trees[x]]) for x in langs}
    high = levels_of([low[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for place, r in enumerate(trees[x]):
            path = [*siblings(low[x], place), *siblings(high, k)]
            now = leaf_of(r, altered(r))
            for before, behind in path:
                now = sha("".join([*before, now, *behind]))
            out.append((r[0], leaf_of(r), low[x][-1][0], high[-1][0], sha("".join("".join(a + b) for a, b in path)), now, now == high[-1][0]))
    return sorted(out, key=str)


def changed():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 0


@pytest.mark.parametrize("extra", [0, 600])
def test_manifest(spark, extra):
    """With 600 rows more: 70 languages of one row each (two levels above subroots), one of 530 (four levels)."""
    rows = ROWS + [(1000 + k, f"Text {k}", f"l{k}" if k < 70 else "en", "s", k) for k in range(extra)]
    got = merkle.manifest(docs_of(spark, rows).repartition(5), changed()).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_sizes_of_one_tree(spark, n):
    rows = [(k, f"Text {k}", "en", "s", k) for k in range(n)]
    got = merkle.manifest(docs_of(spark, rows), changed())
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(rows)


def test_no_documents(spark):
    got = merkle.manifest(docs_of(spark, []), changed())
    assert got.count() == 0 and got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


# --- codes of vectors


def plain_codes(rows, scale=256.0, parts=16, entries_=64, rounds=2):
    """rows (vec_id, vector, label): Lloyd's rounds by full scans in Python's integers."""
    sound = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and r[1] and len(r[1]) % parts == 0]
    sound.sort(key=lambda r: (r[0] is None, r[0] or 0, [math.floor(scale * x) for x in r[1]]))
    dim = len(sound[0][1])
    sound = [r for r in sound if len(r[1]) == dim]
    whole = [[math.floor(scale * x) for x in r[1]] for r in sound]
    w = dim // parts
    book = [[v[p * w : p * w + w] for v in whole[:entries_]] for p in range(parts)]

    def assign():
        out = []
        for v in whole:
            of = []
            for p in range(parts):
                d = [sum((a - b) ** 2 for a, b in zip(v[p * w : p * w + w], e, strict=True)) for e in book[p]]
                of.append((d.index(min(d)), min(d)))
            out.append(of)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(book[p])):
                mine = [v[p * w : p * w + w] for v, f in zip(whole, found, strict=True) if f[p][0] == e]
                if mine:
                    book[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = assign()
    error = [min(sum(d for _, d in f), 2**63 - 1) for f in found]
    by_label = defaultdict(int)
    for r, e in zip(sound, error, strict=True):
        by_label[r[2]] += e
    text = sha(",".join(str(x) for p in book for e in p for x in e))
    return sorted(((r[0], "".join(f"{e:02x}" for e, _ in f), x, min(by_label[r[2]], 2**63 - 1), text) for r, f, x in zip(sound, found, error, strict=True)), key=str)


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("other") for c in CLASH})


def coded(df):
    return sorted(map(tuple, codes.compressed(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


@pytest.mark.parametrize(("n", "dim", "scale"), [(300, 32, 1.0), (300, 16, 0.02), (40, 64, 1.0), (1, 16, 1.0), (130, 32, 1e9)])
def test_codes(spark, n, dim, scale):
    """Few distinct values make ties, few rows short codebooks, large values products beyond 64 bits."""
    rng = random.Random(n + dim)
    rows = [(k // 2 if k % 9 == 0 else k, [rng.gauss(0, 1) * scale for _ in range(dim)], rng.choice([1, 2, None])) for k in range(n)]
    rows += [rows[0]] * 3
    assert coded(vectors_of(spark, rows).repartition(3)) == plain_codes(rows)


def test_odd_vectors(spark):
    rng = random.Random(1)
    rows = [(k, [rng.random() for _ in range(16)], k % 2) for k in range(20)]
    odd = [(50, None, 1), (51, [None] * 16, 1), (52, [float("nan")] * 16, 1), (53, [float("inf")] * 16, 1), (54, [], 1), (55, [1.0] * 17, 1), (56, [1.0] * 32, 1), (None, [0.5] * 16, None)]
    assert coded(vectors_of(spark, rows + odd)) == plain_codes(rows + odd)
    assert codes.compressed(vectors_of(spark, odd[:6])).count() == 0
    assert codes.compressed(vectors_of(spark, [])).columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]


def test_heaps_pop_only_what_the_drift_has_reached():
    """Blobs far apart: after small moves few parts are scanned again, and all codes are those of full scans."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (8, 4)) * 10
    x = (centres[rng.integers(0, 8, 2000)] + rng.integers(-30, 30, (2000, 4))).astype(np.int64)
    book = centres[None].astype(np.int64)
    block = codes.Block(codes.packed(x), b"", b"", b"", b"", book)
    moved = block.round(book, np.zeros((1, 8)))
    assert moved[..., -1].sum() == 2000
    now = moved[..., :-1] // np.maximum(moved[..., -1:], 1)
    drift = codes.moves(book, now)
    again = codes.Block(codes.packed(x), *block.state(), now)
    reached = again.popped(0, drift)
    assert len(reached) < 200
    again = codes.Block(codes.packed(x), *block.state(), now)
    again.round(now, drift)
    assert (again.codes[:, 0] == codes.distances(x, now[0]).argmin(1)).all()
    far = now + rng.integers(-20000, 20000, now.shape)  # large moves: everything may be popped, nothing may be wrong
    third = codes.Block(codes.packed(x), *again.state(), far)
    third.round(far, drift + codes.moves(now, far))
    assert (third.codes[:, 0] == codes.distances(x, far[0]).argmin(1)).all()
    assert sorted(i for h in range(8) for _, i in third.heap(0, h)) == list(range(2000))


def test_tables_are_let_go(spark):
    """Only the tables of the result stay in the shared folder."""
    folder = Path(re.sub("^file:/*", "/", shared_folder(spark, "x"))).parent
    before = set(folder.iterdir()) if folder.exists() else set()
    for name in ("op11_heap_lloyd", "op12_merkle_manifest", "op13_exact_duplicates"):
        entries.QUERIES[name](spark, DATA).count()
    assert len(set(folder.iterdir()) - before) == 3


def test_python_sees_partitions_that_are_put_together(spark):
    """One pass of a worker a task, not one for each partition of the shuffle."""
    nodes = spark.sparkContext.parallelize([(("t", k), (64, bytes(32), None)) for k in range(64)], 2)
    level = merkle.parents(nodes, 1)
    between = level.toDebugString().decode().split("CoalescedRDD")[1].split("ShuffledRDD")[0]
    assert "PythonRDD[" not in between and level.count() == 8
    some = spark.sparkContext.parallelize([(k % 5, k) for k in range(20)], 3)
    assert sorted(merkle.matched(some, some, 2).collect()) == sorted(some.join(some).collect())
