"""Operators against plain Python that says the same."""

import hashlib
import itertools
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from ridgeline.llm import entries, maxent, mixing, neardup, packing, simhash, topk, toxicity
from ridgeline.llm._bpe import WordTokens
from ridgeline.llm._text import shared_folder

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed=5, groups=12):
    """Documents with copies, near copies that chain, and shared passages."""
    rng = random.Random(seed)
    words = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(400)) for _ in range(n)]
    passage, out = words(60), []
    for g in range(groups):
        base = words(rng.choice([3, 5, 8, 40, 120, 300]))
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = words(1)[0]
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                w[at:at] = passage
            out.append(" ".join(w))
            if rng.random() < 0.5:  # the next one starts from here
                base = w
    rng.shuffle(out)
    return out


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def groups(sets):
    root = list(range(len(sets)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(k) for k in range(len(sets))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_duplicates(spark, seed):
    t = texts(seed, 30)
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).orderBy("doc_id").collect()
    sets = [shingles(x) for x in t]
    assert [r["n_shingles"] for r in got] == [len(s) for s in sets]
    want = groups(sets)
    assert [r["component_id"] for r in got] == want and [r["kept"] for r in got] == [k == w for k, w in enumerate(want)]


def test_cells_alone_find_the_links(spark, monkeypatch):
    """Without the comparison with hubs all links have to come from the cells."""
    monkeypatch.setattr(neardup, "hub_pairs", lambda keyed: keyed.select(F.col("node").alias("x"), F.col("node").alias("y")).limit(0))
    monkeypatch.setattr(neardup, "SIDE", 8)
    t = texts(9, 40)
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["component_id"] for r in got] == groups([shingles(x) for x in t])


@pytest.mark.parametrize("side", [4, 1024])
def test_open_gates_find_the_same(spark, monkeypatch, side):
    """The exact setting, with lists cut by bands of sizes and without; only the result's table stays."""
    monkeypatch.setattr(neardup, "SIDE", side)
    t = texts(11, 25)
    folder = Path(re.sub("^file:/*", "/", shared_folder(spark, "x"))).parent
    before = set(folder.iterdir()) if folder.exists() else set()
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string"), exact=True).orderBy("doc_id").collect()
    assert [r["component_id"] for r in got] == groups([shingles(x) for x in t])
    assert len(set(folder.iterdir()) - before) == 1


def test_bands_of_sizes_keep_pairs_together(spark):
    n = spark.range(1, 3000).select(F.col("id").alias("n"))
    bands = {r["n"]: r["b"] for r in n.select("n", neardup.band(F.col("n")).alias("b")).collect()}
    for a in range(1, 2250):
        assert bands[min(2999, a * 4 // 3)] - bands[a] in (0, 1)


def test_large_cells_are_verified_in_parts():
    """Every pair has one group of its cell; the distinct nodes of a group's side hold no more hashes than asked, but for one node."""
    rng = np.random.default_rng(2)
    cell, x, y = np.sort(rng.integers(0, 3, 500)), rng.integers(0, 40, 500), rng.integers(40, 90, 500)
    size = rng.integers(1, 100, 90)
    sure = rng.random(500) < 0.3
    group = neardup.parted(cell, x, y, np.where(sure, 0, size[x]), np.where(sure, 0, size[y]), most=300)
    assert len(set(zip(cell.tolist(), group.tolist(), strict=True))) > 10
    for c, g in set(zip(cell.tolist(), group.tolist(), strict=True)):
        mine = (cell == c) & (group == g) & ~sure
        assert size[np.unique(x[mine])].sum() < 400 and size[np.unique(y[mine])].sum() < 400
    assert len(np.unique(neardup.parted(cell, x, y, size[x], size[y], most=1 << 30))) == 1


def sketch_of(values):
    return np.sort(np.array(sorted(values), np.uint64))[: neardup.SKETCH]


def test_overlaps_are_counts_of_common_values():
    rng = np.random.default_rng(4)
    x, y = (neardup.padded(pa.array([np.sort(rng.choice(400, rng.integers(1, 65), replace=False).astype(np.uint64)).tobytes() for _ in range(n)], pa.binary()), pad) for n, pad in ((30, neardup.PADS[0]), (50, neardup.PADS[1])))
    assert neardup.overlaps(x, y).astype(int).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in y] for a in x]


@pytest.mark.parametrize("sizes", [(5, 40), (60, 70), (90, 400)])
def test_large_cells_find_what_small_cells_find(monkeypatch, sizes):
    """Inverted lists of a cell only spare pairs that the comparison of all pairs refuses too."""
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 2**63, sizes[1] + 20, dtype=np.int64).view(np.uint64)
        for _ in range(12):
            n = rng.integers(sizes[0], sizes[1])
            sets.append(np.unique(np.r_[np.uint64(7), rng.choice(base, n, replace=False) if rng.random() < 0.5 else base[:n]]))
    sketches = [sketch_of(s) for s in sets]
    both = [(side, k) for side in (0, 1) for k in range(len(sets))]
    rows = pa.RecordBatch.from_pydict(
        {
            "v": pa.array([7] * len(both), pa.int64()),
            **{c: pa.array([0] * len(both), pa.int32()) for c in ("s", "i", "j")},
            "side": pa.array([b[0] for b in both], pa.int32()),
            "node": pa.array([b[1] for b in both], pa.int64()),
            "root": pa.array([b[1] for b in both], pa.int64()),
            "n": pa.array([len(sets[b[1]]) for b in both], pa.int64()),
            "out": pa.array([True] * len(both)),
            "sketch": pa.array([sketches[b[1]].tobytes() for b in both], pa.binary()),
            "marks": pa.array([1] * len(both), pa.int64()),
        }
    )
    found = []
    for pairs in (0, 1 << 40):
        monkeypatch.setattr(neardup, "MATRIX", pairs)
        got = list(neardup.met_in_cells(iter([rows])))
        found.append({p for b in got for r in b.to_pylist() for p in zip(np.frombuffer(r["x"], np.int64).tolist(), np.frombuffer(r["y"], np.int64).tolist(), np.frombuffer(r["sure"], bool).tolist(), strict=True)})
    assert found[0] == found[1] and found[0]
    near = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert near <= {p[:2] for p in found[0]}


@pytest.mark.parametrize("n", [80, 400, 4000])
def test_gates_lose_no_pair_just_over_the_threshold(n):
    """Sets whose similarity is 0.75 share enough keys, and their estimate is high enough: equal sizes, and a set within the other."""
    rng = np.random.default_rng(n)
    for k in range(1500):
        within = k % 2
        union = rng.integers(0, 2**63, n, dtype=np.int64).view(np.uint64)
        inter = -(-3 * n // 4)
        half = (n - inter) // 2
        x, y = (union[:inter], union) if within else (union[: inter + half], union[np.r_[0:inter, inter + half : n]])
        a, b = sketch_of(x), sketch_of(y)
        assert len(np.intersect1d(a[: neardup.KEYS], b[: neardup.KEYS])) >= neardup.SHARED_KEYS * neardup.KEYS
        assert neardup.estimates(a[None], b[None], np.array([neardup.SKETCH]))[0] >= neardup.LEAST_ESTIMATE


def test_estimates():
    rng = np.random.default_rng(3)
    for n, common in ((40, 30), (300, 250), (300, 20)):
        pool = rng.integers(0, 2**63, 2 * n - common, dtype=np.int64).view(np.uint64)
        x, y = np.sort(pool[:n])[: neardup.SKETCH], np.sort(pool[n - common :])[: neardup.SKETCH]
        fill = lambda s, pad: np.r_[s, np.full(neardup.SKETCH - len(s), pad, np.uint64)][None]
        most = 2 * neardup.SKETCH if n <= neardup.SKETCH else neardup.SKETCH
        union = sorted({*x.tolist(), *y.tolist()})[:most]
        want = sum(v in set(x.tolist()) and v in set(y.tolist()) for v in union) / len(union)
        assert neardup.estimates(fill(x, neardup.PADS[0]), fill(y, neardup.PADS[1]), np.array([most]))[0] == pytest.approx(want)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (700, 6)) / 2.0
    rows = [(int(k), [float(x) for x in r]) for k, r in enumerate(v)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5), F.col("vec_id") % 50 == 0).collect()
    whole = np.floor(v * 256).astype(np.int64)
    scores = whole @ whole.T
    want = {(q, k + 1, int(c), int(scores[q, c])) for q in range(0, 700, 50) for k, c in enumerate(sorted((c for c in range(700) if c != q), key=lambda c: (-scores[q, c], c))[:5])}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want


def test_large_products():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 5.0], [2.0**40, 1.0]])
    assert topk.products(a, b).tolist() == [[2**60 + 15, 2**63 - 1]]


def test_targets(spark):
    sizes = [("a", 100), ("b", 1000), ("c", 50), (None, 30), ("d", 0)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    order = ["a", "b", "c", "d", None]
    weight = dict(zip(order, [5, 2, 1, 5, 2], strict=True))
    most, left = {s: 2.0 * n for s, n in sizes}, 1.5 * sum(n for _, n in sizes)
    free, want = set(order), {}
    while True:
        level = (left - sum(want.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > most[s]}
        if not over:
            break
        want |= {s: most[s] for s in over}
        free -= over
    want |= {s: weight[s] * level for s in free}
    assert got == pytest.approx(want)


def inclusions(sizes, missing):
    """The square roots' multiple, at most 1, whose expected words are the missing ones."""
    measure = [math.floor(4 * math.sqrt(n)) for n in sizes]
    low, high = 0.0, 1e9
    for _ in range(300):
        step = (low + high) / 2
        if sum(n * min(1, step * m) for n, m in zip(sizes, measure, strict=True)) < missing:
            low = step
        else:
            high = step
    return [min(1.0, low * m) for m in measure]


def uniform(doc):
    return (int(hashlib.md5(f"mix:{doc}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def test_mix_agrees_with_order_sampling(spark):
    rng = random.Random(2)
    docs = [(k, " ".join(["w"] * (rng.randrange(1, 60) if k % 50 else 900)), f"s{k % 4 if k % 3 else 0}") for k in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))
    by, other_order, certain = {}, 0, 0
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    for members in by.values():
        target, total = members[0]["target"], sum(r["size"] for r in members)
        assert members[0]["source_size"] == total and abs(sum(r["taken"] for r in members) - target) <= 60
        whole = math.floor(target / total)
        missing = target - whole * total
        part = dict(zip((r["doc_id"] for r in members), inclusions([r["size"] for r in members], missing) if missing > 1e-6 else [0.0] * len(members), strict=True))
        assert [r["expected"] for r in members] == pytest.approx([whole + part[r["doc_id"]] for r in members], abs=1e-6)
        sure = [r for r in members if part[r["doc_id"]] > 1 - 1e-9]
        drawn = [r for r in members if 0 < part[r["doc_id"]] <= 1 - 1e-9]
        odds = lambda r: (uniform(r["doc_id"]) / (1 - uniform(r["doc_id"]))) / (part[r["doc_id"]] / (1 - part[r["doc_id"]]))  # noqa: B023, E731
        certain += len(sure)
        assert all(r["copies"] == whole + 1 for r in sure)
        missing, before = missing - sum(r["size"] for r in sure), 0
        for r in sorted(drawn, key=odds):
            assert r["copies"] == whole + (before + r["size"] / 2 <= missing) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
            before += r["size"]
        taken = {r["doc_id"] for r in drawn if r["copies"] > whole}
        other_order += taken != {r["doc_id"] for r in sorted(drawn, key=lambda r: uniform(r["doc_id"]))[: len(taken)]}
    assert other_order and certain


def test_documents_are_included_as_often_as_they_should(spark):
    """The same 24 documents in 600 sources, each with random numbers of its own."""
    sizes = [4, 4, 9, 9, 16, 16, 25, 25, 36, 36, 49, 49, 64, 64, 81, 81, 100, 100, 144, 144, 196, 196, 900, 900]
    docs = [(s * 24 + k, " ".join(["w"] * n), f"s{s:03}") for s in range(600) for k, n in enumerate(sizes)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    for weight in (2, 1):
        of = [r for r in rows if (5, 2, 1)[int(r["source"][1:]) % 3] == weight]
        target, whole = of[0]["target"], math.floor(of[0]["target"] / sum(sizes))
        want = inclusions(sizes, target - whole * sum(sizes))
        for k in range(0, len(sizes), 2):
            mine = [r["copies"] - whole for r in of if r["doc_id"] % 24 in (k, k + 1)]
            assert sum(mine) / len(mine) == pytest.approx(want[k], abs=0.09), (weight, sizes[k])


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(entries.tokenizer_definition())


ODD = ["", "It's a TEST, isn't it? 123 don't", "<|endoftext|> <b> a<|startoftext|>b", "ÀÉÎõü ßtraße Σίσυφος ΣΑΣ", "漢字 かな 🙂🙂 é", "tab\tnew\nline\x0bx\x0c y", "a" * 5000, "x y z ​", "\x01\x7f control", "ǅ İstanbul ﬁ", "l'été qu'il n'a 3.14 !!!??"]


def test_tokens_are_the_library_s(library):
    words = WordTokens(entries.tokenizer_definition())
    for _ in range(2):  # the second time from the table
        ids, off = words.ids(pa.array(ODD), 2)
        for k, t in enumerate(ODD):
            assert ids[off[k] : off[k + 1]].tolist() == [*library.encode(t, add_special_tokens=False).ids, 2], t


def test_packing_round_trip(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = packing.pack(docs, entries.tokenizer_definition(), with_ids=True, bin_rows=64).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r["length"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"]) and 0 < r["length"] <= 4096
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for d in docs.collect():
        parts = sorted(by_doc[d["doc_id"]], key=lambda r: r["start"])
        ids = np.frombuffer(b"".join(r["ids"] for r in parts), "<u4").tolist()
        assert ids == [*library.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        assert [r["start"] for r in parts] == np.cumsum([0, *(r["length"] for r in parts)]).tolist()[:-1] and parts[0]["doc_tokens"] == len(ids)
    for s in by_sequence.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == np.cumsum([0, *(r["length"] for r in s)]).tolist()[:-1] and sum(r["length"] for r in s) <= 4096


def test_best_fit_by_brute_force():
    n = np.random.default_rng(4).integers(1, 101, 300)
    at, offset = packing.best_fit(n, 100)
    free, want = [], {}
    for k in np.argsort(-n, kind="stable").tolist():
        fits = [f for f in free if f >= n[k]]
        rest = min(fits) - n[k] if fits else 100 - n[k]
        if fits:
            free.remove(min(fits))
        free.append(rest)
        want[k] = 100 - rest - n[k]
    assert offset.tolist() == [want[k] for k in range(300)] and at.max() + 1 == len(free)


def test_edits(spark):
    docs = [(k * 3, t) for k, t in enumerate(["abcdefgh", "x", None, "some words here and there, more of them", "né" * 9])]
    got = {r["doc_id"]: r for r in simhash.with_edits(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, (i, t) in enumerate(docs):
        t, after = t or "", docs[(k + 1) % len(docs)][1] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        print_of = lambda x: simhash.fingerprints(pa.array([x])).tobytes().hex()
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (print_of(t), print_of(edited))
        like = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
        assert got[i]["near_edited"] == like(print_of(t), print_of(edited)) and got[i]["near_next"] == like(print_of(t), print_of(after))


def test_edits_with_null_ids(spark, monkeypatch):
    """Half of the ids are null: these come first, in ranges of their own; every row is edited by the one that follows it."""
    monkeypatch.setattr(simhash, "ROWS_BY_RANGE", 7)
    rows = [(None if k % 2 else k, f"text number {k % 40} of some words") for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else hashes[r[1]], r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        want.append((i, len(t), hashlib.sha256((t[: len(t) - len(t) // 4] + after[: len(t) // 4]).encode()).hexdigest()))
    placed = simhash.with_edits(df.repartition(5))
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in placed.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    used = placed.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(used) > 5 and max(r["count"] for r in used) < 60


def test_fingerprints_by_votes():
    text = "the quick brown fox jumps over it"
    from ridgeline.llm._text import hash_spans, mix, word_spans

    body, starts, lengths, _ = word_spans(pa.array([text]))
    key = hash_spans(body, starts, lengths)
    votes = np.zeros(128)
    with np.errstate(over="ignore"):
        for k in range(len(key) - 1):
            t = mix(key[k : k + 1] * np.uint64(0x9E3779B97F4A7C15) + key[k + 1])
            bits = np.unpackbits(np.r_[t, mix(t ^ np.uint64(0x5851F42D4C957F2D))].view(np.uint8))
            votes += np.where(bits, 1, -1) * min(24, lengths[k] + lengths[k + 1])
    assert np.packbits(votes > 0).tobytes() == simhash.fingerprints(pa.array([text])).tobytes()


def test_radius_search_by_brute_force(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(128) for _ in range(20)]
    prints = [f"{b ^ sum(1 << rng.randrange(128) for _ in range(rng.randrange(7))):032x}" for b in base for _ in range(8)]
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint string")
    got = {r["query"]: r["n"] for r in simhash.within(df, df).collect()}
    # every key is crowded, and is cut: nothing is lost, nothing counted twice
    assert got == {r["query"]: r["n"] for r in simhash.within(df, df, heavy=0).collect()}
    want = {p: sum((int(p, 16) ^ int(q, 16)).bit_count() <= simhash.RADIUS for q in prints) for p in prints}
    assert got == want


def test_base_scores(spark):
    docs = [(k, t) for k, t in enumerate(["a b a", "B c", None, "", "new words a", "c c c c"])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in maxent.score(df, F.col("doc_id") < 4).collect()}
    tokens = {k: [*WORD.findall((t or "").lower()), "<end>"] for k, t in docs}
    counts = {}
    for k in range(4):
        for w in tokens[k]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for k, t in tokens.items():
        base = sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in counts for w in t), n) and r["base_score"] == pytest.approx(base) and r["score"] < 0


def test_words_beyond_the_common_ones_meet_their_counts(spark, monkeypatch):
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    learn = F.col("doc_id") % 10 != 0
    want = {r["doc_id"]: r for r in maxent.score(df, learn).collect()}
    # words beyond the common ones are rare, so scores differ a little; counts and base scores do not
    monkeypatch.setattr(maxent, "COMMON", 50)
    for r in maxent.score(df, learn).collect():
        w = want[r["doc_id"]]
        assert (r["n_known"], r["base_score"], r["score"]) == (w["n_known"], pytest.approx(w["base_score"]), pytest.approx(w["score"], rel=0.15))


def test_history_tells_words_of_a_class_apart(spark):
    """Two words of equal count and ending: what stands before decides which one is likely."""
    fill = [(k, " ".join(f"w{j}" for j in range(24) for _ in range(3))) for k in range(40)]
    rows = [*fill, *((100 + k, "red zebring") for k in range(40)), *((200 + k, "blue quading") for k in range(40)), (900, "red zebring"), (901, "red quading"), (902, "blue quading"), (903, "blue zebring"), (904, "red unseening")]
    got = {r["doc_id"]: r["score"] for r in maxent.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 900).collect()}
    assert got[900] > got[901] + 0.2 and got[902] > got[903] + 0.2 and got[904] < got[900]


def test_chances_within_a_class_sum_to_one(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("text")
    counts = maxent.count_words(df)
    words = counts.toPandas()
    c = maxent.classes_of(counts, F.col("n") > 1, np.sort(words["h"].to_numpy()[words["n"].to_numpy() > 1].view("uint64")))
    key = words["h"].to_numpy().view("uint64")
    cls, outcome = c.of(key, words["ending"].to_numpy()), c.outcomes(key)
    for k in range(maxent.OWN, maxent.CLASSES):
        assert c.total[k] == c.outcome_n[k - maxent.OWN].sum()
        for t in range(maxent.TAILS):
            n = words["n"].to_numpy()[(cls == k) & (outcome == t)]
            assert n.sum() == c.rest[k, t] == c.outcome_n[k - maxent.OWN, t]
            if len(n):
                shares = (n - c.discount[k]).sum() / c.rest[k, t] + 10 ** c.unknown[k] if t == 0 else n.sum() / c.rest[k, t]
                assert shares == pytest.approx(1)


def test_scores_by_a_plain_forward_pass(spark, monkeypatch):
    """Token by token in Python: features of the history, the softmax over classes, the one within the class, the share of the outcome."""
    seen = {}
    for name in ("classes_of", "train"):
        made = getattr(maxent, name)
        monkeypatch.setattr(maxent, name, lambda *a, name=name, made=made: seen.setdefault(name, made(*a)))
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("length(text) < 3000")
    learn = F.col("doc_id") % 10 != 0
    got = {r["doc_id"]: r["score"] for r in maxent.score(df, learn).collect()}
    c, (outer, inner) = seen["classes_of"], seen["train"]
    hashes = {}

    def hash_of(word):
        if word not in hashes:
            key, ending, _ = maxent.tokens(pa.array([word]))
            hashes[word] = (int(key[0]), int(ending[0])) if word else (int(maxent.END), 0)
        return hashes[word]

    counts = {}
    for r in df.where(learn).collect():
        for w in [*WORD.findall(lower(r["text"])), ""]:
            counts[w] = counts.get(w, 0) + 1
    own, named = dict(zip(c.words.tolist(), c.word_class.tolist(), strict=True)), dict(zip(c.named.tolist(), c.outcome.tolist(), strict=True))
    chance = lambda z, y: (z[y] - max(z) - math.log(sum(math.exp(x - max(z)) for x in z))) / math.log(10)
    mixed = lambda n: int(maxent.mix(np.array([n], np.uint64))[0])
    for r in df.where("doc_id % 30 < 2").collect():
        words = [*WORD.findall(lower(r["text"])), ""]
        keys = [hash_of(w) for w in words]
        cls = [own.get(h, int(c.ending_class[e])) for h, e in keys]
        total = 0.0
        for k, w in enumerate(words):
            before = [cls[k - j] if k >= j else 0 for j in range(1, maxent.BEFORE + 1)]
            pair, last = mixed(before[0] * maxent.CLASSES + before[1] + 1), keys[k - 1][0] if k else 0
            base = 1 + maxent.BEFORE * maxent.CLASSES
            rows = [0, *(1 + j * maxent.CLASSES + b for j, b in enumerate(before)), base + pair % maxent.BUCKETS, base + maxent.BUCKETS + last % maxent.BUCKETS]
            total += chance(sum(outer[x].astype(float) for x in rows).tolist(), cls[k])
            if cls[k] < maxent.OWN:
                continue
            mine, h = cls[k] - maxent.OWN, keys[k][0]
            small = [*rows[1 : maxent.BEFORE + 1], base + pair % maxent.BUCKETS % maxent.INNER_BUCKETS, base + maxent.INNER_BUCKETS + last % maxent.BUCKETS % maxent.INNER_BUCKETS, 0]
            small = [*(x * maxent.SHARED + mine for x in small[:-1]), mine]
            n = counts.get(w, 0)
            y = named.get(h, 1 + (h >> maxent.TAIL_BITS) % (maxent.TAILS - 1) if n > 1 else 0)
            total += chance(sum(inner[x].astype(float) for x in small).tolist(), y)
            if h not in named:
                total += math.log10((n - (0 if y else c.discount[cls[k]])) / c.rest[cls[k], y]) if n else c.unknown[cls[k]]
        assert got[r["doc_id"]] == pytest.approx(total, rel=1e-4, abs=1e-2), r["doc_id"]


def slow_kernel(s, t, order=toxicity.ORDER, decay=toxicity.DECAY):
    spans = lambda x: [(c, x[c[-1]] and tuple(x[i] for i in c), c[-1] - c[0] + 1) for c in itertools.combinations(range(len(x)), order)]
    return sum(decay ** (a[2] + b[2]) for a in spans(s) for b in spans(t) if a[1] == b[1])


@pytest.mark.parametrize(("s", "t"), [("idiot", "idiot"), ("idiot", "ixdxiot"), ("moron", "maroon"), ("abc", "cba"), ("banana", "bandana")])
def test_string_kernel(s, t):
    a, b = toxicity.codes([s]), toxicity.codes([t])
    cut = b[0][b[0] > 0]
    want = slow_kernel(a[0][a[0] > 0].tolist(), cut.tolist())
    assert toxicity.kernel(a, cut)[0] == pytest.approx(want)
    assert toxicity.own_many(a)[0] == pytest.approx(slow_kernel(a[0][a[0] > 0].tolist(), a[0][a[0] > 0].tolist()))
    lcs = max(len(c) for n in range(len(s) + 1) for c in itertools.combinations(s, n) if "".join(c) in {"".join(x) for m in range(len(t) + 1) for x in itertools.combinations(t, m)})
    assert toxicity.common(a, cut)[0] == lcs
