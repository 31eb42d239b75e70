"""The stages one by one against plain Python, and held-out accuracy of what is trained."""

import math
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from ridgeline.llm import entries
from ridgeline.llm.language import UNKNOWN, identify

from .test_brute_force import WORD, groups, inclusions, library, shingles, texts, uniform  # noqa: F401

DATA = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    raw = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "", "en", "src0", 0), (9003, "12 34 !!", "en", None, 8), (None, "the and of this with that have been other words", "en", "src1", 47)], "doc_id long, text string, lang string, source string, n_chars long")
    return raw.unionByName(odd).unionByName(raw.limit(3)).withColumn("score", F.lit("extra")).withColumn("_key", F.lit(1)).withColumn("private", F.lit(2))


def rows(df):
    return [r.asDict() for r in df.collect()]


def key(r):
    return (str(r["doc_id"]), r["text"] or "")


def test_language_keeps_clean_documents(spark, docs):
    got = STAGES["language"](spark, docs, DATA)
    assert got.columns == docs.columns
    gone = {r["doc_id"] for r in docs.select("doc_id").exceptAll(got.select("doc_id")).collect()}
    assert {9001, 9002, 9003} <= gone
    assert got.count() >= docs.count() - 3 - 2


def test_one_of_each_group_stays(spark, docs):
    mine = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts(4, 20))], "doc_id long, text string, lang string, source string, n_chars long")
    both = mine.unionByName(mine.limit(5)).withColumn("_key", F.lit("kept"))
    got = STAGES["near_duplicates"](spark, both, DATA)
    want = [k for k, w in enumerate(groups([shingles(t) for t in texts(4, 20)])) if k == w]
    assert sorted(r["doc_id"] for r in got.collect()) == want and got.columns == both.columns
    full = STAGES["near_duplicates"](spark, docs, DATA)
    assert full.columns == docs.columns and full.where("doc_id in (9001, 9002)").count() == 2


def test_private_values_go(spark, docs):
    got = STAGES["private"](spark, docs, DATA)
    before, after = sorted(rows(docs), key=key), got
    assert after.columns == docs.columns and after.count() == len(before)
    mail = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+")
    old = {m.split("@")[0] for r in before for m in mail.findall(r["text"] or "")}
    new = {m.split("@")[0] for r in rows(after) for m in mail.findall(r["text"] or "")}
    assert len(old) == len(new) and not {o for o in old if len(o) > 6} & new


def test_mix_repeats_documents(spark, docs):
    from ridgeline.llm.mixing import mix

    got = STAGES["mix"](spark, docs, DATA)
    assert got.columns == docs.columns
    taken = {}
    for r in mix(docs.select("doc_id", "text", "source")).collect():
        taken[r["doc_id"], r["h"]] = taken.get((r["doc_id"], r["h"]), 0) + r["copies"]
    counted = {(r["doc_id"], r["h"]): r["count"] for r in got.select("doc_id", F.xxhash64("text").alias("h")).groupBy("doc_id", "h").count().collect()}
    assert counted == {k: v for k, v in taken.items() if v}


def test_run_is_the_stages_in_turn(spark):
    got = corpus_pipeline.run(spark, DATA)
    step = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, DATA)
        if name == "mix":
            last = step
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, step.select(columns).collect()))
    assert got.where("start = 0").count() == last.count()


def plain_targets(sizes):
    """Words of each source: 150 % of all by weight, twice its size at most, the excess shared again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full = set()
    while rest := [s for s in order if s not in full]:
        level = (1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in rest)
        over = {s for s in rest if weight[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else weight[s] * level for s in order}
        full |= over
    return {s: 2 * sizes[s] for s in order}


def plain_copies(members, target):
    """id -> copies of the documents of one source, members: (id, size)."""
    total = sum(n for _, n in members)
    whole = math.floor(target / total) if total else 0
    missing = target - whole * total if total else 0.0
    part = dict(zip((d for d, _ in members), inclusions([n for _, n in members], missing), strict=True)) if missing > 1e-6 else dict.fromkeys((d for d, _ in members), 0.0)
    copies = {d: whole + (part[d] > 1 - 1e-9) for d, _ in members}
    missing, before = missing - sum(n for d, n in members if part[d] > 1 - 1e-9), 0
    odds = lambda d: (uniform(d) / (1 - uniform(d))) / (part[d] / (1 - part[d]))
    for d, n in sorted(((d, n) for d, n in members if 0 < part[d] <= 1 - 1e-9), key=lambda m: odds(m[0])):
        copies[d] += before + n / 2 <= missing
        before += n
    return copies


def test_every_stage_by_plain_python(spark, library, tmp_path):  # noqa: F811
    """What run() hands from stage to stage, and what it returns, against plain versions of the stages."""
    raw = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    first = raw.orderBy("doc_id").limit(25).collect()
    more = [(80_000 + k, r["text"] + " and one more word", r["lang"], "src1", 0) for k, r in enumerate(first)]
    more += [(81_000 + k, r["text"].upper(), None, None, 0) for k, r in enumerate(first[:9])]
    more += [(82_000 + k, t + " 12 ", "en", "src2", 0) for k, t in enumerate(texts(9, 8))]
    more += [(83_000, None, "en", "src1", 0), (83_001, "", None, "src1", 0), (83_002, "12 -- 34", "en", "src3", 8), (83_003, f"{first[0]['text']} write to jane.roe@mail.example or call", "en", "src3", 0)]
    more += [(83_010 + k, f"please write to jane.roe@mail.example about number {k} " + r["text"], r["lang"], "src4", 0) for k, r in enumerate(first[9:13])]
    raw.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long")).write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}

    def watched(name, stage):
        def watch(spark, docs, sf_dir):
            seen[name] = sorted(rows(docs), key=key)
            return stage(spark, docs, sf_dir)

        return watch

    packed = rows(corpus_pipeline.run(spark, str(tmp_path), [(n, watched(n, s)) for n, s in corpus_pipeline.STAGES]))
    by_key = lambda found: sorted(found, key=key)

    # language: the documents that the network tells a language of, with it where none was given
    told = {r["doc_id"]: r for r in identify(spark.read.parquet(f"{tmp_path}/documents.parquet"), F.lit(True), names=("told", "sure")).collect()}
    clear = [r for r in seen["language"] if told[r["doc_id"]]["told"] != UNKNOWN and told[r["doc_id"]]["sure"] >= corpus_pipeline.LEAST_SCORE]
    assert seen["near_duplicates"] == by_key([{**r, "lang": r["lang"] or told[r["doc_id"]]["told"]} for r in clear])
    assert {83_000, 83_001, 83_002} <= {r["doc_id"] for r in seen["language"]} - {r["doc_id"] for r in clear}

    # near duplicates: all pairs
    in_order = sorted(seen["near_duplicates"], key=lambda r: r["doc_id"])
    root = groups([shingles(r["text"]) for r in in_order])
    assert seen["private"] == by_key([r for k, r in enumerate(in_order) if root[k] == k]) and len(seen["private"]) < len(in_order) - 20

    # private values: nothing but values changes, and equal ones stay equal
    after = {r["doc_id"]: r for r in seen["mix"]}
    mail, value = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), re.compile(r"\S*[0-9@]\S*")
    names = {}
    assert len(after) == len(seen["mix"]) == len(seen["private"])
    for r in seen["private"]:
        new = after[r["doc_id"]]
        assert {**r, "text": None} == {**new, "text": None}
        assert value.sub(" ", r["text"]) == value.sub(" ", new["text"])
        for old, made in zip(mail.findall(r["text"]), mail.findall(new["text"]), strict=True):
            assert old != made and names.setdefault(old, made) == made
    assert len(set(names.values())) == len(names) and any(m.startswith("jane.roe@") for m in names)

    # mix: order sampling by source
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in seen["mix"]}
    sources = {}
    for r in seen["mix"]:
        sources.setdefault(r["source"], []).append((r["doc_id"], size[r["doc_id"]]))
    target = plain_targets({s: sum(n for _, n in m) for s, m in sources.items()})
    copies = {d: n for s, m in sources.items() for d, n in plain_copies(m, target[s]).items()}
    assert seen["pack"] == by_key([r for r in seen["mix"] for _ in range(copies[r["doc_id"]])]) and len(set(copies.values())) > 1

    # packing: every id of every copy once, as many sequences as best fit makes
    ids = {r["doc_id"]: [*library.encode(r["text"], add_special_tokens=False).ids, 2] for r in seen["mix"]}
    assert sum(r["length"] for r in packed) == sum(len(ids[r["doc_id"]]) for r in seen["pack"])
    pieces, sequences = {}, {}
    for r in packed:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids"] == np.array(part, "<u4").tobytes() and r["ids_crc32"] == zlib.crc32(r["ids"]) and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"], r["start"], r["length"]] = pieces.get((r["doc_id"], r["start"], r["length"]), 0) + 1
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(n == copies[d] for (d, _, _), n in pieces.items())
    assert {d: sum(n for (e, _, n) in pieces if e == d) for d, n in copies.items() if n} == {d: len(ids[d]) for d, n in copies.items() if n}
    free = []
    for n in sorted((r["length"] for r in packed), reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free.remove(min(fits))
        free.append((min(fits) if fits else 4096) - n)
    assert len(sequences) == len(free)
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0, *(n for _, n in s)]).tolist()[:-1] and sum(n for _, n in s) <= 4096


@pytest.mark.parametrize("stage", ["language", "near_duplicates", "private", "mix"])
def test_columns_of_any_name_keep_their_values(spark, stage):
    """No stage reads, changes or trips over a column that has a name of its own."""
    names = ("key", "wanted_key", "taken_key", "language", "score", "private", "found", "parts", "copies", "rows", "row", "copy", "h", "n", "id", "size", "_key", "_row", "_copies", "_private")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in names})
    got = STAGES[stage](spark, docs, DATA)
    assert got.columns == docs.columns and got.count() > 0
    assert got.where(" OR ".join(f"`{c}` IS DISTINCT FROM concat('{c}', doc_id)" for c in names)).count() == 0


def test_empty_corpus(spark, docs):
    for name in ("language", "near_duplicates", "private", "mix"):
        assert STAGES[name](spark, docs.limit(0), DATA).count() == 0


@pytest.mark.parametrize(("name", "label", "least"), [("op1_toxicity_string_kernel", "toxic", 0.93), ("op10_quality_additive", "quality", 0.95)])
def test_held_out_labels(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    got = entries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col(label)).cast("int")).alias("a")).first()["a"] >= least


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    got = entries.QUERIES["op7_language_byte_net"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("a")).first()["a"] >= 0.99


def test_held_out_words(spark):
    r = entries.QUERIES["op5_maxent_scores"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"]
