"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F
from ridgeline.llm import language, maxent, mixing, neardup, packing, private, quality, simhash, topk, toxicity
from ridgeline.llm.entries import tokenizer_definition

LONG = "word " * 60_000 + "x" * 70_000
ROWS = [
    (1, "one two three four five six", "en", "a"),
    (1, "one two three four five six", "en", "a"),  # repeated
    (1, "another text under the same id", "en", "b"),
    (2, None, "de", None),
    (3, "", None, "a"),
    (4, " \t\n ", "fr", ""),
    (None, "a row without an id", "en", "a"),
    (None, None, None, None),
    (5, LONG, "en", "b"),
    (6, "12 34 -- !!", "es", "b"),
    (7, "ünïcödé 漢字 🙂 ​ ß", "de", "c"),
    (8, "word", "en", "c"),
]
CLASH = ("score", "predicted", "lang_pred", "row", "h", "n", "a", "id", "kept", "private", "size", "copies", "sequence_id", "_bin", "y", "_id", "node", "rank")


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("other") for c in CLASH})


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (4, 1, 0), (8, 0, 1), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "toxicity": (lambda d, x: toxicity.classify(d, x, F.lit(True)), ("score", "predicted")),
    "quality": (lambda d, x: quality.classify(d, x, F.lit(True)), ("score", "predicted")),
    "language": (lambda d, x: language.identify(d, F.lit(True)), ("lang_pred", "score")),
    "mixing": (lambda d, x: mixing.mix(d), ("doc_id", "size", "source_size", "target", "taken")),
    "neardup": (lambda d, x: neardup.near_duplicates(d), ("doc_id", "n_shingles", "component_id", "kept")),
    "maxent": (lambda d, x: maxent.score(d, F.lit(True)), ("n_tokens", "n_known", "train_tokens", "base_score", "score")),
    "private": (lambda d, x: private.pseudonymise(d, "key"), ("text", "private")),
    "simhash report": (lambda d, x: simhash.report(d.select("doc_id", "text"), F.col("doc_id") % 2 == 0), ("n_chars", "fingerprint", "n_within")),
    "simhash": (lambda d, x: simhash.with_edits(d), ("n_chars", "edited_sha256", "fingerprint", "near_edited")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(docs, labels, name):
    apply, columns = OPERATORS[name]
    got = apply(docs, labels)
    assert set(columns) <= set(got.columns) and len(set(got.columns)) == len(got.columns)
    assert got.count() == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(none, labels, name):
    apply, columns = OPERATORS[name]
    got = apply(none, labels.limit(0))
    assert set(columns) <= set(got.columns) and got.count() == 0


def test_repeated_rows_agree_and_nulls_are_defined(docs, labels):
    """Values of odd rows, not only their number: rows 1 and 1 are equal; 2 has no text, 3 an empty one; the ids of two rows are null."""
    by_id = lambda rows, i: [tuple(v for k, v in r.asDict().items() if k not in ("sequence_id",)) for r in rows if r["doc_id"] == i]
    for name in ("toxicity", "quality", "language", "maxent", "private", "neardup"):
        rows = OPERATORS[name][0](docs, labels).collect()
        same = by_id(rows, 1)
        assert len(same) == 3 and len(set(map(repr, same))) == 2, name
    near = {(r["doc_id"], r["n_shingles"]): r for r in neardup.near_duplicates(docs).collect()}
    assert near[1, 2]["component_id"] == 1 and near[1, 2]["kept"] and near[2, 0]["component_id"] == 2 and near[3, 0]["kept"]
    assert near[None, 0]["component_id"] is None and near[None, 0]["kept"] and near[None, 1]["kept"]
    mixed = [r for r in mixing.mix(docs).collect()]
    assert [r["size"] for r in mixed if r["doc_id"] in (2, 3, 4)] == [0, 0, 0] and sum(r["size"] for r in mixed if r["source"] is None) == 0
    assert all(r["taken"] == r["size"] * r["copies"] and r["copies"] in (0, 1, 2) for r in mixed)
    assert {r["doc_id"]: r["text"] for r in private.pseudonymise(docs, "key").where("doc_id in (2, 3)").collect()} == {2: None, 3: ""}
    prints = {r["doc_id"]: r["fingerprint"] for r in simhash.with_edits(docs).where("doc_id in (2, 3, 4)").collect()}
    assert set(prints.values()) == {"0" * 32}


def test_scores_are_defined(docs, labels):
    for name in ("toxicity", "quality", "language"):
        for r in OPERATORS[name][0](docs, labels).collect():
            assert 0 <= r["score"] <= 1
    und = {r["doc_id"] for r in language.identify(docs, F.lit(True)).where("lang_pred = 'und'").collect()}
    assert {2, 3, 4, 6} <= und and not und & {1, 5, 7, 8}
    scored = maxent.score(docs, F.lit(True)).orderBy("n_tokens").collect()
    assert [r["n_tokens"] for r in scored[:4]] == [1, 1, 1, 1] and scored[-1]["n_tokens"] == 60_002


def test_packing_odd_rows(docs, none):
    got = packing.pack(docs, tokenizer_definition(), with_ids=True).collect()
    assert {(r["doc_id"], r["doc_tokens"]) for r in got} >= {(2, 1), (3, 1), (4, 1), (None, 1)}
    assert sum(1 for r in got if r["start"] == 0) == len(ROWS)
    assert packing.pack(none, tokenizer_definition()).count() == 0


def test_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (None, [1.0, 1.0]), (6, []), (7, [1.0]), (50, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [3.0, -4.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("other"))
    got = topk.top_k(v, F.col("vec_id") == 50).orderBy("rank").collect()
    best = 256 * 256 * 5
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, best), (2, 1, best), (3, 8, best), (4, 9, -best)]
    assert topk.top_k(v.limit(0), F.lit(True)).count() == 0
