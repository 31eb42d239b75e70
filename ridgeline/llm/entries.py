"""Queries of this subpackage for the driver: name -> (spark, sf_dir) -> DataFrame, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from ._text import table
from .labelled import fold


def tokenizer_definition(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's definition, read on the driver and shipped to the tasks (under 2 MB)."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def pseudonym_key(spark: SparkSession) -> str:
    """The session's `ridgeline.pseudonym.key`; the queries' tables are invented, so they do with a public one."""
    return spark.conf.get("ridgeline.pseudonym.key", "key for invented tables")


def op9_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_definition())


def op1_toxicity_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    held_out = fold("doc_id", 3) == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels"), ~held_out).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op3_mix_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


def op5_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maxent import score

    held_out = fold("doc_id", 10) == 0
    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .private import pseudonymise

    docs = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pseudonym_key(spark))
    return docs.select("doc_id", "text", F.size("private").cast("long").alias("n_values"), F.transform("private", lambda v: v["kind"]).alias("kinds"))


def op7_language_byte_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 4) == 2
    return identify(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_simhash_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import report

    return report(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id") % 50 == 0)


def op10_quality_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    held_out = fold("doc_id", 5) == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels"), ~held_out).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_heap_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codes import compressed

    return compressed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    return manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 3 == 0)


def op13_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_string_kernel": op1_toxicity_string_kernel,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_mix_pareto": op3_mix_pareto,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_maxent_scores": op5_maxent_scores,
    "op6_pseudonyms": op6_pseudonyms,
    "op7_language_byte_net": op7_language_byte_net,
    "op10_quality_additive": op10_quality_additive,
    "op8_simhash_edits": op8_simhash_edits,
    "op9_pack_best_fit": op9_pack_best_fit,
    "op11_heap_lloyd": op11_heap_lloyd,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_exact_duplicates": op13_exact_duplicates,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
""",
    "op3_mix_pareto": """
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w
  FROM d GROUP BY source
), g(step, source, source_size, w, full_up) AS (
  SELECT 0, source, source_size, w, false FROM s
  UNION ALL
  SELECT step + 1, source, source_size, w,
    full_up OR w * (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) FILTER (WHERE full_up) OVER (), 0)) / (sum(w) FILTER (WHERE NOT full_up) OVER ()) > 2.0::DOUBLE * source_size
  FROM g WHERE step < 60
), t AS (
  SELECT source, source_size, CASE WHEN full_up THEN 2.0::DOUBLE * source_size
    ELSE w * (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) FILTER (WHERE full_up) OVER (), 0)) / (sum(w) FILTER (WHERE NOT full_up) OVER ()) END AS target
  FROM g WHERE step = 60
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
    t.target - CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END * t.source_size AS missing, d.u, d.source, floor(4.0::DOUBLE * sqrt(d.size::DOUBLE)) AS measure
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), m AS (
  SELECT source, measure, any_value(missing) AS missing, sum(size)::DOUBLE AS words FROM r WHERE size > 0 AND missing > 1e-6 GROUP BY source, measure
), p AS (
  SELECT source, measure, coalesce(sum(words) OVER (PARTITION BY source ORDER BY measure DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS certain, missing,
    sum(measure * words) OVER (PARTITION BY source ORDER BY measure DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM m
), i AS (
  SELECT source, arg_max((missing - certain) / rest, measure) AS step, arg_max(certain, measure) AS certain FROM p WHERE (missing - certain) / rest * measure < 1 GROUP BY source
), c AS (
  SELECT r.doc_id, r.size, r.source_size, r.target, r.whole, r.source, r.u, r.missing - coalesce(i.certain, 0) AS missing, least(1.0::DOUBLE, coalesce(i.step, 0) * r.measure) AS part
  FROM r LEFT JOIN i ON i.source IS NOT DISTINCT FROM r.source
), o AS (
  SELECT *, CASE WHEN part > 0 AND part < 1 THEN (u / (1 - u)) / (part / (1 - part)) END AS odds FROM c
)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN odds IS NULL THEN (part >= 1)::INTEGER
    WHEN coalesce(sum(size) OVER (PARTITION BY source, odds IS NULL ORDER BY odds / (1 + odds) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0 <= missing THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
""",
    "op4_near_duplicates": """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d
), n AS (
  SELECT d.doc_id, count(s.g) AS n FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 75 * (nx.n + ny.n - i)
), b AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), c(doc_id, r) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT c.doc_id, b.y FROM c JOIN b ON c.r = b.x
)
SELECT n.doc_id, n.n AS n_shingles, min(c.r) AS component_id, n.doc_id = min(c.r) AS kept
FROM n JOIN c ON c.doc_id = n.doc_id GROUP BY n.doc_id, n.n
""",
    "op11_heap_lloyd": sql.CODES,
    "op12_merkle_manifest": sql.MERKLE,
    "op13_exact_duplicates": sql.EXACT,
}
