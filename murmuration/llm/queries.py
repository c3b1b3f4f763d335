"""Thin queries over the tables: one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.llm import bpe, decontam, licenses, lines, merkle, mixing, neardup, ordinal, rules, sharding, statements, substrings, toxicity, trie


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "hits", "weight")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(), ["doc_id"], digest=True)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(table(spark, sf_dir, "documents"), k=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"), ["doc_id"], length=100, digest=True)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ordinal.fit(ordinal.graded_rows(docs, table(spark, sf_dir, "labels")), grades=3)
    graded = ordinal.grade(docs, model, ["doc_id"])
    return graded.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("tail_prob", 6).alias("tail_prob"), "kept")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=24)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), words=lines.WORDS)
    counts = [F.col(c).cast("long").alias(c) for c in ("n_lines", "n_removed_lines", "n_runs")]
    return cut.select("doc_id", *counts, F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(changed, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    found = merkle.build(docs, ["doc_id", "source", "lang", "n_chars", "text"], tampered={"text": text})
    folded = merkle.fold(F.col("path"), F.col("changed"))
    told = found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, weights=(3, 1, 2), share=1.5, most=2).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_toxicity, op3_histogram_shards, op4_bpe, op5_line_dedup, op6_decontamination, op7_near_duplicates,
        op8_suffix_dedup, op9_license_scan, op10_ordinal_quality, op11_prefix_trie, op12_merkle_manifest, op13_source_mix,
    )
}

#: Runs of three lines, and one or two lines of over 50 words together.
OP5_SQL = r"""
WITH lines AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS x FROM documents),
full_lines AS (SELECT doc_id, i, x, regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS y,
  row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w
  FROM lines WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
starts AS (SELECT doc_id, r, y, w, lead(y, 1) OVER d AS y1, lead(y, 2) OVER d AS y2, lead(w, 1) OVER d AS w1
  FROM full_lines WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
cut AS (SELECT doc_id, r, 3 AS size, [y, y1, y2] AS c FROM starts WHERE y2 IS NOT NULL
  UNION ALL SELECT doc_id, r, 2, [y, y1] FROM starts WHERE y1 IS NOT NULL AND w + w1 > 50
  UNION ALL SELECT doc_id, r, 1, [y] FROM starts WHERE w > 50),
later AS (SELECT doc_id, r, size FROM
  (SELECT doc_id, r, size, row_number() OVER (PARTITION BY c ORDER BY doc_id, r) AS occurrence FROM cut) o WHERE occurrence > 1),
gone AS (SELECT DISTINCT doc_id, r + k AS r FROM later, (VALUES (0), (1), (2)) AS v(k) WHERE k < size),
opens AS (SELECT g.doc_id, count(*) AS n FROM gone g LEFT JOIN gone p ON p.doc_id = g.doc_id AND p.r = g.r - 1 WHERE p.r IS NULL GROUP BY g.doc_id),
counted AS (SELECT f.doc_id, count(*) AS n_lines, count(g.r) AS n_removed
  FROM full_lines f LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.r = f.r GROUP BY f.doc_id),
kept AS (SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.i) AS t FROM lines l LEFT JOIN full_lines f ON f.doc_id = l.doc_id AND f.i = l.i
  LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.r = f.r WHERE g.r IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed_lines, coalesce(o.n, 0) AS n_runs, sha256(coalesce(k.t, '')) AS kept_sha256
FROM documents d LEFT JOIN counted c ON c.doc_id = d.doc_id LEFT JOIN opens o ON o.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

OP7_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS s FROM words),
one AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(s)) AS rep, s FROM sets),
flat AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM one WHERE doc_id = rep),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM flat a JOIN flat b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * k >= 80 * (n + m - k) UNION SELECT b, a FROM pairs WHERE 100 * k >= 80 * (n + m - k) UNION SELECT doc_id, rep FROM one WHERE len(s) > 0 AND doc_id <> rep UNION SELECT rep, doc_id FROM one WHERE len(s) > 0 AND doc_id <> rep),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, c.component_id = s.doc_id AS kept FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = s.doc_id
"""

ORACLE: dict[str, str] = {"op5_line_dedup": OP5_SQL, "op7_near_duplicates": OP7_SQL, "op11_prefix_trie": statements.OP11, "op12_merkle_manifest": statements.OP12}
