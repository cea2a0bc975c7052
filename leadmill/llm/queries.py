"""The queries of the thirteen operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.llm import bpe_codec, centroid_clusters, chosen_paths, chunk_fingerprints, license_scan, merkle_manifest, packing, quality_model, quality_rules, secret_scan, simhash, substring_dedup, token_counts
from leadmill.llm.common import documents


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(license_scan.document_paths(documents(spark, sf_dir)))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return out.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_fingerprints.fingerprint_pairs(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(documents(spark, sf_dir), ["doc_id"])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *[F.col(f"m.{c}") for c in counts], F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.verified(documents(spark, sf_dir))


def op12_chosen_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_paths.near_duplicates(documents(spark, sf_dir))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroid_clusters.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    # Sums of distances of up to 2**62 could pass a long's range, which no table of unit-like vectors comes near.
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", F.col("cluster_inertia").cast("long").alias("cluster_inertia"), F.col("inertia").cast("long").alias("inertia"), "centroid_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_substring_dedup, op3_byte_bpe, op4_simhash, op5_secret_scan, op6_quality_model, op7_chunk_fingerprints, op8_token_counts,
        op9_packing, op10_quality_rules, op11_merkle_manifest, op12_chosen_paths, op13_centroid_clusters,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP2 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d),
g AS (SELECT doc_id, pos, array_to_string(w[pos : pos + 19], ' ') AS gram FROM p WHERE pos + 19 <= len(w)),
later AS (SELECT doc_id, pos FROM g QUALIFY row_number() OVER (PARTITION BY gram ORDER BY doc_id, pos) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM later),
kept AS (SELECT p.doc_id, count(*) AS n, string_agg(p.w[p.pos], ' ' ORDER BY p.pos) AS text FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.pos = gone.pos WHERE gone.pos IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def _op10() -> str:
    """The base counts by windows over exploded words; the verdict from the same table of thresholds."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
    passes = " AND ".join(f"(n_words < {r.from_words} OR coalesce({r.numerator} / nullif({r.denominator}, 0)::DOUBLE BETWEEN {r.least} AND {r.most}, true))" for r in quality_rules.RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS pos FROM d WHERE len(w) >= 5),
g AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, array_to_string(w[pos : pos + 4], ' ')) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(pos, pos + 5)) AS q FROM g WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaims,
    len(list_filter(w, lambda x: list_contains([{stop}], lower(x)))) AS n_stop_words, len(list_filter(w, lambda x: regexp_matches(x, '\\pL'))) AS n_letter_words
  FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {passes} AS good FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good AS kept FROM b
"""


ORACLE_SQL = {"op1_license_scan": license_scan.oracle(), "op2_substring_dedup": _OP2, "op10_quality_rules": _op10(), "op11_merkle_manifest": merkle_manifest.oracle(), "op12_chosen_paths": chosen_paths.oracle(), "op13_centroid_clusters": centroid_clusters.oracle()}
