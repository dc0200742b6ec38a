"""The operators as registered queries, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, decontaminate, fingerprints, licenses, merkle, minhash, packing, pii, quality, sql, substrings, trie, urls, warc
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered=F.crc32(F.col("doc_id").cast("string")) % 7 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ALL = (
    op1_license_scan,
    op2_minhash_near_dedup,
    op3_url_filter,
    op4_suffix_dedup,
    op5_warc,
    op6_pii,
    op7_decontaminate,
    op8_best_fit_packing,
    op9_nearest_vectors,
    op10_quality,
    op11_conversation_trie,
    op12_document_fingerprints,
    op13_merkle_manifest,
    pipeline,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_PATTERNS = " ".join(f"when regexp_matches(url, '{r.pattern}') then '{r.name}'" for r in urls.PATTERN_RULES)
ORACLE: dict[str, str] = {
    "op1_license_scan": licenses.oracle(),
    "op2_minhash_near_dedup": sql.NEAR_DUPLICATES.replace("DOCS", "documents"),
    "op3_url_filter": sql.URL_VERDICTS.replace("PATTERNS", _PATTERNS),
    "op5_warc": sql.WARC_ROUND_TRIP,
    "op9_nearest_vectors": sql.NEAREST_VECTORS,
    "op11_conversation_trie": sql.CONVERSATION_TRIE,
    "op13_merkle_manifest": sql.MERKLE_MANIFEST,
}
