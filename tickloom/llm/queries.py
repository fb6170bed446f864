"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import ball_codes, bisector_clusters, bpe, cap_filters, html_extract, kneser_ney, license_scan, line_dedup, ngram_join, oracle, packing, phrase_index, quality_rules, token_files
from tickloom.settings import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return kneser_ney.score_documents(docs, labels).drop("row_hash")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = scratch_path(spark, "token-files")
    shards = token_files.write_token_files(table(spark, sf_dir, "documents"), folder, path, end_id=2)
    return token_files.read_token_files(spark, shards).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    texts = html_extract.extract_pages(pages, html_extract.train(spark, pages))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(table(spark, sf_dir, "documents"), ngram_join.JoinSettings(width=3, percent=90))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_rules.measure_quality(table(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "common_words")


def op8_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    decoded = bpe.decode_documents(encoded, path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), path, size=1024, end_id=0)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op11_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)


def op12_bisector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisector_clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_codes.encode_vectors(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


ALL: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    op1_kneser_ney, op2_token_files, op3_html_extract, op4_ngram_join, op5_license_scan, op6_line_dedup, op7_quality_rules, op8_cap_filters, op9_byte_bpe, op10_packing,
    op11_phrase_index, op12_bisector_clusters, op13_ball_codes, pipeline,
)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in ALL}


def statements() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {
        "op11_phrase_index": oracle.phrase_index(),
        "op12_bisector_clusters": oracle.bisector_clusters(),
        "op13_ball_codes": oracle.ball_codes(),
    }
