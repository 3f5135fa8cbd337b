"""The numbered queries over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, filter_audit, importance, line_dedup, minhash, mixing, quality, sharding, token_counts, token_files, toxicity, warc
from .storage import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), sharding.shard_tree(8), sharding.shard_tree(9))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.bpe_encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    read = token_files.read_token_files(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, pieces, slots = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.taken_words(targets, pieces, slots)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.response_records(table(spark, sf_dir, "pages")))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.lines_removed(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = importance.importance_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), longest=2, buckets=10_000, percent=25, min_words=20, seed=7)
    return done.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_sharding": op2_sharding,
    "op3_bpe": op3_bpe,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_token_files": op7_token_files,
    "op8_mixing": op8_mixing,
    "op9_warc": op9_warc,
    "op10_minhash": op10_minhash,
    "op11_filter_audit": op11_filter_audit,
    "op12_line_dedup": op12_line_dedup,
    "op13_importance": op13_importance,
}
ORACLES: dict[str, str] = {
    "op2_sharding": sharding.oracle(sharding.shard_tree(8), sharding.shard_tree(9)),
    "op4_embedding_dedup": embedding_dedup.oracle(0.9),
    "op9_warc": warc.oracle(),
    "op10_minhash": minhash.oracle(85),
    "op11_filter_audit": filter_audit.oracle(),
    "op12_line_dedup": line_dedup.oracle(10, 1),
    "op13_importance": importance.oracle(),
}
