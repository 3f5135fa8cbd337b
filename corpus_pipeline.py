"""The corpus pipeline: quality rules, toxicity, MinHash near-dedup, mixing, BPE.

Every stage takes (spark, docs, sf_dir) and works on all documents the stage before it kept; the
first four return the columns of ``documents``.  Verdicts come back by a key of all columns, so rows that
share an id or a text are judged each by their own, and null ids are no exception.  An empty table
passes every stage as an empty table; a score at a bound of the quality band is inside, a severity of
0.4 is outside.

* quality: documents that fail the base rules or leave their language's perplexity band go.
* toxicity: documents of expected severity 0.4 and more go; the model is fitted on the labels.
* minhash: of each group of near-duplicates (five words, 0.8) one row with an id stays, that of the
  smallest id (equal ids in the order of their keys), and one of its rows without an id.  Rows
  without words stay.
* mixing: documents that the mix takes nothing of go, those it takes in part keep the words taken,
  those it takes again come again.
* bpe: doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the hash of the decoded text.

Every stage reads whole texts, however long; further columns of any name pass the first four.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, minhash, mixing, quality, toxicity
from tidemark.llm.storage import stored


def _key_of(docs: DataFrame) -> str:
    """A name for the row key that no column of the documents has."""
    name = "pipeline_row_key"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    return docs.withColumn(key, mixing.row_key(docs))


def _without(docs: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Documents whose key has no rejection among the verdicts (key, kept)."""
    rejected = verdicts.where(~F.col("kept")).select(key).distinct()
    return docs.join(rejected, key, "left_anti").drop(key)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = _key_of(docs)
    keyed = _keyed(docs, key)
    return _without(keyed, quality.quality(keyed, id_col=key), key).select(docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    key = _key_of(docs)
    keyed = _keyed(docs, key)
    return _without(keyed, toxicity.scored(keyed, model, id_col=key), key).select(docs.columns)


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = _key_of(docs)
    keyed = _keyed(docs, key)
    groups = stored(minhash.near_duplicates(keyed, percent=80, id_col=key), "groups")
    rows = groups.join(keyed.select(key, "doc_id").distinct(), key)
    each = rows.where("n_shingles > 0").groupBy("component_id", F.col("doc_id").isNull())
    first = each.agg(F.min(F.struct("doc_id", key)).alias("first")).select(F.col(f"first.{key}").alias(key))
    wordless = groups.where("n_shingles = 0").select(key).distinct()
    one = keyed.join(first, key, "left_semi").dropDuplicates([key])
    return one.unionByName(keyed.join(wordless, key, "left_semi")).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = bpe.bpe_encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return done.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("minhash", minhash_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: SQL can express neither the perplexity model nor the regression nor the library's tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
