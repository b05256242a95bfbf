"""Corpus pipeline: from raw documents to token ids, one operator of ``panelcast.llm`` a stage.

Every stage takes (spark, docs, sf_dir), where docs is what the stage before it kept, and
returns documents (the last one token ids).  ``run`` writes each stage as Parquet in the
shared checkpoint folder and reads it again for the next, so a lost executor costs at most
the stage at work.

toxicity    documents that the classifier calls toxic go
quality     documents that it calls poor go
near_dedup  of documents whose 5-word shingle sets are 0.8 alike (and so connected) one stays
mixing      documents are sampled with probabilities raked to source, language and topic shares
bpe         token ids, and the digest of the text that they decode to

The models are fitted on the documents that reach their stage, with the training labels of
``sf_dir``; the same parameters hold at every size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import bpe_table, jaccard_join, mixing, quality, toxicity
from panelcast.llm.common import materialize, table
from panelcast.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = docs.withColumn("__score", toxicity.score(toxicity.fit(docs, table(spark, sf_dir, "labels")), F.col("text")))
    return scored.where(F.col("__score") < toxicity.THRESHOLD).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = docs.withColumn("__score", quality.score(quality.fit(docs, table(spark, sf_dir, "labels")), F.col("text")))
    return scored.where(F.col("__score") >= quality.THRESHOLD).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, words=5, num=80, den=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded_sha256 of every document that is left."""
    out = bpe_table.encode(docs, tokenizer_path())
    return out.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_dedup", one_of_each_group),
    ("mixing", mix),
    ("bpe", encode),
]

#: Two stages are trained classifiers and the last one is a tokenizer: not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
