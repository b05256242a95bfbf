"""Registered queries of the corpus operators: each applies its operator, with the
production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import (
    ball_codes,
    bpe_table,
    chat,
    embedding_dedup,
    jaccard_join,
    license_scan,
    merkle,
    mixing,
    quality,
    sharding,
    substring_dedup,
    topk_search,
    toxicity,
)
from panelcast.llm.common import table, train_fold

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(fn: Query) -> Query:
        REGISTRY[name] = (fn, sql)
        return fn
    return put


@register("op1_mixing", mixing.oracle_sql())
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.sampling_plan(table(spark, sf_dir, "documents"))
    return plan.select(
        "doc_id", F.coalesce("source", F.lit(mixing.NO_VALUE)).alias("source"),
        F.coalesce("lang", F.lit(mixing.NO_VALUE)).alias("lang"), "topic", "tokens",
        F.round("probability", 6).alias("probability"), "sampled")


@register("op2_chat", chat.ORACLE_SQL)
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_hostile(table(spark, sf_dir, "conversations"))
    return chat.digests(chat.format_conversations(turns))


@register("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (~train_fold(F.col("doc_id"))).alias("held_out"), "score", "predicted")


@register("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (~train_fold(F.col("doc_id"))).alias("held_out"), "score", "predicted")


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ')
                               ELSE array_to_string(w[i:i + 2], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b USING (s)
                    WHERE a.doc_id <> b.doc_id GROUP BY ALL)
  JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents
          UNION SELECT l.x, reach.r FROM reach JOIN links l ON l.y = reach.id)
SELECT d.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.id = d.doc_id GROUP BY d.doc_id
"""


@register("op5_jaccard_join", OP5_SQL)
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
                  CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
           FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""


@register("op6_license_scan")
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "paragraph", "family", F.round("probability", 4).alias("probability"),
                        F.round("similarity", 4).alias("similarity"), "confirmed", F.sha2("text", 256).alias("text_sha256"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op7_bpe")
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_table.encode(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@register("op8_topk", OP8_SQL)
def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors.where("vec_id % 50 = 0"), vectors, k=5)


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
links AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS id, vec_id AS r FROM v
          UNION SELECT l.x, reach.r FROM reach JOIN links l ON l.y = reach.id)
SELECT v.vec_id, CAST((SELECT count(*) FROM links WHERE x = v.vec_id) AS BIGINT) AS n_links,
       min(r) AS component_id, v.vec_id = min(r) AS kept
FROM v JOIN reach ON reach.id = v.vec_id GROUP BY v.vec_id
"""


@register("op9_embedding_dedup", OP9_SQL)
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


@register("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=8)


@register("op11_merkle_manifest", merkle.oracle_sql())
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


@register("op12_substring_dedup", substring_dedup.ORACLE_SQL)
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@register("op13_ball_codes", ball_codes.oracle_sql())
def op13_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_codes.codes(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


def queries() -> dict[str, Query]:
    return {name: fn for name, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
