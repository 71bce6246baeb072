"""The corpus operators' queries with production parameters, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.llm import divergence, filters, licenses
from missive.llm.common import shared_dir, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from missive.llm.pii import find

    return find(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from missive.llm.tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best segmentations of each text, the ids of the best, and what these decode to."""
    from missive.llm.pieces import encode

    docs = table(spark, sf_dir, "documents")
    coded = encode(docs, _tokenizer("piece_bpe_32k.model"), n=2, decoded=True)
    return coded.select("doc_id", "n_pieces", "scores", "pieces", "ids_crc32", "ids", F.md5(F.col("decoded").cast("binary")).alias("decoded_md5"), "round_trip")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from missive.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from missive.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from missive.llm.topk import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from missive.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from missive.llm import quality

    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from missive.llm import compression

    docs = table(spark, sf_dir, "documents")
    return compression.score(docs, compression.train(docs, table(spark, sf_dir, "labels")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from missive.llm.shards import compacted

    return compacted(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from missive.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_token_counts": op2_token_counts,
    "op3_pieces": op3_pieces,
    "op4_packing": op4_packing,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_topk": op6_topk,
    "op7_license_scan": op7_license_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_sharding": op10_sharding,
    "op11_toxicity": op11_toxicity,
    "op12_filter_interactions": op12_filter_interactions,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op7_license_scan": licenses.sql(),
    "op12_filter_interactions": filters.sql(),
    "op13_source_divergence": divergence.sql(),
    "op6_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
