"""A corpus from raw documents to packed training sequences, in five stages.

Each stage gets what its predecessor kept, as a written table, and decides on whole
texts. Models are fitted on the labelled rows of the original tables. Batches of texts go
to Python by ``common.BATCH_ROWS`` rows, a setting that stays with the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.llm import compression, neardup, packing, pii, quality
from missive.llm.common import dropped, narrow_batches, scratch, stored, table


def _back(judged: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` that a scoring pass carried along."""
    return judged.select(*(F.col(f"`in_{c}`").alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees."""
    narrow_batches(spark)
    trees = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _back(quality.judge(docs, trees, carry=tuple(docs.columns)).filter("kept"), docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier calls good."""
    narrow_batches(spark)
    model = compression.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _back(compression.score(docs, model, carry=tuple(docs.columns)).filter("predicted = 1"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest id; rows without id come last.

    Rows are told apart by a number of their own, so repeated ids and null ids count
    like others: equal rows leave one, and different texts of one id are judged each.
    """
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = neardup.near_duplicates(rows, shingle_words=5, percent=80, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id")
    grouped = found.join(found.filter("component_id <> __row").select("component_id").distinct(), "component_id")
    grouped = stored(grouped.join(rows.select("__row", "doc_id"), "__row"), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__row")).alias("first")
    chosen = grouped.groupBy("component_id").agg(first).select(F.col("first.__row").alias("__row"))
    gone = grouped.select("__row").join(chosen, "__row", "left_anti")
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    narrow_batches(spark)
    # the JVM holds more after four stages than in an application that only packs, so the workers hold less
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache=40_000, chars=1_000_000)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("mask_pii", mask_pii),
    ("pack", pack),
]

#: trees, compression and tokenizers aren't expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; between stages the kept rows are written and read again.

    A stage's own tables, and what it read, go once its rows are written.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch() as result:
            docs = result(stage(spark, docs, sf_dir), name)
        if last is not None:
            dropped(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
