"""Batches as they arrive: every micro-batch is one batch of the ledger, in order of arrival."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive import schema as S
from missive.operators import routing, sensitive
from missive.plans import ledger
from missive.plans.ledger import Ledger


def stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Messages of the CSV files that arrive in a folder."""
    return spark.readStream.schema(S.MESSAGE).options(header=True, multiLine=True, escape='"', maxFilesPerTrigger=files_per_batch).csv(folder)


def masked_stream(messages: DataFrame) -> DataFrame:
    """Masking and routing are stateless, so they run on the stream itself."""
    return routing.route(sensitive.masked(messages))


def _stored(batch: DataFrame, n: int, store: str) -> None:
    """Write the records of a micro-batch below its number: raw text is never stored.

    Masking, classification, extraction and acts are done once, for this batch alone; its
    messages and items are numbered after those of the batches before, of which a row each
    says how many there are.
    """
    spark = batch.sparkSession
    about = {"batch_idx": F.lit(n), "batch_name": F.lit(f"batch_{n}"), "batch_kind": F.lit("l2" if n else "l1"), "tenant": F.lit("")}
    before = {}
    if n:
        sizes = spark.read.schema("messages long, task long, event long, batch_idx int").option("basePath", f"{store}/sizes").parquet(f"{store}/sizes")
        before = sizes.filter(F.col("batch_idx") < n).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("messages", "task", "event"))).head().asDict()
    records = ledger.records_of(ledger.enriched(batch.withColumns(about), gate=True, order=True), before)
    path = f"{store}/records/batch_idx={n}"
    records.drop("batch_idx").write.mode("overwrite").parquet(path)
    done = spark.read.parquet(path).agg(F.count("*").alias("messages"), F.count_if(F.col("item_type") == "task").alias("task"), F.count_if(F.col("item_type") == "event").alias("event"))
    done.write.mode("overwrite").parquet(f"{store}/sizes/batch_idx={n}")


def records(spark: SparkSession, store: str) -> DataFrame:
    """The records of all batches stored so far."""
    rows = spark.read.option("basePath", f"{store}/records").parquet(f"{store}/records")
    return rows.withColumn("batch_idx", F.col("batch_idx").cast("int"))


def replay(messages: DataFrame, store: str, checkpoint: str, then: Callable[[Ledger, int], None]):
    """Append the records of each micro-batch to ``store`` and hand the ledger of all batches so far to ``then``.

    The first layer costs what the new batch holds. Subject statistics are over all
    batches, so a new one may move any message: groups are folded anew from the stored
    records when ``then`` asks for them. A batch is written below its number, so a
    repeated batch replaces itself.
    """

    def step(batch: DataFrame, n: int) -> None:
        _stored(batch, n, store)
        every = records(batch.sparkSession, store)
        one = Ledger(every, layer1=every)
        then(one, n)
        one.unpersist()

    return messages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
