"""Evaluation: classification reports, ranking quality, agreement of rankings, and latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(predicted: DataFrame, gold: DataFrame, key: str = "message_id") -> DataFrame:
    """One row: accuracy over all, unambiguous and ambiguous rows. Frames: (key, predicted), (key, label, ambiguous)."""
    hit = F.when(F.col("predicted") == F.col("label"), 1.0).otherwise(0.0)
    rows = predicted.join(gold, key)
    return rows.agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg(F.when(~F.col("ambiguous"), hit)).alias("accuracy_clear"), F.avg(F.when(F.col("ambiguous"), hit)).alias("accuracy_ambiguous"))


def report(rows: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) of rows (label, predicted)."""
    one = lambda c, tp, fp, fn: F.struct(F.col(c).alias("label"), tp.cast("long").alias("tp"), fp.cast("long").alias("fp"), fn.cast("long").alias("fn"))
    hit, zero = (F.col("label") == F.col("predicted")).cast("int"), F.lit(0)
    votes = rows.select(F.inline(F.array(one("label", hit, zero, 1 - hit), one("predicted", zero, 1 - hit, zero))))
    sums = votes.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    f1 = F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return sums.select("label", "tp", "fp", "fn", *(F.round(F.coalesce(x, F.lit(0.0)), 6).alias(n) for x, n in ((p, "precision"), (r, "recall"), (f1, "f1"))))


def confusion(rows: DataFrame, examples: int = 3, key: str = "message_id") -> DataFrame:
    """(label, predicted, n, examples): wrong pairs with their first ids."""
    wrong = rows.filter(F.col("label") != F.col("predicted"))
    return wrong.groupBy("label", "predicted").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_list(key)), 1, examples).alias("examples"))


def ranking(hits: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """One row: recall at k, mean reciprocal rank and nDCG at k of hits (query_id, doc_id, rank) against relevant (query_id, doc_id)."""
    n = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    return _ranking(n, hits.filter(F.col("rank") <= k).join(relevant, ["query_id", "doc_id"], "left_semi"), k)


def ranking_by_label(hits: DataFrame, queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """``ranking`` where a document is relevant to a query of its own label: (query_id, label), (doc_id, label).

    Labels are counted and looked up for the hits; no pairs of a label's rows are made.
    """
    size = docs.groupBy("label").agg(F.count("*").alias("n_relevant"))
    n = queries.join(size, "label").select("query_id", "n_relevant")
    top = hits.filter(F.col("rank") <= k).join(queries, "query_id").join(docs.withColumnRenamed("label", "_own"), "doc_id")
    return _ranking(n, top.filter(F.col("label") == F.col("_own")), k)


def _ranking(n: DataFrame, top: DataFrame, k: int) -> DataFrame:
    got = top.groupBy("query_id").agg(F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    per = n.join(got, "query_id", "left").select(F.coalesce(F.col("found") / F.col("n_relevant"), F.lit(0.0)).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"))
    return per.agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


def overlap(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """One row: mean share of a's top k that b has too, and how often both agree on the first."""
    x, y = a.filter(F.col("rank") <= k), b.filter(F.col("rank") <= k).select("query_id", "doc_id", F.col("rank").alias("rank_b"))
    both = x.join(y, ["query_id", "doc_id"], "left")
    per = both.groupBy("query_id").agg((F.count("rank_b") / F.count("*")).alias("share"), F.max(F.when((F.col("rank") == 1) & (F.col("rank_b") == 1), 1.0).otherwise(0.0)).alias("same"))
    return per.agg(F.round(F.avg("share"), 6).alias("overlap"), F.round(F.avg("same"), 6).alias("top1"))


def latencies(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Median, nearest-rank 95th percentile, mean and maximum per group."""
    return rows.groupBy(by).agg(F.percentile(value, 0.5).alias("median"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"), F.avg(value).alias("mean"), F.max(value).alias("max"))
