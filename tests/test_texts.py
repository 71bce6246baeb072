"""Texts that stand for several messages give the models that the messages give."""

import pytest
from pyspark.sql import functions as F

from missive.operators import embed, model
from missive.plans import ledger, queries

ROWS = [("a", "fruit", "sweet ripe pear and plum", 3), ("b", "tools", "sharp saw and heavy drill", 1), ("c", "fruit", "ripe plum", 2), ("d", "tools", "heavy saw", 4), ("e", "tools", "drill and plum", 1), ("f", None, "ripe saw", 2)]


@pytest.fixture(scope="module")
def both(spark):
    """(the texts with how many messages say them, the messages)."""
    texts = spark.createDataFrame(ROWS, "message_id string, label string, masked_text string, n long").cache()
    rows = texts.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).withColumn("message_id", F.concat("message_id", "i"))
    return texts, rows.drop("i", "n").cache()


def test_vocabulary_counts_messages(both):
    texts, rows = both
    got, want = ({r["term"]: (r["idx"], r["idf"]) for r in df.collect()} for df in (model.vocabulary(texts, times="n"), model.vocabulary(rows)))
    assert got == want and "sweet" in got and "sharp" not in got


def test_training_weighs_messages(both):
    texts, rows = both
    got, want = model.train(texts, times="n"), model.train(rows)
    near = lambda a: {r["masked_text"]: (r["model_category"], r["model_confidence"]) for r in model.with_predictions(texts, a).collect()}
    assert {t: c for t, (c, _) in near(got).items()} == {t: c for t, (c, _) in near(want).items()}
    assert all(abs(p - near(want)[t][1]) < 1e-3 for t, (_, p) in near(got).items())


def test_latent_training_weighs_documents(both):
    as_docs = lambda df: df.withColumnsRenamed({"message_id": "doc_id", "masked_text": "text"})
    texts, rows = map(as_docs, both)
    got, want = embed.train(texts, dims=3, kept=3, times="n"), embed.train(rows, dims=3, kept=3)
    assert abs(got.agreement - want.agreement) < 1e-9
    assert got.projection.sort("idx", "comp").collect() == want.projection.sort("idx", "comp").collect()


def test_rules_read_each_text_once(spark):
    sf = "/root/testdata/sf0.001"
    texts, messages = ledger.judged_by_text(queries._masked(spark, sf))
    assert texts.count() == texts.select("masked_text", "_promoter", "overall_risk", "sensitivity_types").distinct().count() < messages.count()
    n = messages.groupBy("text_id").agg(F.count("*").alias("said")).join(texts, "text_id", "right")
    assert n.filter(~F.col("said").eqNullSafe(F.col("n"))).isEmpty()
    names = ["message_id", "masked_text", "rule_category", "rule_confidence", "rule_signals", "hedged", "overall_risk"]
    whole = queries.classify.with_rules(queries._masked(spark, sf)).select(names).sort("message_id").collect()
    assert messages.join(texts, "text_id").select(names).sort("message_id").collect() == whole
