"""Reports, filters, sinks and retrieval checks on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus
from missive.operators import reports, retrieve
from missive.operators.assistant import Assistant, intent_of
from missive.plans.ledger import Ledger, layer1
from missive.session import Engine
from missive.sources import csv


@pytest.fixture(scope="module")
def led(spark):
    return Ledger(csv.stacked([("first", csv.read_messages(spark, corpus.FIRST)), ("second", csv.read_messages(spark, corpus.SECOND))]))


def test_counts_and_filters(spark):
    rows = spark.createDataFrame([("a", 0.95, "x"), ("b", 0.8, "y"), ("c", 0.6, "x"), ("d", 0.1, "x"), ("e", None, None)], "message_id string, confidence double, kind string")
    assert {(r["floor"], r["n"]) for r in reports.confidence_bands(rows).collect()} == {(0.9, 1), (0.75, 1), (0.6, 1), (0.0, 2)}
    assert [tuple(r) for r in reports.conflict_histogram(rows.filter("kind is not null")).collect()] == [("x", 3), ("y", 1)]
    assert reports.labelled_groups(rows, "kind").collect()[0]["kind"] == "x"
    bars = {r["kind"]: r["bar"] for r in reports.counts_with_bars(rows.filter("kind is not null"), "kind").collect()}
    assert bars["x"] == "#" * 34 and bars["y"].rstrip(".") == "#" * 11
    assert {r["message_id"] for r in reports.replicated(rows.limit(1), 2).collect()} == {"C0_a", "C1_a"}


def test_nearest_equal_brute_force(spark):
    r = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in r.integers(-2, 3, 40)]) for i in range(500)]
    v = spark.createDataFrame(vectors, "doc_id long, x array<double>").select("doc_id", retrieve.quantised(F.col("x")).alias("v")).repartition(5)
    q = v.filter("doc_id < 12").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    got = {}
    for row in retrieve.dense_candidates(q, v, depth=20, dims=8, block=5).collect():
        got.setdefault(row["query_id"], {})[row["doc_id"]] = row["semantic"]
    codes = {row["doc_id"]: (np.array([int(c) for c in row["v"]["codes"]]), row["v"]["scale"]) for row in v.collect()}
    for i in range(12):
        a, s = codes[i]
        near = sorted(codes, key=lambda d: (-int(a[:8] @ codes[d][0][:8]), -d))[:20]
        assert got[i] == {d: pytest.approx(int(a @ codes[d][0]) * s * codes[d][1]) for d in near}


def test_agreement_aborts(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<double>")
    b = spark.createDataFrame([(1, [2.0, 0.0]), (2, [1.0, 0.0])], "id long, vector array<double>")
    assert tuple(retrieve.agreement(a, b).head()) == (2, 0.5, 0.0)
    with pytest.raises(ValueError):
        retrieve.agreement(a, b, least=0.9)


def test_details_of_answers(led):
    ask = Assistant(led)
    why = ask.answer("Why is the badge critical?").details.collect()
    kinds = {r["kind"] for r in why}
    assert {"signal", "history"} <= kinds and any("deadline_tomorrow" in r["detail"] for r in why)
    nothing = ask.answer("Show all messages about the submarine").details.collect()
    assert "insufficient" in {r["kind"] for r in nothing}


def test_layer1_and_gold_files_hold_no_secret(spark, tmp_path):
    rows = layer1(csv.sequenced(csv.stacked([("first", csv.read_messages(spark, corpus.FIRST))])))
    reports.write_layer1(rows, f"{tmp_path}/l1")
    reports.write_gold(rows, f"{tmp_path}/gold")
    text = "".join(p.read_text() for p in tmp_path.rglob("part-*"))
    assert text and not any(s in text for s in corpus.SECRETS)
    assert {"messages.json", "items.json", "sensitive.json", "summary.json", "items.csv"} <= {p.name for p in (tmp_path / "l1").iterdir()}


def test_uploads_have_a_limit(spark, monkeypatch):
    monkeypatch.setattr("missive.session.MAX_ROWS", 3)
    with pytest.raises(ValueError, match="rows"):
        Engine(spark).analyze([("first", corpus.FIRST)])
