"""Training against numpy: the softmax regression's optimum, the singular subspace, and scans of outputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus
from missive.operators import embed, model, outputs, retrieve
from missive.plans.ledger import Ledger
from missive.sources import csv

WORDS = {"fruit": "apple pear plum cherry ripe sweet", "tools": "hammer saw drill plane sharp heavy", "sky": "cloud rain wind storm grey cold"}


@pytest.fixture(scope="module")
def labelled(spark):
    r = np.random.default_rng(3)
    shared = "the a with and some very".split()
    rows = []
    for i in range(180):
        label = list(WORDS)[i % 3] if i % 10 else "fruit"  # classes of unequal size
        words = r.choice(WORDS[label].split() + shared, 7)
        rows.append((f"m{i:03}", label, " ".join(words)))
    rows += [("none", "sky", ""), ("null", "tools", None), ("open", None, "apple cloud")]
    return spark.createDataFrame(rows, "message_id string, label string, masked_text string").cache()


def _dense(rows, vocab, key="message_id"):
    """Ids, and the dense matrix of their features."""
    ids = sorted(r[0] for r in rows.select(key).collect())
    x = np.zeros((len(ids), vocab.count()))
    for r in model.features(rows, vocab, key).collect():
        x[ids.index(r[key]), r["idx"]] = r["w"]
    return ids, x


def _optimum(x, y, weight, strength):
    """Newton's method on the weighted softmax loss with ``strength``/2 |w|^2, intercepts free."""
    n, d = x.shape
    k = y.shape[1]
    x1 = np.c_[x, np.ones(n)]
    ridge = np.r_[np.full(d, strength), 1e-9]
    w = np.zeros((d + 1, k))
    for _ in range(30):
        s = x1 @ w
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = x1.T @ (weight[:, None] * (p - y)) + ridge[:, None] * w
        hess = np.zeros((k, d + 1, k, d + 1))
        for a in range(k):
            for b in range(k):
                hess[a, :, b, :] = x1.T @ ((weight * p[:, a] * ((a == b) - p[:, b]))[:, None] * x1) + (a == b) * np.diag(ridge)
        size = k * (d + 1)
        w -= np.linalg.lstsq(hess.reshape(size, size), grad.T.ravel(), rcond=None)[0].reshape(k, d + 1).T
    return p


def test_weights_reach_the_optimum(labelled):
    artifact = model.train(labelled)
    known = labelled.filter("label is not null")
    ids, x = _dense(known, artifact.vocab)
    label = {r["message_id"]: r["label"] for r in known.collect()}
    names = sorted(WORDS)
    y = np.array([[float(label[i] == c) for c in names] for i in ids])
    weight = (len(ids) / (3 * y.sum(0)))[y.argmax(1)]
    want = _optimum(x, y, weight, 1.0 / model.C)
    got = {r["message_id"]: {d["label"]: d["p"] for d in r["distribution"]} for r in model.predictions(known, artifact).collect()}
    assert max(abs(got[m][c] - want[i, j]) for i, m in enumerate(ids) for j, c in enumerate(names)) < 1e-3
    artifact.removed()


def test_features_equal_their_definition(labelled):
    vocab = model.vocabulary(labelled)
    terms = [r["term"] for r in vocab.orderBy("idx").collect()]
    assert terms == sorted(terms) and [r["idx"] for r in vocab.orderBy("idx").collect()] == list(range(len(terms)))
    ids, x = _dense(labelled.filter("message_id like 'm%'"), vocab)
    assert np.allclose((x**2).sum(1), 1.0)
    few = model.vocabulary(labelled, most=10)
    df = {r["term"]: r["idf"] for r in vocab.collect()}
    kept = {r["term"] for r in few.collect()}
    assert 0 < len(kept) <= 10 and max(df[t] for t in kept) < min(v for t, v in df.items() if t not in kept)
    assert model.vocabulary(labelled.limit(0)).count() == 0


def test_training_refuses(spark, labelled):
    with pytest.raises(ValueError, match="two classes"):
        model.train(labelled.filter("label = 'sky'"))
    secret = labelled.withColumn("masked_text", F.concat(F.col("masked_text"), F.lit(" x48151623")))
    with pytest.raises(ValueError, match="shaped like values"):
        model.train(secret)
    with pytest.raises(ValueError, match="shaped like values"):
        embed.train(secret.select(F.col("message_id").alias("doc_id"), F.col("masked_text").alias("text")))


def test_each_row_is_predicted_by_a_model_that_has_not_seen_it(labelled):
    got = model.cross_validated(labelled, 2, by_template=False).collect()
    assert sorted(r["message_id"] for r in got) == sorted(r["message_id"] for r in labelled.collect())
    right = [r["label"] == r["predicted"] for r in got if r["label"]]
    assert sum(right) / len(right) > 0.9


def test_directions_span_the_singular_subspace(labelled):
    vocab = model.vocabulary(labelled)
    sparse = model.vectors(labelled, vocab).select(F.col("f.idx").alias("idx"), F.col("f.w").alias("w"))
    _, x = _dense(labelled, vocab)
    _, s, vt = np.linalg.svd(x)
    v = embed.leading_directions(sparse.repartition(5), x.shape[1], 6)
    assert np.allclose(v.T @ v, np.eye(6), atol=1e-8)
    # what the directions hold of the matrix is what the best ones hold
    assert np.linalg.norm(x @ v) ** 2 > 0.999 * (s[:6] ** 2).sum()
    assert np.linalg.svd(vt[:2] @ v)[1].min() > 0.99


def test_semantic_vectors_and_hybrid_search(spark, labelled):
    docs = labelled.filter("message_id like 'm%'").select(F.substring("message_id", 2, 3).cast("long").alias("doc_id"), F.col("masked_text").alias("text"))
    semantic = embed.train(docs, dims=24, kept=16)
    assert semantic.agreement >= embed.LEAST_AGREEMENT
    with pytest.raises(ValueError, match="cosine"):
        embed.train(docs, dims=24, kept=1, least=0.999)
    with pytest.raises(ValueError, match="no term"):
        embed.train(docs.limit(0))
    vectors = semantic.vectors(docs)
    query = spark.createDataFrame([(1, "hammer and saw")], "query_id long, text string")
    q = semantic.vectors(query.withColumnRenamed("query_id", "doc_id")).select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    near = retrieve.dense_candidates(q, vectors, 15)
    index = retrieve.Index(docs.withColumn("indexable", F.lit(True)))
    plain = {r["doc_id"]: r["score"] for r in index.hybrid(query, k=200).collect()}
    both = {r["doc_id"]: (r["score"], r["lexical"]) for r in index.hybrid(query, k=400, semantic=near).collect()}
    liked = {r["doc_id"]: max(r["semantic"], 0.0) for r in near.collect()}
    assert set(plain) <= set(both) and set(liked) - set(both) <= {d for d, s in liked.items() if s == 0}
    for d, (score, lexical) in both.items():
        assert score == pytest.approx(lexical + retrieve.SEMANTIC_TIEBREAK * liked.get(d, 0.0), abs=1e-5)
    semantic.removed()


def test_leak_scan_finds_strings_however_nested(spark):
    rows = spark.createDataFrame(
        [
            (1, "fine 2026-10-01 09:00:00", [("sk_live1234", {"k": ["1234567"]})], {"4111 1111 1111 1111": 5}, 1234567),
            (2, None, None, None, None), (3, "call 481516 and 1234567", [], {}, 0),
        ],
        "id long, `a.b` string, c array<struct<x: string, y: map<string, array<string>>>>, d map<string, int>, n int",
    )
    got = {(r["column"], r["shape"]): r["n"] for r in outputs.leaked(rows).collect()}
    assert got == {("a.b", "digit_run"): 1, ("c", "token_prefix"): 1, ("c", "digit_run"): 1, ("d", "card_groups"): 1}
    assert outputs.leaked(rows.limit(0)).count() == 0 and outputs.leaked(rows.select("n")).count() == 0


def test_outputs_of_a_ledger_hold_no_secret_and_a_planted_one_stops_them(spark, tmp_path, monkeypatch):
    led = Ledger(csv.stacked([("first", csv.read_messages(spark, corpus.FIRST)), ("second", csv.read_messages(spark, corpus.SECOND))]))
    assert led.leaks().collect() == []
    tables = led.tables()
    tables["groups"] = tables["groups"].withColumn("title", F.lit("card 4111 1111 1111 1111"))
    monkeypatch.setattr(led, "tables", lambda: tables)
    assert {(r["output"], r["column"], r["shape"]) for r in led.leaks().collect()} == {("groups", "title", "card_groups")}
    with pytest.raises(ValueError, match=r"groups\.title"):
        led.write(str(tmp_path / "out"), checked=True)
    assert not (tmp_path / "out").exists()
    led.unpersist()


def test_vectors_are_made_where_their_rows_are(spark):
    """Sums of the int8 projection against the definition, with zeros for what is unknown; no entry is joined or grouped."""
    vocab = spark.createDataFrame([("oak", 0, 1.0), ("elm", 1, 1.5)], "term string, idx int, idf double")
    projection = spark.createDataFrame([(0, 0, 100), (0, 2, -7), (1, 0, 3), (1, 1, 127)], "idx int, comp int, code int").withColumn("code", F.col("code").cast("tinyint"))
    scale = spark.createDataFrame([(0, 0.01), (1, 0.02), (2, 0.5)], "comp int, scale double")
    semantic = embed.Semantic(vocab, projection, scale, 3)
    docs = spark.createDataFrame([("a", "oak elm"), ("b", "ash"), ("c", None), ("d", "elm")], "doc_id string, text string")
    made = semantic.vectors(docs)
    got = {r["doc_id"]: r for r in made.collect()}
    w = np.array([1.0, 1.5]) / np.sqrt(3.25)
    raw = {"a": [(w[0] * 100 + w[1] * 3) * 0.01, w[1] * 127 * 0.02, w[0] * -7 * 0.5], "d": [0.03, 2.54, 0.0]}
    for doc, r in raw.items():
        unit = np.array(r) / np.linalg.norm(r)
        size = np.abs(unit).max() / 127
        assert got[doc]["vector"] == pytest.approx(unit) and got[doc]["v"]["scale"] == pytest.approx(size) and got[doc]["v"]["codes"] == np.rint(unit / size).astype(int).tolist()
    assert all(got[doc]["vector"] == [0.0] * 3 and got[doc]["v"] == ([0] * 3, 0.0) for doc in "bc")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "comp#" not in plan


def test_leak_scan_reads_a_string_once_for_all_shapes(spark):
    """One removal of dates a column and one for what is suspected, and the counts of each shape searched by itself in every string."""
    import random

    from pyspark.sql import functions as F

    r = random.Random(5)
    parts = ["2026-10-09", "2026-10-09 11:00:05", "2026-10-09T11:00", "4012", "8888 ", "-1881", "123456", "12345", "sk_", "tok-", "ghp_", "gho", "abcd", "task_0001", " ", "-", "_", "é", "\n"]
    texts = [None, "", *("".join(r.choices(parts, k=r.randrange(1, 9))) for _ in range(4000))]
    rows = spark.createDataFrame([(t, [t], {"k": t}) for t in texts], "a string, b array<string>, c map<string,string>")
    each = rows.agg(*(F.count_if(F.regexp_replace("a", outputs.CLOCK, " ").rlike(p)).alias(shape) for shape, p in outputs.SHAPES)).head().asDict()
    want = {(c, shape): n for shape, n in each.items() if n for c in "abc"}
    made = outputs.leaked(rows)
    assert {(x["column"], x["shape"]): x["n"] for x in made.collect()} == want and len(want) == 9
    assert made._jdf.queryExecution().analyzed().toString().count("regexp_replace(") <= 4
