"""The lexical index: what is shuffled, and rows that share an id."""

from missive.operators.retrieve import Index


def test_terms_are_counted_where_their_document_lies(spark):
    rows = [(1, "red pan red", True), (1, "red pot", True), (2, "pot", True), (None, "pan pan", True), (3, "pan", False)]
    index = Index(spark.createDataFrame(rows, "doc_id long, text string, indexable boolean"))
    shuffles = [line for line in index.counts._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert len(shuffles) == 1 and "term" not in shuffles[0]
    counts = {(r["doc_id"], r["term"]): r["tf"] for r in index.counts.collect()}
    assert counts == {(1, "red"): 3, (1, "pan"): 1, (1, "pot"): 1, (1, "red pan"): 1, (1, "pan red"): 1, (1, "red pot"): 1, (2, "pot"): 1, (None, "pan"): 2, (None, "pan pan"): 1}


def test_stored_postings_find_what_the_plan_finds(spark):
    docs = spark.createDataFrame([(i, f"pan {'pot ' * (i % 3)}lid{i % 4}", True) for i in range(12)], "doc_id long, text string, indexable boolean")
    asked = spark.createDataFrame([(1, "pot lid1"), (2, "pan")], "query_id long, text string")
    stored = Index(docs).stored()
    found = [[(r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9), r["matched_terms"]) for r in i.exact(asked, 3).orderBy("query_id", "rank").collect()] for i in (Index(docs), stored)]
    sizes = {r[0]: r[1] for r in stored.terms.selectExpr("doc_id", "weight * weight as w").groupBy("doc_id").sum("w").collect()}
    stored.removed()
    assert found[0] == found[1] and len(found[0]) == 6 and all(abs(x - 1) < 1e-9 for x in sizes.values())


def test_features_are_shuffled_as_text_alone(spark):
    from missive.operators import model

    rows = spark.createDataFrame([("a", "red pan red"), ("b", "red pot"), ("c", None)], "message_id string, masked_text string")
    vocab = spark.createDataFrame([("red", 0, 1.0), ("red pan", 1, 2.0)], "term string, idx int, idf double")
    plan = model.vectors(rows, vocab)
    shuffles = [line for line in plan._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 1 and "term" not in shuffles[0]
    assert {r["message_id"]: [(x["idx"], x["term"]) for x in r["f"]] for r in plan.collect()} == {"a": [(0, "red"), (1, "red pan")], "b": [(0, "red")]}
