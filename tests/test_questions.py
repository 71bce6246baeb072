"""A table of questions against the same questions one by one."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import corpus
from missive.operators import questions
from missive.operators.assistant import CAPS, Assistant, intent_of
from missive.operators.questions import Questions
from missive.plans.ledger import Ledger
from missive.sources import csv

DEMO = """message_id,timestamp,sender,message
C01,2026-10-09 09:00:00,Mira,Any progress on the item concerning the safety badge?
C02,2026-10-09 09:10:00,Project Lead,Please repair the west gate by 2026-10-10. Treat this as urgent.
C03,2026-10-09 09:20:00,Sam,"The west gate might be done, but I am not completely sure."
C04,2026-10-09 09:30:00,Sam,The deadline to repair the west gate is now 2026-10-09.
"""
ASKED = [
    "Which messages are blocked?", "Which messages need confirmation?", "Which messages of the demo batch are blocked?", "Which tasks became critical?", "Which groups became low?", "What was escalated?", "Why is the safety badge critical?", "Why was GROUP_001 marked high?",
    "What deadlines changed?", "Which deadlines have changed in the demo?", "Which messages conflict?", "Are there conflicting deadlines?", "Which events were rescheduled?", "What should I do today?", "What was completed or cancelled?", "What was cancelled?", "Which items are done in the demo?",
    "Which critical or high tasks are pending?", "What is still pending?", "Which low priority items are open in the demo?", "What is the latest status of the vendor contract?", "What is the current status of the submarine?", "Was the fire drill moved?", "Is the west gate repaired?", "Did the submarine sink?",
    "Show all messages about the fire drill", "Show all messages about the submarine", "Show messages about the canteen", "Find messages for GROUP_NONE about the travel claim", "canteen", "boots with a discount", "submarine", "Tell me more", "", None,
]


@pytest.fixture(scope="module")
def led(spark):
    texts = [("first", corpus.FIRST), ("second", corpus.SECOND), ("demo", DEMO)]
    return Ledger(csv.stacked([(name, csv.read_messages(spark, t)) for name, t in texts]))


@pytest.fixture(scope="module")
def bulk(spark, led):
    q = Questions(led, spark.createDataFrame(list(enumerate(ASKED)), "question_id long, question string"))
    yield q
    q.unpersist()


def test_equal_one_by_one(led, bulk):
    names = ["ord", "message_id", "score", "why", "group_id"]
    row = lambda r: tuple(round(r[c], 6) if c == "score" else r[c] for c in names)
    got = {}
    for r in bulk.evidence().orderBy("question_id", "ord").collect():
        got.setdefault(r["question_id"], []).append(row(r))
    ask, seen = Assistant(led), set()
    for i, question in enumerate(ASKED):
        intent = intent_of(question or "")
        want = [row(r) for r in ask.evidence(question or "", intent).orderBy("ord").collect()]
        assert got.get(i, []) == want[: CAPS.get(intent.name)], question
        seen |= {intent.name} if want else set()
    assert len(seen) >= 13, seen


def test_answers(bulk, led):
    rows = {r["question_id"]: r for r in bulk.answers().collect()}
    assert len(rows) == len(ASKED)
    at = lambda text: rows[ASKED.index(text)]
    assert at("Which messages are blocked?")["route"] == "blocked" and at("Which messages need confirmation?")["route"] == "confirm_required"
    assert at("Did the submarine sink?")["refused"] and at("")["refused"] and at(None)["refused"]
    assert at("Show all messages about the fire drill")["n_newest"] == 0 and at("What deadlines changed?")["n_newest"] == 1 < at("What deadlines changed?")["n_evidence"]
    ask = Assistant(led)
    newest = [r["detail"] for r in ask.answer("What deadlines changed?").details.filter("kind = 'newest_batch'").collect()]
    assert newest == ["C04 came in the newest batch, demo"]
    for text in ("Why is the safety badge critical?", "Why was GROUP_001 marked high?", "Was the fire drill moved?", "What is the latest status of the vendor contract?"):
        assert at(text)["group_id"] == ask.resolve(text, intent_of(text)) is not None
    assert not any(s in str(r) for s in corpus.SECRETS for r in bulk.evidence().collect())


def test_empty_and_repeated(spark, led):
    none = Questions(led, spark.createDataFrame([], "question_id long, question string"))
    assert none.answers().count() == 0 and none.evidence().count() == 0
    none.unpersist()
    twice = Questions(led, spark.createDataFrame([(1, "Which messages are blocked?"), (1, "Which messages are blocked?"), (1, "What deadlines changed?"), (None, "What deadlines changed?")], "question_id long, question string"))
    assert sorted((str(r["question_id"]), r["message_id"]) for r in twice.evidence().collect()) == sorted([("1", "A03"), ("1", "B08"), ("1", "C04"), ("None", "B08"), ("None", "C04")])
    twice.unpersist()


def test_equal_texts_are_searched_once(spark):
    class Index:
        def hybrid(self, queries, k):
            self.asked = sorted(r["text"] for r in queries.collect())
            return queries.select("query_id", F.lit(1).alias("rank"), F.concat(F.lit("about "), "text").alias("doc_id"), F.lit(0.5).alias("score"), F.array(F.lit("t")).alias("matched_terms"))

    asker = questions.Questions.__new__(questions.Questions)
    asker.ledger = SimpleNamespace(index=Index())
    hits = asker._search(spark.createDataFrame([("a", "oak"), ("b", "oak"), ("c", "elm")], "key string, text string"), 3)
    assert sorted((r["key"], r["message_id"]) for r in hits.collect()) == [("a", "about oak"), ("b", "about oak"), ("c", "about elm")]
    assert asker.ledger.index.asked == ["elm", "oak"]
