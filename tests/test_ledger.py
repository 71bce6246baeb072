"""Two batches end to end: lifecycle, priority, privacy, retrieval and questions."""

import pytest

import corpus
from missive.operators.assistant import Assistant, intent_of
from missive.operators.groups import _Assigner
from missive.plans.ledger import Ledger
from missive.sources import csv


@pytest.fixture(scope="module")
def led(spark):
    return Ledger(csv.stacked([("first", csv.read_messages(spark, corpus.FIRST)), ("second", csv.read_messages(spark, corpus.SECOND))]))


@pytest.fixture(scope="module")
def groups(led):
    return {r["title"]: r for r in led.groups.collect()}


def test_lifecycle(groups):
    contract, drill, badge, claim = (groups[t] for t in ("Review the vendor contract", "Fire drill", "Renew the safety badge", "Submit the travel claim"))
    assert (contract["status"], contract["status_source"], contract["chase_count"], contract["contested"]) == ("completed", "B03", 3, True)
    assert (drill["status"], drill["latest_date"], drill["latest_time"], drill["schedule_source"]) == ("rescheduled", "2026-10-14", "15:45", "B07")
    assert (badge["latest_deadline"], badge["latest_deadline_source"], badge["n_moves"]) == ("2026-10-09", "B08", 1)
    assert claim["status"] == "cancelled" and set(contract["message_ids"]) == {"A01", "B01", "B02", "B03", "B04", "B05"}


def test_histories(led):
    kinds = {(r["kind"], r["message_id"]) for r in led.histories["conflicts"].collect()}
    assert kinds == {("hedged_contradiction", "B04"), ("chased_after_closure", "B05"), ("deadline_changed", "B08")}
    assert {(r["message_id"], r["direction"]) for r in led.histories["deadline_history"].filter("origin = 'l2_update'").collect()} == {("B08", "earlier")}


def test_priority(led, groups):
    now = {r["group_id"]: r for r in led.priorities.collect()}
    badge = now[groups["Renew the safety badge"]["group_id"]]
    assert badge["priority"] == "critical" and {s["name"] for s in badge["signals"]} >= {"deadline_tomorrow", "deadline_moved_earlier", "explicit_urgency", "authority_sender"}
    assert now[groups["Submit the travel claim"]["group_id"]]["score"] == -6.0
    moved = {(r["group_id"], r["change"]) for r in led.changes.filter("batch_idx = 1").collect()}
    assert (groups["Renew the safety badge"]["group_id"], "band_change") in moved


def test_no_secret_leaves_and_blocked_is_not_indexed(led):
    rows = [str(r) for df in (led.records, led.groups, led.routing_records()) for r in df.collect()]
    assert not any(s in row for s in corpus.SECRETS for row in rows)
    assert "A03" not in {r["doc_id"] for r in led.index.docs.collect()} and "A03" in {r["doc_id"] for r in led.index.excluded.collect()}


def test_questions(led):
    ask = Assistant(led)
    ids = lambda q: [r["message_id"] for r in ask.evidence(q, intent_of(q)).orderBy("ord").collect()]
    assert ids("Which messages are blocked?") == ["A03"]
    assert ids("What deadlines changed?") == ["B08"]
    assert set(ids("What was completed or cancelled?")) == {"B03", "B09"}
    assert len(ids("Show all messages about the fire drill")) == 3


@pytest.mark.parametrize("question,name", [("Which messages are blocked?", "blocked_messages"), ("Why is the badge critical?", "explain_priority"), ("What should I do today?", "due_today"), ("Which critical tasks are pending?", "pending_by_priority"), ("Was the audit finished?", "by_status"), ("Tell me more", "open_search")])
def test_intents(question, name):
    assert intent_of(question).name == name


def test_assignment_compares_only_sharing_signatures():
    step, w = _Assigner(), lambda *t: [{"token": x, "idf": 2.0, "rare": True, "specific": True} for x in t]
    row = lambda seq, *t: {"tenant": "", "seq": seq, "subject_w": w(*t), "item_signature_w": None, "item_type": None, "act": "status_query", "subject_source": "act_frame", "display": " ".join(t)}
    got = [step(row(i, *t))["seed_seq"] for i, t in enumerate([("a", "b"), ("c",), ("a", "b", "d"), ("b", "a"), ("e", "c")])]
    assert got == [0, 1, 0, 0, 1]


def test_each_text_is_read_once(spark):
    """Records by distinct texts equal those message by message: texts said often, by roles and people, null, blocked, and with values that mask alike."""
    from pyspark.sql import functions as F

    from missive.operators import routing, sensitive
    from missive.plans import ledger

    texts = ["Would you draft the red plan before 2026-10-09?", "Half price on lamps this week. Use code SAVE30.", "Your OTP is 482913.", "Your OTP is 99482913.", "Remember to weigh the crate tomorrow, urgent.", "Any update on the red plan?", None, "The red plan has been completed."]
    said = [(f"M{i:03d}", f"2026-10-{1 + i % 9:02d} 09:{i % 60:02d}:00", ["Promotions", "Ana", None, "offers"][i // len(texts) % 4], texts[i % len(texts)], i % 2, f"b{i % 2}", "l2" if i % 2 else "l1", "") for i in range(96)]
    rows = spark.createDataFrame(said, "message_id string, timestamp string, sender string, message string, batch_idx int, batch_name string, batch_kind string, tenant string")
    kept = {}
    made = ledger.records_by_text(routing.route(csv.sequenced(sensitive.masked(rows))), lambda df, name: kept.setdefault(name, df.localCheckpoint()))
    want = ledger.records_of(ledger.enriched(rows, gate=True, order=True))
    assert sorted(made.columns) == sorted(want.columns)
    shown = lambda df: {r["message_id"]: r["all"] for r in df.select("message_id", F.to_json(F.struct(*sorted(want.columns))).alias("all")).collect()}
    assert shown(made) == shown(want) and len(shown(made)) == 96
    assert kept["texts"].count() < 32  # texts by senders that are roles or not, of 96 messages
    led = Ledger(rows)
    assert "masked_text" in led.records.columns and "masked_text" not in led.members.columns and not [k for k in led.kept if "-items-" in k._written_at]
    led.unpersist()
