"""Layer 1 on invented messages, against hand-derived results."""

import pytest
from pyspark.sql import functions as F

import corpus
from missive.functions import text as T
from missive.operators import acts, classify, extract, routing, sensitive
from missive.plans import ledger as L
from missive.sources import csv

DETECTED = [
    ("Your OTP is 482913. It expires soon.", "one_time_password", "482913", "blocked"), ("My password is hunter22!", "password", "hunter22", "blocked"), ("The PIN is 4455", "password", "4455", "blocked"),
    ("Credit card 4111 1111 1111 1111 expires", "payment_card", "4111 1111 1111 1111", "blocked"), ("Account number is AB12345678", "bank_account", "AB12345678", "blocked"), ("use sk_live_abcdef1234 now", "auth_token", "sk_live_abcdef1234", "blocked"),
    ("Recovery code is XK-99-21", "account_recovery_code", "XK-99-21", "blocked"), ("My passport number is K1234567", "government_id", "K1234567", "local_only"), ("The diagnosis is mild asthma.", "health_information", "mild asthma", "local_only"),
    ("Please deliver it to 12 Rose Street, near the mill", "postal_address", "12 Rose Street", "confirm_required"), ("contact me on 70155 28643 after six", "phone_number", "70155 28643", "confirm_required"),
]


@pytest.fixture(scope="module")
def first(spark):
    rows = csv.stacked([("first", csv.read_messages(spark, corpus.FIRST))])
    return {r["message_id"]: r for r in L.layer1(csv.sequenced(rows)).collect()}


def test_values_are_masked_at_fixed_width():
    scan = sensitive.Scanner()
    for text, kind, secret, _ in DETECTED:
        got = scan(text)
        assert got["findings"][0]["type"] == kind and secret not in got["masked_text"] and "******" in got["masked_text"], text
    assert scan("I will send the login details separately.")["findings"][0]["type"] == "credential_mention"
    assert scan("The deadline is 2026-10-10 at 14:00")["findings"] == [] and scan(None)["masked_text"] == ""
    both = scan("My password is hunter22 and contact me on 70155 28643.")
    assert [f["type"] for f in both["findings"]] == ["password", "phone_number"] and both["masked_text"].endswith("on ******.")


def test_routes_follow_the_strictest_finding(spark):
    rows = spark.createDataFrame([(str(i), None, "x", t) for i, (t, *_) in enumerate(DETECTED)] + [("n", None, None, None)], "message_id string, timestamp string, sender string, message string")
    got = {r["message_id"]: r for r in routing.route(sensitive.masked(rows)).collect()}
    assert [got[str(i)]["route"] for i in range(len(DETECTED))] == [d[3] for d in DETECTED]
    assert got["n"]["policy_id"] == "P0-DEFAULT" and "message" not in got["n"].asDict()
    assert all("send_to_external_service" in r["denied"] for r in got.values())


def test_categories_and_items(first):
    assert {k: r["category"] for k, r in first.items()} == {
        "A01": "action_required", "A02": "action_required", "A03": "sensitive_information", "A04": "promotional", "A05": "meeting_or_event", "A06": "personal_information", "A07": "general_information", "A08": "action_required",
    }
    a1, a5 = first["A01"], first["A05"]
    assert (a1["item_id"], a1["item_title"], a1["item_date"], a1["item_frame"]) == ("TASK_0001", "Review the vendor contract", "2026-10-20", "request_with_deadline")
    assert (a5["item_id"], a5["item_title"], a5["item_time"], a5["location"]) == ("EVENT_0001", "Fire drill", "09:30", "Main Hall")
    assert a1["item_priority"] == "low" and a1["unresolved_fields"] == ["time", "person"] and first["A08"]["item_id"] == "TASK_0003"
    assert a1["confidence"] == pytest.approx(0.8832) and first["A03"]["confidence"] == 0.98


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).head()[0]
    assert one(T.canonical(F.lit("FYI:  The  Server\tis up "))) == "the server is up"
    assert one(T.tokenize(F.lit("Due 2026-10-01 at 9:30 am, ****** x 12"))) == ["due", "datetoken", "at", "timetoken", "maskedtoken", "x", "numtoken"]
    assert one(T.ngrams(F.array(F.lit("a")))) == ["a"] and one(T.ngrams(F.array().cast("array<string>"))) == []
    assert one(T.content_tokens(F.lit("Reviews of the model-results, meetings and caching"))) == ["review", "model", "result", "meet", "cach"]
    assert [one(T.clock_of(F.lit(t))) for t in ("9:30 pm", "12 am", "25:00", "4pm")] == ["21:30", "00:00", None, "16:00"]
    assert one(T.day_of(F.lit("2026-9-1"))).isoformat() == "2026-09-01" and one(T.day_of(F.lit("2026-13-45"))) is None
    assert one(extract.suggested_date(F.lit("Tomorrow"), F.lit("2026-10-01").cast("date"))) == "2026-10-02"


ACTS = [
    ("Update: review the plan has been completed.", "completion", "review the plan"), ("You can cancel the audit; it is no longer needed", "cancellation", "audit"), ("The demo has been moved to 2026-10-14 at 11:00.", "reschedule", "demo"),
    ("The deadline to renew the pass is now 2026-11-01.", "deadline_change", "renew the pass"), ("Follow-up: Reminder: any update on the budget?", "status_query", "budget"), ("The budget might already be done", "ambiguous_update", "budget"),
    ("The report may have been completed, I am not sure.", "ambiguous_update", "report may"), ("The canteen menu is new", "informational", None), ("Did the vendor call?", "open_question", "Did the vendor call"), ("I have started working on the slides.", "progress_update", "slides"),
]


def test_acts(spark):
    rows = spark.createDataFrame([(i, t, None) for i, (t, *_) in enumerate(ACTS)], "i int, body string, item_type string")
    got = {r["i"]: r for r in acts.with_acts(rows).collect()}
    for i, (text, act, phrase) in enumerate(ACTS):
        assert (got[i]["act"], got[i]["subject_phrase"]) == (act, phrase), text
    assert got[4]["repeat_depth"] == 2 and got[2]["new_time"] == "11:00"


def test_reader(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_bytes(b"\xef\xbb\xbfmessage_id,timestamp,sender,message,more\nB,2,s,late,x\nA,1,s,\"first, quoted\",y\n")
    rows = csv.sequenced(csv.stacked([("one", csv.read_messages(spark, str(path)))])).orderBy("seq").collect()
    assert [(r["message_id"], r["message"]) for r in rows] == [("A", "first, quoted"), ("B", "late")]
    ragged = csv.read_messages(spark, "message_id,timestamp,sender,message\nA,1,s,one, two\nB,1\n").collect()
    assert (ragged[0]["message"], ragged[1]["message"]) == ("one", None)
    with pytest.raises(ValueError, match="missing column.*found"):
        csv.read_messages(spark, "message_id,text\n1,a\n")
    with pytest.raises(ValueError, match="no rows"):
        csv.read_messages(spark, "message_id,timestamp,sender,message\n")
    assert csv.decode_upload(b"\xe9") == "é" and csv.batch_kind("Demo set", 0) == "demo" and csv.batch_kind("x", 1) == "l2"


def test_weak_labels_and_arbitration(spark):
    rows = spark.createDataFrame([("a", "action_required", 0.9, "action_required", 0.95), ("b", "promotional", 0.9, "general_information", 0.6), ("c", None, 0.0, "promotional", 0.8)], "message_id string, rule_category string, rule_confidence double, model_category string, model_confidence double")
    rows = rows.withColumns({"hedged": F.lit(False), "overall_risk": F.lit(None).cast("string"), "rule_signals": F.array().cast(classify.SIGNALS), "sensitivity_types": F.array().cast("array<string>"), "model_margin": F.lit(0.1)})
    got = {r["message_id"]: (r["category"], r["confidence"], r["agreement"]) for r in classify.with_category(rows, with_model=True).collect()}
    assert got == {"a": ("action_required", 0.99, "rule_and_model_agree"), "b": ("promotional", 0.6, "disagreement"), "c": ("promotional", 0.704, "model_only")}


def test_replay_of_a_stream_equals_one_run(spark, tmp_path):
    """Two files as two micro-batches: the stored records, numbers and groups are those of one run over both batches."""
    from missive.plans.ledger import Ledger
    from missive.streaming import replay

    folder, seen = tmp_path / "in", []
    folder.mkdir()
    store = f"{tmp_path}/store"

    def then(led, n):
        seen.append((n, led.records.count(), sorted((r["title"], r["status"], tuple(r["message_ids"]), tuple(r["item_ids"])) for r in led.groups.collect())))

    for n, text in enumerate((corpus.FIRST, corpus.SECOND)):
        (folder / f"{n}.csv").write_text(text)
        replay.replay(replay.stream(spark, str(folder)), store, f"{tmp_path}/checkpoint", then).awaitTermination(300)
    one = Ledger(csv.stacked([("first", csv.read_messages(spark, corpus.FIRST)), ("second", csv.read_messages(spark, corpus.SECOND))]))
    assert [x[:2] for x in seen] == [(0, 8), (1, 20)]
    assert seen[1][2] == sorted((r["title"], r["status"], tuple(r["message_ids"]), tuple(r["item_ids"])) for r in one.groups.collect())
    stored = replay.records(spark, store)
    same = lambda df: sorted((tuple(r) for r in df.select("seq", "message_id", "masked_text", "route", "category", "item_id", "act", "batch_idx").collect()), key=str)
    assert same(stored) == same(one.records)
    assert "message" not in stored.columns and not any(x in str(r) for x in corpus.SECRETS for r in stored.collect())
    # a repeated batch replaces itself
    replay._stored(csv.read_messages(spark, corpus.SECOND), 1, store)
    assert same(replay.records(spark, store)) == same(one.records)
    one.unpersist()




def test_hints_hide_no_rule_frame(spark):
    frames = [f for family in (classify.PROMOTIONAL, classify.MEETING, classify.ACTION, classify.PERSONAL) for f in family] + [("hedged_event", classify.HEDGED_EVENT), ("hedged_action", classify.HEDGED_ACTION)]
    assert set(classify.HINTS) <= {n for n, _ in frames}
    texts = [
        "use code save30", "50% off", "flat 20% today", "a discount", "flash sale", "limited-time offer", "special festival offer", "cashback", "reward points", "free delivery", "buy one and get one", "coupon", "voucher", "upgrade your boat", "join our rowing plan", "exclusive benefits",
        "you may like our pans", "our new pan plan", "subscribe now", "deal on pans", "sale starts", "calendar update: x", "invite: x", "reminder: x", "it is scheduled for", "it happens on", "takes place at", "is happening in", "will be held on", "please attend the", "come to our", "be present at the",
        "are you free for", "are you available for", "let's meet", "let us meet", "shall we meet", "meeting at", "the demo could be", "the call may be", "kindly row", "plea\u017fe row", "can you row", "i need you to row", "don't forget to", "dont forget to", "remember to row", "make sure you row", "ensure row",
        "if possible, row", "deadline is", "is due by", "due date", "no later than 2026-01-01", "it may be needed", "could you send", "send it soon", "asked whether", "wants to know if", "is waiting for", "for my profile", "personal note", "about me", "note that i", "just so you know, my", "i'm a rower", "i am a rower",
        "i might prefer", "i tend to", "i work best", "i l\u0131ve near", "my nickname", "row the boat",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "c string").withColumn("low", F.translate("c", "\u017f\u0131", "si"))
    both = rows.select("c", *(F.struct(classify._shown(F.col("c"), F.col("low"), n, p).alias("shown"), T.found(F.col("c"), p).alias("found")).alias(n) for n, p in frames)).collect()
    assert [(r["c"], n) for r in both for n, _ in frames if r[n]["shown"] != r[n]["found"]] == []
    assert all(any(r[n]["found"] for r in both) for n in classify.HINTS)


def test_messages_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    from missive.plans import synth

    rows = [(i, i % 3, f"2026-01-{1 + i % 28:02d}") for i in range(90)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate string").withColumn("o_orderdate", F.to_timestamp("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, f"C{i}") for i in range(3)], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(i, f"red pan {i}") for i in range(4)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(synth, "ROWS_A_TASK", 10)
    made = synth.messages(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() == 9 and made.count() == 90


def test_days_of_all_forms_and_of_texts_that_have_none(spark):
    """A form is only tried where it can fit, which changes no day."""
    texts = ["2024-1-2 3:4:5", " 2024-01-02T03:04:05 ", "2024-01-02t03:04:05", "2024-01-02 03:04", "2024-01-02", "2024-02-30", "2024-01-02T03:04", "tomorrow", "at 3:04", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    every = F.coalesce(*(F.try_to_timestamp(F.trim("t"), F.lit(f)) for f in T.DAY_FORMATS)).cast("date")
    got = df.select("i", T.day_of(F.col("t")).alias("d"), every.alias("e")).orderBy("i").collect()
    assert [r["d"] for r in got] == [r["e"] for r in got] and [str(r["d"]) for r in got[:5]] == ["2024-01-02"] * 5 and not any(r["d"] for r in got[5:])
