"""A table of questions answered in one plan: resolution, evidence and routes as joins keyed by question.

The same intents and the same evidence as ``assistant`` gives one by one. Most questions
name no subject, so what answers them depends on few closed values (the intent, a band,
a status): such evidence is found once for each *plan* that is asked for, and questions
take it by an equi-join. Questions about a subject are resolved together: by ids, then by
the subject join, then by votes of one search for all that are left.

Evidence is therefore kept once for each *source*, a plan, an intent about a group or a
search, and not once for each question: many questions about one large group cost no more
than one until their evidence is listed.

Null and empty questions are open searches that find nothing. A question_id may be null or
have several questions; a row that is repeated whole counts once.
"""

from __future__ import annotations

import re
from functools import cached_property, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missive import schema as S
from missive.functions import text as T
from missive.functions.order import numbered_in_order
from missive.operators import assistant as A
from missive.operators import retrieve, routing, subject
from missive.sources.tables import removed, written

#: intents that are about one group, which the question must be resolved to
ABOUT_ONE = ["explain_priority", "latest_status", "yes_no_verification", "messages_about"]
SEARCHED = 12
#: messages of a group that one task puts in order
STRIDE = 1 << 16

_INTENT = "struct<name:string,subject:string,ids:array<string>,demo:boolean,values:array<string>>"
_ARROW = pa.struct([("name", pa.string()), ("subject", pa.string()), ("ids", pa.list_(pa.string())), ("demo", pa.bool_()), ("values", pa.list_(pa.string()))])


def _values(intent: A.Intent, question: str) -> list[str]:
    """The closed values that choose an intent's evidence, in alphabetical order."""
    if intent.name == "became_priority":
        return (intent.bands or ["critical"])[:1]
    if intent.name == "pending_by_priority":
        return sorted(set(intent.bands or ["critical", "high"]))
    if intent.name == "by_status":
        return sorted({s for s in intent.statuses or S.TERMINAL if s in S.STATUSES})
    if intent.name == "conflicts" and re.search(A.DATED, question, re.IGNORECASE):
        return ["dated"]
    return []


def _parsed(questions: pa.Array) -> pa.Array:
    out = []
    for q in questions.to_pylist():
        i = A.intent_of(q or "")
        out.append({"name": i.name, "subject": i.subject, "ids": i.ids, "demo": i.demo, "values": _values(i, q or "")})
    return pa.array(out, _ARROW)


def intents(questions: DataFrame) -> DataFrame:
    """(question_id, question) with name, subject, ids, demo, values and ``plan``, null where the evidence is the question's own."""
    rows = questions.select("question_id", F.coalesce("question", F.lit("")).alias("question")).withColumn("_i", F.arrow_udf(_parsed, _INTENT)(F.col("question"))).select("question_id", "question", "_i.*")
    own = F.col("name").isin(*ABOUT_ONE, "open_search")
    return rows.withColumn("plan", F.when(~own, F.concat_ws("|", "name", F.col("demo").cast("string"), F.array_join("values", ","))))


class Questions:
    """The answers to ``questions`` (question_id, question) from one ledger. ``unpersist`` removes what was written for them."""

    def __init__(self, ledger, questions: DataFrame):
        self.ledger, self.kept = ledger, []
        # each question has a key of its own, so a repeated id mixes nothing up
        key = F.sha2(F.to_json(F.struct("question_id", "question")), 256)
        self.asked = self._keep(intents(questions).withColumn("key", key).dropDuplicates(["key"]), "questions")

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        self.kept.append(written(df, name))
        return self.kept[-1]

    def unpersist(self) -> None:
        for df in self.kept:
            removed(df)
        self.kept.clear()

    def _search(self, texts: DataFrame, k: int) -> DataFrame:
        """(key, rank, message_id, score, matched_terms) of (key, text). Each distinct text is searched once, however many questions have it."""
        asked = texts.select("key", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("query_id"))
        hits = self.ledger.index.hybrid(asked.select("query_id", "text").dropDuplicates(["query_id"]), k)
        hits = asked.select("key", "query_id").join(hits, "query_id")
        return hits.select("key", "rank", F.col("doc_id").alias("message_id"), "score", "matched_terms")

    # -- which group a question means --------------------------------------------
    def _by_id(self, asked: DataFrame) -> DataFrame:
        """By the first id in the question that a message, item or group has."""
        led = self.ledger.members
        named = led.select("seq", "group_id", F.explode(F.array_distinct(F.filter(F.array("message_id", "item_id", "group_id"), lambda x: x.isNotNull()))).alias("id"))
        named = named.groupBy("id").agg(F.min(F.struct("seq", "group_id")).alias("hit"))
        ids = asked.select("key", F.posexplode("ids").alias("n", "id"))
        first = ids.join(named, "id").groupBy("key").agg(F.min(F.struct("n", "hit")).alias("x"))
        return first.select("key", F.col("x.hit.group_id").alias("group_id"), F.lit(None).cast("array<string>").alias("shared"))

    def _by_subject(self, asked: DataFrame) -> DataFrame:
        """By the subject it names, else by its whole wording."""
        phrases = asked.select("key", F.posexplode(F.array("subject", "question")).alias("n", "phrase")).filter("phrase <> ''")
        probe = phrases.select(F.col("phrase").alias("id")).distinct().select("id", T.signature(F.col("id")).alias("s")).filter("s is not null").select("id", "s.tokens")
        names = self.ledger.members.select(F.col("group_id").alias("id"), F.col("subject.tokens").alias("tokens")).distinct()
        best = subject.best_match(subject.subject_pairs(probe, names, self.ledger.idf)).withColumnRenamed("a", "phrase")
        best = phrases.join(best, "phrase").groupBy("key").agg(F.min_by(F.struct(F.col("b").alias("group_id"), "shared"), "n").alias("x"))
        return best.select("key", "x.group_id", "x.shared")

    def _by_votes(self, asked: DataFrame) -> DataFrame:
        """By the groups of what it retrieves: one alone, or one with enough of a score."""
        hits = self._search(asked.select("key", F.col("question").alias("text")), A.CONTEXT).filter(F.col("score") >= retrieve.MIN_EVIDENCE)
        votes = hits.join(self.ledger.members.select("message_id", "group_id"), "message_id").groupBy("key", "group_id").agg(F.round(F.sum("score"), 9).alias("v"))
        best = votes.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("v")).alias("v"), "group_id")).alias("x"))
        return best.filter("n = 1 or -x.v >= 0.6").select("key", "x.group_id", F.lit(None).cast("array<string>").alias("shared"))

    @cached_property
    def meant(self) -> DataFrame:
        """(key, group_id, shared): the group that a question about one means; ``shared``: words that decided."""
        left = self.asked.filter(F.col("name").isin(ABOUT_ONE))
        found = []
        for step in (self._by_id, self._by_subject, self._by_votes):
            found.append(self._keep(step(left), "meant"))
            left = left.join(found[-1].select("key"), "key", "left_anti")
        return reduce(DataFrame.unionByName, found)

    @cached_property
    def sourced(self) -> DataFrame:
        """The questions with the group they mean and the ``source`` of their evidence."""
        rows = self.asked.join(self.meant, "key", "left")
        about = F.when(F.col("group_id").isNotNull(), F.concat_ws("|", "name", "group_id"))
        return self._keep(rows.withColumn("source", F.coalesce("plan", about, "key")), "sourced")

    # -- evidence that a plan shares ---------------------------------------------
    @cached_property
    def plans(self) -> DataFrame:
        """The plans that are asked for: at most some 200, as intents, bands and statuses are closed."""
        return self.asked.filter("plan is not null").select("plan", "name", "demo", "values").dropDuplicates(["plan"])

    def _planned(self, rows: DataFrame, name: str, demo: Column | None = None) -> DataFrame:
        """Rows once for each plan of an intent; with ``demo``, only the rows of demo batches where the plan asks for these."""
        plans = F.broadcast(self.plans.filter(F.col("name") == name).select("plan", F.col("demo").alias("_demo"), F.col("values").alias("_values")))
        rows = rows.join(plans, F.lit(True))
        return (rows if demo is None else rows.filter(~F.col("_demo") | F.coalesce(demo, F.lit(False)))).drop("_demo")

    def _with_demo(self, rows: DataFrame) -> DataFrame:
        """Add ``in_demo``: whether a demo batch has a message of the row's group."""
        of = self.ledger.members.filter("batch_kind = 'demo'").select("tenant", "group_id").distinct().withColumn("in_demo", F.lit(True))
        return rows.join(of, ["tenant", "group_id"], "left")

    @staticmethod
    def _shape(rows: DataFrame, why: Column, score: Column | None = None, by: str = "plan") -> DataFrame:
        return rows.select(by, F.col("ord").cast("long").alias("ord"), "message_id", (F.lit(1.0) if score is None else score).cast("double").alias("score"), why.alias("why"), "group_id")

    @staticmethod
    def _first(rows: DataFrame, name: str, *order: Column) -> DataFrame:
        """The first rows of each plan, as many as an answer shows."""
        return rows.withColumn("ord", F.row_number().over(Window.partitionBy("plan").orderBy(*order))).filter(F.col("ord") <= A.CAPS[name])

    def _routed(self, name: str, route: str, why: Column) -> DataFrame:
        rows = self._planned(self.ledger.grouped.filter(F.col("route") == route), name, F.col("batch_kind") == "demo")
        return self._shape(numbered_in_order(rows, ["plan"], F.floor(F.col("seq") / STRIDE), [F.col("seq"), F.col("tenant")], "ord"), why)

    def _became_priority(self) -> DataFrame:
        newest = self.ledger.batches.groupBy("tenant").agg(F.max("batch_idx").alias("batch_idx"))
        now = self.ledger.changes.join(newest, ["tenant", "batch_idx"]).filter("trigger = 'message'").withColumn("_crossed", F.col("previous") != F.col("new"))
        # of a band that some group crossed into, only these count; else those that rose within it
        crossed = now.groupBy("new").agg(F.bool_or("_crossed").alias("_any"))
        now = now.join(F.broadcast(crossed), "new").filter(F.when(F.col("_any"), F.col("_crossed")).otherwise(F.col("score") > F.col("previous_score")))
        rows = self._planned(now, "became_priority").filter(F.array_contains("_values", F.col("new")))
        rows = rows.select("plan", "group_id", "new", F.posexplode("new_message_ids").alias("n", "message_id"))
        return self._shape(numbered_in_order(rows, ["plan"], F.left("group_id", F.lit(10)), [F.col("group_id"), F.col("n")], "ord"), F.concat(F.lit("it moved "), F.col("group_id"), F.lit(" to "), F.col("new")))

    def _deadline_changes(self) -> DataFrame:
        rows = self.ledger.histories["deadline_history"].filter("origin = 'l2_update' and direction in ('earlier', 'later', 'unresolved')")
        rows = self._planned(self._with_demo(rows), "deadline_changes", F.col("in_demo"))
        rows = numbered_in_order(rows, ["plan"], F.left(F.coalesce("timestamp", F.lit("")), F.lit(13)), [F.col("timestamp"), F.col("seq")], "ord")
        return self._shape(rows, A.deadline_why())

    def _conflicts(self) -> DataFrame:
        dated = F.array_contains("_values", "dated")
        firm = self._planned(self._with_demo(self.ledger.histories["conflicts"]), "conflicts", F.col("in_demo")).filter(~dated | F.col("kind").isin(A.DEADLINE_CONFLICTS))
        firm = firm.select("plan", F.lit(0).alias("part"), "seq", "group_id", F.concat_ws(": ", "kind", "detail").alias("why"), F.posexplode("message_ids").alias("n", "message_id")).filter("message_id <> ''")
        loose = self._planned(self.ledger.grouped, "conflicts", F.col("batch_kind") == "demo").filter(A.uncertain(dated))
        both = firm.unionByName(loose.select("plan", F.lit(1).alias("part"), "seq", "group_id", F.lit("it is uncertain in itself").alias("why"), F.lit(0).alias("n"), "message_id"))
        one = both.withColumn("_n", F.row_number().over(Window.partitionBy("plan", "message_id").orderBy("part", "seq", "n"))).filter("_n = 1")
        return self._shape(self._first(one, "conflicts", F.col("part"), F.col("group_id"), F.col("seq"), F.col("n")), F.col("why"))

    def _rescheduled(self) -> DataFrame:
        last = self.ledger.members.groupBy("tenant", "group_id").agg(F.max("timestamp").alias("_last"))
        rows = self.ledger.members.filter("act = 'reschedule'").join(last, ["tenant", "group_id"])
        rows = self._planned(self._with_demo(rows), "rescheduled", F.col("in_demo"))
        return self._shape(self._first(rows, "rescheduled", F.desc("_last"), F.col("group_id"), F.col("seq")), F.concat(F.lit("a reschedule act on "), F.col("group_id")), F.col("match_score"))

    def _by_status(self) -> DataFrame:
        rows = self._with_demo(self.ledger.groups.filter(F.col("status_source").isNotNull()))
        rows = self._planned(rows, "by_status", F.col("in_demo")).filter(F.array_contains("_values", F.col("status"))).withColumn("message_id", F.col("status_source"))
        rows = numbered_in_order(rows, ["plan"], F.struct("status", F.floor(F.col("group_no") / STRIDE)), [F.col("status"), F.col("group_no")], "ord")
        return self._shape(rows, A.status_why(), F.col("confidence"))

    def _open_groups(self) -> DataFrame:
        band = self.ledger.priorities.select("tenant", "group_id", "priority", F.col("score").alias("_band_score"), "priority_confidence", "as_of")
        rows = self.ledger.groups.filter(~F.col("status").isin(S.TERMINAL)).join(band, ["tenant", "group_id"])
        return rows.withColumn("message_id", F.coalesce("latest_deadline_source", "schedule_source", "status_source", "first_message"))

    def _due_today(self) -> DataFrame:
        rows = self._planned(self._open_groups().filter(A.due_by_now()), "due_today")
        return self._shape(self._first(rows, "due_today", F.desc("_band_score"), F.col("group_id")), F.concat(F.lit("it set the deadline of "), F.col("group_id"), F.lit(", now "), F.col("priority")), F.col("priority_confidence"))

    def _pending_by_priority(self) -> DataFrame:
        rows = self._planned(self._with_demo(self._open_groups()), "pending_by_priority", F.col("in_demo")).filter(F.array_contains("_values", F.col("priority")))
        return self._shape(self._first(rows, "pending_by_priority", F.desc("_band_score"), F.col("group_id")), F.concat(F.col("group_id"), F.lit(" is open and "), F.col("priority")), F.col("priority_confidence"))

    def _shared(self) -> DataFrame:
        """Evidence (plan, ...) of the intents that some question has."""
        made = {
            "blocked_messages": lambda: self._routed("blocked_messages", "blocked", A.blocked_why()),
            "needs_confirmation": lambda: self._routed("needs_confirmation", "confirm_required", F.col("confirmation_prompt")),
            "became_priority": self._became_priority, "deadline_changes": self._deadline_changes, "conflicts": self._conflicts, "rescheduled": self._rescheduled,
            "by_status": self._by_status, "due_today": self._due_today, "pending_by_priority": self._pending_by_priority,
        }
        wanted = {r["name"] for r in self.plans.select("name").distinct().collect()}
        parts = [f() for name, f in made.items() if name in wanted]
        return reduce(DataFrame.unionByName, parts) if parts else None

    # -- evidence of a question's own -----------------------------------------------
    def _grouped(self) -> DataFrame:
        """Evidence of questions about one group, found once for each group and intent."""
        wanted = self.sourced.filter("group_id is not null")
        groups = lambda name: wanted.filter(F.col("name") == name).select("group_id").distinct()
        of = lambda name: self.ledger.members.join(groups(name), "group_id", "left_semi")

        def last(rows: DataFrame, n: int) -> DataFrame:
            newest = rows.withColumn("_n", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("seq")))).filter(F.col("_n") <= n)
            return newest.withColumn("ord", F.row_number().over(Window.partitionBy("group_id").orderBy("seq")).cast("long"))

        about = numbered_in_order(of("messages_about"), ["group_id"], F.floor(F.col("seq") / STRIDE), [F.col("seq")], "ord")
        source = self.ledger.groups.join(groups("latest_status"), "group_id", "left_semi").select(F.col("group_id").alias("_of"), F.col("status_source").alias("message_id"))
        newest = of("latest_status").groupBy(F.col("group_id").alias("_of")).agg(F.max_by("message_id", "seq").alias("message_id"))
        deciding = self.ledger.members.join(source.unionByName(newest).filter("message_id is not null").distinct(), "message_id")
        deciding = deciding.withColumn("ord", F.row_number().over(Window.partitionBy("_of").orderBy("seq")))
        member = F.concat(F.lit("member of "), F.col("group_id"), F.lit(" ("), F.col("act"), F.lit(")"))
        shape = lambda rows, name, why, key="group_id": rows.select(F.lit(name).alias("name"), F.col(key).alias("_of"), F.col("ord").cast("long").alias("ord"), "message_id", F.col("match_score").cast("double").alias("score"), why.alias("why"), "group_id")
        parts = [
            shape(about, "messages_about", member),
            shape(last(of("explain_priority"), 6), "explain_priority", member),
            shape(last(of("yes_no_verification").filter(F.col("act").isin(A.ASSERTING)), 4), "yes_no_verification", member),
            shape(deciding, "latest_status", F.concat(F.lit("it decides or follows the status of "), F.col("group_id")), "_of"),
        ]
        return reduce(DataFrame.unionByName, parts).withColumn("source", F.concat_ws("|", "name", "_of")).drop("name", "_of")

    def _retrieved(self) -> DataFrame:
        """Evidence that a search finds: of open questions, and of messages about something that is no group."""
        lost = self.asked.filter("name = 'messages_about'").join(self.meant.select("key"), "key", "left_anti")
        texts = lost.select("key", "name", F.coalesce("subject", "question").alias("text")).unionByName(self.asked.filter("name = 'open_search'").select("key", "name", F.col("question").alias("text")))
        hits = self._keep(self._search(texts, SEARCHED), "searched").join(texts.select("key", "name"), "key")
        hits = hits.filter((F.col("name") != "open_search") | (F.col("rank") <= A.CONTEXT)).join(self.ledger.grouped.select("message_id", "group_id", "act"), "message_id")
        whole = Window.partitionBy("key")
        enough, open_ = F.col("score") >= retrieve.MIN_EVIDENCE, F.col("name") == "open_search"
        asks = F.col("act").isin("open_question", "status_query")
        hits = hits.withColumns({"_best": F.max("score").over(whole), "_answered": F.bool_or(enough & ~asks).over(whole)})
        hits = hits.filter((F.col("_best") >= retrieve.MIN_EVIDENCE) & (~open_ | (enough & F.col("_answered"))))
        hits = hits.withColumn("ord", F.row_number().over(whole.orderBy("rank", "group_id")))
        return self._shape(hits, F.concat(F.lit("retrieved on "), F.array_join("matched_terms", ", ")), F.col("score"), "key")

    # -- answers ---------------------------------------------------------------------
    @cached_property
    def found(self) -> DataFrame:
        """(source, ord, message_id, score, why, group_id, route, masked_text, withheld, newest): the evidence of each source, as much as an answer shows.

        Texts are quoted only where policy allows; ``newest``: the message came in its tenant's last batch.
        """
        rows = self._grouped().unionByName(self._retrieved().withColumnRenamed("key", "source"))
        shared = self._shared()
        if shared is not None:
            rows = rows.unionByName(shared.withColumnRenamed("plan", "source"))
        last = self.ledger.batches.groupBy("tenant").agg(F.max("batch_idx").alias("_last"))
        about = self.ledger.records.join(last, "tenant").select("message_id", "route", routing.may("quote_in_answer").alias("_quotable"), "masked_text", (F.col("batch_idx") == F.col("_last")).alias("newest"))
        rows = rows.join(about, "message_id", "left")
        rows = rows.withColumns({"withheld": ~F.coalesce("_quotable", F.lit(False)), "masked_text": F.when(F.col("_quotable"), F.col("masked_text"))}).drop("_quotable")
        return self._keep(rows, "evidence")

    def evidence(self) -> DataFrame:
        """``found`` listed for each question_id. Its size is that of all answers together; ``answers`` and ``found`` are smaller."""
        return self.sourced.select("source", "question_id").join(self.found, "source").drop("source")

    def answers(self, confirmed: bool = False) -> DataFrame:
        """One row a question: intent, the group it means, the source of its evidence and how much there is, its strictest route, and whether it is refused.

        ``weak_link``: a single word links the question to the group it is taken to mean.
        ``n_newest``: how much of the evidence came in the last batch.
        """
        counted = {"n_evidence": F.count("*"), "n_withheld": F.count_if(F.col("route") == "blocked"), "n_confirm": F.count_if(F.col("route") == "confirm_required"), "n_newest": F.count_if("newest")}
        n = self.found.groupBy("source").agg(*(c.alias(name) for name, c in counted.items()))
        rows = self.sourced.join(n, "source", "left")
        weak = (F.coalesce(F.size("shared"), F.lit(0)) == 1).alias("weak_link")
        rows = rows.select("question_id", "question", F.col("name").alias("intent"), "group_id", weak, "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in counted))
        route = F.when(F.col("n_withheld") > 0, "blocked").when((F.col("n_confirm") > 0) & F.lit(not confirmed), "confirm_required").otherwise("local_only")
        return rows.withColumns({"route": route, "refused": F.col("n_evidence") == 0})
