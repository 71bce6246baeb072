"""Questions over a ledger: intent, the messages that are evidence, and how the answer may be shown.

An intent picks a plan over the ledger's tables; the plan's result is the evidence
(ord, message_id, score, why, group_id). Texts are quoted only where policy allows,
and a question without evidence is refused instead of guessed at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missive import schema as S
from missive.functions import text as T
from missive.operators import retrieve, routing, subject

# The question frames in order of precedence.
INTENTS = [
    ("blocked_messages", r"\b(?:blocked?|must\s+be\s+blocked|not\s+be\s+(?:sent|shared)|external\s+processing|do\s+not\s+send)\b"),
    ("needs_confirmation", r"\b(?:require|requires|requiring|need|needs)\s+(?:a\s+)?confirmation|\bconfirmation\s+before\b|\bask\s+for\s+confirmation\b"),
    ("became_priority", r"\bbecame\s+(critical|high|medium|low)\b|\bnewly\s+(critical|high)\b|\bescalated\b|\bwhich\s+.*\bbecame\b"),
    ("explain_priority", r"\bwhy\s+(?:was|is|were)\b.*\b(?:critical|high|medium|low|priority|marked|flagged)\b|\bexplain\s+the\s+priority\b"),
    ("deadline_changes", r"\bdeadlines?\s+(?:have\s+)?(?:changed|moved|shifted|been\s+(?:changed|moved|extended))\b|\bwhat\s+deadlines?\b|\bchanged\s+deadlines?\b"),
    ("conflicts", r"\bconflict(?:s|ing)?\b|\bcontradict\w*\b|\bdisagree\w*\b|\buncertain\s+deadlines?\b|\bambiguous\b"),
    ("rescheduled", r"\breschedul\w+\b|\bmoved\s+to\s+a\s+new\b|\bnew\s+schedule\b|\bchanged\s+(?:its\s+)?(?:time|slot|schedule)\b"),
    ("due_today", r"\b(?:due|complete|do|finish|work\s+on)\b.*\b(?:today|now|right\s+now)\b|\btoday'?s?\s+tasks?\b|\bwhat\s+should\s+i\s+do\b"),
    ("by_status", r"\b(?:completed|finished|cancelled|canceled|done|(?:are|is|been)\s+complete)\b"),
    ("pending_by_priority", r"\b(?:critical|high|urgent|top)[\s-]*(?:or\s+high[\s-]*)?(?:priority)?\b.*\b(?:pending|outstanding|open|still|left|remain)\b|\b(?:pending|outstanding|open)\b.*\b(?:critical|high|priority)\b|\bwhat\s+is\s+(?:still\s+)?(?:pending|outstanding)\b"),
    ("latest_status", r"\blatest\s+status\b|\bcurrent\s+status\b|\bstatus\s+of\b|\bwhere\s+(?:do|does)\s+.*\bstand\b|\bwhat\s+happened\s+to\b"),
    ("yes_no_verification", r"^\s*(?:was|were|is|are|did|does|do|has|have|had|will|would|should)\b.*\?\s*$"),
    ("messages_about", r"\bshow\s+(?:me\s+)?(?:all\s+)?messages?\b|\bmessages?\s+(?:related|about|regarding|concerning)\b|\ball\s+messages?\s+for\b|\bfind\s+(?:me\s+)?messages?\b"),
]
IDS = r"\b((?:MSG|DEMO|TASK|EVENT|GROUP)_[A-Za-z0-9]+)\b"
ABOUT = r"\b(?:about|regarding|concerning|related\s+to|for|of|on)\s+(?:the\s+)?(.+?)\s*[?.]?$"
BAND, STATUS = r"\b(critical|high|medium|low)\b", r"\b(completed|complete|finished|cancelled|canceled|pending|rescheduled|unclear)\b"
DEMO = r"\b(?:demo|test)\s+(?:data|messages?|batch|set)\b|\bin\s+the\s+demo\b"
DATED = r"\bdeadlines?\b|\bdue\s+dates?\b|\bdates?\b"
SAME_STATUS = {"complete": "completed", "finished": "completed", "canceled": "cancelled"}
DEADLINE_CONFLICTS = ["deadline_changed", "deadline_changed_after_closure", "unresolved_alternatives"]
ASSERTING = ["completion", "cancellation", "reschedule", "deadline_change", "progress_update"]
CAPS = {"conflicts": 24, "rescheduled": 20, "due_today": 12, "pending_by_priority": 12}
CONTEXT = 5


@dataclass
class Intent:
    name: str
    subject: str | None = None
    ids: list[str] = field(default_factory=list)
    bands: list[str] = field(default_factory=list)
    statuses: list[str] = field(default_factory=list)
    demo: bool = False


def intent_of(question: str) -> Intent:
    """What kind of question it is and what it is about."""
    has = lambda p: re.search(p, question, re.IGNORECASE)
    ids = [i.upper() for i in re.findall(IDS, question, re.IGNORECASE)]
    about = has(ABOUT)
    about = about and re.sub(r"^(?:the\s+)?(?:task|item|meeting|event)\s+", "", about[1].strip(), flags=re.IGNORECASE).strip()
    statuses = [SAME_STATUS.get(w.lower(), w.lower()) for w in re.findall(STATUS, question, re.IGNORECASE)]
    return Intent(
        next((n for n, p in INTENTS if has(p)), "open_search"), about or None, ids, [b.lower() for b in re.findall(BAND, question, re.IGNORECASE)],
        list(dict.fromkeys(statuses)), bool(has(DEMO)) or any(i.startswith("DEMO_") for i in ids),
    )


def blocked_why() -> Column:
    return F.concat(F.lit("policy "), F.col("policy_id"), F.lit(" blocks it for "), F.array_join("sensitivity_types", ", "))


def deadline_why() -> Column:
    return F.concat_ws(" ", F.lit("it changed the deadline:"), F.coalesce("previous", F.lit("none")), F.lit("to"), F.coalesce("new", "raw"), "direction")


def status_why() -> Column:
    return F.concat(F.lit("it set "), F.col("group_id"), F.lit(" to "), F.col("status"), F.lit(": "), F.col("status_reason"))


def uncertain(dated: Column) -> Column:
    """Whether a message leaves something open by itself."""
    return (F.size("alternatives") > 0) | (F.col("conflict_marker") & F.col("group_id").isNull()) | (dated & F.col("act_hedged") & F.col("new_date_raw").isNotNull())


def due_by_now() -> Column:
    """Whether an open group's date isn't after the day of the last message, or is said to be near."""
    due, today = F.coalesce("latest_deadline", "latest_date"), F.left("as_of", F.lit(10))
    return (due <= today) | F.lower("pending_relative_deadline").rlike("today|tonight")


@dataclass
class Answer:
    intent: Intent
    evidence: DataFrame
    route: DataFrame
    retrieved: DataFrame
    #: (kind, group_id, ord, detail): what stands beside the evidence, see ``Assistant.details``
    details: DataFrame | None = None

    def refused(self) -> bool:
        """Whether nothing supports an answer."""
        return self.evidence.isEmpty()


class Assistant:
    """Answers questions from one ledger's tables."""

    def __init__(self, ledger):
        self.ledger, self.spark = ledger, ledger.messages.sparkSession

    def _rows(self, df: DataFrame, order: list[Column], why: Column | str, score: Column | float = 1.0, group: str = "group_id") -> DataFrame:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        n = F.row_number().over(Window.orderBy(*order))
        return df.select(n.alias("ord"), "message_id", lit(score).cast("double").alias("score"), lit(why).alias("why"), F.col(group).alias("group_id"))

    def _demo(self, df: DataFrame, intent: Intent) -> DataFrame:
        """Only groups with a message of a demo batch, where the question asks for these."""
        if not intent.demo:
            return df
        of = self.ledger.members.filter("batch_kind = 'demo'").select("tenant", "group_id").distinct()
        return df.join(of, ["tenant", "group_id"], "left_semi")

    def _search(self, text: str, k: int) -> DataFrame:
        asked = self.spark.createDataFrame([(0, text)], "query_id long, text string")
        return self.ledger.index.hybrid(asked, k).select("rank", F.col("doc_id").alias("message_id"), "score", "matched_terms")

    def resolve(self, question: str, intent: Intent) -> str | None:
        """The group a question means: by an id in it, by its subject, by its wording, else by what it retrieves."""
        return self._meant(question, intent)[0]

    def _meant(self, question: str, intent: Intent) -> tuple[str | None, list[str] | None]:
        """``resolve``'s group, and the words it shares with the question where these decided."""
        led = self.ledger
        for i in intent.ids:
            hit = led.members.filter((F.col("message_id") == i) | (F.col("item_id") == i) | (F.col("group_id") == i)).select("group_id").head()
            if hit:
                return hit[0], None
        for phrase in filter(None, [intent.subject, question]):
            probe = self.spark.createDataFrame([(0, phrase)], "id long, phrase string").select("id", T.signature(F.col("phrase")).alias("s")).filter("s is not null").select("id", "s.tokens")
            names = led.members.select(F.col("group_id").alias("id"), F.col("subject.tokens").alias("tokens")).distinct()
            best = subject.best_match(subject.subject_pairs(probe, names, led.idf)).head()
            if best:
                return best["b"], list(best["shared"])
        votes = self._search(question, CONTEXT).filter(F.col("score") >= retrieve.MIN_EVIDENCE).join(led.members.select("message_id", "group_id"), "message_id")
        votes = votes.groupBy("group_id").agg(F.sum("score").alias("v")).orderBy(F.desc("v"), "group_id").take(2)
        return (votes[0]["group_id"] if votes and (len(votes) == 1 or votes[0]["v"] >= 0.6) else None), None

    def evidence(self, question: str, intent: Intent) -> DataFrame:
        """(ord, message_id, score, why, group_id) of what answers the question; no rows: refuse."""
        return getattr(self, f"_{intent.name}")(question, intent)

    def answer(self, question: str, confirmed: bool = False) -> Answer:
        intent = intent_of(question)
        found = self.evidence(question, intent)
        cap = CAPS.get(intent.name)
        found = found if cap is None else found.filter(F.col("ord") <= cap)
        about = self.ledger.records.select("message_id", "timestamp", "sender", "item_id", routing.may("quote_in_answer").alias("quotable"), "masked_text")
        shown = found.join(about, "message_id", "left").withColumns({"masked_text": F.when(F.col("quotable"), F.col("masked_text")), "withheld": ~F.coalesce("quotable", F.lit(False))}).drop("quotable")
        return Answer(intent, shown, routing.route_answer(found, self.ledger.records, confirmed), self._search(question, CONTEXT), self.details(question, intent, found))

    # -- what stands beside the evidence --------------------------------------
    def details(self, question: str, intent: Intent, found: DataFrame) -> DataFrame:
        """(kind, group_id, ord, detail) of an answer.

        ``signal`` and ``history``: what a priority is made of, and its last changes;
        ``elapsed_time``: subjects that reached a band without a message; ``weak_link``:
        the question shares a single word with the subject it is taken to mean;
        ``newest_batch``: a message of the evidence that came in the last batch, where others
        came before; ``insufficient``: nothing supports an answer.
        """
        rows = found.limit(1).agg(F.count("*").alias("n")).filter("n = 0")
        rows = rows.select(F.lit("insufficient").alias("kind"), F.lit(None).cast("string").alias("group_id"), F.lit(0).alias("ord"), F.lit("the messages don't support an answer").alias("detail"))
        rows = rows.unionByName(self._newest(found))
        if intent.name == "became_priority":
            target = (intent.bands or ["critical"])[0]
            late = self._last_changes().filter((F.col("new") == target) & (F.col("trigger") == "elapsed_time"))
            rows = rows.unionByName(late.select(F.lit("elapsed_time").alias("kind"), "group_id", F.lit(0).alias("ord"), F.concat_ws(" ", F.lit("it became"), F.col("new"), F.lit("as time went by, without a message")).alias("detail")))
        if intent.name in ("explain_priority", "messages_about", "latest_status", "yes_no_verification"):
            group, shared = self._meant(question, intent)
            if group is None:
                return rows
            if intent.name == "explain_priority":
                rows = rows.unionByName(self._signals(group)).unionByName(self._history(group))
            if shared is not None and len(shared) == 1:
                weak = self.spark.createDataFrame([("weak_link", group, 0, f'only the word "{shared[0]}" links the question to this subject; name it more fully if another is meant')], rows.schema)
                rows = rows.unionByName(weak)
        return rows

    def _newest(self, found: DataFrame) -> DataFrame:
        """The evidence of the last batch, unless all of it is."""
        last = self.ledger.batches.groupBy("tenant").agg(F.max("batch_idx").alias("_last"))
        of = self.ledger.records.join(last, "tenant").select("message_id", "batch_name", (F.col("batch_idx") == F.col("_last")).alias("_newest"))
        at = found.join(of, "message_id")
        older = at.agg(F.bool_and("_newest").alias("_all")).filter("not _all")
        text = F.concat("message_id", F.lit(" came in the newest batch, "), "batch_name")
        return at.filter("_newest").join(F.broadcast(older), F.lit(True)).select(F.lit("newest_batch").alias("kind"), "group_id", F.col("ord").cast("int").alias("ord"), text.alias("detail"))

    def _signals(self, group: str) -> DataFrame:
        own = self.ledger.priorities.filter(F.col("group_id") == group).select("group_id", F.posexplode("signals").alias("ord", "s"))
        return own.select(F.lit("signal").alias("kind"), "group_id", "ord", F.concat(F.col("s.name"), F.format_string(" (%+.2f): ", "s.weight"), F.col("s.detail")).alias("detail"))

    def _history(self, group: str, last: int = 4) -> DataFrame:
        own = self.ledger.changes.filter(F.col("group_id") == group).withColumn("_n", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("batch_idx")))).filter(F.col("_n") <= last)
        return own.select(F.lit("history").alias("kind"), "group_id", F.col("batch_idx").cast("int").alias("ord"), F.concat(F.left("as_of", F.lit(10)), F.lit(": "), F.col("previous"), F.lit(" to "), F.col("new"), F.lit(", "), F.col("trigger")).alias("detail"))

    def _last_changes(self) -> DataFrame:
        led = self.ledger
        return led.changes.join(led.batches.groupBy("tenant").agg(F.max("batch_idx").alias("batch_idx")), ["tenant", "batch_idx"])

    # -- one plan per intent --------------------------------------------------
    def _routed(self, intent: Intent, route: str, why: Column) -> DataFrame:
        rows = self.ledger.grouped.filter(F.col("route") == route)
        return self._rows(rows.filter("batch_kind = 'demo'") if intent.demo else rows, [F.col("seq")], why)

    def _blocked_messages(self, question, intent):
        return self._routed(intent, "blocked", blocked_why())

    def _needs_confirmation(self, question, intent):
        return self._routed(intent, "confirm_required", F.col("confirmation_prompt"))

    def _became_priority(self, question, intent):
        target = (intent.bands or ["critical"])[0]
        now = self._last_changes().filter((F.col("new") == target) & (F.col("trigger") == "message"))
        crossed = now.filter(F.col("previous") != target)
        picked = now.filter(F.col("score") > F.col("previous_score")) if crossed.isEmpty() else crossed
        return self._rows(picked.select("group_id", "new", F.posexplode("new_message_ids").alias("n", "message_id")), [F.col("group_id"), F.col("n")], F.concat(F.lit("it moved "), F.col("group_id"), F.lit(" to "), F.col("new")))

    def _deadline_changes(self, question, intent):
        rows = self.ledger.histories["deadline_history"].filter("origin = 'l2_update' and direction in ('earlier', 'later', 'unresolved')")
        return self._rows(self._demo(rows, intent), [F.col("timestamp"), F.col("seq")], deadline_why())

    def _conflicts(self, question, intent):
        dated = bool(re.search(DATED, question, re.IGNORECASE))
        rows = self._demo(self.ledger.histories["conflicts"], intent)
        rows = rows.filter(F.col("kind").isin(DEADLINE_CONFLICTS)) if dated else rows
        firm = rows.select(F.lit(0).alias("part"), "seq", "group_id", F.concat_ws(": ", "kind", "detail").alias("why"), F.posexplode("message_ids").alias("n", "message_id")).filter("message_id <> ''")
        loose = self.ledger.grouped.filter(uncertain(F.lit(dated)))
        loose = loose.filter("batch_kind = 'demo'") if intent.demo else loose
        both = firm.unionByName(loose.select(F.lit(1).alias("part"), "seq", "group_id", F.lit("it is uncertain in itself").alias("why"), F.lit(0).alias("n"), "message_id"))
        first = both.withColumn("_n", F.row_number().over(Window.partitionBy("message_id").orderBy("part", "seq", "n"))).filter("_n = 1")
        return self._rows(first, [F.col("part"), F.col("group_id"), F.col("seq"), F.col("n")], F.col("why"))

    def _rescheduled(self, question, intent):
        last = Window.partitionBy("tenant", "group_id")
        rows = self._demo(self.ledger.members, intent).withColumn("_last", F.max("timestamp").over(last)).filter("act = 'reschedule'")
        return self._rows(rows, [F.desc("_last"), F.col("group_id"), F.col("seq")], F.concat(F.lit("a reschedule act on "), F.col("group_id")), F.col("match_score"))

    def _by_status(self, question, intent):
        wanted = [s for s in intent.statuses or S.TERMINAL if s in S.STATUSES]
        rows = self._demo(self.ledger.groups, intent).filter(F.col("status").isin(wanted) & F.col("status_source").isNotNull()).withColumn("message_id", F.col("status_source"))
        return self._rows(rows, [F.col("status"), F.col("group_no")], status_why(), F.col("confidence"))

    def _open_groups(self) -> DataFrame:
        band = self.ledger.priorities.select("tenant", "group_id", "priority", "score", "priority_confidence", "as_of")
        return self.ledger.groups.filter(~F.col("status").isin(S.TERMINAL)).join(band, ["tenant", "group_id"])

    def _sourced(self, rows: DataFrame, why: Column) -> DataFrame:
        rows = rows.withColumn("message_id", F.coalesce("latest_deadline_source", "schedule_source", "status_source", "first_message"))
        return self._rows(rows, [F.desc("score"), F.col("group_id")], why, F.col("priority_confidence"))

    def _due_today(self, question, intent):
        return self._sourced(self._open_groups().filter(due_by_now()), F.concat(F.lit("it set the deadline of "), F.col("group_id"), F.lit(", now "), F.col("priority")))

    def _pending_by_priority(self, question, intent):
        rows = self._demo(self._open_groups().filter(F.col("priority").isin(intent.bands or ["critical", "high"])), intent)
        return self._sourced(rows, F.concat(F.col("group_id"), F.lit(" is open and "), F.col("priority")))

    def _members(self, group: str | None, keep: Column | None = None, last: int | None = None) -> DataFrame:
        rows = self.ledger.members.filter(F.col("group_id") == (group or ""))
        rows = rows if keep is None else rows.filter(keep)
        if last is not None:
            rows = rows.withColumn("_n", F.row_number().over(Window.orderBy(F.desc("seq")))).filter(F.col("_n") <= last)
        return self._rows(rows, [F.col("seq")], F.concat(F.lit("member of "), F.col("group_id"), F.lit(" ("), F.col("act"), F.lit(")")), F.col("match_score"))

    def _explain_priority(self, question, intent):
        return self._members(self.resolve(question, intent), last=6)

    def _latest_status(self, question, intent):
        group = self.resolve(question, intent)
        source = self.ledger.groups.filter(F.col("group_id") == (group or "")).select(F.col("status_source").alias("message_id"))
        last = self.ledger.members.filter(F.col("group_id") == (group or "")).orderBy(F.desc("seq")).limit(1).select("message_id")
        wanted = source.union(last).filter("message_id is not null").distinct()
        rows = self.ledger.members.join(wanted, "message_id", "left_semi")
        return self._rows(rows, [F.col("seq")], F.concat(F.lit("it decides or follows the status of "), F.col("group_id")), F.col("match_score"))

    def _retrieved(self, question: str, k: int) -> DataFrame:
        hits = self._search(question, k).join(self.ledger.grouped.select("message_id", "group_id", "act"), "message_id")
        best = hits.agg(F.max("score").alias("_best")).filter(F.col("_best") >= retrieve.MIN_EVIDENCE)
        return hits.join(F.broadcast(best), F.lit(True), "left_semi")

    def _messages_about(self, question, intent):
        group = self.resolve(question, intent)
        if group:
            return self._members(group)
        return self._rows(self._retrieved(intent.subject or question, 12), [F.col("rank")], F.concat(F.lit("retrieved on "), F.array_join("matched_terms", ", ")), F.col("score"))

    def _yes_no_verification(self, question, intent):
        return self._members(self.resolve(question, intent), F.col("act").isin(ASSERTING), last=4)

    def _open_search(self, question, intent):
        """Refused where the best hits only ask the same question again."""
        hits = self._retrieved(question, CONTEXT).filter(F.col("score") >= retrieve.MIN_EVIDENCE)
        answered = hits.filter(~F.col("act").isin("open_question", "status_query"))
        return self._rows(hits.join(F.broadcast(answered.select(F.lit(1).alias("_one")).limit(1)), F.lit(True), "left_semi"), [F.col("rank")], F.concat(F.lit("retrieved on "), F.array_join("matched_terms", ", ")), F.col("score"))
