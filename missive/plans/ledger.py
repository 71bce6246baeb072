"""The two layers end to end: classified messages, and the ledger of subjects over batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive import schema as S
from missive.functions.order import spread
from missive.operators import acts, classify, extract, groups, model, outputs, priority, retrieve, routing, sensitive, subject
from missive.sources.csv import sequenced
from missive.sources.tables import removed, written


def enriched(messages: DataFrame, artifact: model.Artifact | None = None, people: DataFrame | None = None, gate: bool = False, order: bool = False) -> DataFrame:
    """Mask, route, classify and extract. The raw text is gone after the first step, before any shuffle.

    ``gate``: extract only where the row's policy allows it. ``order``: number the messages.
    """
    rows = sensitive.masked(messages)
    rows = routing.route(sequenced(rows) if order else rows)
    rows = classify.with_rules(rows)
    if artifact is not None:
        rows = model.with_predictions(rows, artifact)
    rows = classify.with_category(rows, with_model=artifact is not None)
    return extract.with_items(rows, people, routing.may("extract") if gate else None)


def layer1(messages: DataFrame, artifact: model.Artifact | None = None) -> DataFrame:
    """Layer 1 of one batch with ``seq``: everything per message, items numbered and people looked up in the batch."""
    people = extract.roster(messages)
    return extract.numbered(enriched(messages, artifact, people))


def mean_of(column: str) -> Column:
    """A mean to four places of values of at most four: summed as decimals, so the order of rows never shows at a tie."""
    return F.round((F.sum(F.round(column, 4).cast("decimal(18,4)")) / F.count(column)), 4).cast("double")


def layer1_summary(rows: DataFrame) -> DataFrame:
    """One row of counts, first and last timestamp, number of senders and mean confidence; ``extract.roster`` has the senders."""
    return rows.agg(
        F.count("*").alias("messages"), F.min_by("timestamp", "seq").alias("first_timestamp"), F.max_by("timestamp", "seq").alias("last_timestamp"), F.count_if(F.col("item_type") == "task").alias("tasks"),
        F.count_if(F.col("item_type") == "event").alias("events"), F.count_if("is_sensitive").alias("sensitive"), F.count_if("needs_review").alias("needs_review"), F.sum(F.coalesce(F.size("unresolved_fields"), F.lit(0))).alias("unresolved_fields"),
        mean_of("confidence").alias("mean_confidence"), F.count_distinct("sender").alias("n_senders"),
    )


def counts_of(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts per value of a closed vocabulary, zeros included."""
    spark = rows.sparkSession
    dim = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"ord int, {column} string")
    n = rows.groupBy(column).agg(F.count("*").alias("n"))
    return F.broadcast(dim).join(n, column, "left").select("ord", column, F.coalesce("n", F.lit(0)).alias("n"))


def records_of(rows: DataFrame, before: dict[str, int] | None = None) -> DataFrame:
    """Records of ``enriched`` rows with numbered items, acts and subjects.

    ``before``: how many messages and items of each type earlier batches have, for rows
    that are a batch alone.
    """
    before = before or {}
    rows = extract.numbered(rows.withColumn("seq", F.col("seq") + before.get("messages", 0)), before)
    return subject.with_subject(acts.with_acts(rows))


#: what of a message its category, item, act and subject follow from, its day of sending apart
SAID = ["masked_text", "_promoter", "overall_risk", "sensitivity_types", "_may"]


def records_by_text(rows: DataFrame, keep: Callable = written) -> DataFrame:
    """``records_of`` of masked and routed rows with ``seq``: the grammar reads each distinct text once, however many messages say it.

    ``keep`` writes the table of texts, which messages then take by an equi-join.
    """
    promoter = F.lower(F.trim(F.coalesce("sender", F.lit("")))).isin(S.PROMOTIONAL_SENDERS)
    rows = rows.withColumns({"_promoter": F.when(promoter, F.col("sender")), "_may": routing.may("extract")})
    texts = spread(rows.select(*SAID).distinct(), "masked_text")
    texts = classify.with_category(classify.with_rules(texts, sender_col="_promoter"))
    texts = keep(subject.with_subject(acts.with_acts(extract.stated(texts, allowed=F.col("_may")))), "texts")
    about = texts.withColumnsRenamed({c: f"_of_{c}" for c in SAID})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in SAID]
    told = rows.join(about, reduce(Column.__and__, same)).drop(*(f"_of_{c}" for c in SAID), "_promoter", "_may")
    return extract.numbered(extract.timed(told))


def judged_by_text(rows: DataFrame, keep: Callable = written) -> tuple[DataFrame, DataFrame]:
    """Masked and routed rows as texts with the verdict of the rules (text_id, n and ``classify.with_rules``), and (message_id, text_id).

    What a verdict or a model says follows from the text, its sender's role and its
    findings: so it is found once for each distinct one, which stands for ``n`` messages.
    """
    promoter = F.lower(F.trim(F.coalesce("sender", F.lit("")))).isin(S.PROMOTIONAL_SENDERS)
    said = ["masked_text", "_promoter", "overall_risk", "sensitivity_types"]
    rows = keep(rows.withColumn("_promoter", F.when(promoter, F.col("sender"))).select("message_id", *said), "said")
    texts = spread(rows.groupBy(*said).agg(F.count("*").alias("n")), "masked_text")
    # numbered as a table: the numbers are read again, not made again
    texts = keep(classify.with_rules(texts, sender_col="_promoter").withColumn("text_id", F.monotonically_increasing_id()), "judged-texts")
    about = texts.select("text_id", *(F.col(c).alias(f"_of_{c}") for c in said))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in said]
    messages = keep(rows.join(about, reduce(Column.__and__, same)).select("message_id", "text_id"), "judged")
    return texts, messages


#: long columns of the records that no report of groups reads
UNGROUPED = ["masked_text", "canonical", "body", "core", "findings", "rule_signals", "reason", "confirmation_prompt", "item_priority_reason"]


@dataclass
class Ledger:
    """The tables of a run.

    Those that others read are written when they are first asked for: each further plan
    starts from a table and not from the whole grammar. ``unpersist`` removes them.
    ``layer1``: records that were made before (``records_of`` batch by batch), where given.
    """

    messages: DataFrame
    artifact: model.Artifact | None = None
    layer1: DataFrame | None = None
    kept: list[DataFrame] = field(default_factory=list)

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        self.kept.append(written(df, name))
        return self.kept[-1]

    @cached_property
    def records(self) -> DataFrame:
        """One row per message: masked text, findings, route, category, item, act and subject."""
        if self.layer1 is not None:
            return self.layer1
        if self.artifact is not None:  # a model reads whole messages
            rows = self._keep(enriched(self.messages, self.artifact, gate=True, order=True), "items")
            return self._keep(records_of(rows), "records")
        rows = self._keep(routing.route(sequenced(sensitive.masked(self.messages))), "masked")
        return self._keep(records_by_text(rows, self._keep), "records")

    @cached_property
    def batches(self) -> DataFrame:
        return self.records.groupBy("tenant", "batch_idx", "batch_name", "batch_kind").agg(F.count("*").alias("messages"), F.min_by("timestamp", "seq").alias("first_seen"), F.max_by("timestamp", "seq").alias("last_seen"))

    @cached_property
    def idf(self) -> DataFrame:
        """Subject statistics over all batches."""
        return self._keep(subject.subject_idf(self.records), "idf")

    @cached_property
    def members(self) -> DataFrame:
        return self._keep(groups.assign(self.records.drop(*UNGROUPED), self.idf, self._keep), "members")

    @cached_property
    def states(self) -> DataFrame:
        return self._keep(groups.lifecycle(self.members), "states")

    @cached_property
    def groups(self) -> DataFrame:
        return self._keep(groups.final_groups(self.members, self.states), "groups")

    @cached_property
    def histories(self) -> dict[str, DataFrame]:
        return groups.histories(self.members, self.states)

    @cached_property
    def last_states(self) -> DataFrame:
        return self._keep(priority.last_states(self.members, self.states), "last-states")

    @staticmethod
    def _decided(at: DataFrame) -> DataFrame:
        return priority.decided(at.withColumn("confidence", groups.group_confidence()))

    @cached_property
    def decisions(self) -> DataFrame:
        """Priority of every group at the end of every batch: groups x batches rows, for a report of all snapshots alone."""
        return self._keep(self._decided(priority.snapshot_states(self.last_states, self.batches)), "decisions")

    @cached_property
    def changes(self) -> DataFrame:
        """From the batches in which a group's score can change, see ``priority.turning_states``."""
        return self._keep(priority.changes(self._decided(priority.turning_states(self.last_states, self.batches))), "changes")

    @cached_property
    def priorities(self) -> DataFrame:
        """The newest decision of each group."""
        return self._keep(self._decided(priority.newest_states(self.last_states, self.batches)), "priorities")

    @cached_property
    def grouped(self) -> DataFrame:
        """Records with the group they are in, if any."""
        return self.records.join(self.members.select("tenant", "seq", "group_id", "match_score", "match_tokens", "weak_link"), ["tenant", "seq"], "left")

    def priority_records(self) -> DataFrame:
        """One row per item: its group's decision, or its own where it is in no group."""
        names = ["priority", "score", "priority_confidence", "reason", "signals", "needs_review", "gated"]
        item = self.grouped.filter("item_id is not null").select("tenant", "message_id", "item_id", "item_type", "item_title", "item_date", "group_id")
        status = self.groups.select("tenant", "group_id", F.col("status").alias("group_status"), F.col("latest_deadline").alias("group_latest_deadline"))
        shared = item.join(self.priorities.select("tenant", "group_id", *names), ["tenant", "group_id"]).join(status, ["tenant", "group_id"])
        as_of = self.batches.groupBy("tenant").agg(F.max_by("last_seen", "batch_idx").alias("now"))
        lone = priority.solo(self.grouped.join(as_of, "tenant"), F.col("now"))
        alone = item.filter("group_id is null").join(lone.select("tenant", "message_id", *names), ["tenant", "message_id"]).withColumns({"group_status": F.lit(None).cast("string"), "group_latest_deadline": F.lit(None).cast("string")})
        return shared.unionByName(alone)

    def documents(self) -> DataFrame:
        """What may be searched: masked text with the group's title, and whether policy admits it."""
        title = self.groups.select("tenant", "group_id", "title")
        rows = self.grouped.join(title, ["tenant", "group_id"], "left")
        return rows.select(F.col("message_id").alias("doc_id"), F.concat_ws(" ", "masked_text", "title").alias("text"), routing.may("index_for_search").alias("indexable"))

    @cached_property
    def index(self) -> retrieve.Index:
        return retrieve.Index(self.documents()).stored()

    def routing_records(self) -> DataFrame:
        """Every message's route; masked text only where a detector fired and the message isn't blocked."""
        shown = F.when(F.col("is_sensitive") & (F.col("route") != "blocked"), F.col("masked_text"))
        return self.records.select("message_id", "timestamp", "sender", "category", "route", "policy_id", "overall_risk", "sensitivity_types", "allowed", "denied", "confirmation_prompt", shown.alias("masked_text"), routing.may("index_for_search").alias("indexed"))

    def summary(self) -> DataFrame:
        """One row: groups, grouped and ungrouped messages, items, contested groups, and counts by band, status and route as maps."""
        as_map = lambda df, c: df.groupBy(c).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(c, "n")))).alias(f"by_{c}"))
        base = self.grouped.agg(F.count("*").alias("messages"), F.count("group_id").alias("grouped"), F.count("item_id").alias("items"), F.count_if(F.col("route") == "blocked").alias("blocked"))
        g = self.groups.agg(F.count("*").alias("groups"), F.count_if("contested").alias("contested"), mean_of("confidence").alias("mean_confidence"))
        return base.crossJoin(g).crossJoin(as_map(self.priorities, "priority")).crossJoin(as_map(self.groups, "status")).crossJoin(as_map(self.records, "route"))

    def tables(self) -> dict[str, DataFrame]:
        """All result tables as they are given out: without columns that quote more than the masked text, and that only of messages that aren't blocked."""
        secret = F.col("route") == "blocked"
        safe = self.grouped.withColumn("masked_text", F.when(~secret, F.col("masked_text"))).drop("message", "body", "core", "canonical", "subject", "item_signature", "findings", "rule_signals")
        return {"records": safe, "groups": self.groups, "priorities": self.priority_records(), "changes": self.changes, "routing": self.routing_records(), "summary": self.summary(), **self.histories}

    def leaks(self) -> DataFrame:
        """(output, column, shape, n): strings of the result tables that are shaped like a secret; no row where all is well."""
        return outputs.leaks(self.tables())

    def write(self, path: str, single_file: bool = False, checked: bool = False) -> None:
        """All result tables below ``path``: JSON, and CSV for groups and priorities. Blocked texts never leave.

        ``checked``: raise ValueError before anything is written if ``leaks`` finds something.
        """
        from missive.sources.csv import write_csv, write_json

        if checked and (found := self.leaks().head(20)):
            raise ValueError("shaped like a secret: " + ", ".join(f"{r['output']}.{r['column']} ({r['shape']}, {r['n']})" for r in found))
        tables = self.tables()
        for name, df in tables.items():
            write_json(df, f"{path}/{name}.json", single_file)
        write_csv(tables["groups"], f"{path}/groups.csv", single_file)
        write_csv(tables["priorities"], f"{path}/priorities.csv", single_file)

    def unpersist(self) -> None:
        for df in self.kept:
            removed(df)
        if "index" in self.__dict__:
            self.index.removed()
        self.kept.clear()


STATUSES, BANDS = S.STATUSES, S.BANDS
