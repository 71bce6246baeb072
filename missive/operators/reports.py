"""Reports, filters and small sinks over the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive import schema as S
from missive.functions import text as T

#: fixed values: floors of the confidence bands, and the least size of a group that makes a query
CONFIDENCE_FLOORS, LEAST_GROUP, BAR = [0.90, 0.75, 0.60], 3, 34


def confidence_bands(rows: DataFrame) -> DataFrame:
    """(floor, n): rows by the highest floor their confidence reaches; 0 below all."""
    floor = T.first_of([(F.col("confidence") >= f, F.lit(f)) for f in CONFIDENCE_FLOORS], F.lit(0.0))
    return rows.groupBy(floor.alias("floor")).agg(F.count("*").alias("n"))


def contains(words: str, *columns: str) -> Column:
    """Whether the columns, put together, show the words, whatever their case."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(words.lower()))


def messages_shown(rows: DataFrame, category: str | None = None, review: bool | None = None, words: str = "", risk: str | None = None) -> DataFrame:
    """Messages as a list narrows them: by category, need of review, risk, and words in sender or text."""
    keep = F.lit(True)
    if category:
        keep &= F.col("category") == category
    if review is not None:
        keep &= F.col("needs_review") == review
    if risk:
        keep &= F.col("overall_risk") == risk
    return rows.filter(keep & contains(words, "message_id", "sender", "masked_text") if words else keep)


def items_shown(rows: DataFrame, kind: str | None = None, unresolved: bool = False, words: str = "") -> DataFrame:
    """Items by type, open fields, and words in title or text."""
    keep = F.col("item_type").isNotNull() if kind is None else F.col("item_type") == kind
    if unresolved:
        keep &= F.size("unresolved_fields") > 0
    return rows.filter(keep & contains(words, "item_title", "body") if words else keep)


def largest_groups(groups: DataFrame, n: int) -> DataFrame:
    """The n groups of most messages; of equal ones the first ids."""
    return groups.withColumn("messages", F.size("message_ids").cast("long")).orderBy(F.desc("messages"), "group_id").limit(n)


def labelled_groups(members: DataFrame, key: str = "group_id", least: int = LEAST_GROUP) -> DataFrame:
    """(key, n) of the groups large enough to judge a ranking by."""
    return members.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def paraphrase_targets(paraphrases: DataFrame, groups: DataFrame) -> DataFrame:
    """Paraphrases (query, title) with the groups (group_id, title) whose title they mean, in any case."""
    titles = groups.select(F.lower("title").alias("_title"), "group_id")
    return paraphrases.withColumn("_title", F.lower("title")).join(titles, "_title").drop("_title")


def band_counts(decisions: DataFrame) -> DataFrame:
    """Per batch how many groups are in each band: one column a band."""
    return decisions.groupBy("batch_idx").pivot("priority", S.BANDS).count().na.fill(0, S.BANDS)


def conflict_histogram(conflicts: DataFrame) -> DataFrame:
    """(kind, n), the most frequent first."""
    return conflicts.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def replicated(messages: DataFrame, times: int) -> DataFrame:
    """A corpus of ``times`` copies, their ids told apart by C0_, C1_, ..."""
    copies = F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("_copy")
    return messages.select("*", copies).withColumn("message_id", F.concat(F.lit("C"), F.col("_copy").cast("string"), F.lit("_"), "message_id")).drop("_copy")


def bar(n: Column, most: Column, width: int = BAR) -> Column:
    """A bar of # as long as n's share of the most, on dots."""
    size = F.when(most > 0, F.round(width * n / most)).otherwise(0).cast("int")
    return F.rpad(F.repeat(F.lit("#"), size), width, ".")


def counts_with_bars(rows: DataFrame, column: str) -> DataFrame:
    """(column, n, bar) of each value."""
    n = rows.groupBy(column).agg(F.count("*").alias("n"))
    most = n.agg(F.max("n").alias("most"))
    return n.crossJoin(F.broadcast(most)).select(column, "n", bar(F.col("n"), F.col("most")).alias("bar"))


def gold_labels(rows: DataFrame) -> DataFrame:
    """(message_id, category, template_hash, ambiguous) of classified rows, as a label file has them."""
    return rows.select("message_id", "category", T.template_hash(T.canonical(F.col("masked_text"))).alias("template_hash"), F.coalesce("hedged", F.lit(False)).alias("ambiguous"))


def write_gold(rows: DataFrame, path: str, single_file: bool = False) -> None:
    from missive.sources.csv import write_csv

    write_csv(gold_labels(rows), path, single_file)


def write_layer1(rows: DataFrame, path: str, single_file: bool = False) -> None:
    """Layer 1's tables below ``path``: messages, items, the sensitive report and the summary as JSON, items as CSV. Raw text isn't in any."""
    from missive.operators import extract, sensitive
    from missive.plans.ledger import layer1_summary
    from missive.sources.csv import write_csv, write_json
    from missive.sources.tables import removed, written

    rows = written(rows, "layer1")  # classified once, for all files
    secret = F.col("route") == "blocked"
    about = rows.select("message_id", "timestamp", "sender", "category", "confidence", "agreement", "needs_review", "reason", "route", F.when(~secret, F.col("masked_text")).alias("masked_text"))
    tables = {"messages": about, "items": extract.items(rows.filter(~secret)), "sensitive": sensitive.sensitive_report(rows).drop("masked_text"), "summary": layer1_summary(rows)}
    for name, df in tables.items():
        write_json(df, f"{path}/{name}.json", single_file)
    write_csv(tables["items"], f"{path}/items.csv", single_file)
    removed(rows)
