"""What a message may be used for, by policy: a fixed table joined by the action of its findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missive import schema as S

_ACTION_OF = {t: a for t, _, a, _ in S.SENSITIVITY}
_POLICY_OF = {p[0]: p for p in S.POLICIES}
_LABEL_OF = {t: label for t, _, _, label in S.SENSITIVITY}


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def policy_action(types: Column) -> Column:
    """The action whose policy governs: that of the strictest route; of several, of the first type."""
    rank = {t: S.ROUTES.index(_POLICY_OF[a][2]) for t, a in _ACTION_OF.items()}
    ranks, actions = _map(rank), _map(_ACTION_OF)
    top = F.array_max(F.transform(types, lambda t: ranks[t]))
    first = F.get(F.filter(types, lambda t: ranks[t] == top), F.lit(0))
    return F.coalesce(F.try_element_at(actions, first), F.lit("none"))


def route(rows: DataFrame) -> DataFrame:
    """Add policy_id, route, allowed, denied and, where needed, the prompt that asks for confirmation."""
    action = policy_action(F.col("sensitivity_types"))
    policy = F.create_map(*(x for a, p, r, ops in S.POLICIES for x in (F.lit(a), F.struct(F.lit(p).alias("policy_id"), F.lit(r).alias("route"), F.array(*map(F.lit, ops)).alias("allowed")))))
    labels = _map(_LABEL_OF)
    out = rows.withColumn("p", policy[action])
    out = out.withColumns({"policy_id": F.col("p.policy_id"), "route": F.col("p.route"), "allowed": F.col("p.allowed")}).drop("p")
    prompt = F.concat(F.col("message_id"), F.lit(" holds "), F.array_join(F.transform("sensitivity_types", lambda t: labels[t]), ", "), F.lit(". Its masked text is quoted or exported only on confirmation."))
    return out.withColumns({"denied": F.array_except(F.array(*map(F.lit, S.OPERATIONS)), "allowed"), "confirmation_prompt": F.when(F.col("route") == "confirm_required", prompt)})


def may(operation: str) -> Column:
    """Whether a routed row's policy allows an operation."""
    return F.array_contains("allowed", operation)


def policy_table(spark: SparkSession) -> DataFrame:
    """The policies with the types and risks they govern."""
    types = spark.createDataFrame([(t, r, a) for t, r, a, _ in S.SENSITIVITY], "type string, risk string, action string")
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(S.POLICIES)], "ord int, action string, policy_id string, route string, allowed array<string>")
    of = types.groupBy("action").agg(F.sort_array(F.collect_list("type")).alias("types"), F.sort_array(F.collect_set("risk")).alias("risks"))
    out = rows.join(F.broadcast(of), "action", "left")
    empty = F.array().cast("array<string>")
    return out.select("policy_id", "route", F.col("action").alias("applies_to_action"), F.coalesce("types", empty).alias("sensitivity_types"), F.coalesce("risks", empty).alias("risk_levels"), "allowed", F.array_except(F.array(*map(F.lit, S.OPERATIONS)), "allowed").alias("denied"))


def route_answer(evidence: DataFrame, routed: DataFrame, confirmed: bool = False) -> DataFrame:
    """One row: the strictest route of an answer's evidence (message_id, ord), and which ids it holds back or asks for."""
    rows = evidence.join(routed.select("message_id", "route"), "message_id", "left")
    ids = lambda r: F.transform(F.sort_array(F.collect_list(F.when(F.col("route") == r, F.struct("ord", "message_id")))), lambda s: s["message_id"])
    rows = rows.agg(ids("blocked").alias("withheld_message_ids"), ids("confirm_required").alias("confirm_message_ids"))
    asks = (F.size("confirm_message_ids") > 0) & F.lit(not confirmed)
    return rows.withColumn("route", F.when(F.size("withheld_message_ids") > 0, "blocked").when(asks, "confirm_required").otherwise("local_only"))
