"""Classification: rule frames, an optional linear model, and the arbitration between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive import schema as S
from missive.functions import text as T

# The frames of each family in order, matched on canonical (lower-case) text.
PROMOTIONAL = [
    ("coupon_code", r"\buse\s+code\s+[A-Z0-9]{3,}\b"),
    ("discount_offer", r"\b(\d+%\s*off|flat\s+\d+%|discount|flash\s+sale|limited[-\s]time\s+offer|special\s+(?:festival\s+)?offer)\b"),
    ("commercial_incentive", r"\b(cashback|reward\s+points|free\s+delivery|buy\s+one\s+and\s+get\s+one|coupon|voucher)\b"),
    ("upsell", r"\b(upgrade\s+your\s+\w+|join\s+our\s+\w+\s+plan|exclusive\s+benefits|you\s+may\s+like\s+our|our\s+new\s+\w+\s+plan|subscribe\s+now)\b"),
    ("sale_event", r"\b(sale\s+on\b|offer\s+on\b|deal\s+on\b|\bsale\s+starts\b|\bsale\s+ends\b)"),
]
MEETING = [
    ("calendar_marker", r"^(calendar\s+(?:update|invite|entry)|invite|reminder)\s*:"),
    ("scheduled_copula", r"\b(?:is|are|was|will\s+be)\s+scheduled\s+(?:for|on|at)\b"),
    ("occurrence_verb", r"\b(?:happens|takes\s+place|is\s+happening|will\s+be\s+held|is\s+being\s+held)\s+(?:on|at|in)\b"),
    ("invitation", r"\b(?:please\s+)?(?:join|attend|come\s+to|be\s+present\s+at)\s+(?:the|our|us\s+for)\b"),
    ("availability_probe", r"\bare\s+you\s+(?:available|free)\s+for\b"),
    ("meet_proposal", r"\b(?:let(?:'s|\s+us)\s+meet|shall\s+we\s+meet|can\s+we\s+meet|meeting\s+at)\b"),
]
HEDGED_EVENT = r"\bthe\s+(?:meeting|review|discussion|session|call|sync|demo|interview|catch[-\s]?up|stand[-\s]?up|appointment|briefing)\s+(?:could|might|may|should)\s+be\b"
ACTION = [
    ("polite_directive", r"\b(?:please|kindly)\s+(?!join\b|note\b)[a-z]+\b"),
    ("request_question", r"\b(?:can|could|would|will)\s+you\s+[a-z]+\b"),
    ("explicit_request", r"\bi\s+need\s+you\s+to\s+[a-z]+\b"),
    ("reminder_directive", r"\b(?:don'?t\s+forget\s+to|remember\s+to|make\s+sure\s+(?:you\s+|to\s+)?|be\s+sure\s+to|ensure\s+(?:you\s+)?)[a-z]+\b"),
    ("conditional_request", r"\bif\s+possible,?\s+[a-z]+\b"),
    ("deadline_marker", r"\b(?:deadline\s+is|is\s+due\s+(?:on|by)|due\s+date|due\s+(?:on|by)\b)"),
    ("date_bounded", r"\b(?:by|before|no\s+later\s+than)\s+\d{4}-\d{2}-\d{2}\b"),
    ("bare_imperative", r"^(?:submit|send|complete|prepare|review|upload|call|email|book|renew|verify|share|update|finish|reply|confirm|pay|check|fix|draft|arrange|collect|back\s+up)\s+(?:the|your|my|a|an|it)\b"),
]
HEDGED_ACTION = r"\b(?:may\s+be\s+needed|might\s+be\s+needed|could\s+you\s+send|send\s+it\s+soon|asked\s+whether|wants\s+to\s+know\s+(?:if|whether)|is\s+waiting\s+for)\b"
PERSONAL = [
    ("profile_marker", r"\b(?:for\s+my\s+profile|personal\s+note|about\s+me)\b\s*[:,]?"),
    ("remember_preference", r"\b(?:remember|note)\s+that\s+i\b"),
    ("disclosure_marker", r"\bjust\s+so\s+you\s+know,?\s+(?:i|my)\b"),
    ("first_person_trait", r"\bi\s+(?:am|'m)\s+(?:a\s+)?(?!going|working\s+on)[a-z]+\b"),
    ("first_person_preference", r"\bi\s+(?:might\s+)?(?:prefer|like|usually|always|never|tend\s+to|use|drink|eat|study|work\s+best)\b"),
    ("first_person_situation", r"\bi\s+live\s+(?:near|in|at|around)\b"),
    ("my_attribute", r"\bmy\s+(?:favourite|favorite|t[-\s]?shirt\s+size|emergency\s+contact|dietary|preference|nickname|working\s+hours)\b"),
]
FIRST_PERSON = r"\b(?:i|i'm|i'll|my|me|mine|myself)\b"
DECLARATIVE_SUBJECT = r"^(?:the|a|an|our|this|that|there|tomorrow|today|tonight|yesterday|all|new|most|some|every|[a-z]+ing)\s+\S+"
STATE_PREDICATE = r"\b(?:is|are|was|were|has|have|had|will|can|closes|opens|starts|ends|leaves|arrives|changed|moved|updated|reorganized|extended|says|remains|continues|becomes)\b"
SENSITIVE_CONFIDENCE, REVIEW = 0.98, 0.60

#: words one of which stands in every match of a frame; what shows none isn't searched with the frame's pattern
HINTS = {
    "coupon_code": ("code",), "discount_offer": ("%", "discount", "sale", "offer"), "commercial_incentive": ("cashback", "reward", "free", "buy", "coupon", "voucher"), "upsell": ("upgrade", "plan", "exclusive", "like", "subscribe"), "sale_event": ("sale", "offer", "deal"),
    "calendar_marker": (":",), "scheduled_copula": ("scheduled",), "occurrence_verb": ("happen", "takes", "held"), "invitation": ("join", "attend", "come", "present"), "availability_probe": ("available", "free"), "meet_proposal": ("meet",), "hedged_event": ("could", "might", "may", "should"),
    "polite_directive": ("please", "kindly"), "request_question": ("you",), "explicit_request": ("need",), "reminder_directive": ("forget", "remember", "sure"), "conditional_request": ("possible",), "deadline_marker": ("deadline", "due"), "date_bounded": ("-",), "hedged_action": ("needed", "send", "asked", "wants", "waiting"),
    "profile_marker": ("profile", "personal", "about"), "remember_preference": ("that",), "disclosure_marker": ("just",), "first_person_trait": ("am", "'m"), "first_person_preference": ("prefer", "like", "usually", "always", "never", "tend", "use", "drink", "eat", "study", "work"),
    "first_person_situation": ("live",), "my_attribute": ("my",),
}

SIGNALS = "array<struct<name:string,evidence:string>>"


def _shown(text: Column, folded: Column, name: str, pattern: str) -> Column:
    """Whether a frame matches; its pattern is only tried where the folded text shows one of its hints."""
    hit = T.found(text, pattern)
    return reduce(Column.__or__, (folded.contains(h) for h in HINTS[name])) & hit if name in HINTS else hit


def _signals(text: Column, folded: Column, frames: list[tuple[str, str]]) -> Column:
    """The frames that match, with the words that do."""
    made = F.array(*(F.when(_shown(text, folded, n, p), F.struct(F.lit(n).alias("name"), F.trim(T.group(text, p)).alias("evidence"))) for n, p in frames))
    return F.filter(made, lambda s: s.isNotNull())


def _one(text: Column, name: str, pattern: str) -> Column:
    return F.array(F.struct(F.lit(name).alias("name"), F.trim(T.group(text, pattern)).alias("evidence")))


def _confidence(base: Column | float, n: Column | int, hedged: Column | bool) -> Column:
    base, n, hedged = (x if isinstance(x, Column) else F.lit(x) for x in (base, n, hedged))
    value = base + 0.05 * F.greatest(n - 1, F.lit(0)) - F.when(hedged, 0.22).otherwise(0.0)
    return F.round(F.least(value, F.lit(0.96)), 4)


def with_rules(rows: DataFrame, text_col: str = "masked_text", sender_col: str = "sender") -> DataFrame:
    """Add rule_category, rule_confidence, rule_signals and hedged. The families are tried in order.

    Canonical text and each family's signals are columns of their own, so that a
    pattern is matched once per row.
    """
    rows = rows.withColumn("canonical", T.canonical(F.coalesce(F.col(text_col), F.lit(""))))
    # canonical text is lower-case: two letters are left that patterns take for s and i
    rows = rows.withColumn("_low", F.translate("canonical", "\u017f\u0131", "si"))
    c, low = F.col("canonical"), F.col("_low")
    rows = rows.withColumns({f"_{n}": _signals(c, low, frames) for n, frames in (("promo", PROMOTIONAL), ("meet", MEETING), ("act", ACTION), ("pers", PERSONAL))})
    promo, meet, act, pers = (F.col(f"_{n}") for n in ("promo", "meet", "act", "pers"))
    n_promo, n_meet, n_act, n_pers = (F.size(x) for x in (promo, meet, act, pers))
    role = F.lower(F.trim(F.coalesce(F.col(sender_col), F.lit("")))).isin(S.PROMOTIONAL_SENDERS)
    by_sender = F.concat(promo, F.array(F.struct(F.lit("promotional_sender").alias("name"), F.concat(F.lit("sender="), F.col(sender_col)).alias("evidence"))))
    firm = T.has_date(c) | T.has_time(c)
    bounded = F.exists(act, lambda s: s["name"].isin("deadline_marker", "date_bounded"))
    states = ~c.endswith("?") & ~T.found(c, FIRST_PERSON) & T.found(c, DECLARATIVE_SUBJECT) & T.found(c, STATE_PREDICATE)

    def verdict(category: str, confidence: Column, signals: Column, hedged) -> Column:
        return F.struct(F.lit(category).alias("category"), confidence.alias("confidence"), signals.cast(SIGNALS).alias("signals"), (hedged if isinstance(hedged, Column) else F.lit(hedged)).alias("hedged"))

    promo_base = F.when(n_promo > 1, 0.90).otherwise(0.86)
    chosen = T.first_of(
        [
            ((n_promo > 0) & role, verdict("promotional", _confidence(promo_base + 0.04, n_promo + 1, False), by_sender, False)),
            (n_promo > 0, verdict("promotional", _confidence(promo_base, n_promo, False), promo, False)),
            (n_meet > 0, verdict("meeting_or_event", _confidence(F.when(firm, 0.90).otherwise(0.80), n_meet, ~firm), meet, ~firm)),
            (_shown(c, low, "hedged_event", HEDGED_EVENT), verdict("meeting_or_event", _confidence(0.78, 1, True), _one(c, "hedged_event", HEDGED_EVENT), True)),
            (n_act > 0, verdict("action_required", _confidence(F.when(bounded, 0.91).otherwise(0.84), n_act, False), act, False)),
            (_shown(c, low, "hedged_action", HEDGED_ACTION), verdict("action_required", _confidence(0.72, 1, True), _one(c, "hedged_action", HEDGED_ACTION), True)),
            (n_pers > 0, verdict("personal_information", _confidence(F.when(n_pers > 1, 0.90).otherwise(0.84), n_pers, False), pers, False)),
            (states, verdict("general_information", _confidence(0.84, 2, False), F.concat(_one(c, "third_person_declarative", DECLARATIVE_SUBJECT), _one(c, "state_predicate", STATE_PREDICATE)), False)),
        ]
    )
    rows = rows.withColumn("_rule", chosen)
    return rows.withColumns(
        {
            "rule_category": F.col("_rule.category"),
            "rule_confidence": F.coalesce("_rule.confidence", F.lit(0.0)),
            "rule_signals": F.coalesce("_rule.signals", F.array().cast(SIGNALS)),
            "hedged": F.coalesce("_rule.hedged", F.lit(False)),
        }
    ).drop("_low", "_promo", "_meet", "_act", "_pers", "_rule")


def weak_labels(rows: DataFrame) -> DataFrame:
    """Rows whose rule verdict is firm enough to train on, with it as ``label``."""
    return rows.filter(F.col("rule_category").isNotNull() & ~F.col("hedged") & (F.col("rule_confidence") >= 0.84)).withColumn("label", F.col("rule_category"))


def with_category(rows: DataFrame, with_model: bool = False) -> DataFrame:
    """Arbitrate: detector veto, model alone, no signal, rules alone, agreement, disagreement.

    With a model the columns model_category, model_confidence and model_margin are expected.
    """
    if not with_model:
        rows = rows.withColumns({"model_category": F.lit(None).cast("string"), "model_confidence": F.lit(0.0), "model_margin": F.lit(0.0)})
    rule, p = F.col("rule_category"), F.col("model_category")
    rc, pc = F.col("rule_confidence"), F.col("model_confidence")
    veto = F.coalesce(F.col("overall_risk").isin("high", "medium"), F.lit(False))
    topical = F.when((rule.isNull() | (rule == "general_information")) & p.isNotNull(), p).otherwise(rule)
    alone, only = F.round(F.least(pc * 0.88, F.lit(0.88)), 4), F.round(rc * 0.92, 4)
    agree = F.round(F.least(F.greatest(rc, pc) + 0.04, F.lit(0.99)), 4)
    differ = F.round(F.greatest(F.lit(0.30), F.least(F.lit(0.72), 0.45 + F.abs(rc - pc) * 0.5)), 4)

    def outcome(category, confidence, agreement: str, review, secondary=None) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(lit(category).alias("category"), lit(confidence).cast("double").alias("confidence"), F.lit(agreement).alias("agreement"), lit(review).alias("needs_review"), (F.lit(None).cast("string") if secondary is None else secondary).alias("secondary_category"))

    made = T.first_of(
        [
            (veto, outcome("sensitive_information", SENSITIVE_CONFIDENCE, "deterministic_detector", False, topical)),
            (rule.isNull() & p.isNull(), outcome("general_information", 0.35, "no_signal", True)),
            (rule.isNull(), outcome(p, alone, "model_only", alone < REVIEW)),
            (p.isNull(), outcome(rule, only, "rule_only", only < REVIEW)),
            (p == rule, outcome(rule, agree, "rule_and_model_agree", F.col("hedged") & (agree < REVIEW + 0.15))),
        ],
        outcome(F.when(rc >= pc, rule).otherwise(p), differ, "disagreement", True),
    )
    names = ("category", "confidence", "agreement", "needs_review", "secondary_category")
    rows = rows.withColumn("_c", made).withColumns({n: F.col(f"_c.{n}") for n in names}).drop("_c")
    return rows.withColumn("reason", _reason())


def _reason() -> Column:
    """Why the category was chosen, from what was seen."""
    signals = F.slice("rule_signals", 1, 2)
    frame = F.concat(
        F.lit("matched the "), F.array_join(F.transform(signals, lambda s: F.replace(s["name"], F.lit("_"), F.lit(" "))), ", "),
        F.lit(" frame ("), F.array_join(F.transform(signals, lambda s: F.concat(F.lit('"'), s["evidence"], F.lit('"'))), "; "), F.lit(")"),
    )
    p, a = F.format_string("%.2f", "model_confidence"), F.col("agreement")
    types = F.replace(F.array_join("sensitivity_types", ", "), F.lit("_"), F.lit(" "))
    return (
        F.when(a == "deterministic_detector", F.concat(F.lit("A pattern rule found "), types, F.lit(" in the body; the value is masked and the message is handled by risk, not topic.")))
        .when(a == "no_signal", "No frame matched and there is no model, so this is general information with low confidence.")
        .when(a == "model_only", F.concat(F.lit("No frame matched; the model alone says "), F.col("category"), F.lit(" at p="), p, F.lit(".")))
        .when(a == "rule_only", F.concat(F.lit("The rules "), frame, F.lit("; there is no model to compare with.")))
        .when(a == "rule_and_model_agree", F.concat(F.lit("The rules "), frame, F.lit(", and the model agrees at p="), p, F.lit(".")))
        .otherwise(F.concat(F.lit("The rules "), frame, F.lit(" for "), F.col("rule_category"), F.lit(" but the model prefers "), F.col("model_category"), F.lit(" at p="), p, F.lit(".")))
    )
