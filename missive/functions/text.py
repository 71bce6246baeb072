"""Text functions on columns. All stay in the JVM; null texts count as empty where noted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: case-insensitive, only \n ends a line, Unicode classes: what the patterns below mean
FLAGS = "(?idU)"

# Openers, stop words, stems, number words and patterns of the message grammar.
OPENERS = [
    r"For today:", r"FYI:", r"Important:", r"One more thing:", r"Just checking[—–-]", r"Quick update:", r"Please note:",
    r"Can you help\?", r"Hi,", r"Hello,", r"Hey,", r"Heads up:", r"Note:", r"Reminder to self:",
]
DATE = r"\b(\d{4})-(\d{2})-(\d{2})\b"
TIME = r"\b(\d{1,2}):(\d{2})\s*(am|pm)?\b|\b(\d{1,2})\s*(am|pm)\b"
STOPWORDS = """
a an the this that these those it its is are was were be been being am and or but if then than so as of to for from in
on at by with about into before after until during while sometime someone somebody something over under again further
once here there when where why how all any both each few more most other some such no nor not only own same too very can
will just should now i me my we our you your he she they them their who whom please kindly do does did done doing have has
had having would could shall may might must let us also still yet ever never item items work material thing things stuff
matter subject topic regarding concerning earlier previous latest new one another request required needed progress update
updates status
""".split()
GENERIC_HEADS = "session meet task deadline schedule instruction message reminder".split()
IRREGULAR = {
    "meeting": "meet", "meetings": "meet", "notes": "note", "minutes": "minute", "files": "file", "details": "detail",
    "results": "result", "labels": "label", "cases": "case", "receipts": "receipt", "slots": "slot",
    "checklists": "checklist", "presentations": "presentation", "documents": "document", "exercises": "exercise",
    "reports": "report", "videos": "video", "forms": "form", "books": "book", "bills": "bill", "emails": "email",
    "models": "model", "trackers": "tracker", "assignments": "assignment", "queries": "query", "decisions": "decision",
    "diagrams": "diagram", "charts": "chart", "embeddings": "embedding",
}

WHITE = r"(?U)\s+"


def rx(pattern: str) -> str:
    """A grammar pattern as Java reads it."""
    return FLAGS + pattern.replace("(?P<", "(?<")


def folded(text: Column) -> Column:
    """Lower case, with the letters that patterns without regard to case also take for s, i and k."""
    return F.lower(F.translate(text, "\u017f\u0131\u0130\u212a", "siik"))


def found(text: Column, pattern: str) -> Column:
    return text.rlike(rx(pattern))


def group(text: Column, pattern: str, index: int = 0) -> Column:
    """A group of the first match; null without a match or where the group took no part."""
    return F.nullif(F.regexp_extract(text, rx(pattern), index), F.lit(""))


def strip(text: Column, more: str = "") -> Column:
    """Without white space, and the characters ``more``, at both ends."""
    chars = "".join("\\" + c for c in more)
    return F.regexp_replace(text, rf"(?U)^[\s{chars}]+|[\s{chars}]+\z", "")


def body_of(text: Column) -> Column:
    """The message without its conversational opener."""
    return strip(F.regexp_replace(text, rx(r"^\s*(?:" + "|".join(OPENERS) + r")\s*"), ""))


def opener_of(text: Column) -> Column:
    """The opener, or an empty string."""
    return strip(F.regexp_extract(text, rx(r"^\s*(?:" + "|".join(OPENERS) + r")\s*"), 0))


def canonical(text: Column) -> Column:
    """Lower-case body with single blanks: what rules are matched on."""
    return F.trim(F.regexp_replace(F.lower(body_of(text)), WHITE, " "))


def has_date(text: Column) -> Column:
    return found(text, DATE)


def has_time(text: Column) -> Column:
    return found(text, TIME)


def tokenize(text: Column) -> Column:
    """Lower-case word tokens, with dates, times, masks and numbers folded into placeholders, in this order."""
    t = F.lower(text)
    for pattern, token in ((DATE, "datetoken"), (TIME, "timetoken"), (r"\*{3,}", "maskedtoken"), (r"\b\d+\b", "numtoken")):
        t = F.regexp_replace(t, rx(pattern), f" {token} ")
    return F.regexp_extract_all(t, F.lit(r"[a-z0-9']+"), F.lit(0))


def ngrams(tokens: Column, most: int = 2) -> Column:
    """Unigrams, then n-grams up to ``most`` joined by blanks."""
    out = tokens
    for n in range(2, most + 1):
        last = F.size(tokens) - (n - 1)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), _gram(tokens, n))
        out = F.concat(out, F.when(last >= 1, runs).otherwise(F.array().cast("array<string>")))
    return out


def _gram(tokens: Column, n: int):
    return lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " ")


def _mapped(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def stem(word: Column) -> Column:
    """Fold a word's ending: irregular words first, then -ies, -es after a hiss, -s, -ing."""
    n = F.length(word)
    base = F.left(word, n - 3)
    cut = F.when(word.endswith("ies"), F.concat(base, F.lit("y")))
    cut = cut.when(word.rlike("(?:ss|sh|ch)es$"), F.left(word, n - 2))
    cut = cut.when(word.rlike("[^su]s$"), F.left(word, n - 1))
    cut = cut.when(word.endswith("ing") & (n > 6), F.when(base.rlike("[ltsvz]$"), F.concat(base, F.lit("e"))).otherwise(base))
    return F.coalesce(F.try_element_at(_mapped(IRREGULAR), word), F.when(n > 4, cut), word)


def content_tokens(text: Column) -> Column:
    """Stemmed content words in order of first appearance."""
    lowered = F.translate(F.lower(F.coalesce(text, F.lit(""))), "—–-", "   ")
    words = F.transform(F.regexp_extract_all(lowered, F.lit(r"[a-z][a-z0-9']*"), F.lit(0)), stem)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS)))


def specific_tokens(tokens: Column) -> Column:
    """Tokens that identify a subject: those that aren't generic heads."""
    return F.array_except(tokens, F.array(*map(F.lit, GENERIC_HEADS)))


def display_of(phrase: Column) -> Column:
    """A phrase as it is shown: single blanks, no leading article, no outer punctuation."""
    t = F.trim(F.regexp_replace(F.coalesce(phrase, F.lit("")), WHITE, " "))
    t = F.regexp_replace(t, rx(r"^(?:the|a|an|our|your|my)\s+"), "")
    return F.regexp_replace(t, r"^[ .,;:!?-]+|[ .,;:!?-]+\z", "")


def sorted_tokens(phrase: Column) -> Column:
    """The tokens of a phrase's signature; null without a phrase."""
    return F.when(phrase.isNotNull(), F.array_sort(content_tokens(phrase)))


def signature(phrase: Column, tokens: Column | None = None) -> Column:
    """STRUCT(tokens sorted, display, specific sorted); null where nothing specific is named.

    ``tokens``: a column that holds the phrase's ``sorted_tokens``, so that they are made once a row.
    """
    tokens = sorted_tokens(phrase) if tokens is None else tokens
    made = F.struct(tokens.alias("tokens"), display_of(phrase).alias("display"), specific_tokens(tokens).alias("specific"))
    return F.when(F.size(made["specific"]) > 0, made)


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))


def clean_title(raw: Column) -> Column:
    """A captured title: trimmed of punctuation, without article, first letter upper; '' where nothing is left."""
    t = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^[ \t.,;:!?]+|[ \t.,;:!?]+\z", "")
    t = F.regexp_replace(F.regexp_replace(t, WHITE, " "), rx(r"^(?:the|a|an|our|your|my)\s+"), "")
    return capitalised(t)


def clean_subject(raw: Column) -> Column:
    """A captured subject: trimmed, without determiner and trailing scaffolding; null where nothing is left."""
    t = F.regexp_replace(F.regexp_replace(raw, WHITE, " "), r"""^[ \t.,;:!?"']+|[ \t.,;:!?"']+\z""", "")
    t = F.regexp_replace(t, rx(r"^(?:the|a|an|our|your|my|to|that|this)\s+"), "")
    t = F.regexp_replace(t, rx(r"\s+(?:item|work|material|request)$"), "")
    return F.nullif(F.regexp_replace(t, r"^[ .,;:!?]+|[ .,;:!?]+\z", ""), F.lit(""))


def group_title(display: Column, tokens: Column, limit: int = 64) -> Column:
    """A group's heading: first letter upper, cut at a word beyond ``limit``."""
    raw = capitalised(F.coalesce(F.nullif(display, F.lit("")), F.array_join(tokens, " ")))
    return F.when(F.length(raw) > limit, F.concat(F.regexp_replace(F.left(raw, F.lit(limit)), r" [^ ]*\z", ""), F.lit("…"))).otherwise(raw)


def two_digits(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def _hours(text: Column, pattern: str, hour: int, mark: int) -> Column:
    h = group(text, pattern, hour).cast("int") % 12
    return F.concat(two_digits(h + F.when(F.lower(group(text, pattern, mark)) == "pm", 12).otherwise(0)), F.lit(":00"))


def clock_in(text: Column) -> Column:
    """The first clock time as HH:MM: an H:MM in range, else an hour with am or pm."""
    clock, half = r"\b(\d{1,2}):(\d{2})\b", r"\b(\d{1,2})\s*(am|pm)\b"
    h, m = group(text, clock, 1).cast("int"), group(text, clock, 2).cast("int")
    return F.when((h <= 23) & (m <= 59), F.concat(two_digits(h), F.lit(":"), two_digits(m))).when(found(text, half), _hours(text, half, 1, 2))


def clock_of(raw: Column) -> Column:
    """A captured time as HH:MM, where am and pm count after H:MM too; null if it isn't one."""
    t = F.lower(F.trim(raw))
    clock, half = r"^(\d{1,2}):(\d{2})\s*(am|pm)?$", r"^(\d{1,2})\s*(am|pm)$"
    h, m, mark = group(t, clock, 1).cast("int"), group(t, clock, 2).cast("int"), group(t, clock, 3)
    h = F.when((mark == "pm") & (h < 12), h + 12).when((mark == "am") & (h == 12), 0).otherwise(h)
    return F.when((h <= 23) & (m <= 59), F.concat(two_digits(h), F.lit(":"), two_digits(m))).when(found(t, half), _hours(t, half, 1, 2))


#: accepted forms of a timestamp or day
DAY_FORMATS = ["yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m", "yyyy-M-d"]


def day_of(value: Column) -> Column:
    """The day of a timestamp or date string in one of four forms; null for others and for days that don't exist."""
    t = F.trim(value)
    full, marked, short, day = (F.try_to_timestamp(t, F.lit(f)) for f in DAY_FORMATS)
    # a form that can't fit isn't tried: each attempt that fails costs an exception
    return F.when(t.rlike("[tT]"), marked).when(~t.contains(":"), day).otherwise(F.coalesce(full, short)).cast("date")


def first_of(branches: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """CASE WHEN over (condition, value) pairs in order."""
    chain = reduce(lambda c, b: c.when(*b), branches[1:], F.when(*branches[0]))
    return chain if otherwise is None else chain.otherwise(otherwise)


def template_key(text: Column) -> Column:
    """The message's shape: dates, times and numbers replaced by marks."""
    t = F.regexp_replace(text, rx(r"\d{4}-\d{2}-\d{2}"), "<DATE>")
    t = F.regexp_replace(t, rx(r"\d{1,2}:\d{2}"), "<TIME>")
    return F.regexp_replace(t, rx(r"\d+"), "<N>")


def template_hash(text: Column) -> Column:
    return F.left(F.sha2(template_key(text).cast("binary"), 256), F.lit(16))
