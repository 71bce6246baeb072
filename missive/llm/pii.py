"""Personal data: exact base shapes, then bootstrapped contextual extraction.

Everything here is DataFrame expressions. Positions of matches come from marking
them in the text with a control character and adding up the lengths of the pieces;
where the text holds that character itself, another one stands in for it, which no
pattern knows. Running totals go block by block, so that the work on a text is
linear in its length and its matches.

Base spans are the leftmost matches of four shapes that pass their check (``BASE``).
They are the seeds. Bootstrapping: the words around a seed make lexical patterns
(two words before; one before and one after; one before). Every place in the corpus with digits, an
at sign or a spelt-out one is a slot, whatever its shape; what a learned pattern
surrounds in a slot is its instance, if it is at all possible as the kind (``POSSIBLE``: enough
digits, say). Patterns and instances form a graph; in each round a pattern's
confidence is the share of its distinct instances that are known, and an instance that
at least ``SUPPORT`` patterns of enough confidence and ``SEEDS`` known instances extract becomes
known itself, and so supports patterns in the next round, and makes more patterns
learned. Rounds end when one finds nothing new; each takes values out of a finite
number. The graph has one edge per distinct pattern and instance and is aggregated
before each shuffle; no text is shuffled.

Null and empty texts have no spans. Repeated rows are each reported. Text of any
length is read as a whole. Columns other than id and text aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.llm.common import dropped, stored, text_of

KINDS = ["email", "ip", "card", "phone"]
SUPPORT, SEEDS, CONFIDENCE = 2, 3, 0.8

#: the shapes with possessive repeats (the parts can't match otherwise) and starts
#: only where a match can begin, so that a search takes linear time and no deep stack
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: what a text must show before it is searched
HINT = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: a slot: words with digits or an at sign, taken together where digits follow digits, or words around a spelt-out at sign
_AT, _DOT = r"[ ]?[\[({<]\s?at\s?[\])}>][ ]?", r"[ ]?[\[({<]\s?dot\s?[\])}>][ ]?"
SLOT = rf"(?<!\S)(?:[^\s\[({{<@]++{_AT}[^\s\[({{<]++(?:{_DOT}[^\s\[({{<]++)*+|[^\s0-9@]*+[0-9@]\S*+(?:[ ][(]?[0-9][0-9().\[\]-]*+(?!\S))*+)"
SLOT_HINT = r"[0-9@]|[\[({<]\s?(?i:at)\s?[\])}>]"
_EDGES = " .,;:!?'\"*#$%&|<>=/\\"


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


#: whether a slot's value can be an instance of the kind at all
POSSIBLE = {
    "email": lambda v: v.rlike(r"(?i)[^\s@]@[^\s@]|[^\s][ ]?[\[({<]\s?at\s?[\])}>]"),
    "ip": lambda v: v.rlike(r"(?i)^[0-9a-f]{1,4}(?:(?:[.:]|\[[.:]\])[0-9a-f]{1,4}){3,7}$"),
    "card": lambda v: _digits(v).between(13, 19) & ~v.rlike(r"\p{L}"),
    "phone": lambda v: _digits(v).between(7, 15) & ~v.rlike(r"\p{L}"),
}

MENTION = "array<struct<kind:string,start:int,end:int,value:string,patterns:array<string>,known:boolean>>"
BLOCK, PIECE = 256, 256


def running(values: Column, step) -> Column:
    """The running results of step(total, value), from 0, of an array of integers; linear, as no list is grown beyond a block."""

    def scan(items: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("made"))
        return F.aggregate(items, start, lambda a, v: F.struct(step(a["at"], v).alias("at"), F.concat(a["made"], F.array(step(a["at"], v))).alias("made")), lambda a: a["made"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda i: F.slice(values, i * BLOCK + 1, F.lit(BLOCK)))
    ends = scan(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), step)), F.lit(0))
    firsts = F.concat(F.array(F.lit(0)), ends)
    made = F.zip_with(blocks, F.slice(firsts, F.lit(1), F.size(ends)), scan)
    return F.when(F.size(values) > 0, F.flatten(made)).otherwise(F.array().cast("array<int>"))


def with_matches(rows: DataFrame, found: dict[str, tuple[str, str]]) -> DataFrame:
    """Add, for each name with (pattern, hint), the leftmost non-overlapping matches of ``text``.

    A match has start, end (code points, end exclusive), value, and the text before and after it,
    two matches back and one ahead at the furthest, so that all its texts together are a few
    times the text. Only texts that show the hint are searched.
    """
    names, none = list(found), F.array().cast("array<string>")
    rows = rows.withColumn("_clean", F.translate("text", "\x01", "\x02"))
    parts = {f"_p_{n}": F.when(F.col("text").rlike(hint), F.split(F.regexp_replace("_clean", F.lit(pattern), F.lit("\x01$0\x01")), "\x01", -1)).otherwise(none) for n, (pattern, hint) in found.items()}
    rows = rows.withColumns(parts).drop("_clean")
    rows = rows.withColumns({f"_l_{n}": F.transform(f"_p_{n}", lambda p: F.char_length(p)) for n in names})
    rows = rows.withColumns({f"_e_{n}": running(F.col(f"_l_{n}"), lambda a, v: a + v) for n in names})

    def spans(n: str) -> Column:
        p, e = F.col(f"_p_{n}"), F.col(f"_e_{n}")
        span = lambda i: F.struct(F.get(e, 2 * i).alias("start"), F.get(e, 2 * i + 1).alias("end"), F.get(p, 2 * i + 1).alias("value"), F.concat_ws("", *(F.get(p, 2 * i - k) for k in (3, 2, 1, 0))).alias("before"), F.concat_ws("", F.get(p, 2 * i + 2), F.get(p, 2 * i + 3)).alias("after"))
        k = F.floor(F.size(p) / 2).cast("int")
        return F.transform(F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>")), span)

    return rows.withColumns({n: spans(n) for n in names}).drop(*(f"_{x}_{n}" for n in names for x in "ple"))


def luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum ends in 0."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, r"[^0-9]", "")
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda span: _valid(kind, span["value"])


def _of_kind(kind: str):
    return lambda span: span["known"] & (span["kind"] == kind)


def _slot(span: Column) -> Column:
    """A slot without the signs at its edges."""
    left = F.ltrim(span["value"], F.lit(_EDGES))
    start = (span["start"] + F.char_length(span["value"]) - F.char_length(left)).cast("int")
    value = F.rtrim(left, F.lit(_EDGES))
    return F.struct(start.alias("start"), (start + F.char_length(value)).cast("int").alias("end"), value.alias("value"), span["before"].alias("before"), span["after"].alias("after"))


def _patterns(span: Column) -> Column:
    """The lexical patterns of a span: words before and after it, lower-cased, without outer signs."""
    word = r"[^\p{L}\p{N}]*+([\p{L}\p{N}]++)"
    back = F.reverse(F.lower(span["before"]))
    one, two = (F.reverse(F.nullif(F.regexp_extract(back, f"^{word}(?:{word})?", k), F.lit(""))) for k in (1, 2))
    next_ = F.nullif(F.regexp_extract(F.lower(span["after"]), f"^{word}", 1), F.lit(""))
    made = F.array(F.concat(F.lit("2 "), two, F.lit(" "), one), F.concat(F.lit("lr "), one, F.lit(" _ "), next_), F.concat(F.lit("1 "), one))
    return F.filter(made, lambda p: p.isNotNull())


def _mention(kind: str, known: bool):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("value"), _patterns(s).alias("patterns"), F.lit(known).alias("known"))


def _possible(kind: str):
    return lambda s: POSSIBLE[kind](s["value"]) & ~F.coalesce(_valid_whole(kind, s["value"]), F.lit(False))


def _valid_whole(kind: str, value: Column) -> Column:
    """Whether a value as a whole is a base span of the kind."""
    shape = BASE[kind].replace(r"(?:\G|(?<![A-Za-z0-9._%+-]))", "").replace("(?<![0-9])", "")
    return value.rlike(f"^(?:{shape})$") & _valid(kind, value)


def _joined(kinds_spans: Column) -> Column:
    """kind:start:end, comma-joined, of spans by kind as in KINDS, then start."""
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    ranked = F.array_sort(F.transform(kinds_spans, lambda s: F.struct(order[s["kind"]].alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.concat_ws(",", F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(row, doc_id, found): base spans (known) and possible instances in slots of each document, as a written table.

    With ``carry`` the row's own columns come along as the struct ``doc``.
    """
    own = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")] if carry else []
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), *own)
    # a base match that fails its check is a slot too
    every = "|".join([BASE["email"], BASE["ip"], BASE["phone"], BASE["card"], SLOT])
    rows = with_matches(rows, {f"b_{k}": (BASE[k], HINT[k]) for k in KINDS} | {"slots": (every, SLOT_HINT)})
    rows = rows.withColumns({f"b_{k}": F.filter(f"b_{k}", _check(k)) for k in KINDS if k != "email"} | {"slots": F.transform("slots", _slot)})
    base = [F.transform(f"b_{k}", _mention(k, True)) for k in KINDS]
    more = [F.transform(F.filter("slots", _possible(k)), _mention(k, False)) for k in KINDS]
    return stored(rows.select("row", "doc_id", *(["doc"] if carry else []), F.concat(*base, *more).cast(MENTION).alias("found")), "mentions")


def discovered(found: DataFrame) -> DataFrame | None:
    """(kind, value) of the candidates that bootstrapping makes known; None if there is none."""
    flat = found.select(F.inline("found"))
    if flat.filter(~F.col("known")).isEmpty():
        return None
    edges = flat.select("kind", "value", "known", F.explode("patterns").alias("pattern")).groupBy("kind", "pattern", "value").agg(F.bool_or("known").alias("known"))
    graph = stored(edges, "graph")
    new = None
    while True:
        score = graph.groupBy("kind", "pattern").agg(F.count_if("known").alias("seeds"), F.count("*").alias("values"))
        good = score.filter((F.col("seeds") >= SEEDS) & (F.col("seeds") >= CONFIDENCE * F.col("values"))).select("kind", "pattern", (F.col("seeds") / F.col("values")).alias("confidence"))
        heard = graph.filter(~F.col("known")).join(good, ["kind", "pattern"]).groupBy("kind", "value").agg(F.count("*").alias("support"), F.sum(F.log(F.lit(1.000001) - F.col("confidence"))).alias("doubt"))
        step = stored(heard.filter((F.col("support") >= SUPPORT) & (F.exp("doubt") <= (1 - CONFIDENCE) ** SUPPORT)).select("kind", "value"), "discovered")
        if step.isEmpty():
            break
        new = step if new is None else new.unionByName(step)
        learned = graph.join(step.withColumn("hit", F.lit(True)), ["kind", "value"], "left").select("kind", "pattern", "value", (F.col("known") | F.coalesce("hit", F.lit(False))).alias("known"))
        graph, old = stored(learned, "graph"), graph
        dropped(old)
    return new


def _added(found: DataFrame) -> DataFrame | None:
    """(row, doc_id, added): the spans of discovered values; only rows that have some."""
    new = discovered(found)
    if new is None:
        return None
    flat = found.select("row", "doc_id", F.inline("found")).filter(~F.col("known")).join(new, ["kind", "value"])
    return flat.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end", "value"))).alias("added"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of base spans by kind, the base digest, all spans, and how many were added."""
    found = mentions(docs, id_col, text_col)
    added = _added(found)
    base = F.filter("found", lambda s: s["known"])
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    if added is None:
        rows = found.withColumn("more", plain(F.filter("found", lambda s: F.lit(False))))
    else:
        rows = found.join(added.drop("doc_id"), "row", "left").withColumn("more", F.coalesce(plain(F.col("added")), plain(F.filter("found", lambda s: F.lit(False)))))
    counts = [F.size(F.filter("found", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select(
        "doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.concat(plain(base), F.col("more"))).alias("spans"), F.size("more").cast("long").alias("n_added")
    )


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span, base or discovered, replaced by its kind in brackets."""
    found = mentions(docs, id_col, text_col, carry=True)
    added = _added(found)
    text = F.col("doc")[text_col]
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    every = plain(F.filter("found", lambda s: s["known"]))
    if added is None:
        out = found
    else:
        out = found.join(added.drop("doc_id"), "row", "left")
        every = F.concat(every, F.coalesce(plain(F.col("added")), plain(F.filter("found", lambda s: F.lit(False)))))
    out = out.withColumn("__spans", F.array_sort(every))

    # the text in short pieces, so that no gap is looked for from the text's start
    out = out.withColumns({"__pieces": F.when(F.size("__spans") > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))), "__ends": F.transform("__spans", lambda s: s["end"])})
    out = out.withColumn("__upto", running(F.col("__ends"), lambda a, v: F.greatest(a, v)))
    pieces, upto = F.col("__pieces"), F.col("__upto")

    def between(a: Column, b: Column) -> Column:
        i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        piece = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
        inner = F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        return F.when(i == j, F.substring(piece(i), a % PIECE + 1, b - a)).otherwise(F.concat(F.substring(piece(i), a % PIECE + 1, F.lit(PIECE)), inner, F.substring(piece(j), F.lit(1), b % PIECE)))

    def put(s: Column, i: Column) -> Column:
        at = F.when(i > 0, F.get(upto, i - 1)).otherwise(0)
        return F.when(s["start"] >= at, F.concat(between(at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

    whole = F.concat(F.array_join(F.transform("__spans", put), ""), between(F.element_at(upto, -1), F.char_length(text)))
    new = F.when(F.size("__spans") > 0, whole).otherwise(text)
    out = out.withColumn("__text", new)
    doc = F.col("doc")
    kept = {text_col: F.col("__text")}
    if length_col in docs.columns:
        kept[length_col] = F.when(F.size("__spans") > 0, F.length("__text").cast(docs.schema[length_col].dataType)).otherwise(doc[length_col])
    return out.select(*(kept.get(c, doc[c]).alias(c) for c in docs.columns))
