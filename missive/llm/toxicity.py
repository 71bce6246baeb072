"""Toxicity by a weighted lexicon.

Texts are folded first: letters to lower case without accents, compatibility forms and
look-alikes from other alphabets to plain letters, digits and signs that stand for a letter
to that letter, everything else to blanks. An Aho-Corasick automaton then finds the
lexicon's entries, whole words or beginnings of words, in one pass; entries inside an
exception phrase don't count. The summed weight, divided by the root of the text's
words, goes through a logistic curve.

The lexicon is learned from labelled rows that aren't held out, at most
``SAMPLE_PER_CLASS`` documents of each class: Spark counts in how many toxic and clean
documents each beginning of a word and each word occurs. An entry is kept where its lift
is beyond what as many candidates would show by chance; its weight is the log of the lift.
Of beginnings that say the same the longest is kept, so ``scu`` gives way to ``scum``. Two-word phrases around an entry that are no likelier in toxic documents
become exceptions. Near copies in the sample count once. The curve is fitted on rows scored by lexicons that never saw their
fold.

Null and empty texts have no words and get the curve's value at no match. Without labels
of both classes there is no lexicon: the score is the share of toxic labels, 0 without any.
Of repeated ids in ``labels`` only those with one verdict count, of repeated ids in
``documents`` one text is learned from; all rows are scored, one by one. Texts of any
length are scanned whole; other columns aren't read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.llm.common import held_out, labelled_sample, scratch, stored, text_of, worker_state
from missive.llm.compression import curve

#: labelled documents of each class that the lexicon is learned from, at most
SAMPLE_PER_CLASS = 3000
#: candidates that come to the driver, at most; the bound of the lexicon
CANDIDATES = 200_000
FOLDS, LEAST_DOCS, LEAST_LIFT, SHORTEST, LONGEST = 5, 3, 8.0, 3, 14
#: words added to each text's length, so that one match in a few words isn't everything
PRIOR_WORDS, LEAST_DENSITY, TOXIC_FROM = 20, 0.05, 0.7

# Letters of other alphabets that look like Latin ones, and signs read as letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "г": "r", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "п": "n", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʟ": "l", "ʀ": "r",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}

_EXCEPTION = -1.0


class _Fold(dict):
    """What each character becomes; found by rule once and kept. Unjoined accents and invisible characters go."""

    def __missing__(self, code: int):
        c = chr(code)
        if c in SIGNS or unicodedata.category(c) in ("Mn", "Me", "Cf"):
            self[code] = c if c in SIGNS else None
            return self[code]
        plain = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
        letter = plain[0].lower()[:1] if len(plain) == 1 else c.lower()[:1]
        letter = LOOK_ALIKES.get(letter, letter)
        self[code] = letter if letter.isalpha() or letter in SIGNS else " "
        return self[code]


_FOLD = _Fold()
_RUN = "".join(map(re.escape, SIGNS))
#: one or two signs before a letter, or digits between a letter and the end of its word
_SIGNS = re.compile(rf"(?<![{_RUN}])[{_RUN}]{{1,2}}(?=[^\W\d_])|(?<=[^\W\d_])[0-9]{{1,2}}(?![{_RUN}\w])")
_REST = {ord(c): " " for c in SIGNS}


def folded(text: str) -> str:
    """The folded text; one character for each of the text's but for those that are dropped."""
    out = text.translate(_FOLD)
    if _SIGNS.search(out):
        out = _SIGNS.sub(lambda m: "".join(SIGNS.get(c, " ") for c in m[0]), out)
    return out.translate(_REST)


def _places(text: str) -> list[int]:
    """Where each kept character of a folded text stands in the text."""
    return [i for i, c in enumerate(text) if _FOLD[ord(c)] is not None]


def density(found: list[tuple[str, int, int, float]], words: int) -> float:
    """The summed weight by the root of the length: chance matches in a text of ``words`` vary by as much."""
    return sum(m[3] for m in found) / math.sqrt(words + PRIOR_WORDS)


class Lexicon:
    """Entries ``" word "`` and ``" beginning"`` with weights, and exception phrases."""

    def __init__(self, entries: dict[str, float], exceptions: list[str] = ()):
        self.entries, self.exceptions = entries, list(exceptions)
        self.automaton = None

    def __reduce__(self):
        return Lexicon, (self.entries, self.exceptions)

    def _built(self):
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for term, weight in self.entries.items():
                forms = {term}
                if "l" in term:  # a 1 or ! may stand for l as well as for i
                    forms.add(term.replace("l", "i"))
                for form in forms:
                    if form == term or form not in self.entries:
                        self.automaton.add_word(form, (form, term, weight))
            for phrase in self.exceptions:
                form = f" {' '.join(folded(phrase).split())} "
                self.automaton.add_word(form, (form, form, _EXCEPTION))
            if len(self.automaton):
                self.automaton.make_automaton()
        return self.automaton

    def matches(self, text: str) -> tuple[list[tuple[str, int, int, float]], int]:
        """(entry, start, end, weight) in the text, the longest where several begin, and the number of words."""
        plain = folded(text)
        n, automaton = len(plain.split()), self._built()
        if not n or not len(automaton):
            return [], n
        found: dict[int, tuple] = {}
        excepted = []
        for last, (form, term, weight) in automaton.iter(f" {plain} "):
            first = last - len(form) + 1
            if weight == _EXCEPTION:
                excepted.append((first, last))
            elif first not in found or len(found[first][0]) < len(form):
                found[first] = (form, term, weight, last)
        if not found:
            return [], n
        at = _places(text) if len(plain) != len(text) else None
        out = []
        for first, (form, term, weight, last) in sorted(found.items()):
            # the padding blank and the entry's leading blank cancel out
            start, end = first, first + len(form.strip())
            start, end = (start, end) if at is None else (at[start], at[end - 1] + 1)
            if form != term and not set(text[start:end]) & set("1!|"):
                continue
            if not any(a <= first and last <= b for a, b in excepted):
                out.append((term.strip(), start, end, weight))
        return out, n

    def density(self, text: str) -> float:
        return density(*self.matches(text))


class Model:
    """A lexicon and the curve 1 / (1 + exp(-(slope * log density + offset)))."""

    def __init__(self, lexicon: Lexicon, slope: float, offset: float):
        self.lexicon, self.slope, self.offset = lexicon, slope, offset

    def score(self, density: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _scaled(density) + self.offset, -30, 30)))


def _scaled(density: np.ndarray) -> np.ndarray:
    return np.log(np.asarray(density, float) + LEAST_DENSITY) - math.log(LEAST_DENSITY)


# -- learning ----------------------------------------------------------------
def _terms(text: str) -> set[str]:
    """The folded words of a text, as ``" word "``, and their beginnings, as ``" beg"``."""
    words = set(folded(text).split())
    return {f" {w} " for w in words if len(w) <= LONGEST} | {f" {w[:k]}" for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)}


def independent(sample: DataFrame) -> DataFrame:
    """One row of each group of near copies, which would make any of their words telling.

    A row goes if one of the four smallest hashes of its five-word runs is a row's with a
    smaller id.
    """
    words = F.split(F.trim(F.lower("text")), r"\s+")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 4, F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, 5)))
    marks = sample.select("doc_id", words.alias("words")).select("doc_id", F.explode(F.slice(F.array_sort(F.array_distinct(runs)), 1, 4)).alias("mark"))
    first = marks.groupBy("mark").agg(F.min("doc_id").alias("first"))
    copies = marks.join(first, "mark").filter("first < doc_id").select("doc_id").distinct()
    return sample.join(copies, "doc_id", "left_anti")


def _counts(sample: DataFrame) -> DataFrame:
    """(term, n): documents that hold it, as counts by fold, clean ones first and toxic ones after them."""

    def run(batches):
        for batch in batches:
            seen: dict[str, np.ndarray] = {}
            for text, label, fold in zip(*(c.to_pylist() for c in batch.columns)):
                for term in _terms(text):
                    if term not in seen:
                        seen[term] = np.zeros(2 * FOLDS, np.int64)
                    seen[term][label * FOLDS + fold] += 1
            counts = np.array(list(seen.values()), np.int64).reshape(-1, 2 * FOLDS).T
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *map(pa.array, counts)], names=["term", *columns])

    columns = [f"n{i}" for i in range(2 * FOLDS)]
    found = sample.select("text", "label", "fold").mapInArrow(run, "term string, " + ", ".join(f"{c} long" for c in columns))
    return found.groupBy("term").agg(*(F.sum(c).alias(c) for c in columns))


def _lift(a, b, toxic: int, clean: int) -> float:
    return math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))


def _evidence(a: int, b: int, toxic: int, clean: int) -> float:
    """Log of how much likelier a of ``toxic`` and b of ``clean`` documents are with their own share than with the sample's; 0 unless the lift is high."""
    if a < LEAST_DOCS or _lift(a, b, toxic, clean) < math.log(LEAST_LIFT):
        return 0.0
    share, own = toxic / (toxic + clean), a / (a + b)
    return (a + b) * (own * math.log(own / share) + (b and (1 - own) * math.log((1 - own) / (1 - share))))


def entries(counts: dict[str, tuple[int, int]], toxic: int, clean: int, candidates: int) -> dict[str, float]:
    """The lexicon of (toxic, clean) document counts by term.

    Only evidence beyond what the best of so many candidates shows by chance counts. The
    strongest beginnings come first, of equal ones the longest; what begins an entry, or
    what an entry begins, is no entry.
    """
    found = {t: _evidence(*n, toxic, clean) for t, n in counts.items() if not t.endswith(" ")}
    least = math.log(max(candidates, 1))
    longer = defaultdict(list)
    for t in found:
        longer[t[:-1]].append(t)
    out, taken = {}, set()
    for t in sorted((t for t, x in found.items() if x >= least and x > 0), key=lambda t: (-round(found[t], 6), -len(t), t)):
        if t in taken or any(t[:k] in out for k in range(1 + SHORTEST, len(t) + 1)):
            continue
        while more := [x for x in longer[t] if found[x] >= max(least, 0.97 * found[t]) and x not in taken]:
            t = max(more, key=lambda x: (found[x], x))
        taken |= {t[:k] for k in range(1 + SHORTEST, len(t) + 1)}
        out[t] = _lift(*counts[t], toxic, clean)
    whole = lambda t: counts.get(f"{t} ", (0, 0))[0] >= 0.95 * counts[t][0]
    return {f"{t} " if whole(t) else t: weight for t, weight in out.items()}


def _contexts(sample: DataFrame, lexicons: list[Lexicon]) -> DataFrame:
    """(label, fold, density, phrases) of each row, scored by the lexicon that never saw its fold; phrases of the last, whole lexicon."""
    shared = sample.sparkSession.sparkContext.broadcast(lexicons)

    def run(batches):
        for batch in batches:
            rows = []
            for text, label, fold in zip(*(c.to_pylist() for c in batch.columns)):
                found, _ = shared.value[-1].matches(text)
                around = set()
                for _, start, end, _ in found:
                    before = folded(text[max(0, start - 40) : start]).split(" ")
                    after = folded(text[end : end + 40]).split(" ")
                    word = folded(text[start:end]) + after[0]
                    around |= {f"{before[-2]} {word}"} if len(before) > 1 and before[-2] and not before[-1] else set()
                    around |= {f"{word} {after[1]}"} if len(after) > 2 and after[1] else set()
                rows.append((label, fold, shared.value[fold].density(text), sorted(around)))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    schema = pa.schema([("label", pa.int32()), ("fold", pa.int32()), ("density", pa.float64()), ("phrases", pa.list_(pa.string()))])
    return sample.select("text", "label", "fold").mapInArrow(run, "label int, fold int, density double, phrases array<string>")


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, exceptions: tuple[str, ...] = ()) -> Model:
    """Learn lexicon, exceptions and curve; ``exceptions``: phrases that never count, beside those learned."""
    verdicts = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).filter("toxic = _most").drop("_most")
    with scratch():
        verdicts = stored(verdicts, "verdicts")
        share = {r[0]: r[1] for r in verdicts.groupBy(F.col("toxic").cast("int")).count().collect()}
        if len(share) < 2:
            return Model(Lexicon({}, exceptions), 0.0, 30.0 if share.get(1) else -30.0)
        sample = labelled_sample(docs, verdicts, per_class, "toxic").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
        fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
        sample = stored(independent(stored(sample.withColumn("fold", fold), "labelled")), "sample")
        sizes = np.zeros(2 * FOLDS, np.int64)
        for r in sample.groupBy("label", "fold").count().collect():
            sizes[r["label"] * FOLDS + r["fold"]] = r["count"]
        clean, toxic = (int(sizes[i * FOLDS : (i + 1) * FOLDS].sum()) for i in (0, 1))
        if not clean or not toxic:
            return Model(Lexicon({}, exceptions), 0.0, 30.0 if toxic else -30.0)
        counts = stored(_counts(sample), "counts")
        b, a = (sum((F.col(f"n{i * FOLDS + k}") for k in range(FOLDS)), F.lit(0)) for i in (0, 1))
        likely = counts.filter((a >= LEAST_DOCS) & ((a + 0.5) * (clean + 1) >= (b + 0.5) * (toxic + 1) * (LEAST_LIFT / 2)))
        n_candidates = counts.filter(a + b >= LEAST_DOCS).count()
        rows = likely.orderBy(F.desc(a - b), "term").limit(CANDIDATES).collect()
        lexicons = []
        for left_out in [*range(FOLDS), None]:
            seen = [k for k in range(FOLDS) if k != left_out]
            own = {r["term"]: (sum(r[1 + FOLDS + k] for k in seen), sum(r[1 + k] for k in seen)) for r in rows}
            n0, n1 = (int(sum(sizes[i * FOLDS + k] for k in seen)) for i in (0, 1))
            lexicons.append(Lexicon(entries(own, n1, n0, n_candidates) if n0 and n1 else {}, exceptions))
        known = stored(_contexts(sample, lexicons), "contexts")
        phrases = known.select("label", F.explode("phrases").alias("phrase")).groupBy("phrase").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
        harmless = phrases.filter((F.col("b") >= LEAST_DOCS) & ((F.col("b") + 0.5) * (toxic + 1) >= (F.col("a") + 0.5) * (clean + 1)))
        learned = [r["phrase"] for r in harmless.orderBy(F.desc("b"), "phrase").limit(CANDIDATES).collect()]
        scored = known.select("label", "density").collect()
    y, x = np.array([r["label"] for r in scored], float), _scaled([r["density"] for r in scored])
    weight = np.where(y == 1, share[1] / toxic, share[0] / clean)
    slope, offset = curve(x, y, weight * len(y) / weight.sum())
    return Model(Lexicon(lexicons[-1].entries, [*exceptions, *learned]), slope, offset)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words, n_matches and matches (entry:start:end in code points, comma-joined)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon.entries, model.lexicon.exceptions, model.slope, model.offset))

    def run(batches):
        terms, exceptions, slope, offset = shared.value
        model = worker_state(("toxicity", hash(frozenset(terms.items())), hash(tuple(exceptions)), slope, offset), lambda: Model(Lexicon(terms, exceptions), slope, offset))
        for batch in batches:
            found = [model.lexicon.matches(t) for t in batch.column(1).to_pylist()]
            s = model.score([density(*x) for x in found])
            spans = [",".join(f"{t}:{a}:{b}" for t, a, b, _ in ms) for ms, _ in found]
            made = [batch.column(0), batch.column(2), pa.array(s, pa.float64()), pa.array((s >= TOXIC_FROM).astype(np.int32)), pa.array([n for _, n in found], pa.int64()), pa.array([len(ms) for ms, _ in found], pa.int64()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "held_out", "score", "predicted", "n_words", "n_matches", "matches"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("string").alias("text"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_words long, n_matches long, matches string")
