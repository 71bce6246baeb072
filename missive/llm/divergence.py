"""Source divergence audit: how far each source's words are from those of the other sources of its language.

Plain relational work: terms are exploded and counted, each (lang, source) group is
crossed with its language's kept vocabulary so that zeros count too, the dense table is
joined with itself on (lang, term), summed, and ranked by windows.

* A term is a run of ASCII letters and non-ASCII characters, A-Z lower-cased. A language
  keeps the terms found in at least ``least_docs`` of its rows (each row is a document,
  repeated ids too).
* With ``V`` kept terms and ``N`` their occurrences in a group, a term found ``n`` times
  has p = 1 + floor(scale * (n + 1) / (N + V)); two groups differ in a term by
  floor((p - q)^2 / q). All of it is in integers: a p is at most scale + 1, and the sum of
  all p of a group at most scale + V, so squares and sums stay within 64 bits.

Null text, lang and source count as ''. A group without terms has its pairs with what the
formula gives, 0 where the language keeps no term; an empty table gives no rows. Texts of
any length are cut whole into terms; other columns aren't read.

Counts are summed per task before the shuffle, so a hot source or a frequent word is a row
a task. Groups meet the vocabulary on (lang, part of the vocabulary): a language of any
size is spread over ``PARTS`` keys. The self-join's keys are (lang, term), each with one
row a source of the language; the sums leave each task as one row a pair of sources.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missive.llm.common import scratch, stored, text_of

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, SCALE, TOP_TERMS = 3, 1_000_000_000, 200
#: parts of a language's vocabulary that the groups are joined with
PARTS = 64


def terms_of(text: Column) -> Column:
    """The terms of a text in order; plain ASCII texts take the short way to lower case."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.regexp_extract_all(low, F.lit(TERM), F.lit(0))


def _counted(rows: DataFrame) -> DataFrame:
    """(lang, source, term, n): occurrences of a term in a group; where source is null, rows of the language that hold it."""
    terms = rows.select("lang", "source", terms_of(F.col("text")).alias("terms"))
    ways = F.array(F.struct("source", "terms"), F.struct(F.lit(None).cast("string").alias("source"), F.array_distinct("terms").alias("terms")))
    items = terms.select("lang", F.inline(ways)).select("lang", "source", F.explode("terms").alias("term"))
    return items.groupBy("lang", "source", "term").agg(F.count("*").alias("n"))


def share(n: Column, total: Column, scale: int) -> Column:
    """1 + floor(scale * (n + 1) / total), exact; in 64 bits where the product fits."""
    fits = n < (2**63 - 1) // scale - 1
    short = (F.when(fits, n).otherwise(0) + 1) * F.lit(scale).cast("long")
    wide = F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(scale).cast("decimal(18,0)"), total.cast("decimal(20,0)"))
    return F.when(fits, F.call_function("div", short, total)).otherwise(wide) + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rows = rows.withColumn("rank", F.row_number().over(order))
    if most is not None:
        rows = rows.filter(F.col("rank") <= most)
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, scale: int = SCALE, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank.

    Part ``pair``: every other source of the language with the summed distance from it.
    Part ``term``: the ``top_terms`` terms that the source uses more than its language.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), text_of().alias("text"))
    with scratch() as result:
        counted = stored(_counted(rows), "terms")
        kept = counted.filter(F.col("source").isNull() & (F.col("n") >= least_docs)).select("lang", "term")
        found = counted.filter(F.col("source").isNotNull()).join(kept, ["lang", "term"], "left_semi")
        by_term = stored(found.groupBy("lang", "term").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("counts"), F.sum("n").alias("lang_n")), "vocabulary")
        groups = rows.select("lang", "source").distinct()
        sizes = by_term.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
        own = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = stored(groups.join(own, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0), "groups")

        spread = groups.filter("v > 0").withColumn("vocabulary_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        words = by_term.withColumn("vocabulary_part", F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int"))
        dense = words.join(spread, ["lang", "vocabulary_part"])
        n = F.coalesce(F.try_element_at("counts", "source"), F.lit(0))
        dense = dense.select("lang", "term", "source", n.alias("n"), share(n, F.col("total") + F.col("v"), scale).alias("p"), share(F.col("lang_n"), F.col("lang_total") + F.col("v"), scale).alias("lang_p"))
        dense = stored(dense, "dense")

        a = dense.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p"))
        b = dense.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("q"))
        both = a.join(b, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b")
        sums = both.agg(F.sum(distance(F.col("p"), F.col("q"))).alias("ab"), F.sum(distance(F.col("q"), F.col("p"))).alias("ba"))
        way = lambda source, item, value: F.struct(F.col(source).alias("source"), F.col(item).alias("item"), F.col(value).alias("value"))
        sums = sums.select("lang", F.inline(F.array(way("a", "b", "ab"), way("b", "a", "ba"))))
        # groups of a language that keeps no term have pairs too
        bare = groups.filter("v = 0")
        bare = bare.select("lang", "source").join(bare.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
        pairs = _ranked(sums.unionByName(bare), "pair")
        more = dense.filter("n > 0 AND p > lang_p").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("lang_p")).alias("value"))
        return result(pairs.unionByName(_ranked(more, "term", top_terms)), "divergence")


def sql(least_docs: int = LEAST_DOCS, scale: int = SCALE, top_terms: int = TOP_TERMS) -> str:
    """The same over ``documents`` in DuckDB."""
    f = lambda p, q: f"(({p} - {q}) * ({p} - {q})) // {q}"
    p = lambda n, total: f"CAST(1 + ({scale}::HUGEINT * ({n} + 1)) // {total} AS HUGEINT)"
    return f"""
        WITH d AS (
            SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}') AS terms
            FROM documents
        ), o AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
        kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= {least_docs}),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN kept ON o.lang = kept.lang AND o.term = kept.term GROUP BY o.lang, o.source, o.term),
        own AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
        whole AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM c GROUP BY lang, term),
        dense AS (
            SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, {p("coalesce(c.n, 0)", "(coalesce(own.total, 0) + v.v)")} AS p, {p("whole.n", "(whole.total + v.v)")} AS q
            FROM g JOIN kept ON g.lang = kept.lang JOIN v ON v.lang = g.lang JOIN whole ON whole.lang = kept.lang AND whole.term = kept.term
            LEFT JOIN own ON own.lang = g.lang AND own.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
        ), summed AS (
            SELECT a.lang, a.source, b.source AS item, sum({f("a.p", "b.p")}) AS value
            FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        ), terms AS (SELECT lang, source, term AS item, {f("p", "q")} AS value FROM dense WHERE n > 0 AND p > q),
        rows AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= {top_terms}
    """
