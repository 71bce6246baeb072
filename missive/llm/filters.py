"""Filter interaction audit: what each of five filters removes, in every order of them.

Each document becomes a mask of the filters that it fails; counts per mask say all about
every order, so the 120 orders cost nothing beyond one vector of counts for each part.

Copies are found on an RDD routed by fingerprint. A task that reads the documents first
keeps the copies among its own rows in chains: fingerprint -> texts that share it, each
with its smallest id. Rows above their chain's id are decided there and leave without
their text. What is left, one row a text and chain (a text that thousands share included),
is written as a table, so that a lost executor costs no second reading, and goes to the
partition of its xxhash, sorted by it, where the chains of one fingerprint at a time are
merged the same way. A chain compares whole texts, so a collision of fingerprints never
makes a copy. ``combineByKey`` then merges the vectors of counts by part.

A: under 100 words; B: 100 * distinct words < 80 * words; C: 100 * [A-Z] > 10 * code
points; D: holds any of ``#$%&*|``; E: the text of a smaller doc_id, in the whole table.
Null texts are empty (A alone, and E), null lang is part ''. A row without id is a copy of
none and none is a copy of it; repeated rows of one id count each and aren't each other's
copies. A document is good or toxic if any of its labels says so. Empty tables give no
rows; texts of any length are judged whole; other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.llm.common import scratch, stored, text_of

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_UPPER_PERCENT, SYMBOLS = 100, 80, 10, b"#$%&*|"
#: bytes of text that a task holds in chains before it passes them on
CHAIN_BYTES = 32 << 20

_UPPER = bytes(range(65, 91))
_COPY = 1 << FILTERS.index("E")


def failed(raw: bytes, points: int) -> int:
    """The mask of filters A to D of a text of ``points`` code points, in UTF-8: white space and ASCII are single bytes there."""
    words = raw.split()
    n = len(words)
    return (
        (n < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT_PERCENT * n) << 1
        | (100 * (len(raw) - len(raw.translate(None, _UPPER))) > MOST_UPPER_PERCENT * points) << 2
        | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3
    )


class Chains:
    """Texts of one fingerprint, each with its smallest id and how many rows of each lang have that id."""

    def __init__(self):
        self.of: dict[int, list[list]] = {}
        self.bytes = 0

    def offer(self, key: int, raw: bytes, mask: int, doc_id: int, langs: dict[str, int]) -> Iterator[tuple]:
        """Take rows of one id; yields (doc_id, lang, mask, rows) of those that turn out to be copies."""
        chain = self.of.setdefault(key, [])
        for link in chain:
            if link[0] == raw:
                break
        else:
            chain.append([raw, mask, doc_id, dict(langs)])
            self.bytes += len(raw) + 200
            return
        if doc_id == link[2]:
            for lang, n in langs.items():
                link[3][lang] = link[3].get(lang, 0) + n
            return
        larger, rows = (doc_id, langs) if doc_id > link[2] else (link[2], link[3])
        for lang, n in rows.items():
            yield larger, lang, mask | _COPY, n
        if doc_id < link[2]:
            link[2], link[3] = doc_id, dict(langs)

    def drained(self) -> Iterator[tuple]:
        """(fingerprint, text, id, lang, mask, rows) of what is held; nothing is held any more."""
        for key, chain in self.of.items():
            for raw, mask, doc_id, langs in chain:
                for lang, n in langs.items():
                    yield key, raw, doc_id, lang, mask, n
        self.of, self.bytes = {}, 0


#: decided rows that a task sums before it passes them on
DECIDED_ROWS = 50_000
_LINK = pa.schema([("key", pa.int64()), ("raw", pa.binary()), ("doc_id", pa.int64()), ("lang", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])


def _local(rows) -> Iterator[tuple]:
    """What is left of the chains of a task's rows (doc_id, text, code points, lang), and its decided rows, without key and text."""
    chains, decided = Chains(), Counter()

    def passed_on():
        for row, n in decided.items():
            yield None, None, *row, n
        decided.clear()

    for doc_id, raw, points, lang in rows:
        mask = failed(raw, points)
        if doc_id is None:
            decided[None, lang, mask] += 1
        else:
            for *done, n in chains.offer(xxhash.xxh3_64_intdigest(raw) - 2**63, raw, mask, doc_id, {lang: 1}):
                decided[tuple(done)] += n
        if chains.bytes > CHAIN_BYTES:
            yield from chains.drained()
        if len(decided) > DECIDED_ROWS:
            yield from passed_on()
    yield from chains.drained()
    yield from passed_on()


def _batches(batches) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            texts = batch.column(1)
            yield from zip(batch.column(0).to_pylist(), texts.cast(pa.binary()).to_pylist(), pc.utf8_length(texts).to_pylist(), batch.column(2).to_pylist())

    held, size = [], 0
    for row in _local(rows()):
        held.append(row)
        size += len(row[1] or b"") + 50
        if size > CHAIN_BYTES // 4:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _LINK)], schema=_LINK)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _LINK)], schema=_LINK)


def _merged(rows) -> Iterator[tuple]:
    """(doc_id, lang, mask, rows) of what was routed here, sorted by key; the chains of one key at a time are held."""
    chains, at = Chains(), None
    for key, (raw, doc_id, lang, mask, n) in rows:
        if key != at:
            yield from (x[2:] for x in chains.drained())
            at = key
        yield from chains.offer(key, bytes(raw), mask, doc_id, {lang: n})
    yield from (x[2:] for x in chains.drained())


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, mask, n): how many rows of an id fail which filters; bit k of the mask is filter k."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), text_of().cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    links = stored(rows.mapInArrow(_batches, "key long, raw binary, doc_id long, lang string, mask int, n long"), "links")
    routed = links.filter("key is not null").rdd.map(lambda r: (r[0], tuple(r[1:])))
    parts = max(routed.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    merged = routed.repartitionAndSortWithinPartitions(parts, lambda key: key).mapPartitions(_merged)
    found = spark.createDataFrame(merged, "doc_id long, lang string, mask int, n long", verifySchema=False)
    decided = links.filter("key is null").select("doc_id", "lang", "mask", "n")
    return found.unionByName(decided).groupBy("doc_id", "lang", "mask").agg(F.sum("n").alias("n"))


def _orders() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """(order, step) of the rows of a part, and for each figure the matrix that makes it of counts by mask."""
    n = len(FILTERS)
    mask, bits = np.arange(2**n), np.array([m.bit_count() for m in range(2**n)])
    orders = list(permutations(range(n)))
    keys, made = [], {name: [] for name in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    for order in orders:
        before = 0
        for step, k in enumerate(order, 1):
            fails, gone = mask >> k & 1 == 1, mask & before != 0
            before |= 1 << k
            keys.append(("".join(FILTERS[i] for i in order), step))
            made["kept"].append(mask & before == 0)
            made["removed"].append(fails & ~gone)
            made["redundant"].append(fails & gone)
            made["unique_fails"].append(mask == 1 << k)
            # of the orders, the first of a document's failures is any of them equally often
            made["shapley"].append(np.where(fails, len(orders) // np.maximum(bits, 1), 0))
    return keys, {name: np.array(rows).astype(np.int64) for name, rows in made.items()}


def _table(parts) -> Iterator[tuple]:
    keys, made = _orders()
    for part, (n, good, toxic) in parts:
        figures = [made[name] @ n for name in ("kept", "removed", "redundant", "unique_fails")] + [made["removed"] @ good, made["removed"] @ toxic, made["shapley"] @ n]
        for (order, step), *values in zip(keys, *(x.tolist() for x in figures)):
            yield part, order, step, *values


def _added(vector: np.ndarray, row) -> np.ndarray:
    mask, n, good, toxic = row
    vector[:, mask] += (n, n * good, n * toxic)
    return vector


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step: what the step keeps and removes.

    The counts of ids meet their labels after they are summed, so an id of very many rows
    is a few rows in the join.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    said = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).cast("int").alias(c)
    known = known.filter("doc_id is not null").groupBy("doc_id").agg(said("good"), said("toxic"))
    empty = lambda row: _added(np.zeros((3, 2 ** len(FILTERS)), np.int64), row)
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    with scratch() as result:
        rows = masks(docs).join(known, "doc_id", "left").select("lang", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))
        parts = rows.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(empty, _added, lambda a, b: a + b, int(spark.conf.get("spark.sql.shuffle.partitions")))
        return result(spark.createDataFrame(parts.mapPartitions(_table), schema, verifySchema=False), "audit")


def sql() -> str:
    """The same over ``documents`` and ``labels`` in DuckDB."""
    word = r"[^\x20\x09-\x0D]+"
    bit = "(1 << (ascii(substr(o.filter_order, s.step, 1)) - 65))"
    before = "list_sum(list_transform(range(1, s.step), lambda i: 1 << (ascii(substr(o.filter_order, i, 1)) - 65)))"
    orders = " CROSS JOIN ".join(f"(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) f{i}" for i in range(1, 6))
    differ = " AND ".join(f"f{i}.f <> f{j}.f" for i in range(1, 6) for j in range(1, i))
    return f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
        least AS (SELECT md5(text) AS h, text, min(doc_id) AS first FROM t GROUP BY text),
        w AS (SELECT t.doc_id, t.part, t.text, regexp_extract_all(t.text, '{word}') AS w, coalesce(t.doc_id > least.first, false) AS copy FROM t JOIN least ON md5(t.text) = least.h AND t.text = least.text),
        m AS (
            SELECT doc_id, part, CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT) + 4 * CAST(100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) AS INT)
                   + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(copy AS INT) AS mask
            FROM w
        ), known AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic FROM labels GROUP BY doc_id),
        c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN known ON m.doc_id = known.doc_id GROUP BY part, mask),
        o AS (SELECT f1.f || f2.f || f3.f || f4.f || f5.f AS filter_order FROM {orders} WHERE {differ}),
        s AS (SELECT o.filter_order, s.step, {bit} AS bit, coalesce({before}, 0) AS before FROM o CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS step) s)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(sum(CASE WHEN mask & (CAST(before AS INT) | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
               CAST(sum(CASE WHEN mask & bit > 0 AND mask & CAST(before AS INT) = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
               CAST(sum(CASE WHEN mask & bit > 0 AND mask & CAST(before AS INT) > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
               CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
               CAST(sum(CASE WHEN mask & bit > 0 AND mask & CAST(before AS INT) = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
               CAST(sum(CASE WHEN mask & bit > 0 AND mask & CAST(before AS INT) = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
               CAST(sum(CASE WHEN mask & bit > 0 THEN n * 120 // bit_count(mask) ELSE 0 END) AS BIGINT) AS shapley
        FROM c CROSS JOIN s GROUP BY part, filter_order, step
    """
