"""Near-duplicate documents with HyperMinHash.

A document is its set of word shingles. For each of ``HASHES`` hash functions the
shingles are dealt to ``BUCKETS`` buckets, and a bucket keeps, of its smallest hash,
the number of leading zeros (4 bits) and the ``MANTISSA`` bits after the leading one:
one byte a register. A band is ``ROWS`` neighbouring registers of one function; two
sets of similarity j share a given band with a chance of about j**ROWS, so at 0.8
one of the 40 bands is shared but for five pairs in a million.

1. Equal sets form a class, whose smallest doc_id stands for it from then on.
2. Bands that several classes share are kept as (band, class), with the smallest
   class of the band as its leader.
3. Star rounds: each class is compared with one leader it shares a band with, first
   the band's smallest class, later one drawn by hash from the band's first component,
   another for each band and round. The
   registers give the similarity, corrected for registers that agree by chance; pairs
   well above or near the limit are confirmed on full sets; links form components.
4. The rest: classes that share a band with another component. Those joined by shared
   bands are a family, whose centre is the set of the shingles that at least half of
   them have (it may be empty). A class x is then its difference D(x) to the centre,
   and x and y are linked exactly if excess(x) + excess(y) <= 2 w |D(x) & D(y)|, with
   w = 100 + percent and excess(x) = w |D(x)| - (100 - percent) |x|. Hence
   * the class of least excess is linked with whatever is linked with anything
     without a shared difference: one star a family covers all such links;
   * other links need shared differences, and only differences that occur in two
     components can be shared. Where a class has too few of them for its own and any
     possible partner's excess, it has no further link. In a large group of near copies
     the copies' own changes are shared with nobody, so none is left;
   * classes still left are joined on the rarest of their shared differences, as many
     as leave too few others for a link (prefix filter); how many these are depends on
     the partner's excess, so each class is entered for each level of it.
   These bounds are exact, so no link of two classes that share a band is lost by them,
   and no group's pairs are made. What is left is estimated once more before it is
   confirmed: a linked pair of ``SURE_SIZE`` shingles or more is dropped there only if its
   registers fall short by MARGIN, 7 standard errors (a chance below 1 in 10^11).
5. Components by smallest-label propagation with pointer jumping.

Sets of up to 3 shingles can only be linked by being equal and have no bands.
Every step is a shuffle by key with written tables between; nothing is collected.

Null texts and texts without words have an empty set and are linked with nothing.
Rows without an id come back with component_id null, kept true. Rows that share an
id are one document's: each has its own set, all have one component. Where their texts
differ, rows are compared under numbers of their own and then connected by id. Very
long texts count with all their words. Only the id and the text are read, so other
columns may have any name. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missive.llm.common import GenerationCache, dropped, lean, narrowed, scratch, stored, text_of, worker_state

HASHES, BUCKETS, ROWS, MANTISSA = 20, 12, 6, 4
REGISTERS = HASHES * BUCKETS
EMPTY, MOST_ZEROS = 255, 14
#: chance that registers of unequal minima agree is about this times 2**-MANTISSA, for sets of like size
COLLISION = 0.169919487159739093975315012348
#: pairs estimated below limit - MARGIN (7 standard errors of 240 registers) aren't confirmed; smaller sets always are
MARGIN, SURE_SIZE = 0.2, 100
STAR_ROUNDS = 2
#: excesses up to this many times w have levels of their own
LEVELS = 16
BITS = 1 << 23
#: word hashes that a worker keeps, and the bytes of sets it holds before it gives them on
CACHE_ENTRIES, PIECE_BYTES = 50_000, 4 << 20

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SEEDS = [np.uint64(xxhash.xxh3_64_intdigest(f"register {i}".encode())) for i in range(HASHES)]


def _hashes() -> GenerationCache:
    return worker_state("words", lambda: GenerationCache(xxhash.xxh3_64_intdigest, CACHE_ENTRIES))


def shingle_set(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-word shingles (a-z for A-Z; words between the six ASCII blanks)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    with np.errstate(over="ignore"):
        s = np.full(len(words) - width + 1, width, np.uint64)
        for j in range(width):
            s = (s ^ h[j : len(words) - width + 1 + j]) * _M1
            s ^= s >> np.uint64(32)
    return np.unique(s)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash of each set: REGISTERS bytes, EMPTY where a bucket got no shingle."""
    n = len(sets)
    x = np.concatenate(sets) if n else np.empty(0, np.uint64)
    row = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, [len(s) for s in sets])
    out = np.empty((n, HASHES, BUCKETS), np.uint8)
    for f, seed in enumerate(_SEEDS):
        with np.errstate(over="ignore"):
            z = (x ^ seed) * _M2
            z ^= z >> np.uint64(32)
            z *= _M1
        bucket = ((z >> np.uint64(32)) * np.uint64(BUCKETS)) >> np.uint64(32)
        z ^= z >> np.uint64(29)
        least = np.full(n * BUCKETS, 0xFFFFFFFF, np.uint32)
        np.minimum.at(least, row + bucket.astype(np.int64), (z & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        zeros = 32 - np.frexp(least.astype(np.float64))[1]
        mantissa = (least.astype(np.uint64) << (zeros + 1).astype(np.uint64) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - MANTISSA)
        byte = (np.minimum(zeros, MOST_ZEROS).astype(np.uint64) << np.uint64(MANTISSA)) | mantissa
        out[:, f] = np.where(least == 0xFFFFFFFF, EMPTY, byte).reshape(n, BUCKETS)
    return out.reshape(n, REGISTERS)


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from rows of registers, corrected for chance agreement."""
    live = (a != EMPTY) | (b != EMPTY)
    agree = ((a == b) & live).sum(1) / np.maximum(1, live.sum(1))
    ratio = np.maximum(n_a, n_b) / np.maximum(1, np.minimum(n_a, n_b))
    chance = COLLISION * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(0.0, (agree - chance) / (1 - chance))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def _signed(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, regs): set_a and set_b are 128 hash bits of the set."""

    def run(batches):
        for batch in batches:
            texts, done = batch.column(1), 0
            while done < len(texts):
                sets, size, first = [], 0, done
                while done < len(texts) and size < 400_000:
                    sets.append(shingle_set(texts[done].as_py(), n))
                    size += len(sets[-1])
                    done += 1
                digests = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]
                regs = registers(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, done - first), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array([r.tobytes() for r in regs], pa.binary())],
                    ["doc_id", "n_shingles", "set_a", "set_b", "regs"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n_shingles long, set_a long, set_b long, regs binary")


def _bands(classes: DataFrame) -> DataFrame:
    """(band, doc, n): the band's number and its six registers as one long; the class and its set's size."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            r = _matrix(batch.column(1)).reshape(len(batch), -1, ROWS).astype(np.int64)
            key = np.broadcast_to(np.arange(r.shape[1], dtype=np.int64), r.shape[:2]).copy()
            for j in range(ROWS):
                key = key << 8 | r[:, :, j]
            some = (r != EMPTY).any(2)
            docs, sizes = (np.broadcast_to(batch.column(i).to_numpy()[:, None], some.shape) for i in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(docs[some]), pa.array(sizes[some])], ["band", "doc", "n"])

    return classes.filter("n_shingles > 3").select("doc_id", "regs", "n_shingles").mapInArrow(lean(run), "band long, doc long, n long")


def _estimated(pairs: DataFrame, classes: DataFrame, limit: float) -> DataFrame:
    """(a, b, est) of the pairs that the sizes and registers don't rule out."""
    side = lambda c: classes.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("regs").alias(f"r_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("n_a", "n_b") >= limit * F.greatest("n_a", "n_b"))

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            n_a, n_b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            est = similarity(_matrix(batch.column(4)), _matrix(batch.column(5)), n_a, n_b)
            on = pa.array((est >= limit - MARGIN) | (np.minimum(n_a, n_b) < SURE_SIZE))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(est)], ["a", "b", "est"]).filter(on)

    return both.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(lean(run), "a long, b long, est double")


def _pieces(ids: pa.Array, sets: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    """(doc_id, shingles) in batches of about PIECE_BYTES, so that a worker never holds the sets of a whole batch of texts."""
    first, size, own = 0, 0, []
    for one in sets:
        own.append(one)
        size += len(one)
        if size >= PIECE_BYTES:
            yield pa.RecordBatch.from_arrays([ids.slice(first, len(own)), pa.array(own, pa.binary())], ["doc_id", "shingles"])
            first, size, own = first + len(own), 0, []
    yield pa.RecordBatch.from_arrays([ids.slice(first, len(own)), pa.array(own, pa.binary())], ["doc_id", "shingles"])


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, shingles): the sorted set, as bytes, of each document in ``wanted`` (doc_id).

    A bitmap of BITS bits, whatever the number of ids, goes to all tasks, which pass
    over most texts that aren't wanted; so sets are shuffled to the ids and not texts.
    Where ids outnumber the bits more texts pass, and the join still decides.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS)) + 1
    parts = wanted.select(place("doc_id").alias("h")).groupBy(F.bitmap_bucket_number("h").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    bits = np.zeros(BITS // 8, np.uint8)
    for k, part in parts.collect():  # BITS / 32768 rows of 4 kB
        bits[(k - 1) * 4096 : k * 4096] = np.frombuffer(part, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            at = batch.column(2).to_numpy() - 1
            batch = batch.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            yield from _pieces(batch.column(0), (shingle_set(t.as_py(), n).tobytes() for t in batch.column(1)))

    key = F.col(id_col).cast("long")
    texts = docs.filter(key.isNotNull()).select(key.alias("doc_id"), text_of(text_col).alias("text"), place(key).alias("at"))
    return texts.mapInArrow(lean(run), "doc_id long, shingles binary").join(wanted, "doc_id")


def _confirmed(pairs: DataFrame, docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose full sets meet 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            yes = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                common = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
                yes.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(yes, pa.bool_()))

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = stored(_sets_of(docs, wanted, n, id_col, text_col), "sets")
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s_{c}"))
    out = stored(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b").mapInArrow(lean(run), "a long, b long").distinct(), "links")
    dropped(sets)
    return out


def _family_rows(bands: DataFrame) -> DataFrame:
    """(doc, family) of the classes in ``bands`` (band, doc, c_doc, ...): a family is connected by shared bands.

    A class goes with the smallest of its bands' first classes, and only these first
    classes are then connected: they are few where many classes share bands.
    """
    first = bands.groupBy("band").agg(F.min("doc").alias("a"))
    pairs = bands.join(first, "band").select("a", "doc").distinct()
    own = pairs.groupBy("doc").agg(F.min("a").alias("p"))
    links = pairs.join(own, "doc").filter("a <> p").select("a", F.col("p").alias("b")).distinct()
    found = components(links).withColumnRenamed("doc_id", "p")
    return own.join(found, "p", "left").select("doc", F.coalesce("component", "p").alias("family"))


def _longs(numbers: pa.ListScalar) -> np.ndarray:
    """The numbers of one row's list; none for null."""
    return numbers.values.to_numpy() if numbers.is_valid else np.empty(0, np.int64)


def _differences(sets: DataFrame, percent: int) -> DataFrame:
    """(doc, c_doc, family, n, excess, difference) of ``sets`` (doc, c_doc, family, shingles).

    ``difference`` holds the hashes in which the set differs from its family's centre, as
    bytes; a missing one is told from an additional one by its flipped bits.
    """

    def flat(batches):
        for batch in batches:
            tokens = [np.frombuffer(s.as_buffer(), np.int64) for s in batch.column(1)]
            at = pa.array(np.repeat(np.arange(len(tokens)), [len(t) for t in tokens]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.concatenate([np.empty(0, np.int64), *tokens]))], ["family", "shingle"])

    def run(batches):
        for batch in batches:
            sizes, excess, found = [], [], []
            # the centre stands in each row of its family: read in place, as lists of Python's numbers it is five times as large
            for raw, middle in zip(batch.column(3), batch.column(4)):
                own, middle = np.frombuffer(raw.as_buffer(), np.int64), _longs(middle)
                d = np.concatenate([np.setdiff1d(own, middle, assume_unique=True), ~np.setdiff1d(middle, own, assume_unique=True)])
                sizes.append(len(own))
                excess.append((100 + percent) * len(d) - (100 - percent) * len(own))
                found.append(d.tobytes())
            made = [pa.array(sizes, pa.int64()), pa.array(excess, pa.int64()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], ["doc", "c_doc", "family", "n", "excess", "difference"])

    size = sets.groupBy("family").agg(F.count("*").alias("size"))
    counts = sets.select("family", "shingles").mapInArrow(lean(flat), "family long, shingle long").groupBy("family", "shingle").agg(F.count("*").alias("df"))
    # at most twice a mean set for each family
    middle = counts.filter("df > 1").join(size, "family").filter("2 * df >= size").groupBy("family").agg(F.collect_list("shingle").alias("middle"))
    rows = sets.join(middle, "family", "left").select("doc", "c_doc", "family", "shingles", "middle")
    return rows.mapInArrow(lean(run), "doc long, c_doc long, family long, n long, excess long, difference binary")


def _shared(rows: DataFrame) -> DataFrame:
    """(doc, difference, df): the differences of each class that another component of its family has too."""

    def flat(batches):
        for batch in batches:
            own = [np.frombuffer(s.as_buffer(), np.int64) for s in batch.column(3)]
            at = pa.array(np.repeat(np.arange(len(own)), [len(t) for t in own]))
            yield pa.RecordBatch.from_arrays([c.take(at) for c in batch.columns[:3]] + [pa.array(np.concatenate([np.empty(0, np.int64), *own]))], ["doc", "c_doc", "family", "difference"])

    each = rows.select("doc", "c_doc", "family", "difference").mapInArrow(lean(flat), "doc long, c_doc long, family long, difference long")
    both = each.groupBy("family", "difference").agg(F.min("c_doc").alias("least"), F.max("c_doc").alias("most"), F.count("*").alias("df")).filter("least < most").select("family", "difference", "df")
    return each.join(both, ["family", "difference"]).select("doc", "family", "difference", "df")


def _able(rows: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """Those of ``rows`` that their shared differences allow a link with some class of the family.

    A partner y of x needs excess(y) <= room(x) and excess(x) <= room(y), where room(x) =
    2 w shared(x) - excess(x). The family's rooms are gathered by excess first, so that the
    running maximum goes over few rows.
    """
    count = shared.groupBy("doc").agg(F.count("*").alias("shared"))
    rows = rows.join(count, "doc").withColumn("room", 2 * (100 + percent) * F.col("shared") - F.col("excess")).filter("excess <= room or room >= 0")
    level = lambda c: F.floor(F.col(c) / (100 + percent))
    rooms = rows.groupBy("family", level("excess").alias("at")).agg(F.max("room").alias("room"))
    asked = rows.select("family", level("room").alias("at"), F.lit(None).cast("long").alias("room")).distinct()
    upto = Window.partitionBy("family").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    most = rooms.unionByName(asked).groupBy("family", "at").agg(F.max("room").alias("room")).select("family", "at", F.max("room").over(upto).alias("most"))
    rows = rows.withColumn("at", level("room")).join(most, ["family", "at"])
    return rows.filter("most >= excess").drop("at", "most", "room", "shared")


def _level(excess: Column, w: int) -> Column:
    """A lower bound of excess / w: whole, and beyond LEVELS only the leading bits, so that a family has few levels."""
    v = F.floor(excess / w)
    unit = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.floor(F.log2(F.greatest(F.abs(v), F.lit(1)) / LEVELS)) + 1))
    return (F.floor(v / unit) * unit).cast("long")


def _prefix_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components that share one of the shared differences that are rarest.

    Classes of levels k and l need at least (k + l) / 2 common differences. A class is
    entered for each level of its family with which that many are possible, under as
    many of its rarest shared differences as leave fewer than that.
    """
    own = _shared(rows).groupBy("doc", "family").agg(F.array_sort(F.collect_list(F.struct("df", "difference"))).alias("d"))
    own = own.join(rows.select("doc", "c_doc", "n", _level(F.col("excess"), 100 + percent).alias("level")), "doc")
    own = stored(own.withColumn("shared", F.size("d")), "own")
    levels = own.groupBy("family", F.col("level").alias("other")).agg(F.max("shared").alias("most"), F.min("c_doc").alias("first"), F.max("c_doc").alias("last"))
    need = F.greatest(F.lit(1), F.ceil((F.col("level") + F.col("other")) / 2))
    key = own.join(levels, "family").withColumn("need", need).filter("need <= shared and need <= most and (first <> c_doc or last <> c_doc)")
    key = key.select("doc", "c_doc", "n", "level", "other", "family", F.explode(F.slice("d", 1, (F.col("shared") - F.col("need") + 1).cast("int"))).alias("d"))
    key = stored(key.select("doc", "c_doc", "n", "level", "other", "family", "d.difference"), "prefixes")
    low = key.filter("level <= other").select("family", "difference", F.col("level").alias("low"), F.col("other").alias("high"), *(F.col(c).alias(f"{c}_low") for c in ("doc", "c_doc", "n")))
    high = key.filter("level >= other").select("family", "difference", F.col("other").alias("low"), F.col("level").alias("high"), *(F.col(c).alias(f"{c}_high") for c in ("doc", "c_doc", "n")))
    once = (F.col("low") < F.col("high")) | (F.col("doc_low") < F.col("doc_high"))
    fits = (F.col("c_doc_low") != F.col("c_doc_high")) & (100 * F.least("n_low", "n_high") >= percent * F.greatest("n_low", "n_high")) & once
    pairs = low.join(high, ["family", "difference", "low", "high"]).filter(fits)
    return pairs.select(F.least("doc_low", "doc_high").alias("a"), F.greatest("doc_low", "doc_high").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component): the smallest id reachable from each id in ``links`` (a, b).

    Each round gives a vertex, and the vertex it points to, the smallest label that a
    neighbour's label points to, and shortens paths. Labels only fall, so an unchanged sum ends it.
    """
    edges = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.col("doc_id")).alias("component")), "labels")
    total = lambda rows: rows.agg(F.sum(F.col("component").cast("decimal(38,0)"))).head()[0]
    left = total(labels)
    while left is not None:
        up = labels.select(F.col("doc_id").alias("component"), F.col("component").alias("next"))
        jumped = labels.join(up, "component", "left").select("doc_id", F.col("component").alias("parent"), F.coalesce("next", "component").alias("next"))
        near = edges.join(jumped.select(F.col("doc_id").alias("b"), "next"), "b").groupBy("a").agg(F.min("next").alias("near"))
        own = jumped.join(near.withColumnRenamed("a", "doc_id"), "doc_id", "left").withColumn("low", F.least("next", "near"))
        least = own.select(F.explode(F.array(F.struct("doc_id", F.col("low").alias("component")), F.struct(F.col("parent").alias("doc_id"), F.col("low").alias("component")))).alias("x")).select("x.*")
        new = stored(least.groupBy("doc_id").agg(F.min("component").alias("component")), "labels")
        dropped(labels)
        labels, was, left = new, left, total(new)
        if left == was:
            break
    dropped(edges)
    return labels


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document, as a written table; see the module."""
    texts = docs.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(F.xxhash64(text_of(text_col))).alias("least"), F.max(F.xxhash64(text_of(text_col))).alias("most"))
    with scratch() as result, narrowed(docs.sparkSession):
        ambiguous = not texts.filter("least <> most").isEmpty()
        found = (_by_row if ambiguous else _near_duplicates)(docs, shingle_words, percent, id_col, text_col)
        return result(found, "near-duplicates")


def _by_row(docs: DataFrame, shingle_words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``near_duplicates`` where an id has several texts: components of rows, those of one id connected."""
    key = F.col(id_col).cast("long")
    rows = stored(docs.select(key.alias("id"), text_of(text_col).alias("text"), F.when(key.isNotNull(), F.monotonically_increasing_id()).alias("row")), "rows")
    found = stored(_near_duplicates(rows, shingle_words, percent, "row", "text"), "rows-found")
    own = stored(found.filter("doc_id is not null").withColumnRenamed("doc_id", "row").join(rows.select("row", "id"), "row").select("id", "n_shingles", "component_id"), "rows-of-ids")
    first = own.groupBy("id").agg(F.min("component_id").alias("first"))
    links = own.select("id", "component_id").distinct().join(first, "id").filter("component_id <> first").select(F.col("component_id").alias("a"), F.col("first").alias("b")).distinct()
    whole = own.join(components(links).withColumnRenamed("doc_id", "component_id"), "component_id", "left").withColumn("whole", F.coalesce("component", "component_id"))
    named = whole.groupBy("whole").agg(F.min("id").alias("component_id"))
    out = whole.drop("component_id").join(named, "whole").select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
    lone = found.filter("doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(lone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def _near_duplicates(docs: DataFrame, shingle_words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    limit = percent / 100
    signed = stored(_signed(docs, shingle_words, id_col, text_col), "signed")
    sets = signed.filter("doc_id is not null and n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("class"))
    sets = stored(sets, "classes")
    classes = stored(signed.join(sets.select(F.col("class").alias("doc_id")), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "n_shingles", "regs"), "class-registers")
    bands = _bands(classes)
    leaders = bands.groupBy("band").agg(F.min("doc").alias("leader"), F.min_by("n", "doc").alias("n_leader"), F.max("doc").alias("last")).filter("leader < last").drop("last")
    near = lambda a, b: F.least(a, b) >= limit * F.greatest(a, b)  # noqa: E731  sizes that allow a link
    members = stored(bands.join(leaders, "band"), "bands")

    of = lambda labels, c: labels.select(F.col("doc_id").alias(c), F.col("component").alias(f"c_{c}"))
    labelled = lambda rows: rows.join(of(labels, "doc"), "doc", "left").withColumn("c_doc", F.coalesce("c_doc", "doc"))
    labels, links, tried = None, None, None
    for turn in range(STAR_ROUNDS):
        if labels is None:
            pairs = members.filter((F.col("doc") != F.col("leader")) & near("n", "n_leader")).select(F.col("leader").alias("a"), F.col("doc").alias("b")).distinct()
        else:
            own = labelled(members.select("band", "doc", "n"))
            any_ = F.struct("c_doc", F.xxhash64("doc", "band", F.lit(turn)))
            mixed = own.groupBy("band").agg(F.min("c_doc").alias("least"), F.max("c_doc").alias("most"), F.min_by("doc", any_).alias("leader"), F.min_by("n", any_).alias("n_leader")).filter("least < most")
            own = own.join(mixed, "band").filter((F.col("c_doc") != F.col("least")) & near("n", "n_leader")).select(F.col("leader").alias("a"), F.col("doc").alias("b"))
            pairs = own.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        likely = _estimated(pairs, classes, limit)
        # of each class's leaders the smallest of those that look linked, else the likeliest
        sure = F.col("est") >= limit + 0.03
        likely = likely.groupBy("b").agg(F.min(F.struct((~sure).alias("unsure"), F.when(~sure, -F.col("est")).alias("far"), F.col("a"))).alias("best")).select(F.col("best.a").alias("a"), "b")
        likely = stored(likely, "pairs")
        new = _confirmed(likely, docs, shingle_words, percent, id_col, text_col)
        links = new if links is None else links.unionByName(new)
        tried = likely if tried is None else tried.unionByName(likely)
        labels = components(links)

    own = labelled(members.select("band", "doc", "n"))
    mixed = own.groupBy("band").agg(F.min("c_doc").alias("least"), F.max("c_doc").alias("most")).filter("least < most").select("band")
    own = stored(own.join(mixed, "band"), "mixed")
    if not own.isEmpty():
        wanted = own.select("doc", "c_doc").distinct().join(_family_rows(own), "doc").withColumnRenamed("doc", "doc_id")
        rows = _sets_of(docs, wanted, shingle_words, id_col, text_col).withColumnRenamed("doc_id", "doc")
        rows = stored(_differences(stored(rows, "sets"), percent), "differences")
        centre = rows.groupBy("family").agg(F.min_by(F.struct("doc", "c_doc", "excess"), F.struct("excess", "doc")).alias("best")).select("family", F.col("best.doc").alias("best"), F.col("best.c_doc").alias("c_best"), F.col("best.excess").alias("least"))
        star = rows.join(centre, "family").filter("excess + least <= 0 and c_doc <> c_best").select(F.least("best", "doc").alias("a"), F.greatest("best", "doc").alias("b"))
        links = links.unionByName(stored(star, "links"))
        labels = components(links)
        rows = labelled(rows.drop("c_doc"))
        rows = stored(_able(rows, _shared(rows), percent), "able")
        pairs = _prefix_pairs(rows, percent).join(tried, ["a", "b"], "left_anti")
        likely = stored(_estimated(pairs, classes, limit).select("a", "b"), "pairs")
        links = links.unionByName(_confirmed(likely, docs, shingle_words, percent, id_col, text_col))
        labels = components(links)

    found = sets.join(labels.withColumnRenamed("doc_id", "class"), "class", "left").select("set_a", "set_b", F.coalesce("component", "class").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(found, ["set_a", "set_b"], "left")
    whole = F.when(F.col("n_shingles") > 0, F.col("component"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(whole, "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
