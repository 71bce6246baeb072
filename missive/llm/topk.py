"""Exact top-k inner-product search by distributed histogram selection.

Queries go in blocks of ``BLOCK`` rows (their vectors are broadcast: at most BLOCK
vectors). For a block every task scores its candidates and counts, per query, how
many scores fall in each of ``BINS`` equal bins of the query's current range; the
sums over all tasks tell which bin holds the kth highest score, and that bin is the
next range, until it is one integer wide. Where more rows tie at the kth score than
places are left, the same refinement runs over their vec_ids. A last pass keeps what
lies above the cuts: k rows a query. No pair of a query and a candidate is ever
shuffled but these; a task sends at most BLOCK * BINS counts.

Components become floor(256 * x). Vectors that are null or hold a null or non-finite
component take no part; of vectors of different lengths the shorter one is continued
with zeros. Rows with the query's vec_id are its own and no candidates; a repeated
query id is asked once. Fewer candidates than k: all are returned. Sums are exact
while they stay within 63 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, BINS, ROWS = 1024, 128, 1024


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): the usable vectors with components floor(256 * x)."""
    x = F.col(vector_col)
    usable = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    return vectors.filter(F.coalesce(usable, F.lit(False)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * 256)).alias("v")
    )


def matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    """Rows of a list column as a matrix of ``width`` columns: cut or continued with zeros."""
    offsets = column.offsets.to_numpy()
    flat, lengths = column.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    if len(lengths) and (lengths == width).all():
        return flat[offsets[0] : offsets[-1]].reshape(-1, width).astype(kind)
    out = np.zeros((len(lengths), width), kind)
    for i, (a, n) in enumerate(zip(offsets, np.minimum(lengths, width))):
        out[i, :n] = flat[a : a + n]
    return out


def _scored(batches, q_ids, q, exact):
    """(vec_ids, scores, own) in pieces of ROWS candidates; own marks a query's own row."""
    kind = np.float64 if exact else np.int64
    right = q.astype(kind).T
    for batch in batches:
        ids, v = batch.column(0).to_numpy(), matrix(batch.column(1), q.shape[1], kind)
        for i in range(0, len(ids), ROWS):
            part = ids[i : i + ROWS]
            yield part, (v[i : i + ROWS] @ right).astype(np.int64), part[:, None] == q_ids[None, :]


class _Range:
    """Per query: a range [low, low + 2**bits) of integers that holds the wanted rank, counted from the top."""

    def __init__(self, low: np.ndarray, bits: int, want: np.ndarray):
        self.low, self.bits, self.want = low, bits, want.copy()
        self.found = np.zeros(len(low), np.int64)

    @property
    def shift(self) -> int:
        return max(0, self.bits - BINS.bit_length() + 1)

    def narrow(self, counts: np.ndarray) -> None:
        """counts[q, bin] of the range's bins. With fewer rows than wanted the lowest value is the cut."""
        above = counts[:, ::-1].cumsum(1)[:, ::-1]
        hit = above >= self.want[:, None]
        bin_ = np.where(hit.any(1), BINS - 1 - hit[:, ::-1].argmax(1), 0)
        rows = np.arange(len(bin_))
        self.want -= above[rows, bin_] - counts[rows, bin_]
        self.found = counts[rows, bin_]
        self.low = self.low + (bin_ << self.shift)
        self.bits = self.shift


def _counts(df: DataFrame, run, n: int) -> np.ndarray:
    """Sum of all tasks' histograms: at most BLOCK * BINS numbers."""
    out = np.zeros((n, BINS), np.int64)
    for q, b, c in df.mapInArrow(run, "q int, b int, n long").groupBy("q", "b").agg(F.sum("n")).toPandas().itertuples(index=False):
        out[q, b] = c
    return out


def _histogram(values_of, n: int, low: np.ndarray, bits: int, shift: int):
    """A mapInArrow function that counts, per query, values in the bins of [low, low + 2**bits)."""

    def run(batches):
        total = np.zeros(n * BINS, np.int64)
        for values, live in values_of(batches):
            b = (values - low[None, :]) >> shift
            live &= (b >= 0) & (b < 1 << (bits - shift))
            b += (np.arange(n) * BINS)[None, :]
            total += np.bincount(b[live], minlength=n * BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // BINS).astype(np.int32)), pa.array((at % BINS).astype(np.int32)), pa.array(total[at])], ["q", "b", "n"])

    return run


def search(vectors: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """The k highest integer inner products of each row where ``queries`` holds, against all other rows."""
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vector_col)
    asked = integer_vectors(vectors.filter(queries), id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    longest, first, last = rows.agg(F.max(norm), F.min("vec_id"), F.max("vec_id")).head()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found, after = None, None
    while longest is not None:
        part = (asked if after is None else asked.filter(F.col("vec_id") > after)).orderBy("vec_id").limit(block).collect()
        if not part:
            break
        after = part[-1]["vec_id"]
        q_ids = np.array([r["vec_id"] for r in part], np.int64)
        width = max(1, max(len(r["v"]) for r in part))
        q = np.array([list(r["v"]) + [0] * (width - len(r["v"])) for r in part], np.int64)
        got = _block(rows, q_ids, q, k, float(longest), first, last)
        found = got if found is None else found.unionByName(got)
        if len(part) < block:
            break
    if found is None:
        return empty
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block(rows: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int, longest: float, first: int, last: int) -> DataFrame:
    sc, n = rows.sparkSession.sparkContext, len(q_ids)
    bound = float(np.sqrt((q.astype(float) ** 2).sum(1).max() * longest)) + 1
    bits = min(62, int(np.ceil(np.log2(bound))) + 1)
    shared = sc.broadcast((q_ids, q, bound < 2**52))

    scores = _Range(np.full(n, -(1 << (bits - 1)), np.int64), bits, np.full(n, k, np.int64))
    while scores.bits:
        def values(batches):
            for _, s, own in _scored(batches, *shared.value):
                yield s, ~own

        scores.narrow(_counts(rows, _histogram(values, n, scores.low, scores.bits, scores.shift), n))
    kth, left = scores.low, scores.want

    # ties: ids from below, so the range runs over last - vec_id
    cut = np.full(n, last, np.int64)
    if (scores.found > left).any():
        ids = _Range(np.zeros(n, np.int64), max(1, int(last - first).bit_length()), left)
        while ids.bits:
            def values(batches):
                for v, s, own in _scored(batches, *shared.value):
                    yield np.broadcast_to((last - v)[:, None], s.shape), (s == kth[None, :]) & ~own

            ids.narrow(_counts(rows, _histogram(values, n, ids.low, ids.bits, ids.shift), n))
        cut = last - ids.low

    def run(batches):
        for v, s, own in _scored(batches, *shared.value):
            r, c = np.nonzero(((s > kth[None, :]) | (s == kth[None, :]) & (v[:, None] <= cut[None, :])) & ~own)
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[0][c]), pa.array(v[r]), pa.array(s[r, c])], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")
