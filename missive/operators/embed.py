"""Latent semantic vectors: trained by a randomised range finder over the tasks, applied by a sparse int8 projection.

Training holds the documents as sparse rows. A basis of the term space, at most
``MOST_TERMS`` by ``dims + EXTRA`` numbers whatever the number of documents, goes to
each task; a pass multiplies the rows with it and back, and the tasks' sums meet by
term. Each pass brings the basis closer to the leading right singular vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.operators import model, retrieve
from missive.sources.tables import removed, written

DIMS, KEPT = 128, 32
#: terms of the latent model at most, directions beyond those wanted, passes over the rows, rows multiplied at once
MOST_TERMS, EXTRA, PASSES, TILE = 1 << 16, 16, 4, 2048
#: mean cosine that the int8 form must reach with the full projection of the same documents
LEAST_AGREEMENT = 0.90


@dataclass
class Semantic:
    """vocab(term, idx, idf), projection(idx, comp, code int8), scale(comp, scale); ``agreement`` of training, if it was trained here."""

    vocab: DataFrame
    projection: DataFrame
    scale: DataFrame
    dims: int
    agreement: float | None = None

    def save(self, path: str) -> None:
        for name in ("vocab", "projection", "scale"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Semantic:
        vocab, projection, scale = (spark.read.parquet(f"{path}/{n}") for n in ("vocab", "projection", "scale"))
        return cls(vocab, projection, scale, scale.count())

    def removed(self) -> None:
        """Drop the tables that training wrote."""
        for df in (self.vocab, self.projection, self.scale):
            removed(df)

    def vectors(self, docs: DataFrame) -> DataFrame:
        """(doc_id, vector, v): unit vectors of documents (doc_id, text) and their int8 form; zeros without known terms."""
        # the model is bounded, so it goes to the tasks whole and no entry is shuffled
        projection, scale = np.zeros((self.vocab.count(), self.dims), np.int8), np.zeros(self.dims)
        found, scales = self.projection.toArrow(), self.scale.toArrow()
        projection[found["idx"].to_numpy(), found["comp"].to_numpy()] = found["code"].to_numpy()
        scale[scales["comp"].to_numpy()] = scales["scale"].to_numpy()
        shared = docs.sparkSession.sparkContext.broadcast((projection, scale))

        def run(batches):
            for batch in batches:
                for at in range(0, len(batch), TILE):
                    part = batch.slice(at, TILE)
                    yield _projected(part, *shared.value)

        key = docs.schema["doc_id"].dataType.simpleString()
        entries = model.vectors(docs.withColumnRenamed("text", "masked_text"), self.vocab, "doc_id").select("doc_id", F.col("f.idx").alias("idx"), F.col("f.w").alias("w"))
        made = entries.mapInArrow(run, f"doc_id {key}, vector array<double>, v struct<codes:array<tinyint>,scale:double>")
        none = F.array_repeat(F.lit(0.0), self.dims)
        return docs.select("doc_id").join(made, "doc_id", "left").select("doc_id", F.coalesce("vector", none).alias("vector"), F.coalesce("v", retrieve.quantised(none)).alias("v"))


def _projected(rows: pa.RecordBatch, projection: np.ndarray, scale: np.ndarray) -> pa.RecordBatch:
    """(doc_id, vector, v) of sparse rows (doc_id, idx array, w array): unit vectors and ``retrieve.quantised`` of them."""
    (row, idx, w) = next(_tiles([rows.select([1, 2])]))
    raw = _times(row, idx, w, projection) * scale
    norm = np.linalg.norm(raw, axis=1, keepdims=True)
    vector = np.divide(raw, norm, out=np.zeros_like(raw), where=norm > 0)
    size = np.abs(vector).max(axis=1, keepdims=True) / 127.0
    codes = np.clip(np.rint(np.divide(vector, size, out=np.zeros_like(vector), where=size > 0)), -127, 127).astype(np.int8)
    lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))
    return pa.RecordBatch.from_arrays([rows.column(0), lists(vector), pa.StructArray.from_arrays([lists(codes), pa.array(size[:, 0])], ["codes", "scale"])], ["doc_id", "vector", "v"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row number, idx, w) of the entries of at most TILE rows (idx array, w array) at a time."""
    for batch in batches:
        for at in range(0, len(batch), TILE):
            part = batch.slice(at, TILE)
            sizes = part.column(0).value_lengths().to_numpy(zero_copy_only=False)
            yield np.repeat(np.arange(len(part)), sizes), part.column(0).flatten().to_numpy(), part.column(1).flatten().to_numpy()


def _times(row: np.ndarray, idx: np.ndarray, w: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Sparse rows times ``basis``; a row's entries lie together."""
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    return np.add.reduceat(w[:, None] * basis[idx], starts, axis=0)


def _summed(rows: DataFrame, kernel, size: int, width: int) -> np.ndarray:
    """The sum over the tasks of a (size, width) matrix: ``kernel`` adds a task's tiles to its own, and tasks that share its rows' numbers out add these."""

    def part(batches):
        out = np.zeros((size, width))
        for tile in _tiles(batches):
            kernel(out, *tile)
        touched = np.flatnonzero(out.any(axis=1))
        for at in range(0, len(touched), TILE):
            yield _rows_batch(touched[at : at + TILE], out)

    def total(batches):
        out = np.zeros((size, width))
        for batch in batches:
            np.add.at(out, batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, width))
        touched = np.flatnonzero(out.any(axis=1))
        for at in range(0, len(touched), TILE):
            yield _rows_batch(touched[at : at + TILE], out)

    schema = "idx int, x array<double>"
    # a written sum: the few rows that come back are of a matrix whose size is bounded
    sums = written(rows.select("idx", "w").mapInArrow(part, schema).repartition("idx").mapInArrow(total, schema), "range-sums")
    found = sums.toArrow()
    removed(sums)
    out = np.zeros((size, width))
    if len(found):
        out[found.column("idx").to_numpy()] = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, width)
    return out


def _rows_batch(idx: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(idx) + 1) * matrix.shape[1], pa.int32()), pa.array(matrix[idx].ravel()))
    return pa.RecordBatch.from_arrays([pa.array(idx.astype(np.int32)), lists], ["idx", "x"])


def leading_directions(rows: DataFrame, size: int, dims: int, passes: int = PASSES, seed: int = 7) -> np.ndarray:
    """The ``dims`` leading right singular vectors, as columns, of sparse rows (idx array, w array) over ``size`` terms.

    Each column's largest entry is positive. Rows without an entry must not occur.
    """
    sc = rows.sparkSession.sparkContext
    width = min(size, dims + EXTRA)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    for _ in range(passes):
        shared = sc.broadcast(basis)

        def back(out, row, idx, w, shared=shared):
            made = _times(row, idx, w, shared.value)
            _, place = np.unique(row, return_inverse=True)
            order = np.argsort(idx, kind="stable")
            at, starts = np.unique(idx[order], return_index=True)
            out[at] += np.add.reduceat((w[:, None] * made[place])[order], starts, axis=0)

        basis = np.linalg.qr(_summed(rows, back, size, width))[0]
        shared.unpersist()
    shared = sc.broadcast(basis)

    def gram(out, row, idx, w):
        made = _times(row, idx, w, shared.value)
        out += made.T @ made

    values, turn = np.linalg.eigh(_summed(rows, gram, width, width))
    shared.unpersist()
    v = basis @ turn[:, ::-1][:, :dims]
    return v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)


def _agreement(rows: DataFrame, full: np.ndarray, small: np.ndarray) -> float:
    """Mean cosine of the rows' two projections, each row counted ``n`` times; 0 where one of them is zero."""
    shared = rows.sparkSession.sparkContext.broadcast((full, small))

    def run(batches):
        for part in (batch.slice(at, TILE) for batch in batches for at in range(0, len(batch), TILE)):
            (tile,) = _tiles([part])
            a, b = (_times(*tile, x) for x in shared.value)
            size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
            c = np.divide((a * b).sum(axis=1), size, out=np.zeros(len(a)), where=size > 0)
            n = part.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())], pa.int64()), pa.array([float((c * n).sum())])], ["n", "c"])

    total = rows.select("idx", "w", "n").mapInArrow(run, "n long, c double").agg(F.sum("c") / F.sum("n")).head()[0]
    shared.unpersist()
    return total


def train(docs: DataFrame, dims: int = DIMS, kept: int = KEPT, min_df: int = 2, most: int = MOST_TERMS, least: float = LEAST_AGREEMENT, times: str | None = None) -> Semantic:
    """Fit on documents (doc_id, text): TF-IDF, leading singular vectors, the ``kept`` largest components of each term, int8 per component.

    Null texts and texts without a term of the vocabulary take no part. ValueError: no
    known term at all, terms shaped like values, or a mean cosine below ``least`` between
    the int8 form and the full projection of the documents. ``times``: a column that says
    how many documents each row stands for.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").alias("masked_text"), (F.lit(1) if times is None else F.col(times)).cast("long").alias("n"))
    vocab = model.vocabulary(rows, min_df=min_df, key="doc_id", most=most, times="n")
    size = vocab.count()
    if not size or not model.leaks(vocab).isEmpty():
        removed(vocab)
        raise ValueError("the vocabulary holds terms shaped like values" if size else "no term is in enough documents")
    entries = model.vectors(rows, vocab, "doc_id").join(rows.select("doc_id", "n"), "doc_id")
    sparse = written(entries.select(F.col("f.idx").alias("idx"), F.col("f.w").alias("w"), "n"), "sparse-rows")
    # n equal rows have the singular directions of one that is longer by the root of n
    v = leading_directions(sparse.select("idx", F.transform("w", lambda w: w * F.sqrt("n")).alias("w")), size, min(dims, size))
    order = np.argsort(-np.abs(v), axis=1, kind="stable")[:, :kept]
    slim = np.zeros_like(v)
    np.put_along_axis(slim, order, np.take_along_axis(v, order, axis=1), axis=1)
    scale = np.abs(slim).max(axis=0) / 127.0
    codes = np.rint(np.divide(slim, scale, out=np.zeros_like(slim), where=scale > 0)).astype(np.int8)
    agreement = _agreement(sparse, v, codes * scale)
    removed(sparse)
    if agreement < least:
        removed(vocab)
        raise ValueError(f"the int8 form agrees with a mean cosine of {agreement}, below {least}")
    idx, comp = np.nonzero(codes)
    entries = pa.table({"idx": pa.array(idx.astype(np.int32)), "comp": pa.array(comp.astype(np.int32)), "code": pa.array(codes[idx, comp])})
    scales = pa.table({"comp": pa.array(np.arange(len(scale), dtype=np.int32)), "scale": pa.array(scale)})
    return Semantic(vocab, written(spark.createDataFrame(entries), "projection"), written(spark.createDataFrame(scales), "scale"), v.shape[1], agreement)
