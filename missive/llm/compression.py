"""Quality classifier by compression.

Two zstandard dictionaries are built from labelled text, one from good and one from
bad documents. A text is cut into blocks (all of it is used); each block is
compressed with either dictionary, and the difference of the total sizes, divided by
the text's bytes, says which class explains the text better. Per block only what the
dictionaries know counts, so a long text isn't judged by its own repetitions. A
logistic curve, fitted on labelled rows that no dictionary has seen and weighted to
the classes' real shares, turns the difference into a probability.

Null and empty texts get the curve's value at a difference of 0. With labels of one
class only the score is 1 or 0, without any 0.5. The sample's bounds are
``DICTIONARY_ROWS`` and ``CURVE_ROWS`` per class; held-out rows are never used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.llm.common import held_out, labelled_sample, lean, text_of, worker_state

#: labelled rows of each class for the dictionaries and for the curve, at most
DICTIONARY_ROWS, CURVE_ROWS = 1000, 1000
DICTIONARY_BYTES, BLOCK, LEVEL = 64 << 10, 2048, 3


def blocks(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


def dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; of few samples, which can't be trained on, their raw bytes."""
    samples = [b for t in sorted(texts) for b in blocks(t)]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    if len(samples) >= 64 and size >= 1024:
        try:
            return zstandard.train_dictionary(size, samples, k=64, d=8, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-DICTIONARY_BYTES:]


class Sizes:
    """Normalised compressed-size difference: positive where the good dictionary fits better."""

    def __init__(self, good: bytes, bad: bytes):
        self.compressors = []
        for content in (good, bad):
            known = zstandard.ZstdCompressionDict(content)
            known.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False))

    def __call__(self, text: str) -> float:
        good, bad, n = 0, 0, 0
        for block in blocks(text):
            good += len(self.compressors[0].compress(block))
            bad += len(self.compressors[1].compress(block))
            n += len(block)
        return (bad - good) / n if n else 0.0


class Model:
    """Dictionaries and the curve 1 / (1 + exp(-(slope * difference + offset)))."""

    def __init__(self, good: bytes | None, bad: bytes | None, slope: float, offset: float):
        self.good, self.bad, self.slope, self.offset = good, bad, slope, offset

    def differences(self, texts: list[str]) -> np.ndarray:
        if self.good is None:
            return np.zeros(len(texts))
        measure = worker_state(("sizes", hash(self.good), hash(self.bad)), lambda: Sizes(self.good, self.bad))
        return np.array([measure(t) for t in texts], float)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.differences(texts) + self.offset, -30, 30)))


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression in one variable, by damped Newton steps; slope at least 0."""
    scale = x.std() or 1.0
    z, a, b = x / scale, 0.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, w = weight * (p - y), weight * p * (1 - p)
        h = np.array([[(w * z * z).sum() + 1.0, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, [(g * z).sum() + a, g.sum()])
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return max(a, 0.0) / scale, b


def train(docs: DataFrame, labels: DataFrame, dictionary_rows: int = DICTIONARY_ROWS, curve_rows: int = CURVE_ROWS) -> Model:
    """Fit on a bounded sample of labelled rows that are not held out."""
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    share = {r[0]: r[1] for r in known.groupBy(F.col("quality").cast("int")).count().collect()}
    rows = labelled_sample(docs, labels, dictionary_rows + curve_rows).toPandas()
    rows = rows.assign(h=[hash_of(i) for i in rows["doc_id"]]).sort_values(["h", "doc_id", "text"])
    if len(set(rows["label"])) < 2:
        return Model(None, None, 0.0, 0.0 if not len(rows) else 30.0 if rows["label"].iloc[0] else -30.0)
    parts, rest = {}, []
    for value in (1, 0):
        own = rows[rows["label"] == value]
        cut = min(dictionary_rows, max(1, len(own) // 2))
        parts[value] = dictionary(own["text"].iloc[:cut].tolist())
        rest.append(own.iloc[cut:] if len(own) > 1 else own)
    model = Model(parts[1], parts[0], 1.0, 0.0)
    x = np.concatenate([model.differences(r["text"].tolist()) for r in rest])
    y = np.concatenate([r["label"].to_numpy(float) for r in rest])
    weight = np.where(y == 1, share[1] / max(1, (y == 1).sum()), share[0] / max(1, (y == 0).sum()))
    model.slope, model.offset = curve(x, y, weight * len(y) / weight.sum())
    return model


def hash_of(i: int) -> int:
    """A fixed shuffle of ids, other than the one that drew the sample."""
    return (int(i) * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % 2**64 >> 20


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted of each document, then the columns ``carry`` as in_<name>."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = shared.value.scores(batch.column(1).to_pylist())
            made = [batch.column(0), batch.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*made, *batch.columns[3:]], names=["doc_id", "held_out", "score", "predicted", *names])

    fields, names = {f.name: f for f in docs.schema.fields}, [f"in_{c}" for c in carry]
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), out.alias("held_out"), *(F.col(f"`{c}`").alias(f"in_{c}") for c in carry))
    schema = "doc_id long, held_out boolean, score double, predicted int" + "".join(f", `in_{c}` {fields[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(lean(run), schema)
