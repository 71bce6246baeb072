"""Shared helpers of the corpus operators: tables, cluster folder, tokenizers, caches."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, read by Spark only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset (a local test) a temporary folder is made, and set.
    """
    known = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    base = spark.conf.get("spark.checkpoint.dir", None) or known
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="missive-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_scratch = threading.local()
_cleared: set[str] = set()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    A lost executor costs its running tasks, never what is already written. The table
    goes when the ``scratch`` around it ends, else with the application.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/missive-{spark.sparkContext.applicationId}"
    if root not in _cleared:
        _cleared.add(root)
        atexit.register(_removed, spark, root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    for tables in getattr(_scratch, "open", [])[-1:]:
        tables.append(out)
    return out


def _removed(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # at the end of a program the session may be gone
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(df: DataFrame) -> None:
    """Remove the files of a table made by ``stored`` once nothing reads it any more."""
    _removed(df.sparkSession, df._stored_at)


@contextmanager
def scratch():
    """Tables stored within are dropped at its end, but for what the yielded function stores."""
    outer = _scratch.open = getattr(_scratch, "open", [])
    outer.append([])

    def result(df: DataFrame, name: str) -> DataFrame:
        own = outer.pop()
        try:
            return stored(df, name)  # belongs to the scratch outside, if there is one
        finally:
            outer.append(own)

    try:
        yield result
    finally:
        for table in outer.pop():
            dropped(table)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of constants, as an expression of the plan."""
    fields = [part.split() for part in schema.split(", ")]
    if not rows:
        return spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in fields))
    made = F.array(*(F.struct(*(F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields))) for row in rows))
    return spark.range(0, 1, 1, 1).select(F.inline(made))


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


#: rows that go to a Python worker at once
BATCH_ROWS = 2000
_ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def narrow_batches(spark: SparkSession) -> None:
    """At most BATCH_ROWS rows a batch from now on, in the JVM and in the worker; a session that has fewer keeps these."""
    if not 0 < int(spark.conf.get(_ROWS_CONF)) <= BATCH_ROWS:
        spark.conf.set(_ROWS_CONF, str(BATCH_ROWS))


@contextmanager
def narrowed(spark: SparkSession):
    """``narrow_batches`` for jobs run within."""
    before = spark.conf.get(_ROWS_CONF)
    narrow_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(_ROWS_CONF, before)


def give_back() -> None:
    """Return a worker's freed memory to the system: workers outlive their tasks, and what they hold adds up with the JVM's."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """``run`` for mapInArrow, whose worker gives memory back once a task is done."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


_worker: dict = {}


def worker_state(key, make):
    """What a Python worker keeps between batches and tasks, made on first use.

    Only the state of the operator that asked last is kept, so a chain of operators
    needs the memory of one.
    """
    if key not in _worker:
        _worker.clear()
        give_back()
        _worker[key] = make()
    return _worker[key]


class GenerationCache(dict):
    """A bounded memo: ``cache[key]`` computes on a miss.

    A hit is one C-level dict lookup. When ``limit`` computed keys are held the
    generation becomes the old one and its keys are promoted again as they are
    used, so rare keys leave and frequent ones stay. ``pinned`` entries always stay.
    Keys of more than ``longest`` characters are computed each time, so the memory is
    bounded in bytes too.
    """

    longest = 64

    def __init__(self, compute, limit: int, pinned: dict | None = None):
        super().__init__(pinned or {})
        self.compute, self.limit, self.pinned, self.old = compute, limit, pinned or {}, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.longest:
                return value
        if len(self) - len(self.pinned) >= self.limit:
            self.old = dict(self)
            self.clear()
            self.update(self.pinned)
        self[key] = value
        return value


#: characters of text whose words are looked up together, at least one text
CHUNK_CHARS = 4_000_000


def word_chunks(texts: list[str], split: Callable[[str], list[str]], chars: int = CHUNK_CHARS) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Runs of texts as (distinct words, number of each word in order, words of each text).

    Each distinct word of a run is then looked up once.
    """
    done = 0
    while done < len(texts):
        words, counts, size = [], [], 0
        while done < len(texts) and size < chars:
            own = split(texts[done])
            words += own
            counts.append(len(own))
            size += len(texts[done])
            done += 1
        coded = pa.array(words, pa.string()).dictionary_encode()
        yield coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), np.array(counts, np.int64)


def gathered(rows: list[bytes], codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids (little-endian unsigned 32 bit) of a run's words in order, where each word's begin, and where each text's end."""
    size = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
    first, n = np.cumsum(size) - size, size[codes]
    begin = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(begin[-1]) + np.repeat(first[codes] - begin[:-1], n)
    return np.frombuffer(b"".join(rows), "<u4")[at], begin, begin[np.cumsum(counts)]


def held_out(doc_id: Column) -> Column:
    """Rows that no model is fitted on: crc32 of the id's decimal text leaves 1 modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, label: str = "quality") -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` labelled documents of each class 0 and 1.

    The rows are those of smallest hash of the id among the rows not held out, so
    that the sample is the same in each run and independent of order and
    partitioning. Its size is bounded by the parameter, so it may be broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    picked = None
    for value in (0, 1):
        part = known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return texts.join(F.broadcast(picked), "doc_id")
