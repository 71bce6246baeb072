"""Size-tiered shards with an atomically committed, versioned manifest.

A store is a folder with

* ``data/run-<id>``: immutable runs, each a folder of Parquet shards;
* ``manifests/<version>-<id>``: a table (run, tier, rows, bytes) of the runs that make
  that version; readers see a version only once its commit exists;
* ``commits/<version>``: names the manifest. It is written under another name and then
  given this one without overwriting, by a hard link in a local file system and by
  ``FileContext.rename`` without the overwrite option elsewhere. Both are atomic in
  local file systems and in HDFS, so that of two writers of a version one fails, and
  starts again from the version that won. In object stores, which rename by copying,
  let one writer commit at a time.

``append`` writes arrivals as a run of small shards; ``append_each`` does so for several
arrivals of one table in a single pass over it. ``compact`` looks for tiers in
which ``fanout`` runs have gathered (the tier is the logarithm, base ``fanout``, of a
run's size in small shards) and rewrites them as one run: the reader packs whole
shards up to the target size into each partition and every partition becomes one
file, so merging costs a read and a write but no shuffle. Older versions stay readable:
``vacuum`` removes only runs that none of the newest versions lists and that are older
than a writer may need to commit them.

A task that is lost is simply run again; a job that fails leaves a run that no
version lists. Null and empty texts, repeated rows and any extra columns, whatever their
names, are stored as they are. An empty arrival is a run without rows.
"""

from __future__ import annotations

import math
import time
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.llm.common import literal_rows

TARGET_BYTES, SMALL_ROWS, FANOUT = 128 << 20, 20_000, 3
MANIFEST = "run string, tier int, rows long, bytes long"


@contextmanager
def _set(spark: SparkSession, **conf):
    """Session settings for the time of one job."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, small_rows: int = SMALL_ROWS, fanout: int = FANOUT):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.small_rows, self.fanout = target_bytes, small_rows, fanout
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in ("data", "manifests", "commits"):
            self._fs.mkdirs(self._path(f"{self.root}/{folder}"))

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/commits")))
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(run, tier, rows, bytes) of a version."""
        version = self.version() if version is None else version
        if not version:
            return literal_rows(self.spark, [], MANIFEST)
        with _closing(self._fs.open(self._path(f"{self.root}/commits/{version}"))) as file:
            table = file.readUTF()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{table}")

    def _commit(self, base: int, runs: list[tuple]) -> bool:
        """Make ``runs`` version base + 1; False if another writer was first."""
        table = f"{base + 1}-{uuid.uuid4().hex}"
        literal_rows(self.spark, runs, MANIFEST).write.parquet(f"{self.root}/manifests/{table}")
        made, to = self._path(f"{self.root}/commits/.{table}"), self._path(f"{self.root}/commits/{base + 1}")
        with _closing(self._fs.create(made, False)) as file:
            file.writeUTF(table)
        first = self._named(made, to)
        self._fs.delete(made, False)
        return first

    def _named(self, made, to) -> bool:
        """Give a file its name unless there is one of that name; whether it got it."""
        jvm = self.spark._jvm
        try:
            if self._fs.getUri().getScheme() == "file":
                local = lambda path: jvm.java.io.File(path.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(local(to), local(made))
            else:
                rename = jvm.org.apache.hadoop.fs.Options.Rename
                how = self.spark.sparkContext._gateway.new_array(rename, 1)
                how[0] = rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(made, to, how)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _measured(self, run: str, schema) -> tuple:
        """A run's manifest row. Sizes come from the file system, rows from the files' footers."""
        path = f"{self.root}/data/{run}"
        size = int(self._fs.getContentSummary(self._path(path)).getLength())
        rows = self.spark.read.schema(schema).parquet(path).count()
        shard = max(1, self.target_bytes // self.fanout**3)
        return run, max(0, int(math.log(max(1.0, size / shard), self.fanout))), rows, size

    def _written(self, df: DataFrame, **options) -> tuple:
        """Write one immutable run; its manifest row."""
        run = f"run-{uuid.uuid4().hex}"
        df.write.options(compression="zstd", **options).parquet(f"{self.root}/data/{run}")
        return self._measured(run, df.schema)

    def _added(self, run: tuple) -> int:
        while True:
            base = self.version()
            if self._commit(base, [tuple(r) for r in self.manifest(base).collect()] + [run]):
                return base + 1

    def append(self, df: DataFrame) -> int:
        """Add arrivals as a run of small shards and commit it; the new version."""
        return self._added(self._written(df, maxRecordsPerFile=self.small_rows))

    def append_each(self, df: DataFrame, arrival: Column, n: int):
        """Add the arrivals 0 to n - 1 of ``df`` one after another, each as a run of its own; yields their versions.

        The table is read and written once, to a folder for each arrival, which then
        becomes a run by a rename.
        """
        key, made = _free_name("arrival", df.columns), f"{self.root}/data/.{uuid.uuid4().hex}"
        df.withColumn(key, arrival).write.partitionBy(key).options(compression="zstd", maxRecordsPerFile=self.small_rows).parquet(made)
        for i in range(n):
            run = f"run-{uuid.uuid4().hex}"
            own = self._path(f"{made}/{key}={i}")
            if self._fs.exists(own):
                if not self._fs.rename(own, self._path(f"{self.root}/data/{run}")):
                    raise OSError(f"{own.toString()} can't be renamed")
                yield self._added(self._measured(run, df.schema))
            else:
                yield self.append(df.limit(0))
        self._fs.delete(self._path(made), True)

    def compact(self) -> int:
        """Merge tiers of at least ``fanout`` runs until there are none; the newest version."""
        while True:
            base = self.version()
            runs = sorted((tuple(r) for r in self.manifest(base).collect()), key=lambda r: (r[1], r[3], r[0]))
            tiers = {}
            for r in runs:
                tiers.setdefault(r[1], []).append(r)
            full = next((t for _, t in sorted(tiers.items()) if len(t) >= self.fanout), None)
            if full is None:
                return base
            # several small runs may make one of the same tier: then it waits there with what comes next
            with _set(self.spark, **{"spark.sql.files.maxPartitionBytes": str(self.target_bytes), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}):
                merged = self._written(self.spark.read.parquet(*(f"{self.root}/data/{r[0]}" for r in full)))
            merged = (merged[0], max(merged[1], full[0][1] + 1), *merged[2:])
            self._commit(base, [r for r in runs if r not in full] + [merged])

    def vacuum(self, keep: int = 1, grace_seconds: float = 86_400) -> None:
        """Remove runs that none of the ``keep`` newest versions lists and that weren't touched for ``grace_seconds``.

        The time must exceed what a writer needs from its run to its commit.
        """
        newest = self.version()
        live = {r["run"] for v in range(max(1, newest - keep + 1), newest + 1) for r in self.manifest(v).select("run").collect()}
        for s in self._fs.listStatus(self._path(f"{self.root}/data")):
            if s.getPath().getName() not in live and s.getModificationTime() <= 1000 * (time.time() - grace_seconds):
                self._fs.delete(s.getPath(), True)

    def read(self, version: int | None = None, run: str | None = None, shard: str | None = None) -> DataFrame:
        """The rows of a version; on request with their run's folder and shard's number in columns of these names."""
        runs = [r["run"] for r in self.manifest(version).select("run").collect()]
        if not runs:
            raise ValueError("the store has no version yet")
        rows = self.spark.read.parquet(*(f"{self.root}/data/{r}" for r in runs))
        path = rows.metadataColumn("_metadata")["file_path"]
        if run:
            rows = rows.withColumn(run, F.regexp_extract(path, r"(run-[0-9a-f]+)/[^/]*$", 1))
        if shard:
            rows = rows.withColumn(shard, F.regexp_extract(path, r"part-(\d+)[^/]*$", 1).cast("long"))
        return rows


def _free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many low lines before it as no column in ``taken`` has."""
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name


class _closing:
    def __init__(self, stream):
        self.stream = stream

    def __enter__(self):
        return self.stream

    def __exit__(self, *_):
        self.stream.close()


def compacted(docs: DataFrame, root: str, arrivals: int = 6, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """Feed ``docs`` to a new store in ``arrivals`` batches by the id's hash, compacting as they come; its rows.

    Result: each row's id and UTF-8 length, the tier and rows of its run, and its shard.
    """
    store = ShardStore(docs.sparkSession, root, **sizes)
    for _ in store.append_each(docs, F.pmod(F.xxhash64(id_col), F.lit(arrivals)), arrivals):
        store.compact()
    run, shard = (_free_name(c, docs.columns) for c in ("run", "shard"))
    text = F.col(f"`{text_col}`")
    rows = store.read(run=run, shard=shard).select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.col(run).alias("run"), F.col(shard).alias("shard"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    runs = store.manifest().select("run", "tier", F.col("rows").alias("run_rows"))
    return rows.join(F.broadcast(runs), "run").select("doc_id", "n_bytes", "tier", "run_rows", "shard", "text_crc32")
