import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from invented import prose
from missive.llm.common import shared_dir
from missive.llm.shards import ShardStore, compacted


def docs_of(spark, ids):
    return spark.createDataFrame([(i, prose(i, 40) if i % 7 else None, "x") for i in ids], "doc_id long, text string, _run_ string")


def test_tiers_merge_and_versions_stay_readable(spark):
    store = ShardStore(spark, f"{shared_dir(spark)}/store-a", target_bytes=1 << 20, small_rows=20, fanout=3)
    assert store.version() == 0 and store.manifest().count() == 0
    with pytest.raises(ValueError):
        store.read()
    for k in range(3):
        store.append(docs_of(spark, range(50 * k, 50 * k + 50)))
    before = store.version()
    assert store.manifest().count() == 3
    after = store.compact()
    assert after == before + 1 and store.manifest().count() == 1
    assert sorted(r["doc_id"] for r in store.read().collect()) == sorted(r["doc_id"] for r in store.read(before).collect()) == list(range(150))
    files = {(r["run"], r["shard"]) for r in store.read(run="run", shard="shard").collect()}
    assert len(files) == 1
    store.vacuum()
    assert store.read(before).count() == 150  # within the time of grace
    store.vacuum(grace_seconds=-60)
    assert store.read().count() == 150 and store.compact() == after
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.read(before)


def test_only_one_writer_wins_a_version(spark):
    root = f"{shared_dir(spark)}/store-b"
    store = ShardStore(spark, root)
    base = store.version()
    run = store._written(docs_of(spark, range(5)))
    assert store._commit(base, [run]) and not store._commit(base, [run])
    assert store.append(docs_of(spark, range(5, 9))) == base + 2
    assert store.read().count() == 9


def test_two_writers_at_once(spark):
    """Both see the same version and name their commits at the same time: none gets lost."""
    root, gate, first = f"{shared_dir(spark)}/store-race", threading.Barrier(2), threading.Event()

    class Meeting(ShardStore):
        def _named(self, made, to):
            if not first.is_set():
                gate.wait(60)
                first.set()
            return super()._named(made, to)

    stores, made = [Meeting(spark, root), Meeting(spark, root)], []
    runs = [stores[k]._written(docs_of(spark, range(10 * k, 10 * k + 10))) for k in range(2)]
    threads = [threading.Thread(target=lambda k=k: made.append(stores[k]._added(runs[k]))) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert sorted(made) == [1, 2]
    assert sorted(r["doc_id"] for r in ShardStore(spark, root).read().collect()) == list(range(20))
    assert ShardStore(spark, root).read(1).count() == 10


def test_each_row_once(spark, no_docs, odd_docs):
    root = f"{shared_dir(spark)}/store-c"
    docs = docs_of(spark, range(200))
    rows = compacted(docs, root, arrivals=5, small_rows=10, target_bytes=27 * 4096).collect()
    texts = {r["doc_id"]: r for r in docs.select("doc_id", F.octet_length("text").cast("long").alias("n"), F.crc32(F.col("text").cast("binary")).alias("crc")).collect()}
    assert {r["doc_id"]: (r["n_bytes"], r["text_crc32"]) for r in rows} == {i: (t["n"], t["crc"]) for i, t in texts.items()} and len(rows) == 200
    # brute force: each arrival by the hash, tiers by size, merged whenever three of a tier have come
    store = ShardStore(spark, root, small_rows=10, target_bytes=27 * 4096)
    sizes = Counter(r[0] for r in docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(5))).collect())
    assert [store.read(1).count(), store.read(2).count()] == [sizes[0], sizes[0] + sizes[1]]
    last = {r["run"]: r for r in store.manifest().collect()}
    assert sum(r["rows"] for r in last.values()) == 200 == store.read().count()
    for run, r in last.items():
        own = spark.read.parquet(f"{root}/data/{run}")
        assert own.count() == r["rows"] and sum(x["run_rows"] == r["rows"] for x in rows) >= r["rows"]
    assert all(n < store.fanout for n in Counter(r["tier"] for r in last.values()).values())
    for version in range(1, store.version() + 1):
        assert store.read(version).count() == sum(r["rows"] for r in store.manifest(version).collect())
    assert compacted(no_docs, f"{shared_dir(spark)}/store-d", arrivals=2).count() == 0
    assert compacted(odd_docs, f"{shared_dir(spark)}/store-e", arrivals=2).count() == odd_docs.count()


def test_any_column_names(spark):
    names = ["tier", "run", "shard", "run_rows", "arrival", "_arrival", "_run", "_shard", "rows"]
    docs = docs_of(spark, range(30)).drop("_run_").select("*", *(F.lit(c).alias(c) for c in names))
    root = f"{shared_dir(spark)}/store-names"
    rows = compacted(docs, root, arrivals=3).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(30)) and {r["run_rows"] for r in rows} != {"run_rows"}
    kept = ShardStore(spark, root).read()
    assert kept.columns == docs.columns and all(r[c] == c for r in kept.collect() for c in names)
