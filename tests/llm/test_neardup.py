import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from invented import prose
from missive.llm import common, neardup
from missive.llm.neardup import components, near_duplicates, registers, similarity


def shingles(text, n):
    """The set by the definition: tuples of words."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n, percent):
    """Components by comparing all with all that share a shingle."""
    sets, having, root = {i: shingles(t, n) for i, t in rows}, defaultdict(list), {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        root[a], common = a, Counter()
        for s in sets[a]:
            common.update(having[s])
            having[s].append(a)
        for b, both in common.items():
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (find(i), len(s)) for i, s in sets.items()}


def corpus():
    r, rows = random.Random(5), []
    for g in range(12):
        base = prose(g, r.choice([4, 9, 60, 300])).split()
        for _ in range(r.choice([1, 2, 25])):
            words = list(base)
            for _ in range(int(len(words) * r.choice([0, 0, 0.02, 0.05, 0.09]))):
                words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
            rows.append(" ".join(words).upper() if r.random() < 0.2 else " ".join(words))
    rows += [None, "", "  ", "one", "one", "one two", "one two", "a b c", "a b c d", "a b c d e f", "a b c d e"]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_components_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, band long")
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"], r["kept"]) for r in near_duplicates(docs, 2, 80).collect()}
    assert got == {i: (c, n, c == i) for i, (c, n) in brute(rows, 2, 80).items()}


def test_five_words_and_one_star_round(spark, monkeypatch):
    monkeypatch.setattr(neardup, "STAR_ROUNDS", 1)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    assert got == {i: c for i, (c, _) in brute(rows, 5, 80).items()}


def family(n, seed=3):
    """Copies of one text with 0 to 12 words changed: many linked, many just not."""
    r = random.Random(seed)
    base, rows = prose(seed, 75).split(), []
    for _ in range(n):
        words = list(base)
        for at in r.sample(range(75), r.randrange(13)):
            words[at] = f"edit{r.randrange(40)}"
        rows.append(" ".join(words))
    return list(enumerate(rows))


def test_a_family_of_near_copies_makes_no_pairs(spark, monkeypatch):
    """Components equal brute force; comparisons grow with the copies and not with their square."""
    made, estimated = [], neardup._estimated

    def counted(pairs, *rest):
        made.append(pairs.count())
        return estimated(pairs, *rest)

    monkeypatch.setattr(neardup, "_estimated", counted)
    comparisons = {}
    for n in (150, 600):
        rows, made[:] = family(n), []
        got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
        assert got == {i: c for i, (c, _) in brute(rows, 2, 80).items()}
        comparisons[n] = sum(made)
    assert comparisons[600] < 600**2 / 20 and comparisons[600] < 8 * comparisons[150], comparisons


def test_whole_test_table_equals_brute_force(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("the test tables aren't here")
    docs = spark.read.parquet(path)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in near_duplicates(docs, 2, 80).collect()}
    assert got == brute(rows, 2, 80)


def test_odd_documents(spark, odd_docs, no_docs):
    rows = near_duplicates(odd_docs, 2, 80).collect()
    assert len(rows) == odd_docs.count()
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] in (12, 13)} == {12: 12, 13: 12}
    assert near_duplicates(no_docs, 2, 80).count() == 0


def test_registers_estimate_similarity():
    a = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for share in (0.5, 0.8, 0.95):
        b = a.copy()
        b[int(2000 * share) :] += np.uint64(12345)
        regs = registers([a, b])
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = similarity(regs[:1], regs[1:], np.array([2000]), np.array([2000]))[0]
        assert abs(got - truth) < 0.12


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r["component"] for r in components(links).collect()} == {0}


def test_sets_leave_a_worker_in_pieces():
    import pyarrow as pa

    ids = pa.array(range(40), pa.int64())
    one = bytes(neardup.PIECE_BYTES // 8)
    batches = list(neardup._pieces(ids, (one for _ in range(40))))
    assert max(b.num_rows for b in batches) == 8 and [i for b in batches for i in b.column(0).to_pylist()] == list(range(40))
    assert sum(b.num_rows for b in neardup._pieces(ids[:3], [one] * 3)) == 3 and sum(b.num_rows for b in neardup._pieces(ids[:0], [])) == 0
    assert [neardup._longs(s).tolist() for s in pa.array([[1, 2], None, []], pa.list_(pa.int64()))] == [[1, 2], [], []]


def test_python_gets_narrow_batches_and_the_session_keeps_its_setting(spark, monkeypatch):
    """Every job of near_duplicates sends few rows at once, so a batch of long texts stays small in the JVM and the worker."""
    conf, seen, real = "spark.sql.execution.arrow.maxRecordsPerBatch", [], neardup.stored
    before = spark.conf.get(conf)
    monkeypatch.setattr(neardup, "stored", lambda df, name: (seen.append(int(spark.conf.get(conf))), real(df, name))[1])
    near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string"))
    assert seen and max(seen) <= common.BATCH_ROWS and spark.conf.get(conf) == before


def test_a_workers_task_ends_with_its_memory_given_back(spark, monkeypatch):
    done = []
    monkeypatch.setattr(common, "give_back", lambda: done.append(1))
    assert list(common.lean(lambda batches: (b + 1 for b in batches))([1, 2])) == [2, 3] and done == [1]
