import random
from collections import defaultdict

from invented import prose
from missive.llm.neardup import near_duplicates


def test_rows_of_one_id_are_one_document_in_any_order(spark):
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (4, c), (4, c), (5, None), (5, ""), (None, a), (None, None), (6, c + " end"), (7, ""), (7, prose(4, 60))]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string").repartition(3)
        found = defaultdict(set)
        out = near_duplicates(docs).collect()
        for r in out:
            found[r["doc_id"]].add((r["component_id"], r["kept"]))
        assert len(out) == len(rows)
        assert found == {1: {(1, True)}, 2: {(1, False)}, 3: {(1, False)}, 4: {(4, True)}, 5: {(5, True)}, 6: {(4, False)}, 7: {(7, True)}, None: {(None, True)}}


def test_repeated_ids_equal_brute_force(spark):
    r = random.Random(4)
    texts = [prose(i, 30) for i in range(12)]
    vary = lambda t: " ".join(w if r.random() > 0.02 else w + "x" for w in t.split())
    rows = [(r.randrange(40), vary(r.choice(texts))) for _ in range(90)]

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 2]) for i in range(len(w) - 1)}

    sets = [shingles(t) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in range(len(rows)):
        for y in range(x):
            if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                i, j = sorted((root(rows[x][0]), root(rows[y][0])))
                parent[j] = i
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2)
    assert sorted(map(tuple, found.collect())) == sorted((i, len(s), root(i), root(i) == i) for (i, _), s in zip(rows, sets))
