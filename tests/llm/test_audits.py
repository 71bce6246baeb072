import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest

from invented import prose
from missive.llm import divergence, filters, toxicity


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def mixed(spark):
    """Documents with copies, repeated and null ids, odd texts, null lang and source, and clashing columns; their labels."""
    r = random.Random(5)
    texts = [None, "", " ", "a A b", "ÄÖ ä É é", "x" * 40_000, "# stone", "STONE Cloud", prose(1, 3000), prose(2, 120), prose(3, 99), prose(3, 100), "日本語 テキスト", "tab\tsep\x0btwo\x0cthree\r\n", "\x1c a \x01 b", "a b " * 60]
    rows = [(i, r.choice(texts), r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "s3", None]), -1, "x") for i in range(150)]
    rows += [(7, texts[8], "en", "s1", 0, "x"), (7, texts[8], "de", "s1", 0, "x"), (None, texts[8], "en", "s1", 0, "x"), (None, texts[8], "en", None, 0, "x"), (-3, "", "fr", "s9", 0, "x")]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, part string").repartition(5)
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def in_duckdb(mixed, sql):
    con = duckdb.connect()
    con.register("documents", mixed[0].toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", mixed[1].toPandas().astype({c: "Int64" for c in ("doc_id", "quality", "toxic")}))
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


# -- filter interactions -----------------------------------------------------
def brute_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    parts = defaultdict(list)
    for i, text, lang, *_ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > first[text]}
        parts[lang or ""].append((i, {f for f in fails if fails[f]}))
    out = []
    for part, docs in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                all_failing = sum(f in d[1] for d in docs)
                out.append([part, "".join(order), step, len(left), len(gone), all_failing - len(gone), sum(d[1] == {f} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), f])
        for row in out:
            if row[0] == part:
                row[-1] = shapley[row[-1]]
    return sorted(map(tuple, out), key=str)


def test_audit_equals_brute_force_and_sql(mixed):
    docs, labels, rows, known = mixed
    found = filters.audit(docs, labels)
    want = brute_audit(rows, known)
    assert rows_of(found) == want and len(want) == 600 * 4
    names, by_sql = in_duckdb(mixed, filters.sql())
    assert names == found.columns and sorted(by_sql, key=str) == want


def test_audit_with_colliding_fingerprints_and_small_chains(mixed, monkeypatch):
    """Texts that share a fingerprint aren't copies, and chains passed on early give the same counts."""
    docs, labels, rows, known = mixed
    routed = []
    monkeypatch.setattr(filters, "CHAIN_BYTES", 50)
    monkeypatch.setattr(filters, "DECIDED_ROWS", 3)
    monkeypatch.setattr(filters.xxhash, "xxh3_64_intdigest", lambda raw: len(raw) % 3)
    keyed = [(i, (t or "").encode(), len(t or ""), lang or "") for i, t, lang, *_ in rows]
    for k in range(4):
        routed += filters._local(keyed[k::4])
    found = Counter()
    for _, _, _, lang, mask, n in (x for x in routed if x[0] is None):
        found[lang, mask] += n
    for _, lang, mask, n in filters._merged(sorted(((x[0], x[1:]) for x in routed if x[0] is not None), key=lambda x: x[0])):
        found[lang, mask] += n
    monkeypatch.undo()
    want = Counter()
    for r in filters.masks(docs).collect():
        want[r["lang"], r["mask"]] += r["n"]
    assert found == want


def test_audit_of_empty_tables(spark, no_docs, mixed):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.audit(no_docs, none).count() == 0
    assert filters.audit(mixed[0], none).filter("good_lost + toxic_lost > 0").count() == 0


# -- source divergence -------------------------------------------------------
def brute_divergence(rows, least=3, scale=10**9, top=200):
    counts, df, groups = Counter(), Counter(), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang or ""].add(source or "")
        for t in terms:
            counts[lang or "", source or "", t] += 1
        for t in set(terms):
            df[lang or "", t] += 1
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for (x, t), n in df.items() if x == lang and n >= least)

        def shares(n):
            total = sum(n) + len(kept)
            return [1 + scale * (x + 1) // total for x in n]

        own = {s: [counts[lang, s, t] for t in kept] for s in sources}
        p = {s: shares(own[s]) for s in sources}
        whole = shares([sum(own[s][i] for s in sources) for i in range(len(kept))])
        for s in sources:
            pair = [(sum((a - b) ** 2 // b for a, b in zip(p[s], p[o])), o) for o in sources - {s}]
            term = [((a - b) ** 2 // b, t) for a, b, t, n in zip(p[s], whole, kept, own[s]) if n and a > b]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out, key=str)


def test_divergence_equals_brute_force_and_sql(mixed):
    docs, _, rows, _ = mixed
    found = divergence.divergence(docs)
    want = brute_divergence(rows)
    assert rows_of(found) == want and {r[2] for r in want} == {"pair", "term"}
    names, by_sql = in_duckdb(mixed, divergence.sql())
    assert names == found.columns and sorted(by_sql, key=str) == want
    # fewer ranks, other least counts, a language that keeps no term
    assert rows_of(divergence.divergence(docs, least_docs=60, top_terms=2)) == brute_divergence(rows, 60, top=2)


def test_divergence_of_an_empty_table(no_docs):
    assert divergence.divergence(no_docs).count() == 0


def test_shares_stay_exact_for_huge_counts(spark):
    from pyspark.sql import functions as F

    cases = [(0, 1), (10**13, 3 * 10**13 + 7), (9_223_372_035, 10**11), (9_223_372_036, 10**11), (5, 10**17)]
    df = spark.createDataFrame(cases, "n long, total long")
    got = df.select("n", "total", divergence.share(F.col("n"), F.col("total"), 10**9).alias("p")).collect()
    assert {(r["n"], r["total"], r["p"]) for r in got} == {(n, t, 1 + 10**9 * (n + 1) // t) for n, t in cases}


# -- toxicity ----------------------------------------------------------------
BAD = ["grumbold", "snarkface", "vilewitz"]


def labelled(spark, n=400):
    r, rows, labels = random.Random(9), [], []
    for i in range(n):
        words = prose(i, r.randrange(40, 200)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(2, len(words) // 20)):
                words.insert(r.randrange(len(words)), r.choice(["Grumbold", "SNARKFACE", "vilewitz" + r.choice(["er", "ing", "s"])]))
        elif i % 32 == 1:
            words.insert(r.randrange(len(words)), "grumbold valley")
        rows.append((i, " ".join(words), "n", 1.0, "x"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[4][1], "n", 1.0, "x") for i in range(60)]
    labels += [(1000 + i, 1, 1) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, matches string, score double, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = labelled(spark)
    return docs, labels, toxicity.train(docs, labels)


def test_lexicon_holds_the_telling_words_alone(trained):
    """Sixty copies of one toxic document don't make its other words telling; a harmless phrase is an exception."""
    model = trained[2]
    assert set(model.lexicon.entries) == {" grumbold ", " snarkface ", " vilewitz"}
    assert model.lexicon.exceptions == ["grumbold valley"]


def test_held_out_rows_are_told_apart(trained):
    docs, labels, model = trained
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [i for i in truth if found[i]["held_out"]]
    assert len(held) > 100 and sum(found[i]["predicted"] == truth[i] for i in held) >= 0.98 * len(held)


def test_disguised_words_are_found_where_they_stand(spark, trained):
    texts = ["a snаrkfасe here", "a $narkf4ce!", "ｓｎａｒｋｆａｃｅ", "grumb0ld Grumbo1d", "snark​face x", "snárkface", "snarkfaces and unsnarkface", "grumbold valley; grumbold hill", "5 narkf 4ce $$$the 2000"]
    found = [r["matches"] for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1).sortWithinPartitions("doc_id"), trained[2]).collect()]
    assert found == ["snarkface:2:11", "snarkface:2:11", "snarkface:0:9", "grumbold:0:8,grumbold:9:17", "snarkface:0:10", "snarkface:0:10", "", "grumbold:17:25", ""]


def test_odd_rows_and_tables(spark, odd_docs, no_docs, trained):
    docs, labels, model = trained
    found = toxicity.score(odd_docs, model).collect()
    assert len(found) == odd_docs.count() and all(0 <= r["score"] < 0.7 and r["predicted"] == 0 for r in found)
    assert toxicity.score(no_docs, model).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, none)).filter("score > 0.01").count() == 0
    assert toxicity.score(docs, toxicity.train(docs, labels.filter("toxic = 1"))).filter("predicted = 0").count() == 0
    assert toxicity.train(no_docs, labels).lexicon.entries == {}
    # labels that contradict each other say nothing
    twice = labels.union(labels.selectExpr("doc_id", "quality", "1 - toxic"))
    assert toxicity.train(docs, twice).lexicon.entries == {}


def test_given_exceptions_and_own_weights():
    found, words = toxicity.Lexicon({" scum ": 2.0, " tra": 1.0}, ["pond scum"]).matches("Pond scum, scum trash trà")
    assert found == [("scum", 11, 15, 2.0), ("tra", 16, 19, 1.0), ("tra", 22, 25, 1.0)] and words == 5
