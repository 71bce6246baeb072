"""Grouping by components against one ordered pass, and components against union-find."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from missive.functions.graph import components
from missive.operators import groups, subject

SIGNATURE = "struct<tokens:array<string>,specific:array<string>,display:string>"
ROW = f"tenant string, seq long, item_type string, act string, subject_source string, subject {SIGNATURE}, item_signature {SIGNATURE}, message_id string"


def invented_rows(seed, n, words, tenants=("", "other")):
    """Messages about subjects of one to four words, drawn so that some words are common and many subjects are near each other."""
    r = random.Random(seed)
    pick = lambda: sorted({words[int(r.random() ** 2 * len(words))] for _ in range(r.randrange(1, 5))})
    sign = lambda t: (t, [x for x in t if x != "report"], " ".join(t))
    rows = []
    for seq in range(n):
        tokens = pick()
        item = r.choice([None, None, "task", "event"])
        rows.append((r.choice(tenants), seq, item, r.choice(["status_query", "new_task", "completion"]), r.choice(["act_frame", "open_question"]), sign(tokens) if r.random() > 0.1 else None, sign(pick()) if item and r.random() < 0.3 else None, f"M{seq}"))
    return rows


def one_pass(rows, sets):
    """seed_seq, score and weak link of each message by one ordered fold over its whole tenant."""
    weights = {(s["tenant"], tuple(s["tokens"])): [w.asDict() for w in s["weights"]] for s in sets.collect()}
    folds, out = {}, {}
    for tenant, seq, item, act, source, subj, sig, _ in sorted(rows, key=lambda r: r[1]):
        if subj is None:
            continue
        fold = folds.setdefault(tenant, groups._Assigner())
        got = fold({"tenant": tenant, "seq": seq, "item_type": item, "act": act, "subject_source": source, "display": subj[2], "subject_w": weights[tenant, tuple(subj[0])], "item_signature_w": sig and weights[tenant, tuple(sig[0])]})
        out[tenant, seq] = (got["seed_seq"], got["match_score"], got["weak_link"], tuple(got["match_tokens"]))
    return out


@pytest.mark.parametrize("seed,n_words", [(1, 400), (2, 60), (3, 12)])
def test_components_give_what_one_pass_gives(spark, seed, n_words):
    """From many small components to one giant one."""
    words = ["report", *(f"w{i}" for i in range(n_words))]
    rows = invented_rows(seed, 400, words)
    df = spark.createDataFrame(rows, ROW).repartition(5)
    idf = subject.subject_idf(df).persist()
    want = one_pass(rows, groups.token_sets(df.filter("subject is not null"), idf))
    found = groups.assign(df, idf).select("tenant", "seq", "group_no", "match_score", "weak_link", "match_tokens", "seed").collect()
    first = {(r["tenant"], r["group_no"]): r["seq"] for r in found if r["seed"]}
    assert {(r["tenant"], r["seq"]): (first[r["tenant"], r["group_no"]], r["match_score"], r["weak_link"], tuple(r["match_tokens"])) for r in found} == want
    for tenant in ("", "other"):  # numbered by their first message
        seeds = [first[tenant, k] for k in sorted(k for t, k in first if t == tenant)]
        assert seeds == sorted(seeds) and [k for t, k in first if t == tenant].__len__() == max(k for t, k in first if t == tenant)
    idf.unpersist()


def test_one_tenant_is_many_tasks(spark):
    """The fold's rows are dealt by component, so one tenant is spread."""
    rows = invented_rows(5, 300, [f"w{i}" for i in range(2000)], tenants=("",))
    df = spark.createDataFrame(rows, ROW)
    idf = subject.subject_idf(df)
    sets = groups.token_sets(df.filter("subject is not null"), idf)
    linked = components(groups.matching_sets(groups.written(sets, "sets")))
    assert linked.select("component").distinct().count() + sets.count() - linked.count() > 50


def test_no_messages(spark):
    df = spark.createDataFrame([], ROW)
    assert groups.assign(df, subject.subject_idf(df)).count() == 0


@pytest.mark.parametrize("shape", ["random", "path", "star", "none"])
def test_components_equal_union_find(spark, shape):
    r = random.Random(2)
    names = r.sample(range(10**12), 300)
    edges = {"random": [(r.choice(names), r.choice(names)) for _ in range(200)], "path": list(zip(names, names[1:])), "star": [(names[0], x) for x in names], "none": []}[shape]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = components(spark.createDataFrame(edges, "a long, b long")).select("node", F.col("component")).collect()
    assert {(r["node"], r["component"]) for r in got} == {(x, root(x)) for x in parent} and len(got) == len(parent)


def test_only_messages_that_may_change_a_group_are_folded(monkeypatch):
    """Many messages about few subjects: outcomes equal the plain fold's, over batches, and few messages are folded."""
    r, folded, real = random.Random(4), [], groups._Assigner.__call__
    weigh = lambda names: [{"token": t, "idf": 1.0, "rare": True, "specific": True} for t in names]
    names = [["oak", "plank"], ["elm", "plank"], ["oak", "plank", "red"], ["ash"]]
    rows = []
    for seq in range(3000):
        k, item = r.randrange(4), r.choice([None, None, 0, 3]) if seq > 1500 else None
        rows.append({"tenant": "", "component": seq * 2 // 3000, "seq": seq, "item_type": r.choice([None, "task"]) if seq % 1500 > 700 else None, "act": "completion", "subject_source": r.choice(["act_frame", "open_question"]),
                     "display": " ".join(names[k]), "set_id": k, "item_set_id": item, "subject_w": weigh(names[k]), "item_signature_w": None if item is None else weigh(names[item])})
    plain = {0: groups._Assigner(), 1: groups._Assigner()}
    want = [plain[x["component"]](x) for x in rows]
    monkeypatch.setattr(groups._Assigner, "__call__", lambda self, row: (folded.append(1), real(self, row))[1])
    got = [x for b in groups._assigned(pa.Table.from_pylist(rows).to_batches(max_chunksize=700)) for x in b.to_pylist()]
    assert got == want and len(folded) < 200


def test_groups_of_one_common_word_cost_no_search_of_each_other():
    """A lone common word never matches, so each such message starts a group; the fold holds their set once, and others keep their outcome."""
    word = lambda t, rare: {"token": t, "idf": 1.0, "rare": rare, "specific": True}
    row = lambda seq, *ws: {"tenant": "", "seq": seq, "item_type": None, "act": "completion", "subject_source": "act_frame", "display": "", "subject_w": list(ws), "item_signature_w": None}
    fold, common, oak = groups._Assigner(), word("ring", False), [word("oak", True), word("ring", False)]
    assert fold(row(0, *oak))["seed"] and all(fold(row(1 + i, common))["seed_seq"] == 1 + i for i in range(50))
    assert len(fold.signatures) == 2 and fold.version == 2
    assert fold(row(99, *oak))["seed_seq"] == 0


def test_lone_sets_get_the_folds_outcome_in_columns(spark):
    """Messages whose set matches nothing, not even itself, start a group each: the same as the fold gives, without it."""
    r, word = random.Random(6), {"token": "ring", "idf": 1.0, "rare": False, "specific": True}
    rows = [{"tenant": "", "seq": i, "item_type": r.choice([None, "task", "event"]), "act": r.choice(["completion", "new_event", "reschedule", None]), "subject_source": r.choice(["act_frame", "open_question", None]),
             "display": f"the ring {i}", "subject_w": [word], "item_signature_w": None} for i in range(60)]
    weights = "array<struct<token:string,idf:double,rare:boolean,specific:boolean>>"
    df = spark.createDataFrame(rows, f"tenant string, seq long, item_type string, act string, subject_source string, display string, subject_w {weights}, item_signature_w {weights}")
    assert df.filter(groups.matches_itself(F.col("subject_w"))).count() == 0
    fold = groups._Assigner()
    got = groups._lone(df).select(*(n.split()[0] for n in groups.ASSIGNED.split(", "))).orderBy("seq").collect()
    assert [x.asDict() for x in got] == [{k: v for k, v in fold(row).items()} for row in rows]
