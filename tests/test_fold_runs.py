"""The fold of messages in runs, against the ordered pass message by message."""

import random

import pyarrow as pa
import pytest

from missive.operators import groups


def rows_of(seed, n, words):
    r = random.Random(seed)
    weights = lambda ts: [{"token": t, "idf": 1.0 + int(t[1:]) % 5 / 4, "rare": int(t[1:]) % 3 > 0, "specific": int(t[1:]) % 7 > 0} for t in ts]
    sets = [sorted({f"w{r.randrange(words)}" for _ in range(r.randrange(1, 5))}) for _ in range(words * 2)]
    rows = []
    for seq in range(n):
        a, b = r.randrange(len(sets)), r.choice([None, None, r.randrange(len(sets))])
        rows.append({"tenant": "", "seq": seq, "component": seq * 3 // n, "set_id": a, "item_set_id": b, "item_type": r.choice([None, "task", "event"]) if r.random() < 0.2 else None, "act": r.choice(["status_query", "new_task"]),
                     "subject_source": r.choice(["act_frame", None]), "display": " ".join(sets[a]), "subject_w": weights(sets[a]), "item_signature_w": None if b is None else weights(sets[b])})
    return rows


@pytest.mark.parametrize("seed,words,size", [(1, 5, 700), (2, 12, 1000), (3, 30, 64), (4, 8, 3000)])
def test_runs_give_what_one_pass_gives(monkeypatch, seed, words, size):
    weight = pa.list_(pa.struct([("token", pa.string()), ("idf", pa.float64()), ("rare", pa.bool_()), ("specific", pa.bool_())]))
    schema = pa.schema([("tenant", pa.string()), ("seq", pa.int64()), ("component", pa.int64()), ("set_id", pa.int64()), ("item_set_id", pa.int64()), ("item_type", pa.string()), ("act", pa.string()), ("subject_source", pa.string()), ("display", pa.string()), ("subject_w", weight), ("item_signature_w", weight)])
    rows, want, at = rows_of(seed, 3000, words), [], None
    for row in rows:
        if row["component"] != at:
            at, step = row["component"], groups._Assigner()
        want.append(step(row))
    looked = []
    monkeypatch.setattr(groups, "_coded", lambda batch, made=groups._coded: looked.append(len(batch)) or made(batch))
    table = pa.Table.from_pylist(rows, schema).combine_chunks()
    got = [r for b in groups._assigned(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
    assert got == want and sum(looked) == len(rows)
