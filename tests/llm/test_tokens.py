import hashlib
import itertools
import time
import zlib

import numpy as np
import public_tokenizers
import pytest

from missive.llm.packing import Packer, fullest, pack
from missive.llm.pieces import Pieces, decode, encode
from missive.llm.tokens import count_tokens, load_tokenizer

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def library(path):
    with open(path, encoding="utf-8") as f:
        return load_tokenizer(f.read())


def test_counts_equal_the_library(spark, odd_docs, no_docs):
    tok = library(BYTES)
    rows = count_tokens(odd_docs, BYTES).collect()
    texts = [r["text"] or "" for r in odd_docs.collect()]
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(tok.encode(t, add_special_tokens=False).ids) for t in texts)
    assert sorted(r["n_bytes"] for r in rows) == sorted(len(t.encode()) for t in texts)
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in rows)
    assert count_tokens(no_docs, BYTES).count() == 0


def test_packing_is_gapless_and_whole(spark, odd_docs, no_docs):
    docs = odd_docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).repartition(3, "doc_id")
    tok = library(WORDS)
    ids = {r["doc_id"]: np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4") for r in docs.collect()}
    pieces = pack(docs, WORDS).collect()
    at = dict.fromkeys(ids, 0)
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        own = ids[p["doc_id"]]
        assert p["start"] == at[p["doc_id"]] and p["doc_tokens"] == len(own)
        assert p["ids_crc32"] == zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes())
        at[p["doc_id"]] += p["length"]
    assert at == {d: len(i) for d, i in ids.items()}
    sequences = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == sequences.get(p["sequence_id"], 0)
        sequences[p["sequence_id"]] = p["offset"] + p["length"]
    assert all(n <= 4096 and n & (n - 1) == 0 for n in sequences.values())
    assert pack(no_docs, WORDS).count() == 0


@pytest.mark.parametrize("lengths", [[3, 3, 5, 7], [5, 5, 5], [2, 9, 4], [30], [1] * 9, [6, 6, 4, 4, 4]])
def test_fullest_is_the_best_subset(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    chosen = fullest(counts, 16)
    sums = {sum(c) for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k)}
    assert sum(n * k for n, k in chosen.items()) == max(s for s in sums if s <= 16)
    assert all(k <= counts[n] for n, k in chosen.items())


def test_packer_without_exact_fit_cuts_one_tail():
    packer, pieces = Packer(0, capacity=16, pending=4), []
    for d in range(9):
        pieces += packer.add(d, bytes(4 * 7))
    pieces += packer.finish()
    assert sum(p[2] for p in pieces) == 63


def brute(pieces, word, n):
    def ways(end):
        if not end:
            return [(0.0, b"")]
        return [(s + score, i + ids) for start, (score, ids) in pieces.edges(word, end) for s, i in ways(start)]

    return sorted((-s for s, _ in ways(len(word))))[:n]


def test_n_best_equals_enumeration():
    from missive.llm.pieces import read_pieces

    table = read_pieces(PIECES)
    pieces = Pieces(*table, n=4)
    for word in ["▁hello", "▁the", "▁tionhe", "é日", "▁▁", "▁a", "▁question", "aaaaaaa", "--------"]:
        assert [-s for s, _ in pieces.best_of_word(word)] == brute(pieces, word, 4)
    for text in ["hello the world", "a b", "to  be"]:
        per_word = [[s for s, _ in pieces.best_of_word(w)] for w in pieces.split(text)]
        best = sorted((sum(c) for c in itertools.product(*per_word)), reverse=True)[:4]
        assert [s for s, _ in pieces.n_best(text)] == pytest.approx(best)


def test_edges_are_all_pieces_that_end_there():
    from missive.llm.pieces import read_pieces

    names, scores, byte_ids = read_pieces(PIECES)
    pieces, known = Pieces(names, scores, byte_ids), {n for n, s in zip(names, scores) if s > float("-inf")}
    for word in ["▁mentquestion", "é日x", "▁▁▁the"]:
        for end in range(1, len(word) + 1):
            wanted = {s for s in range(end) if word[s:end] in known} | {end - 1}
            assert {s for s, _ in pieces.edges(word, end)} == wanted


def test_second_cost_is_the_next_pop():
    from missive.llm.pieces import read_pieces

    pieces = Pieces(*read_pieces(PIECES), n=2)
    for word in ["▁hello", "▁mentquestion", "▁a", "xxxxxx", "日"]:
        best = pieces.best_of_word(word)
        assert pieces.entry(word)[:2] == best[0]
        assert pieces.entry(word)[2] == (best[0][0] - best[1][0] if len(best) > 1 else float("inf"))


@pytest.mark.parametrize("word", ["x", " ", "aB3/"])
def test_long_runs_take_linear_time(word):
    """A million characters in one word, of one kind or not: seconds, and the same pieces as many short ones decode to."""
    from missive.llm.pieces import read_pieces

    pieces = Pieces(*read_pieces(PIECES), n=2)
    text = word * (1_000_000 // len(word))
    start = time.process_time()
    best = pieces.n_best(text)
    assert time.process_time() - start < 120
    assert all(a[0] >= b[0] for a, b in zip(best, best[1:]))
    assert all(pieces.decode(np.frombuffer(ids, "<u4").tolist()) == text for _, ids in best)
    assert not pieces.words or max(map(len, pieces.words)) <= pieces.words.longest


def test_pieces_decode_to_the_text(spark, odd_docs, no_docs):
    coded = encode(odd_docs.filter("doc_id is not null"), PIECES)
    texts = {r["doc_id"]: (r["text"] or "").replace("▁", " ") for r in odd_docs.filter("doc_id is not null").collect()}
    assert {r["doc_id"]: r["decoded"] for r in decode(coded, PIECES).collect()} == texts
    assert encode(no_docs, PIECES).count() == 0


def test_query_of_pieces_equals_brute_force(spark, tmp_path):
    from missive.llm import registry
    from missive.llm.pieces import read_pieces

    texts = ["the hello", "a b", None, "", "the hello", "to  be", "é日\nx", "a▁b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.op3_pieces(spark, str(tmp_path)).collect()
    pieces = Pieces(*read_pieces(PIECES), n=2)
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    for r in rows:
        text = texts[r["doc_id"]] or ""
        lattice = "▁" + text.replace(" ", "▁") if text else ""
        best = brute(pieces, lattice, 2) if text else [0.0]
        assert [-s for s in r["scores"]] == pytest.approx(best)
        ids = np.array(r["ids"], "<u4")
        assert r["pieces"][0] == r["n_pieces"] == len(ids) and r["ids_crc32"][0] == zlib.crc32(ids.tobytes())
        assert r["decoded_md5"] == hashlib.md5(text.replace("▁", " ").encode()).hexdigest()
        assert r["round_trip"] == ("▁" not in text)
