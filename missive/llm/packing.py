"""Packing documents into fixed-length training sequences by minimum bin slack.

Each input partition is packed on its own: no shuffle, no state outside a task, so
a lost executor repeats just its tasks with the same result. Within a partition:

* a document of a window's length or more gives off whole windows; its tail waits;
* when ``PENDING`` tails wait, a window is filled: a bitset subset-sum over the
  multiset of waiting lengths finds the reachable total closest to the window's
  capacity, and the DP's stages, walked backwards, give how many tails of each
  length make it (longest lengths first, so small ones stay for later windows);
* slack that no multiset can fill is closed by cutting the longest waiting tail;
* at the end of the partition the rest is cut at powers of two, which need no padding.

Null and empty texts consist of the closing id alone. Equal documents are packed
one by one. Sequence ids are partition * 2**32 + number, hence unique. Extra columns
are not read.
"""

from __future__ import annotations

import array
import re
import sys
import zlib
from collections import defaultdict, deque

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.llm.common import CHUNK_CHARS, GenerationCache, gathered, lean, text_of, word_chunks, worker_state
from missive.llm.tokens import load_tokenizer

CAPACITY = 4096
#: tails that wait for a partner before a window is filled
PENDING = 512
#: chunks whose ids a worker keeps
CACHE_ENTRIES = 250_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: where str.split and the library differ, or where special tokens may stand
_WHOLE = re.compile(r"[\x1c-\x1f]|<\|")

#: words of these characters are put in lower case, parted and spelt out as bytes here
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte: itself, or one from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in kept)}


class Encoder:
    """Whole texts to ids (little-endian unsigned 32 bit), word by word through a cache.

    The tokenizer never joins ids over white space, so the words between can be
    encoded apart; texts where that is not sure are encoded as a whole. A word of
    plain letters goes part by part to the library's merges alone, with a second
    cache for parts; other words go through the whole library.
    """

    def __init__(self, content: str, limit: int = CACHE_ENTRIES, chars: int = CHUNK_CHARS):
        self.tokenizer, self.chars = load_tokenizer(content), chars
        self.words = GenerationCache(self.word, limit)
        self.parts = GenerationCache(self.part, limit)
        self.merges, self.letters = self.tokenizer.model, byte_letters()

    def whole(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, word: str) -> bytes:
        if word.isascii():
            if word.isalpha():
                return self.parts[word.lower()]
            if word[:-1].isalpha():  # letters and one sign or digit
                return self.parts[word[:-1].lower()] + self.parts[word[-1]]
        if _PLAIN.fullmatch(word):
            return b"".join(map(self.parts.__getitem__, _PARTS.findall(word.lower())))
        return self.whole(word)

    def part(self, part: str) -> bytes:
        spelt = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        ids = array.array("I", [t.id for t in self.merges.tokenize(spelt)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def many(self, texts: list[str]):
        """The ids of each text. Words are looked up once for a run of texts."""
        plain, done = ["" if _WHOLE.search(t) else t for t in texts], 0
        for words, codes, counts in word_chunks(plain, str.split, self.chars):
            ids, _, ends = gathered(list(map(self.words.__getitem__, words)), codes, counts)
            last = 0
            for end in ends.tolist():
                yield ids[last:end].tobytes() if texts[done] == plain[done] else self.whole(texts[done])
                last, done = end, done + 1


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many items of each length make the largest total up to ``capacity``.

    Bit t of a stage's bitset says that the lengths so far can make total t; a
    length with a count is added in the binary portions 1, 2, 4, ... of the count.
    Stops as soon as the capacity itself is reachable.
    """
    mask, reach, stages = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, portion = min(counts[length], capacity // length), 1
        while left:
            portion = min(portion, left)
            stages.append((length, portion, reach))
            reach |= (reach << (length * portion)) & mask
            left, portion = left - portion, portion * 2
        if reach >> capacity:
            break
    total, taken = reach.bit_length() - 1, defaultdict(int)
    for length, portion, before in reversed(stages):
        if not before >> total & 1:
            taken[length] += portion
            total -= length * portion
    return dict(taken)


class Packer:
    """Takes (document, ids) and gives pieces with their places; see the module."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, pending: int = PENDING):
        self.capacity, self.pending, self.sequence = capacity, pending, first_sequence
        self.waiting: dict[int, deque] = defaultdict(deque)
        self.n = 0

    def _piece(self, doc, ids: bytes, start: int, length: int, total: int, offset: int) -> tuple:
        return doc, start, length, zlib.crc32(memoryview(ids)[: 4 * length]), total, self.sequence, offset

    def add(self, doc, ids: bytes):
        total = len(ids) // 4
        whole = total - total % self.capacity
        for start in range(0, whole, self.capacity):
            yield self._piece(doc, ids[4 * start : 4 * (start + self.capacity)], start, self.capacity, total, 0)
            self.sequence += 1
        if whole < total:
            self._wait(doc, ids[4 * whole :], whole, total)
        while self.n >= self.pending and self._tokens() >= self.capacity:
            yield from self._window()

    def _wait(self, doc, ids, start, total):
        self.waiting[len(ids) // 4].append((doc, ids, start, total))
        self.n += 1

    def _tokens(self) -> int:
        return sum(length * len(items) for length, items in self.waiting.items())

    def _take(self, length: int) -> tuple:
        items = self.waiting[length]
        item = items.popleft()
        if not items:
            del self.waiting[length]
        self.n -= 1
        return item

    def _fill(self, items: list[tuple], size: int):
        """One sequence of ``size`` from whole tails and, if they leave slack, a cut of the longest one waiting."""
        offset = 0
        for doc, ids, start, total in items:
            yield self._piece(doc, ids, start, n := len(ids) // 4, total, offset)
            offset += n
        if offset < size:
            doc, ids, start, total = self._take(max(self.waiting))
            n = size - offset
            yield self._piece(doc, ids, start, n, total, offset)
            self._wait(doc, ids[4 * n :], start + n, total)
        self.sequence += 1

    def _window(self, size: int | None = None):
        size = size or self.capacity
        chosen = fullest({length: len(items) for length, items in self.waiting.items()}, size)
        yield from self._fill([self._take(length) for length, n in chosen.items() for _ in range(n)], size)

    def finish(self):
        while (left := self._tokens()) > 0:
            yield from self._window(min(self.capacity, 1 << (left.bit_length() - 1)))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, pending: int = PENDING, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE_ENTRIES, chars: int = CHUNK_CHARS) -> DataFrame:
    """Pieces of all documents with their sequence and offset; every id lies in exactly one piece.

    ``cache``: words whose ids a worker keeps; ``chars``: text whose words it looks up at once. Less of both takes more time and less memory, with the same result.

    ``capacity`` is a power of two. Each sequence is filled to it, or to a smaller
    power of two at a partition's end. ids_crc32 is taken over the piece's ids.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    with open(tokenizer_path, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        key = ("pack", hash(content.value), cache, chars)
        encode, end = worker_state(key, lambda: Encoder(content.value, cache, chars)), end_id.to_bytes(4, "little")
        packer = Packer(TaskContext.get().partitionId() << 32, capacity, pending)

        def table(rows):
            columns = zip(*rows) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode.many(batch.column(1).to_pylist())):
                rows += packer.add(doc, ids + end)
            yield table(rows)
        yield table(list(packer.finish()))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(lean(run), SCHEMA)
