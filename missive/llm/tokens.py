"""Token counts by a map-side two-tier lookup.

Tier 1 is a table of pre-token lengths made from the vocabulary alone: every entry
that is a whole pre-token with its leading space and that the library encodes as
one token. Byte-pair merges are learned in order of frequency, so these are the
frequent pre-tokens; the table is bounded by the vocabulary's size and broadcast.
Tier 2 is a bounded cache in each Python worker for what tier 1 misses; a miss is
encoded by the library. Nothing is shuffled: the plan is one scan and one map.

Null and empty texts have 0 tokens. Rows may repeat; each is counted. Other
columns, also ones named like the results, are not read or returned.
"""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.llm.common import GenerationCache, text_of, worker_state

#: computed pre-tokens that a worker keeps (two generations of them)
CACHE_ENTRIES = 300_000

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

#: white space other than single blanks or runs of line feeds between words
_ODD = re.compile(r" [ \n]|\n |[^\S \n]|[\x1c-\x1f]|<\|")
#: units that never share a pre-token: a word with the blank before it, or white space
_UNITS = re.compile(r" ?\S+|\s+(?!\S)|\s")
#: where Python's and the library's idea of white space differ, or special tokens may stand
_WHOLE = re.compile(r"[\x1c-\x1f\x85]|<\|")


def load_tokenizer(content: str):
    """A tokenizer of the ``tokenizers`` library from its file's content, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(content)


def frequent_lengths(tokenizer) -> dict[str, int]:
    """Tier 1: pre-token without its leading blank -> its number of tokens (always 1)."""
    words = sorted(w[1:] for w in tokenizer.get_vocab() if w.startswith("Ġ") and w[1:].isascii() and w[1:].isalpha())
    coded = tokenizer.encode_batch([" " + w for w in words], add_special_tokens=False)
    return {w: 1 for w, c in zip(words, coded) if len(c.ids) == 1}


class Counter:
    """Counts the tokens of whole texts exactly as the library does."""

    def __init__(self, content: str, frequent: dict[str, int], limit: int = CACHE_ENTRIES):
        self.tokenizer = load_tokenizer(content)
        self.after_blank = GenerationCache(lambda word: self.whole(" " + word), limit, frequent)
        self.alone = GenerationCache(self.whole, limit // 4)

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if text[0] != " " and text[-1] != " " and not _ODD.search(text):
            first, *rest = text.split(" ")
            return self.alone[first] + sum(map(self.after_blank.__getitem__, rest))
        if _WHOLE.search(text):
            return self.whole(text)
        return sum(map(self.alone.__getitem__, _UNITS.findall(text)))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, UTF-8 bytes, tokens, and whether the tokens exceed ``limit``.

    ``tokenizer_path`` names a byte-level tokenizer file on the driver; its content
    is broadcast (a fixed size, that of the vocabulary).
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        content = f.read()
    shared = spark.sparkContext.broadcast((content, frequent_lengths(load_tokenizer(content))))

    def run(batches):
        key = ("count", hash(shared.value[0]))
        count = worker_state(key, lambda: Counter(*shared.value))
        for batch in batches:
            n = [count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
