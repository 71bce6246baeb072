"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

The trees are fitted here, on a bounded labelled sample (``SAMPLE_PER_CLASS``), and
flattened into numpy node arrays; scoring walks all rows of a batch down one tree
level at a time. For the features in ``FEATURES`` with sign -1 the score may only
fall as the feature grows (+1: only rise): a split that would break that is never
taken, and the bounds between sibling leaves hold for all their descendants.

Null and empty texts have no words: all counts 0, base_failed true, kept false.
Without labels of both classes there are no trees and the base rules decide alone.
Repeated rows are judged one by one; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.llm.common import GenerationCache, labelled_sample, lean, text_of, worker_state

#: labelled rows of each class that the trees are fitted on, at most
SAMPLE_PER_CLASS = 3000
TREES, DEPTH, BINS, RATE, REGULAR, LEAST_ROWS = 40, 3, 32, 0.2, 1.0, 10
CACHE_ENTRIES = 300_000

#: document statistics with the sign of their monotonic constraint (0: none)
FEATURES = {
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "exclaim_share": -1,
    "digit_share": 0,
    "mean_word_chars": 0,
    "distinct_share": 0,
    "words_per_line": 0,
    "log_words": 0,
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SYMBOLS, _UPPER, _DIGITS = b"#*$%&|<>", bytes(range(65, 91)), b"0123456789"
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))


class Statistics:
    """Base counts and features of whole texts (UTF-8 bytes; bytes.split() parts words at the six ASCII blanks)."""

    def __init__(self, limit: int = CACHE_ENTRIES):
        self.hashes = GenerationCache(xxhash.xxh3_64_intdigest, limit)

    def __call__(self, text: str) -> tuple[list[int], list[float]]:
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        n, size = len(words), max(1, len(raw))
        chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
        symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
        lines, dups, seen = 0, 0, set()
        for line in raw.split(b"\n"):
            if line and not line.isspace():
                lines += 1
                dups += line in seen
                seen.add(line)
        repeats, distinct = self.repeats(words)
        without = lambda drop: len(raw) - len(raw.translate(None, drop))
        features = [
            symbols / size,
            dups / max(1, lines),
            repeats / max(1, n),
            without(_UPPER) / max(1, without(_LETTERS)),
            raw.count(b"!") / max(1, n),
            without(_DIGITS) / size,
            chars / max(1, n),
            distinct / max(1, n),
            n / max(1, lines),
            float(np.log1p(n)),
        ]
        return [n, chars, symbols, dups, repeats], features

    def repeats(self, words: list[bytes]) -> tuple[int, int]:
        """Words that lie in a 3-word window found at least twice; distinct words."""
        n = len(words)
        if n < 4:
            return 0, len(set(words))
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, n)
        with np.errstate(over="ignore"):
            w = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + (h[1:-1] ^ (h[1:-1] >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9) + h[2:]
        order = np.argsort(w, kind="stable")
        same = w[order][1:] == w[order][:-1]
        again = np.zeros(n - 2, bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        covered[:-2] |= again
        covered[1:-1] |= again
        covered[2:] |= again
        return int(covered.sum()), len(np.unique(h))


class Trees:
    """Boosted trees as arrays: node k of a level-ordered complete tree has children 2k+1 and 2k+2."""

    def __init__(self, feature, threshold, leaf, start: float):
        self.feature, self.threshold, self.leaf, self.start = feature, threshold, leaf, start

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while inner and node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Second-order boosting of the logistic loss with histogram splits and monotonic signs; classes weigh alike."""
    inner, leaves = 2**depth - 1, 2**depth
    none = Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), 0.0)
    if len(np.unique(y)) < 2:
        return none
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    margin, built = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = weight * (p - y), weight * p * (1 - p)
        feature, threshold, leaf = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(leaves)
        node, bounds = np.zeros(len(y), np.int64), {0: (-np.inf, np.inf)}
        for k in range(inner):
            mine = node == k
            lo, hi = bounds[k]
            found = _split(bins, grad, hess, mine, cuts, signs, lo, hi)
            if found is None:
                bounds[2 * k + 1] = bounds[2 * k + 2] = (lo, hi)
                node[mine] = 2 * k + 1
                continue
            j, b, left, right = found
            feature[k], threshold[k], middle = j, cuts[j][b], (left + right) / 2
            bounds[2 * k + 1] = (lo, middle) if signs[j] > 0 else (middle, hi) if signs[j] < 0 else (lo, hi)
            bounds[2 * k + 2] = (middle, hi) if signs[j] > 0 else (lo, middle) if signs[j] < 0 else (lo, hi)
            node[mine] = 2 * k + 1 + (bins[mine, j] > b)
        for k in range(leaves):
            mine = node == inner + k
            if mine.any():
                leaf[k] = RATE * np.clip(-grad[mine].sum() / (hess[mine].sum() + REGULAR), *bounds[inner + k])
        margin += leaf[node - inner]
        built.append((feature, threshold, leaf))
    return Trees(*(np.stack(a) for a in zip(*built)), 0.0)


def _split(bins, grad, hess, mine, cuts, signs, lo, hi):
    """Best (feature, bin, left value, right value) of a node, or None."""
    best, out = 1e-6, None
    g_all, h_all, n_all = grad[mine].sum(), hess[mine].sum(), mine.sum()
    for j, cut in enumerate(cuts):
        if not len(cut) or n_all < 2 * LEAST_ROWS:
            continue
        b = bins[mine, j]
        g, h, n = (np.bincount(b, w, len(cut) + 1).cumsum()[:-1] for w in (grad[mine], hess[mine], None))
        left, right = np.clip(-g / (h + REGULAR), lo, hi), np.clip(-(g_all - g) / (h_all - h + REGULAR), lo, hi)
        gain = g * g / (h + REGULAR) + (g_all - g) ** 2 / (h_all - h + REGULAR) - g_all**2 / (h_all + REGULAR)
        allowed = (n >= LEAST_ROWS) & (n_all - n >= LEAST_ROWS) & (signs[j] * (right - left) >= 0)
        gain = np.where(allowed, gain, -np.inf)
        k = int(gain.argmax())
        if gain[k] > best:
            best, out = gain[k], (j, k, left[k], right[k])
    return out


def _statistics() -> Statistics:
    return worker_state("statistics", Statistics)


def _features(batches):
    measure = _statistics()
    for batch in batches:
        x = [measure(t)[1] for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Trees:
    """Trees from a bounded sample of labelled documents, which alone reaches the driver, as features."""
    sample = labelled_sample(docs, labels, per_class)
    rows = sample.select("text", F.col("label").alias("y")).mapInArrow(_features, "x array<double>, y int").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T) if len(x) else []
    return fit(x[order], rows["y"].to_numpy(float)[order], list(FEATURES.values()))


def judge(docs: DataFrame, trees: Trees, threshold: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts and verdict of each document, followed by the columns ``carry`` of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        measure = _statistics()
        for batch in batches:
            rows = [measure(t) for t in batch.column(1).to_pylist()]
            counts = np.array([r[0] for r in rows], np.int64).reshape(-1, len(COUNTS))
            score = shared.value.probability(np.array([r[1] for r in rows], float).reshape(-1, len(FEATURES)))
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            made = [batch.column(0), *map(pa.array, counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
            yield pa.RecordBatch.from_arrays([*made, *batch.columns[2:]], names=[*["doc_id", *COUNTS, "base_failed", "rule_score", "kept"], *carry_names])

    fields = {f.name: f for f in docs.schema.fields}
    carry_names = [f"in_{c}" for c in carry]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), *(F.col(f"`{c}`").alias(f"in_{c}") for c in carry))
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, rule_score double, kept boolean"
    schema += "".join(f", `in_{c}` {fields[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(lean(run), schema)
