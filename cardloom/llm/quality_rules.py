"""Quality rules: gradient-boosted trees over document statistics.

The statistics are counted with numpy over blocks of text.  The trees are trained here, on the driver, from a bounded
sample of labelled documents (``SAMPLE_ROWS`` at most, by a fixed hash order), with logistic loss and monotone
constraints on chosen features: more symbols, repeats, capitals or duplicate lines can never raise a score.  The fitted
trees are flattened into one set of node arrays, so a block of documents is scored by a few array lookups per level.
Scoring needs no shuffle; only the flat model (some kB) goes to the tasks.

Defined cases: a null text is an empty text and fails the base rule; a null ``doc_id`` is carried through; repeated
rows give repeated results; extra columns are ignored; an empty table gives an empty result; without labels of both
classes only the base rule decides and ``score`` is null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm import _text

#: Labelled documents that the trees are fitted on, at most.
SAMPLE_ROWS = 4000
TREES, DEPTH, RATE, BINS, LEAF_ROWS, L2 = 60, 3, 0.2, 48, 20, 1.0
#: Documents whose probability of being good is lower are rejected.
THRESHOLD = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_digits", "n_bangs", "n_chars")
#: Features and their constraint: -1 if a rise may only lower the score, 0 if free.
FEATURES = {
    "symbols_per_char": -1,
    "dup_line_share": -1,
    "repeat_word_share": -1,
    "upper_share": -1,
    "bangs_per_word": -1,
    "digit_share": 0,
    "mean_word_chars": 0,
    "words_per_line": 0,
    "log_words": 0,
}
_SYMBOL = _text.byte_class(b"#*$%&|<>")
_UPPER = _text.byte_class(bytes(range(65, 91)))
_DIGIT = _text.byte_class(bytes(range(48, 58)))
_BANG = _text.byte_class(b"!?")
_HEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])  # bytes that begin a code point
_WORD_HEAD = _HEAD & _text.WORD_BYTE


def statistics(column: pa.Array) -> np.ndarray:
    """Counts of every text, one row each, columns ``COUNTS + EXTRA``."""
    parts = [np.zeros((0, 10), np.int64)]
    for block in _text.blocks(column):
        data, rows = block.data, block.rows
        out = np.zeros((rows, 10), np.int64)
        starts, ends = block.runs(_text.WORD_BYTE)
        first = np.searchsorted(starts, block.offsets)
        out[:, 0] = np.diff(first)
        for k, flags in ((1, _WORD_HEAD), (2, _SYMBOL), (6, _UPPER), (7, _DIGIT), (8, _BANG), (9, _HEAD)):
            out[:, k] = block.per_row(flags[data])
        prefix = block.prefix()
        salt = _text.keyed(rows, 71)  # keeps equal content of different documents apart

        line_starts, line_ends, line_first = block.lines()
        worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
        of = np.repeat(np.arange(rows), np.diff(line_first))[worded]
        lines = block.hashes(prefix, line_starts[worded], line_ends[worded]) ^ salt[of]
        _, where = np.unique(lines, return_index=True)
        out[:, 5] = np.bincount(of, minlength=rows)
        out[:, 3] = out[:, 5] - np.bincount(of[where], minlength=rows)

        of = np.repeat(np.arange(rows), out[:, 0])
        words = block.hashes(prefix, starts, ends)
        windows = _text.combine(words, 3)
        if len(windows):
            whole = of[2:] == of[:-2]
            at = np.flatnonzero(whole)
            keys = windows[at] ^ salt[of[at]]
            order = np.argsort(keys)
            same = keys[order[1:]] == keys[order[:-1]]
            twice = np.zeros(len(at), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(len(words), bool)
            for k in range(3):
                covered[at[twice] + k] = True
            out[:, 4] = _text.ranges_sum(covered, first)
        parts.append(out)
    return np.concatenate(parts)


def features(counts: np.ndarray) -> np.ndarray:
    """Model features of each row of :func:`statistics`, in the order of ``FEATURES``."""
    words, chars, symbols, dup, repeat, lines, upper, digits, bangs, total = counts.T.astype(float)
    one = np.maximum(words, 1)
    return np.column_stack(
        [
            symbols / np.maximum(total, 1),
            dup / np.maximum(lines, 1),
            repeat / one,
            upper / np.maximum(total, 1),
            bangs / one,
            digits / np.maximum(total, 1),
            chars / one,
            words / np.maximum(lines, 1),
            np.log1p(words),
        ]
    )


@dataclass
class FlatTrees:
    """All trees in node arrays; a leaf is its own child, so walking ``depth`` steps always ends in one."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class for each row."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                goes_left = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(goes_left, self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, constraints: list[int]) -> FlatTrees:
    """Boosts histogram trees with logistic loss; bounds passed down the tree keep constrained features monotone."""
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.column_stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T, strict=True)])
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    bias = float(np.log(share / (1 - share)))
    margin = np.full(len(y), bias)

    def node(leaf: float) -> int:
        feature.append(0), threshold.append(0.0), left.append(len(left)), right.append(len(right)), value.append(leaf)
        return len(value) - 1

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-9)

        def weight(g: float, h: float, low: float, high: float) -> float:
            return min(max(g / (h + L2), low), high)

        def grow(rows: np.ndarray, depth: int, low: float, high: float) -> int:
            g, h = grad[rows].sum(), hess[rows].sum()
            me = node(RATE * weight(g, h, low, high))
            best = (1e-6, None)
            if depth:
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    n = len(e) + 1
                    gl = np.cumsum(np.bincount(binned[rows, f], grad[rows], n))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, f], hess[rows], n))[:-1]
                    nl = np.cumsum(np.bincount(binned[rows, f], minlength=n))[:-1]
                    gain = gl**2 / (hl + L2) + (g - gl) ** 2 / (h - hl + L2) - g**2 / (h + L2)
                    wl, wr = np.clip(gl / (hl + L2), low, high), np.clip((g - gl) / (h - hl + L2), low, high)
                    ok = (nl >= LEAF_ROWS) & (len(rows) - nl >= LEAF_ROWS) & ((wr - wl) * constraints[f] >= 0)
                    gain = np.where(ok, gain, -1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (f, k, wl[k], wr[k]))
            if best[1] is None:
                margin[rows] += value[me]
                return me
            f, k, wl, wr = best[1]
            middle = (wl + wr) / 2
            bounds = {0: (low, high, low, high), 1: (low, middle, middle, high), -1: (middle, high, low, middle)}
            a, b, c, d = bounds[constraints[f]]
            goes_left = binned[rows, f] <= k
            feature[me], threshold[me] = f, float(edges[f][k])
            left[me] = grow(rows[goes_left], depth - 1, a, b)
            right[me] = grow(rows[~goes_left], depth - 1, c, d)
            return me

        roots.append(grow(np.arange(len(y)), DEPTH, -np.inf, np.inf))
    arrays = [np.array(v) for v in (feature, threshold, left, right, value, roots)]
    return FlatTrees(*arrays, DEPTH, bias)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> FlatTrees | None:
    """Trees fitted on at most ``sample_rows`` labelled documents; None without both classes.

    The sample is the labelled ids with the smallest hashes: the same at every run and partitioning.  It is chosen
    before any text is read, so at most ``sample_rows`` texts are counted and only their counts reach the driver.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    sample = texts.join(F.broadcast(chosen), "doc_id").select("quality", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = statistics(batch.column(1)).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["quality", "counts"])

    rows = sorted((r.quality, list(r.counts)) for r in sample.mapInArrow(count, "quality int, counts array<long>").toLocalIterator())
    if len({q for q, _ in rows}) < 2:
        return None
    return fit(features(np.array([c for _, c in rows])), np.array([float(q) for q, _ in rows]), list(FEATURES.values()))


def assess(docs: DataFrame, model: FlatTrees | None, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, base verdict, model score and verdict of every document."""
    types = dict.fromkeys(COUNTS, "long") | {"base_failed": "boolean", "kept": "boolean", "score": "double"}
    schema = ", ".join(f"{k} {v}" for k, v in ({"doc_id": "long"} | types).items())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, good, score = judge(batch.column(1), model, threshold)
            failed = base_failed(counts)
            columns = [batch.column(0), *(pa.array(c) for c in counts.T[:5]), pa.array(failed), pa.array(good), pa.array(score, pa.float64(), mask=np.isnan(score))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *types])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Whether the base rule rejects each row of :func:`statistics`."""
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])


def judge(texts: pa.Array, model: FlatTrees | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, verdict and score (NaN without a model) of each text."""
    counts = statistics(texts)
    score = model.score(features(counts)) if model else np.full(len(counts), np.nan)
    return counts, ~base_failed(counts) & ~(score < threshold), score


def keep_good(docs: DataFrame, model: FlatTrees | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that pass the base rule and the model."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, good, _ = judge(batch.column("text").cast(pa.string()), model, threshold)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
