"""Edit-aware token counts.

Each document's pre-tokens are kept in a segment tree: the leaves are short runs of pre-tokens, every node holds the
characters and tokens below it.  An edit finds its leaves by descending the character sums, re-splits only the touched
pre-tokens with boundary context until the new boundaries meet old ones again, encodes only those, and updates the
sums on the way up.  All other counts stay as they were.

A pre-token depends on the text from its start to two characters past its end, so one that ends two characters before
the edit or earlier cannot change; behind the edit, once a new boundary falls on an old one the rest is as before.

Defined cases: a null text is an empty text; a null ``doc_id`` is carried through (its edits are those with a null id);
edits apply in the order of ``edit_no`` to the text as left by the earlier ones, with offsets clipped to it; equal
``edit_no`` apply in the order of place and replacement; documents without edits keep their count; rows that repeat a
``doc_id`` get the same edits; extra columns are ignored; empty tables give empty results or unedited counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm import bpe

LEAF = 48
CONTEXT = 2
#: Characters that are split at a time behind an edit until boundaries meet.
STEP = 64
#: Characters of text whose trees a task holds at a time.
BLOCK_CHARS = 1_000_000


class CountTree:
    """Segment tree over one document's pre-tokens.

    An edit updates the character sums at once and marks the leaves it touched; their token sums follow when the total
    is asked for, so the new pre-tokens of many documents' edits are encoded together.
    """

    def __init__(self, words: list[str], entries: np.ndarray, coder: bpe.CorpusEncoder):
        self.coder = coder
        self.recounted = 0
        self.build(list(self._leaves(words, entries)))

    @classmethod
    def of(cls, text: str, coder: bpe.CorpusEncoder) -> CountTree:
        """The tree of a text."""
        words = coder.split(text)
        return cls(words, coder.number(words), coder)

    @staticmethod
    def _leaves(words: list[str], entries: np.ndarray) -> Iterator[tuple[list[str], np.ndarray]]:
        for k in range(0, len(words), LEAF):
            yield words[k : k + LEAF], entries[k : k + LEAF]

    def build(self, leaves: list[tuple[list[str], np.ndarray]]) -> None:
        """Places the leaves, sums their characters upwards and marks them all."""
        leaves = leaves or [([], np.zeros(0, np.int32))]
        self.words, self.entries = [x[0] for x in leaves], [x[1] for x in leaves]
        self.size = 1
        while self.size < len(leaves):
            self.size *= 2
        self.chars = [0] * (2 * self.size)
        self.tokens = [0] * (2 * self.size)
        for k, words in enumerate(self.words):
            self.chars[self.size + k] = sum(map(len, words))
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.stale = set(range(len(leaves)))

    def settle(self) -> None:
        """Sums the tokens of the marked leaves and carries the sums upwards."""
        self.coder.learn()
        counts = self.coder.ids.counts
        for k in self.stale:
            self.tokens[self.size + k] = int(counts[self.entries[k]].sum())
        nodes = {(self.size + k) // 2 for k in self.stale}
        while nodes and 0 not in nodes:
            for k in nodes:
                self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
            nodes = {k // 2 for k in nodes}
        self.stale.clear()

    @property
    def total(self) -> int:
        """Tokens of the whole document."""
        if self.stale:
            self.settle()
        return self.tokens[1]

    @property
    def length(self) -> int:
        """Characters of the whole document."""
        return self.chars[1]

    def text(self) -> str:
        """The document as edited so far."""
        return "".join("".join(leaf) for leaf in self.words)

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and how many characters stand before the leaf."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if place >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.size, before

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replaces the characters from ``start`` to ``end``."""
        start = min(max(start, 0), self.length)
        end = min(max(end, start), self.length)
        first, before = self.find(max(0, start - CONTEXT - 1))
        # The pre-token that may change first: the earliest whose end lies past start - CONTEXT.
        leaf_words = self.words[first]
        keep = 0
        at = before
        while keep < len(leaf_words) and at + len(leaf_words[keep]) <= start - CONTEXT:
            at += len(leaf_words[keep])
            keep += 1
        # Old pre-tokens from here on, up to the one that holds the edit's end.
        leaf, word, place = first, keep, at
        old: list[str] = []

        def take() -> bool:
            """Moves one old pre-token into the region."""
            nonlocal leaf, word, place
            while leaf < len(self.words) and word >= len(self.words[leaf]):
                leaf, word = leaf + 1, 0
            if leaf >= len(self.words):
                return False
            old.append(self.words[leaf][word])
            place += len(old[-1])
            word += 1
            return True

        while place < end and take():
            pass
        joined = "".join(old)
        head, tail = joined[: start - at], joined[end - at :]
        fixed = len(head) + len(replacement)
        step = STEP
        while True:
            # Boundaries of the old pre-tokens behind the edit, in new offsets.
            ends: dict[int, tuple[int, int]] = {}
            target = len(tail) + step
            old.clear()
            base = len(tail)
            more = True
            ends[fixed + base] = (leaf, word)
            while base < target and (more := take()):
                base += len(old[-1])
                ends[fixed + base] = (leaf, word)
            tail += "".join(old)
            words = self.coder.split(head + replacement + tail)
            done, offset = None, 0
            for k, w in enumerate(words):
                # Pre-tokens that end too close to the cut may still grow.
                if offset >= fixed and offset in ends and (not more or offset + CONTEXT <= fixed + len(tail)):
                    done = k
                    break
                offset += len(w)
                if more and offset + CONTEXT > fixed + len(tail):
                    break
            if done is None and not more:
                done, offset = len(words), fixed + len(tail)
            if done is not None:
                break
            step *= 2
        stop_leaf, stop_word = ends[offset]
        fresh = words[:done]
        self.recounted += len(fresh)
        entries = [self.entries[first][:keep], self.coder.number(fresh)]
        words = self.words[first][:keep] + fresh
        if stop_leaf < len(self.words):
            words += self.words[stop_leaf][stop_word:]
            entries.append(self.entries[stop_leaf][stop_word:])
        self.put(first, min(stop_leaf, len(self.words) - 1), words, np.concatenate(entries))

    def put(self, first: int, last: int, words: list[str], entries: np.ndarray) -> None:
        """Spreads pre-tokens over the leaves ``first`` to ``last`` and updates the character sums above them."""
        leaves = last - first + 1
        if len(words) > 4 * LEAF * leaves:  # outgrown: new leaves for all
            own = list(zip(self.words, self.entries, strict=True))
            self.build(own[:first] + list(self._leaves(words, entries)) + own[last + 1 :])
            return
        per = -(-len(words) // leaves) or 1
        for k in range(leaves):
            own = slice(k * per, (k + 1) * per)
            self.words[first + k], self.entries[first + k] = words[own], entries[own]
            self.chars[self.size + first + k] = sum(map(len, words[own]))
        self.stale.update(range(first, last + 1))
        low, high = (self.size + first) // 2, (self.size + last) // 2
        while low:
            for k in range(low, high + 1):
                self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            low, high = low // 2, high // 2


COUNTS = "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_chars_after long, n_recounted long"


def count_edited(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Token counts before and after the edits in the column ``edits``, an ordered array of (start, end, replacement)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.shared_encoder(ranks_path, pattern)
        for batch in batches:
            rows: list[list[int]] = []
            edits = iter(batch.column(2).to_pylist())
            for block in bpe.by_size([t or "" for t in batch.column(1).to_pylist()], BLOCK_CHARS):
                coder.make_room()
                trees = [CountTree.of(text, coder) for text in block]
                before = [tree.total for tree in trees]  # the block's words are encoded together
                n_edits = []
                for tree in trees:
                    changes = next(edits) or ()
                    n_edits.append(len(changes))
                    for change in changes:
                        tree.edit(change["start"] or 0, change["end"] or 0, change["replacement"] or "")
                # ... and so are the words that their edits made.
                rows += [[a, n, t.total, t.length, t.recounted] for a, n, t in zip(before, n_edits, trees, strict=True)]
            columns = [pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [c.split()[0] for c in COUNTS.split(", ")])

    return docs.select("doc_id", "text", "edits").mapInArrow(run, COUNTS)


def edited_counts(docs: DataFrame, edits: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Counts of every document after the rows of ``edits`` (``doc_id``, ``edit_no``, ``start``, ``end``, ``replacement``)."""
    types = {"edit_no": "long", "start": "long", "end": "long", "replacement": "string"}
    change = F.struct(*(F.col(name).cast(kind).alias(name) for name, kind in types.items()))
    by_doc = edits.groupBy(F.col("doc_id").cast("long").alias("edited")).agg(F.sort_array(F.collect_list(change)).alias("edits"))
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    rows = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("edited")), "left").select("doc_id", "text", "edits")
    return count_edited(rows, ranks_path, pattern)
