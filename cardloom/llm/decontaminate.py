"""Benchmark decontamination by spaced-seed hashing.

A mask such as ``11011001`` hashes the words under its ones and ignores those under its zeros, so a seed still matches
when an ignored word was replaced.  Seeds of the test items and of the documents are joined on their hashes; around
each hit the document and the item are aligned, and the hit counts only if some ``WINDOW`` aligned words differ in at
most ``SUBSTITUTIONS`` places.  The fixed masks hit every such overlap.  An item of 8 to 12 words counts as a whole, with
as many substitutions; below 12 its masks come from quarters of the item, each pair of quarters being one mask: two
replaced words leave two quarters untouched.  A shorter item counts only if it stands there word for word.

The test items are a query set: they are read in blocks of at most ``BLOCK_WORDS`` words, each block becomes a sorted
seed table of bounded size that the tasks hold, and every document meets every block where it is read.  More items mean
more blocks, never a larger table.  A bitmap of the seed hashes turns away nearly all document positions before the
join.  Words are lower-cased runs of letters and digits, so case and punctuation do not matter.

Defined cases: a null document text has no words and is clean; null, empty or wordless items match nothing; an item with
a null id contaminates like any other but is not listed; a null ``doc_id`` is carried through; rows repeating a
``doc_id`` share one verdict in the report, contaminated if any of them is, while the filter judges each row; repeated
items are compared once and reported by each of their ids; extra columns are kept by the filter and ignored by the
report; empty tables give empty or clean results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm import _shared, _text

#: Fixed masks; spans of 7 to 12 words, 5 of them looked at.
MASKS = ("1101011", "11010011", "110010000101")
WINDOW = 13
SUBSTITUTIONS = 2
#: Shorter items are looked for word for word; those of fewer words than ``MASKED`` have masks of their own.
VERBATIM, MASKED = 8, 12
#: Words of test items in one seed table (tens of MB), and passes over the documents before the result is written.
BLOCK_WORDS = 1_000_000
CHAINED = 4
#: Aligned words that are compared at a time.
COMPARED = 1_000_000
MATCHES = "doc_id long, item_id long, start long, n_aligned long, n_equal long"

_TOKEN_BYTE = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each block of texts: the first text's row, the word hashes, and where each text's words start."""
    for block in _text.blocks(column):
        starts, ends = block.runs(_TOKEN_BYTE)
        yield block.first, block.hashes(block.prefix(lower=True), starts, ends), np.searchsorted(starts, block.offsets)


def seeds(words: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hash of the looked-at words under the mask at every position where it fits."""
    size = len(words) - len(mask) + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    looked = [k for k, bit in enumerate(mask) if bit == "1"]
    out = np.full(size, number + 1, np.uint64)
    for k, factor in zip(looked, _text.keyed(len(looked), 101) | np.uint64(1), strict=True):
        out += words[k : k + size] * factor
    return _text.mix(out)


def masks_for(n_words: int) -> tuple[str, ...]:
    """The masks that an item of so many words is looked for with."""
    if n_words >= MASKED:
        return MASKS
    if n_words < VERBATIM:
        return ("1" * n_words,)
    quarter = [4 * k // n_words for k in range(n_words)]
    return tuple("".join("01"[q in pair] for q in quarter) for pair in combinations(range(4), 2))


_NUMBER = {mask: k for k, mask in enumerate(dict.fromkeys(m for n in range(1, MASKED + 1) for m in masks_for(n)))}


class SeedTable:
    """The seeds of one block of test items, sorted by hash."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]]):
        ids: dict[bytes, list[int | None]] = {}
        for i, w in items:
            if len(w):
                ids.setdefault(w.tobytes(), []).append(i)
        self.ids = list(ids.values())
        self.words = [np.frombuffer(w, np.uint64) for w in ids]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.flat = np.concatenate([np.zeros(0, np.uint64), *self.words])
        self.start = np.cumsum(self.size) - self.size
        of_mask: dict[str, list[int]] = {}
        for k, w in enumerate(self.words):
            for mask in masks_for(len(w)):
                of_mask.setdefault(mask, []).append(k)
        self.tables = []
        for mask, own in of_mask.items():
            hashes = [seeds(self.words[k], mask, _NUMBER[mask]) for k in own]
            flat = np.concatenate(hashes)
            order = np.argsort(flat, kind="stable")
            item = np.repeat(own, [len(h) for h in hashes])[order]
            place = np.concatenate([np.arange(len(h)) for h in hashes])[order]
            self.tables.append((mask, flat[order], item, place))
        total = sum(len(t[1]) for t in self.tables)
        self.shift = np.uint64(64 - max(20, int(8 * total).bit_length()))
        self.bitmap = np.zeros(1 << (64 - int(self.shift)), bool)
        for _, flat, _, _ in self.tables:
            self.bitmap[flat >> self.shift] = True

    def hits(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(text, item, document position of the item's first word) of every seed hit, each once, in order."""
        found = [np.zeros((0, 3), np.int64)]
        for mask, flat, item, place in self.tables:
            own = seeds(words, mask, _NUMBER[mask])
            at = np.flatnonzero(self.bitmap[own >> self.shift])
            if not len(at):
                continue
            text = np.searchsorted(first, at, "right") - 1
            fits = at + len(mask) <= first[text + 1]  # a mask never reaches into the next text
            at, text = at[fits], text[fits]
            low, high = np.searchsorted(flat, own[at], "left"), np.searchsorted(flat, own[at], "right")
            n = high - low
            of = np.repeat(np.arange(len(at)), n)
            seed = np.arange(len(of)) + np.repeat(low - (np.cumsum(n) - n), n)
            found.append(np.column_stack((text[of], item[seed], at[of] - first[text[of]] - place[seed])))
        return np.unique(np.concatenate(found), axis=0)

    def matches(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int | None, int, int, int]]:
        """(text, item id, first aligned word, aligned words, equal words) of every verified hit."""
        text, item, shift = self.hits(words, first).T
        a = np.maximum(shift, 0)
        n = np.minimum(first[text + 1] - first[text], shift + self.size[item]) - a
        width = np.minimum(WINDOW, self.size[item])
        needed = width - np.where(self.size[item] < VERBATIM, 0, SUBSTITUTIONS)
        could = np.flatnonzero(n >= width)
        total = np.cumsum(n[could])
        while len(could):
            part = max(1, int(np.searchsorted(total, COMPARED, "right")))
            own, could, total = could[:part], could[part:], total[part:] - total[part - 1]
            size = n[own]
            ends = np.cumsum(size)
            k = np.repeat(np.arange(part), size)
            within = np.arange(len(k)) - np.repeat(ends - size, size)
            theirs = self.start[item[own]] + a[own] - shift[own]
            equal = words[(first[text[own]] + a[own])[k] + within] == self.flat[theirs[k] + within]
            summed = np.concatenate(([0], np.cumsum(equal)))
            to = np.arange(len(k)) + width[own][k]
            in_window = np.where(to <= ends[k], summed[np.minimum(to, len(k))] - summed[:-1], 0)
            good = np.maximum.reduceat(in_window, ends - size) >= needed[own]
            n_equal = summed[ends] - summed[ends - size]
            for h, same in zip(own[good].tolist(), n_equal[good].tolist(), strict=True):
                for i in self.ids[item[h]]:
                    yield int(text[h]), i, int(a[h]), int(n[h]), same


def seed_tables(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[SeedTable]:
    """The test items in blocks, in the order of their ids."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [w[a:b].tobytes() for _, w, f in word_hashes(batch.column(1)) for a, b in zip(f[:-1], f[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["item_id", "words"])

    rows = benchmark.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").where("text is not null")
    block: list[tuple[int | None, np.ndarray]] = []
    size = 0
    for row in rows.mapInArrow(hashed, "item_id long, words binary").orderBy("item_id", "words").toLocalIterator():
        words = np.frombuffer(bytes(row.words), np.uint64)
        if block and size + len(words) > block_words:
            yield SeedTable(block)
            block, size = [], 0
        block.append((row.item_id, words))
        size += len(words)
    if block:
        yield SeedTable(block)


def find_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every verified overlap of a document with a test item."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    spark = docs.sparkSession
    out = spark.createDataFrame([], MATCHES)
    sent: list[Broadcast[SeedTable]] = []
    for table in seed_tables(benchmark):
        if len(sent) == CHAINED:
            out = _written(out, "matches", sent)
        sent.append(spark.sparkContext.broadcast(table))

        def run(batches: Iterable[pa.RecordBatch], held=sent[-1]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for row, words, first in word_hashes(batch.column(1)):
                    found += [(row + m[0], *m[1:]) for m in held.value.matches(words, first)]
                columns = list(zip(*found, strict=True)) or [[]] * 5
                ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns[1:])], [c.split()[0] for c in MATCHES.split(", ")])

        out = out.unionByName(rows.mapInArrow(run, MATCHES))
    return out


def _written(df: DataFrame, name: str, sent: list[Broadcast[SeedTable]]) -> DataFrame:
    """The table as written; the seed tables that it was made with are given up."""
    out = _shared.save(df, name)
    while sent:
        sent.pop().destroy()
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: ``contaminated``, the items it overlaps and the largest number of equal words."""
    matches = find_matches(docs, benchmark)
    by_doc = matches.groupBy(F.col("doc_id").alias("matched")).agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("n_equal").alias("most_equal")
    )
    out = docs.selectExpr("cast(doc_id as long) doc_id").join(by_doc, F.col("doc_id").eqNullSafe(F.col("matched")), "left")
    return out.select(
        "doc_id",
        F.col("most_equal").isNotNull().alias("contaminated"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
        F.coalesce("most_equal", F.lit(0)).alias("most_equal"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that overlap no test item; each block of items filters in the same pass."""
    sent: list[Broadcast[SeedTable]] = []
    for table in seed_tables(benchmark):
        if len(sent) == CHAINED:
            docs = _written(docs, "clean", sent)
        sent.append(docs.sparkSession.sparkContext.broadcast(table))

        def run(batches: Iterable[pa.RecordBatch], held=sent[-1]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for row, words, first in word_hashes(batch.column("text").cast(pa.string())):
                    for match in held.value.matches(words, first):
                        clean[row + match[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
