"""Repeated passages by suffix trees that variable-length prefixes split into groups of bounded size.

A window is ``WINDOW`` consecutive words of one document.  A word goes if a window that covers it has the words of a window
of a document with a smaller id.

Method
------
1. Documents with equal words form a class, named by the digest of their words; all but the smallest id of a class repeat
   it whole.  From here on there is one text a class, in blocks of about ``BLOCK_BYTES``.
2. A suffix begins at every word that has a whole window before it ends.  It is read as symbols of ``SYMBOL`` words, so a
   window is the first five of them.  Equal windows of one block are one suffix, that of the smallest id.
3. *Prefixes.*  Blocks deal the hashes of their suffixes' prefixes, at first of ``FIRST`` symbols, to bins.  A prefix that a
   single document holds is a leaf right below the root: its suffixes go.  A prefix of at most ``GROUP`` suffixes is done.
   The others are made longer by one symbol and dealt again, until all are done or a whole window long.  Blocks get back
   one byte a prefix.
4. *Subtrees.*  All suffixes of a prefix meet in one bin, each with its symbols.  Sorted, with the depth to which
   neighbours agree, they are the subtree; its internal nodes as deep as a window are the repeats.  What lies below one of
   them repeats the smallest document there.  Blocks get back one bit a suffix.
5. The windows of repeats, laid together, are the repeated spans of a text; spans go back to all documents of a class.

Prefix hashes only deal: two prefixes that share a hash share a bin and a fate, no more.  A repeat is one if all symbols of
two windows agree, 64 bits for every ten words.  Bins grow in number and not in size; nothing about documents reaches the
driver but counts.

Defined cases: a null text has no words; a document with a null id repeats nothing and is repeated by none, so nothing of
it goes; rows that repeat an id are documents of their own with equal ids, and so do not repeat each other; fewer words
than a window have no window; extra columns are kept by :func:`remove_repeats`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions.joins import join_counted
from cardloom.llm import _shared, _text

WINDOW = 50
SYMBOL = 10
#: Symbols of the shortest prefixes.
FIRST = 2
#: Suffixes of one prefix that one task takes.
GROUP = 200_000
#: Prefixes of a bin when they are counted.
BIN = 2_000_000
BLOCK_BYTES = 6 << 20
#: A suffix that is not settled yet; others are dropped (0) or belong to a prefix of so many symbols.
OPEN = 255
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NOTHING = hashlib.sha256(b"").digest()
_BLOCK = "block long, keys array<binary>, ids array<long>, texts array<binary>"
_SPANS = "array<struct<first:int,end:int>>"


def offsets(window: int, symbol: int) -> list[int]:
    """Where a window's symbols begin; the last one ends with it."""
    symbol = min(symbol, window)
    return sorted({*range(0, window - symbol + 1, symbol), window - symbol})


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than U+0020 and U+0009 to U+000D."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words`` and ``key``, the SHA-256 of the words joined by one space, of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys = [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                counts.append(len(words))
                keys.append(hashlib.sha256(b" ".join(words)).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "n_words", "key"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_words long, key binary")


def class_texts(docs: DataFrame, classes: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """Blocks of the classes' words, joined by one space; one document a class is read for them."""

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i.as_py(), w) for i, t in zip(batch.column(0), batch.column(1), strict=True) if len(w := words_of(t.as_py())) >= window]
            texts = [b" ".join(w) for _, w in rows]
            keys = [hashlib.sha256(t).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array(keys, pa.binary()), pa.array(texts, pa.binary())], ["doc_id", "key", "words"])

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        held: list[tuple] = []
        size = 0
        last = None
        for batch in batches:
            for key, doc_id, words in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "words")), strict=True):
                if (key, doc_id) == last:  # rows that repeat an id and its words
                    continue
                last = key, doc_id
                if held and size + len(words) > block_bytes:
                    yield _block_row(number, held)
                    number, held, size = number + 1, [], 0
                held.append((key, doc_id, words))
                size += len(words)
        if held:
            yield _block_row(number, held)

    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").where("doc_id is not null")
    texts = texts.mapInArrow(joined, "doc_id long, key binary, words binary")
    reps = classes.select("key", F.col("first_id").alias("doc_id"))
    chosen = texts.join(reps, ["key", "doc_id"]).select("key", "doc_id", "words").sortWithinPartitions("key", "doc_id")
    return _shared.save(chosen.mapInArrow(blocks, _BLOCK), "blocks", "zstd")


def _block_row(number: int, held: list[tuple]) -> pa.RecordBatch:
    keys, ids, words = zip(*held, strict=True)
    lists = [pa.array([list(keys)], pa.list_(pa.binary())), pa.array([list(ids)], pa.list_(pa.int64())), pa.array([list(words)], pa.list_(pa.binary()))]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists], ["block", "keys", "ids", "texts"])


class Suffixes:
    """The suffixes of one block: a row for each of its different windows, in the order of their hashes."""

    def __init__(self, ids: pa.Array, texts: pa.Array, window: int, symbol: int):
        self.ids = np.asarray(ids, np.int64)
        self.window = window
        hashes, counts = [], []
        for part in _text.blocks(texts.cast(pa.large_binary()).cast(pa.large_string())):
            starts, ends = part.runs(_text.WORD_BYTE)
            hashes.append(part.hashes(part.prefix(), starts, ends))
            counts.append(np.diff(np.searchsorted(starts, part.offsets)))
        counts = np.concatenate(counts)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        of = np.repeat(np.arange(len(counts)), counts)
        begins = np.flatnonzero(of[: max(0, len(of) - window + 1)] == of[window - 1 :])
        self.offsets = offsets(window, symbol)
        self.grams = grams = _text.combine(np.concatenate(hashes), min(symbol, window))
        chain = grams[begins]
        for k in self.offsets[1:]:
            chain = _text.mix(chain * _STEP + grams[begins + k])
        own = self.ids[of[begins]]
        order = np.argsort(chain)
        ranked = chain[order]
        new = np.ones(len(order), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        same = np.flatnonzero(~new)
        if len(same):
            if any((grams[begins[order[same]] + k] != grams[begins[order[same - 1]] + k]).any() for k in self.offsets):  # different windows of one hash
                symbols = np.column_stack([grams[begins + k] for k in self.offsets])
                order = np.lexsort((own, *symbols.T, chain))
                new[1:] = (symbols[order[1:]] != symbols[order[:-1]]).any(axis=1)
            else:  # the smallest id first among equal windows
                inside = ~new
                inside[same - 1] = True
                some = order[inside]
                order[inside] = some[np.lexsort((own[some], chain[some]))]
        #: Where each window of the block begins, sorted so that equal windows stand together, the smallest id first.
        self.begins, self.window_no = begins[order], np.cumsum(new) - 1
        self.own_id = own[order]
        self.lead = np.flatnonzero(new)  # of each different window, its first place in ``begins``
        self.lead_at = self.begins[self.lead]
        self.lead_id = self.own_id[self.lead]
        #: Whether documents of different ids in this block hold the window.
        self.shared = np.zeros(len(self.lead), bool)
        self.shared[self.window_no[same][self.own_id[same] != self.lead_id[self.window_no[same]]]] = True

    def symbols(self, rows: np.ndarray) -> np.ndarray:
        """The symbols of the rows."""
        return np.column_stack([self.grams[self.lead_at[rows] + k] for k in self.offsets])

    def prefix(self, rows: np.ndarray, length: int) -> np.ndarray:
        """Hash of the first ``length`` symbols of the rows."""
        out = self.grams[self.lead_at[rows]]
        for k in self.offsets[1:length]:
            out = _text.mix(out * _STEP + self.grams[self.lead_at[rows] + k])
        return out

    def groups(self, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different prefixes of the rows: hash, how many rows, whether different ids hold it; and the prefix of each row."""
        found, no, n = np.unique(self.prefix(rows, length), return_inverse=True, return_counts=True)
        low = np.full(len(found), np.iinfo(np.int64).max)
        high = np.full(len(found), np.iinfo(np.int64).min)
        np.minimum.at(low, no, self.lead_id[rows])
        np.maximum.at(high, no, self.lead_id[rows])
        several = low != high
        several[no[self.shared[rows]]] = True
        return found, n, several, no


def _bins(hashes: np.ndarray, bins: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(bins)).astype(np.int64)


def _signed(hashes: np.ndarray) -> pa.Array:
    """The low 32 bits; within a bin they tell all but one in some thousand prefixes apart."""
    return pa.array((hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))


def _dealt(hashes: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by bin, and where each bin begins in it."""
    to = _bins(hashes, bins)
    order = np.argsort(to, kind="stable")
    return order, np.searchsorted(to[order], np.arange(bins + 1))


def _offer(suffixes: Suffixes, rows: np.ndarray, length: int, bins: int) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """For each bin: its number, the hashes of the block's prefixes that it gets, their counts and flags."""
    found, n, several, _ = suffixes.groups(rows, length)
    order, cuts = _dealt(found, bins)
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        mine = order[cuts[b] : cuts[b + 1]]
        yield b, _signed(found[mine]), n[mine], several[mine]


def _verdict(group: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """A bin's verdict on the prefixes of every block: 0 drop, 1 done, 2 too many suffixes."""

    def run(table: pa.Table) -> pa.Table:
        return _ruled(table, group, last)

    return run


def _ruled(table: pa.Table, group: int, last: bool) -> pa.Table:
    lists = table.column("prefixes").combine_chunks()
    sizes = np.diff(np.asarray(lists.offsets))
    prefixes = np.asarray(lists.flatten())
    n = np.asarray(table.column("n").combine_chunks().flatten(), np.int64)
    several = np.frombuffer(b"".join(table.column("several").to_pylist()), np.uint8).astype(bool)
    _, no, blocks = np.unique(prefixes, return_inverse=True, return_counts=True)
    total = np.bincount(no, n, len(blocks))
    more = blocks > 1
    more[no[several]] = True
    code = np.where(~more, 0, np.where((total <= group) | last, 1, 2)).astype(np.uint8)[no]
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    codes = [code[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"block": table.column("block"), "bin": table.column("bin"), "said": pa.array(codes, pa.binary())})


def _said(right: pa.Table) -> dict[int, bytes]:
    return dict(zip(right.column("bin").to_pylist(), right.column("said").to_pylist(), strict=True))


def settled(blocks: DataFrame, bins: int, homes: int, window: int, symbol: int, first: int, group: int) -> tuple[DataFrame, DataFrame]:
    """``block``, ``bin`` (-1), ``said``: of every suffix of a block the length of the prefix it belongs to, 0 if it was dropped.

    And the suffixes that are left, with their symbols and ids, by block and the bin that their prefix calls home.
    """
    depth = len(offsets(window, symbol))

    def offered(length: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = []
            for block, s, state in _opened(left, right, window, symbol):
                for b, prefixes, n, several in _offer(s, np.flatnonzero(state == OPEN), length, bins):
                    rows.append((block, b, prefixes, n, several.astype(np.uint8).tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            ints = lambda xs: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, xs)]), pa.int32()), pa.concat_arrays([pa.array([], pa.int32()), *(pa.array(x, pa.int32()) for x in xs)]))
            return pa.table({"block": pa.array(columns[0], pa.int64()), "bin": pa.array(columns[1], pa.int64()), "prefixes": ints(columns[2]), "n": ints(columns[3]), "several": pa.array(columns[4], pa.binary())})

        return run

    def told(length: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = []
            for block, s, state in _opened(left, right, window, symbol):
                open_rows = np.flatnonzero(state == OPEN)
                if len(open_rows):
                    found, _, _, no = s.groups(open_rows, length)
                    verdict = np.zeros(len(found), np.uint8)
                    order, cuts = _dealt(found, bins)
                    for b, codes in _said(right).items():
                        if b >= 0:
                            verdict[order[cuts[b] : cuts[b + 1]]] = np.frombuffer(codes, np.uint8)
                    state[open_rows] = np.array([0, length, OPEN], np.uint8)[verdict[no]]
                rows.append((block, -1, state.tobytes(), int((state == OPEN).sum()), [], []))
                for b, mine in _homes(s, state, length, homes):
                    rows.append((block, b, None, 0, s.symbols(mine).view(np.int64).reshape(-1), s.lead_id[mine]))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = {"block": pa.int64(), "bin": pa.int64(), "said": pa.binary(), "n_open": pa.int64()}
            held = {n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns, strict=False)}
            return pa.table(held | {"symbols": _lists(columns[4]), "ids": _lists(columns[5])})

        return run

    known = blocks.limit(0).selectExpr("block", "block bin", "keys[0] said")
    trees = None
    for length in range(min(first, depth), depth + 1):
        offers = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(offered(length), "block long, bin long, prefixes array<int>, n array<int>, several binary")
        ruled = offers.groupBy("bin").applyInArrow(_verdict(group, length == depth), "block long, bin long, said binary")
        ruled = _shared.save(ruled, "ruled")
        state = blocks.groupBy("block").cogroup(known.unionByName(ruled).groupBy("block")).applyInArrow(told(length), "block long, bin long, said binary, n_open long, symbols array<long>, ids array<long>")
        state = _shared.save(state, "state")
        _shared.drop(ruled)
        known = state.where("bin = -1").select("block", "bin", "said")
        grown = state.where("bin >= 0").select("block", "bin", "symbols", "ids")
        trees = grown if trees is None else trees.unionByName(grown)
        if not state.agg(F.sum("n_open")).first()[0]:
            break
    return known, trees


def _lists(arrays: Iterable[np.ndarray | list]) -> pa.Array:
    """Arrow lists of long."""
    arrays = [np.asarray(x, np.int64) for x in arrays]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _opened(left: pa.Table, right: pa.Table, window: int, symbol: int) -> Iterator[tuple[int, Suffixes, np.ndarray]]:
    """The block's number, its suffixes and what is settled about them so far."""
    said = _said(right).get(-1)
    for block, ids, texts in zip(left.column("block"), left.column("ids"), left.column("texts"), strict=True):
        suffixes = Suffixes(ids.values, texts.values, window, symbol)
        state = np.frombuffer(said, np.uint8).copy() if said is not None else np.full(len(suffixes.lead), OPEN, np.uint8)
        yield block.as_py(), suffixes, state


def deep_nodes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The subtree of the suffixes: their sorted order, and for each place there its node of full depth.

    Neighbours in order agree to the depth of their lowest common node; those that agree in all symbols lie below one
    internal node as deep as a window.
    """
    order = np.lexsort(symbols.T[::-1])
    depth = np.cumprod(symbols[order[1:]] == symbols[order[:-1]], axis=1).sum(axis=1)
    return order, np.concatenate(([0], np.cumsum(depth < symbols.shape[1])))[: len(order)]


def _below(table: pa.Table, depth: int) -> pa.Table:
    """A bit for every suffix of a bin: whether a document with a smaller id lies below its deep node."""
    lists = table.column("ids").combine_chunks()
    sizes = np.diff(np.asarray(lists.offsets))
    ids = np.asarray(lists.flatten())
    symbols = np.asarray(table.column("symbols").combine_chunks().flatten()).reshape(-1, depth)
    order, node = deep_nodes(symbols)
    smallest = np.full(node[-1] + 1 if len(node) else 0, np.iinfo(np.int64).max)
    np.minimum.at(smallest, node, ids[order])
    repeats = np.zeros(len(ids), bool)
    repeats[order] = smallest[node] < ids[order]
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    bits = [np.packbits(repeats[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"block": table.column("block"), "bin": table.column("bin"), "said": pa.array(bits, pa.binary())})


def _homes(s: Suffixes, state: np.ndarray, length: int, homes: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each bin the suffixes that go there by their prefix, of those whose prefix has so many symbols."""
    kept = np.flatnonzero(state == length)
    order, cuts = _dealt(_text.mix(s.prefix(kept, length)), homes)
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b + length * homes, kept[order[cuts[b] : cuts[b + 1]]]


def repeated_spans(docs: DataFrame, window: int = WINDOW, symbol: int = SYMBOL, first: int = FIRST, group: int = GROUP, block_bytes: int = BLOCK_BYTES, classes: DataFrame | None = None) -> DataFrame:
    """``key``, ``doc_id``, ``spans`` (word ranges, end exclusive), ``n_removed`` and ``kept_key`` of the smallest document of each class.

    ``kept_key`` is the SHA-256 of the words that are left, joined by one space.
    """
    classes = classes_of(keyed(docs), window) if classes is None else classes
    blocks = class_texts(docs, classes, window, block_bytes)
    total = classes.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    known, trees = settled(blocks, int(total // BIN) + 1, homes := int(total // max(1, 2 * group)) + 1, window, symbol, first, group)
    depth = len(offsets(window, symbol))

    def gathered(one: pa.Table, two: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for _, s, state_ in _opened(one, two, window, symbol):
            repeats = np.zeros(len(s.lead), bool)
            said = _said(two)
            for length in np.unique(state_[state_ > 0]).tolist():
                for b, rows in _homes(s, state_, length, homes):
                    repeats[rows] = np.unpackbits(np.frombuffer(said[b], np.uint8), count=len(rows)).astype(bool)
            gone = repeats[s.window_no] | (s.own_id > s.lead_id[s.window_no])
            covered = np.zeros(int(s.first[-1]) + 1, np.int64)
            np.add.at(covered, s.begins[gone], 1)
            np.add.at(covered, s.begins[gone] + window, -1)
            covered = np.cumsum(covered)[:-1] > 0
            for k, (key, doc_id, text) in enumerate(zip(*(one.column(c)[0].values for c in ("keys", "ids", "texts")), strict=True)):
                mine = covered[s.first[k] : s.first[k + 1]]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mine.view(np.int8), [0]))))
                spans = [{"first": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]
                kept_key = key.as_py()
                if spans:
                    words = text.as_py().split()
                    kept_key = hashlib.sha256(b" ".join([words[p] for p in np.flatnonzero(~mine)])).digest()
                out.append((key.as_py(), doc_id.as_py(), spans, int(mine.sum()), kept_key))
        columns = list(zip(*out, strict=True)) or [()] * 5
        span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
        kinds = (pa.binary(), pa.int64(), span, pa.int64(), pa.binary())
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("key", "doc_id", "spans", "n_removed", "kept_key"), columns, kinds, strict=True)})

    bits = _shared.save(trees.groupBy("bin").applyInArrow(lambda t: _below(t, depth), "block long, bin long, said binary"), "bits")
    out = blocks.groupBy("block").cogroup(known.unionByName(bits).groupBy("block")).applyInArrow(gathered, f"key binary, doc_id long, spans {_SPANS}, n_removed long, kept_key binary")
    out = _shared.save(out, "spans")
    _shared.drop(blocks, bits)
    return out


def classes_of(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """``key``, ``first_id``, ``n_words`` and ``members`` of every class that has an id and a window, as a written table."""
    held = rows.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    return _shared.save(held.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("n_words").alias("n_words"), F.count("*").alias("members")), "classes")


def find_repeats(docs: DataFrame, window: int = WINDOW, **how: int) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``key``, ``kept_key`` and ``spans`` of every document."""
    rows = _shared.save(keyed(docs), "rows")
    classes = classes_of(rows, window)
    spans = repeated_spans(docs, window, classes=classes, **how)
    asked = F.col("doc_id").isNotNull() & (F.col("n_words") >= window)
    held = join_counted(rows.where(asked), classes.select("key", "first_id", "members"), ["key"], "members")
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("end")))
    copies = held.where("doc_id > first_id").select("doc_id", "n_words", F.col("n_words").alias("n_removed"), "key", F.lit(_NOTHING).alias("kept_key"), whole.cast(_SPANS).alias("spans"))
    firsts = held.where("doc_id = first_id").select("doc_id", "n_words", "key").join(spans, ["key", "doc_id"])
    short = rows.where(~asked).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "key", F.col("key").alias("kept_key"), F.array().cast(_SPANS).alias("spans"))
    names = ["doc_id", "n_words", "n_removed", "key", "kept_key", "spans"]
    return copies.unionByName(firsts.select(*names)).unionByName(short)


def remove_repeats(docs: DataFrame, window: int = WINDOW, **how: int) -> DataFrame:
    """The documents, all columns; where words go, ``text`` becomes the words that are left, joined by one space.

    ``removed_words`` says how many went.
    """
    own_id, own_key, gone, n = _shared.unused(docs, "_id", "_key", "_spans", "_n")
    found = find_repeats(docs.select("doc_id", "text"), window, **how).where("n_removed > 0")
    found = found.select(F.col("doc_id").alias(own_id), F.col("key").alias(own_key), F.col("spans").alias(gone), F.col("n_removed").alias(n)).distinct()
    text = F.col("text").cast("string")
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_key: F.unhex(F.sha2(F.array_join(words, " "), 256))})
    rows = rows.join(found, [own_id, own_key], "left")
    left = F.filter(words, lambda w, k: ~F.exists(gone, lambda s: (s["first"] <= k) & (k < s["end"])))
    kept = [F.when(F.col(gone).isNull(), text).otherwise(F.array_join(left, " ")).alias(c) if c == "text" else F.col(c) for c in docs.columns]
    return rows.select(*kept, F.coalesce(n, F.lit(0)).cast("long").alias("removed_words"))
