"""Importance resampling towards a target: hashed word n-grams, log ratios a bucket, and a draw by Gumbel keys.

Features are all runs of one and of two words, joined by a space and repeated as often as they occur.  A feature's bucket
is the CRC-32 of its bytes modulo ``BUCKETS``.  The gain of a bucket compares how often target and corpus fill it, the
weight of a document is the mean gain of its features, and the draw adds a Gumbel variate made from the document's id.

Method
------
1. Texts are coded once, in blocks of about ``BLOCK_BYTES``: a block's different words, and its texts as numbers of these.
2. *Dictionary.*  Blocks deal their words to bins by hash; a bin numbers its different words, and the blocks get the
   numbers back.  Numbers are dense over all bins, so a word is an integer from here on.
3. *Tuples.*  A feature is one or two of these integers.  Blocks count their different tuples and deal them to bins by
   the hash of the integers; a tuple that every text holds is one entry a block.
4. *Hashes.*  Of the blocks that hold a tuple, a bin names the first.  That block puts the bytes of the tuple together
   and hashes them, the only time for this tuple, and sends the bucket to the bin.
5. The bin joins buckets with the counts of all blocks: sums a bucket and side go on, and every block gets the buckets of
   its tuples back.  ``BUCKETS`` sums a side reach the driver and become gains.
6. Blocks add up the gains of their documents.  Ranks are dense numbers over ranges of the score.

Bins hold a bounded number of entries and grow in number; blocks and bins exchange packed arrays and not a row a feature.

Defined cases: a null or empty text has no features and weight 0, and is never drawn; rows that repeat an id are documents
of their own with the same variate, ties among them in any order; a null id counts as an empty one and comes before all
others; an empty target or corpus has no counts; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions.numbering import numbered
from cardloom.llm import _shared, _text

BUCKETS = 10_000
#: Words that a document must have to be drawn, and how many of 100 such documents are.
LEAST_WORDS, DRAWN_PERCENT = 20, 25
SEED = 7
BLOCK_BYTES = 8 << 20
#: Words, and tuples, of one bin.
WORD_BIN, TUPLE_BIN = 1_000_000, 3_000_000
#: Turns in which bins get their tuples.
TURNS = 2
_WORD = _text.byte_class(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))
_DOWN = np.arange(256, dtype=np.uint8)
_DOWN[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CODED = "block long, doc_ids array<long>, lengths binary, seq binary, words array<binary>, n_words long, n_distinct long"
_SAID = "block long, bin long, said binary"


def coded(docs: DataFrame, id_col: str, side: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of texts as numbers of the block's own words; block numbers are even for side 0 and odd for side 1."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        for batch in batches:
            for part in _text.blocks(batch.column(1), block_bytes):
                starts, ends = part.runs(_WORD)
                hashes = part.hashes(part.prefix(lower=True), starts, ends)
                lengths = np.diff(np.searchsorted(starts, part.offsets))
                found, first, seq, often = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                by_count = np.argsort(-often, kind="stable")  # small numbers for frequent words pack well
                place = np.empty(len(found), np.int64)
                place[by_count] = np.arange(len(found))
                first, seq = first[by_count], place[seq]
                down = _DOWN[part.data].tobytes()
                words = [down[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                ids = batch.column(0).slice(part.first, part.rows)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.array(ids, pa.int64()), pa.array(words, pa.binary()))]
                blobs = [pa.array([_packed(x)], pa.binary()) for x in (lengths, seq)]
                longs = [pa.array([x], pa.int64()) for x in (number * 2 + side, len(seq), len(found))]
                yield pa.RecordBatch.from_arrays([longs[0], lists[0], *blobs, lists[1], *longs[1:]], [c.split()[0] for c in _CODED.split(", ")])
                number += 1

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _CODED)


def _bins(hashes: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by bin, and where each bin begins in it."""
    to = ((hashes >> np.uint64(32)) % np.uint64(bins)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    return order, np.searchsorted(to[order], np.arange(bins + 1))


def _filled(cuts: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(cuts)).tolist()


def _packed(values: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes as the largest needs, compressed, after one byte that says how many."""
    kind = np.min_scalar_type(values.max() if len(values) else 0)
    return bytes([kind.itemsize]) + zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<u{data[0]}").astype(np.uint64)


def _steps(numbers: np.ndarray) -> np.ndarray:
    """Twice what each number adds to the one before it; twice what it lacks, and one, where it is smaller."""
    step = np.diff(numbers, prepend=np.uint64(0))
    back = np.uint64(0) - step
    return np.where(step >> np.uint64(63), back << np.uint64(1) | np.uint64(1), step << np.uint64(1))


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of every word; words hold no blanks."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(words) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0] if len(words) else np.zeros(1, np.int64)
    block = _text.Block(0, data, offsets)
    return block.hashes(block.prefix(), offsets[:-1], offsets[1:])


def _rows(kinds: str, rows: list[tuple]) -> pa.Table:
    """A table of rows under a schema of long and binary columns."""
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds.split(", "))
    types = {"long": pa.int64(), "binary": pa.binary()}
    return pa.table({c.split()[0]: pa.array(x, types[c.split()[1]]) for c, x in zip(kinds.split(", "), columns, strict=True)})


def dictionary(blocks: DataFrame, bins: int) -> tuple[DataFrame, list[int]]:
    """``block``, ``bin``, ``said``: the places of a block's words among the different words of each bin; and where bins begin.

    A word's number is its bin's beginning and its place there, from 1 on; the beginnings are one number a million words.
    """

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(*(batch.column(c) for c in ("block", "words")), strict=True):
                order, cuts = _bins(_hashes(words.values), bins)
                to = _filled(cuts)
                lists = [words.values.take(pa.array(order[cuts[b] : cuts[b + 1]])) for b in to]
                flat = pa.concat_arrays([pa.array([], pa.binary()), *lists])
                held = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()] * len(to), pa.int64()), pa.array(to, pa.int64()), held], ["block", "bin", "words"])

    def numbers(table: pa.Table) -> pa.Table:
        lists = table.column("words").combine_chunks()
        codes = lists.flatten().dictionary_encode()
        cuts = np.concatenate(([0], np.cumsum(np.diff(np.asarray(lists.offsets)))))
        place = np.asarray(codes.indices).astype(np.uint64)
        rows = [(k, b, _packed(place[x:y])) for k, b, x, y in zip(table.column("block").to_pylist(), table.column("bin").to_pylist(), cuts[:-1], cuts[1:], strict=True)]
        rows.append((-1, rows[0][1], _packed(np.array([len(codes.dictionary)], np.uint64))))
        return _rows(_SAID, rows)

    words = blocks.select("block", "words").mapInArrow(dealt, "block long, bin long, words array<binary>")
    said = _shared.save(words.groupBy("bin").applyInArrow(numbers, _SAID), "dictionary")
    sizes = {r.bin: int(_unpacked(r.said)[0]) for r in said.where("block = -1").collect()}
    begins = np.concatenate(([0], np.cumsum([sizes.get(b, 0) for b in range(bins)])))
    return said.where("block != -1").selectExpr("block", "-1 - bin bin", "said"), begins.tolist()


class Features:
    """The different tuples of a block, its words first, then its pairs of neighbours; and where each of them occurs."""

    def __init__(self, row: dict, said: dict[int, bytes], begins: list[int]):
        words = row["words"].values
        self.lengths = _unpacked(row["lengths"].as_py()).astype(np.int64)
        n = len(words)
        ids = np.zeros(n, np.uint64)
        order, cuts = _bins(_hashes(words), len(begins) - 1)
        for b in _filled(cuts):
            ids[order[cuts[b] : cuts[b + 1]]] = _unpacked(said[-1 - b]) + np.uint64(begins[b] + 1)
        # From here on words stand in the order of their numbers, so tuples do, too.
        order = np.argsort(ids)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.words, ids = words.take(pa.array(order)), ids[order]
        self.seq = place[_unpacked(row["seq"].as_py()).astype(np.int64)]
        of = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.of = of
        self.pair_at = np.flatnonzero(of[1:] == of[:-1])
        pairs, self.pair_no, n_pairs = np.unique(self.seq[self.pair_at] * n + self.seq[self.pair_at + 1], return_inverse=True, return_counts=True)
        #: Places of the words in the block, the second -1 for single words.
        self.one = np.concatenate((np.arange(n), pairs // max(n, 1)))
        self.two = np.concatenate((np.full(n, -1), pairs % max(n, 1)))
        self.count = np.concatenate((np.bincount(self.seq, minlength=n), n_pairs)).astype(np.uint64)
        self.singles = n
        self.first = ids[self.one] if n else np.zeros(0, np.uint64)
        self.second = np.where(self.two < 0, np.uint64(0), ids[self.two]) if n else np.zeros(0, np.uint64)

    def bins(self, bins: int) -> tuple[np.ndarray, np.ndarray]:
        """The order that sorts tuples by bin, single words before pairs, each by its first word; and where bins begin."""
        return _bins(_text.mix(self.first * _STEP + _text.mix(self.second + _STEP)), bins)

    def texts(self, rows: np.ndarray) -> pa.Array:
        """Bytes of the tuples, their words joined by a space."""
        single = self.two[rows] < 0
        one = self.words.take(pa.array(self.one[rows]))
        two = self.words.take(pa.array(np.where(single, 0, self.two[rows])))
        return pc.if_else(pa.array(single), one, pc.binary_join_element_wise(one, two, b" "))


def _opened(left: pa.Table, right: pa.Table, begins: list[int]) -> Iterator[tuple[int, dict, Features, dict[int, bytes]]]:
    said = dict(zip(right.column("bin").to_pylist(), right.column("said").to_pylist(), strict=True))
    for k in range(len(left)):
        row = {c: left.column(c)[k] for c in left.column_names}
        yield row["block"].as_py(), row, Features(row, said, begins), said


def _numbers(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The tuple of every entry of a bin, counted from 0 over its different tuples; the counts; where each row begins."""
    first, second, count = ([_unpacked(x) for x in table.column(c).to_pylist()] for c in ("first", "second", "n"))
    first = [np.cumsum(np.where(x & np.uint64(1), np.uint64(0) - (x >> np.uint64(1)), x >> np.uint64(1)), dtype=np.uint64) for x in first]
    cuts = np.cumsum([0, *map(len, first)]).tolist()
    pair = np.concatenate((*first, *second))
    if len(pair) and pair.max() >> np.uint64(32):  # more words than half a key holds: by their order in this bin
        pair = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
    keys = (pair[: cuts[-1]] << np.uint64(32)) | pair[cuts[-1] :]
    return np.unique(keys, return_inverse=True)[1], np.concatenate(count).astype(np.int64), cuts


_OWNED = "block long, bin long, said binary, tuples binary, n binary"


def _owned(table: pa.Table) -> pa.Table:
    """For each block a bit for every tuple that it dealt: whether it is the first block here to hold it.

    And the tuples' numbers in the bin with their counts, which stand for the tuples from here on.
    """
    table = table.sort_by("block")
    no, count, cuts = _numbers(table)
    mine = np.zeros(len(no), bool)
    mine[np.unique(no, return_index=True)[1]] = True
    ends = zip(table.column("block").to_pylist(), table.column("bin").to_pylist(), cuts[:-1], cuts[1:], strict=True)
    return _rows(_OWNED, [(k, b, np.packbits(mine[x:y]).tobytes(), _packed(no[x:y]), _packed(count[x:y])) for k, b, x, y in ends])


def _joined(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Buckets of the owners' tuples joined to the counts of all blocks; sums a bucket come as blocks -1 and -2."""

    def run(held: pa.Table, hashed: pa.Table) -> pa.Table:
        held = held.sort_by("block")
        blocks, bin_no = held.column("block").to_pylist(), held.column("bin")[0].as_py()
        sent = dict(zip(hashed.column("block").to_pylist(), hashed.column("said").to_pylist(), strict=True))
        numbers = [_unpacked(x).astype(np.int64) for x in held.column("tuples").to_pylist()]
        every = np.concatenate(numbers)
        owner = np.unique(every, return_index=True)[1]
        bucket = np.zeros(len(owner), np.int64)
        bucket[every[np.sort(owner)]] = np.concatenate([_unpacked(sent[k]) for k in blocks if k in sent])
        sums = np.zeros((2, buckets), np.int64)
        rows = []
        for k, no, n in zip(blocks, numbers, held.column("n").to_pylist(), strict=True):
            rows.append((k, bin_no, _packed(bucket[no])))
            sums[k & 1] += np.bincount(bucket[no], _unpacked(n), buckets).astype(np.int64)
        rows += [(-1 - side, bin_no, sums[side].tobytes()) for side in (0, 1)]
        return _rows(_SAID, rows)

    return run


def bucket_counts(sums: DataFrame, buckets: int) -> tuple[list[int], list[int]]:
    """Features of the corpus and of the target in each bucket, from the bins' sums."""

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for side, said in zip(batch.column("block").to_pylist(), batch.column("said").to_pylist(), strict=True):
                total[-1 - side] += np.frombuffer(said, np.int64)
        side, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(side), pa.array(bucket), pa.array(total[side, bucket])], ["side", "bucket", "n"])

    out = [[0] * buckets, [0] * buckets]
    rows = sums.select("block", "said").mapInArrow(added, "side long, bucket long, n long")
    for r in rows.groupBy("side", "bucket").agg(F.sum("n").alias("n")).collect():  # two rows a bucket at most
        out[r.side][r.bucket] = r.n
    return out[0], out[1]


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """Thousandths of the log ratio of target to corpus a bucket, one added to each count, floored."""
    buckets, in_corpus, in_target = len(corpus), sum(corpus), sum(target)
    ratios = (float(t + 1) * float(in_corpus + buckets) / (float(s + 1) * float(in_target + buckets)) for s, t in zip(corpus, target, strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weights(docs: DataFrame, target: DataFrame, target_id: str = "item_id", buckets: int = BUCKETS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` of every document, as a written table."""
    blocks = coded(docs, "doc_id", 0, block_bytes).unionByName(coded(target, target_id, 1, block_bytes))
    blocks = _shared.save(blocks, "coded", "zstd")
    size = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"), F.coalesce(F.sum("n_distinct"), F.lit(0)).alias("distinct")).first()
    ids, begins = dictionary(blocks, int(size.distinct // WORD_BIN) + 1)
    bins = int(2 * size.words // TUPLE_BIN) + 1

    def dealt(turn: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = []
            for block, _, tuples, _ in _opened(left, right, begins):
                order, cuts = tuples.bins(bins)
                for b in _filled(cuts):
                    if b % TURNS == turn:
                        mine = order[cuts[b] : cuts[b + 1]]
                        rows.append((block, b, *map(_packed, (_steps(tuples.first[mine]), tuples.second[mine], tuples.count[mine]))))
            return _rows(grams_schema, rows)

        return run

    def hashed(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for block, _, tuples, said in _opened(left, right, begins):
            order, cuts = tuples.bins(bins)
            for b in _filled(cuts):
                mine = order[cuts[b] : cuts[b + 1]]
                mine = mine[np.unpackbits(np.frombuffer(said[b], np.uint8), count=len(mine)).astype(bool)]
                if len(mine):
                    values = np.array([zlib.crc32(x) for x in tuples.texts(mine).to_pylist()], np.uint64) % np.uint64(buckets)
                    rows.append((block, b, _packed(values)))
        return _rows(_SAID, rows)

    grams_schema = "block long, bin long, first binary, second binary, n binary"
    by_block = blocks.groupBy("block")
    parts = []
    for turn in range(TURNS):  # so that the disk holds the tuples of some bins at a time
        grams = by_block.cogroup(ids.groupBy("block")).applyInArrow(dealt(turn), grams_schema)
        parts.append(_shared.save(grams.groupBy("bin").applyInArrow(_owned, _OWNED), "owned", "none"))
    owned = reduce(DataFrame.unionByName, parts)
    sent = by_block.cogroup(ids.unionByName(owned.select("block", "bin", "said")).groupBy("block")).applyInArrow(hashed, _SAID)
    sent = _shared.save(sent, "hashed", "none")
    held = owned.select("block", "bin", "tuples", "n")
    found = _shared.save(held.groupBy("bin").cogroup(sent.groupBy("bin")).applyInArrow(_joined(buckets), _SAID), "buckets", "none")
    _shared.drop(*parts, sent)
    gain = gains(*bucket_counts(found.where("block < 0"), buckets))

    def weighed(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for _, row, tuples, said in _opened(left, right, begins):
            order, cuts = tuples.bins(bins)
            gained = np.zeros(len(order), np.int64)
            for b in _filled(cuts):
                gained[order[cuts[b] : cuts[b + 1]]] = gain[_unpacked(said[b]).astype(np.int64)]
            docs_ = len(tuples.lengths)
            n = tuples.singles
            total = np.bincount(tuples.of, gained[:n][tuples.seq], docs_) + np.bincount(tuples.of[tuples.pair_at], gained[n:][tuples.pair_no], docs_)
            features = tuples.lengths + np.maximum(tuples.lengths - 1, 0)
            weight = np.where(features > 0, total.astype(np.int64) // np.maximum(features, 1), 0)
            out.append(pa.table({"doc_id": row["doc_ids"].values, "n_words": pa.array(tuples.lengths), "n_features": pa.array(features), "weight": pa.array(weight)}))
        kinds = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight")])
        return pa.concat_tables([kinds.empty_table(), *out])

    corpus = blocks.where("block % 2 = 0").groupBy("block")
    said = ids.unionByName(found.where("block >= 0 and block % 2 = 0"))
    out = corpus.cogroup(said.where("block % 2 = 0").groupBy("block")).applyInArrow(weighed, "doc_id long, n_words long, n_features long, weight long")
    out = _shared.save(out, "weights")
    _shared.drop(blocks, found)
    return out


def resample(docs: DataFrame, target: DataFrame, target_id: str = "item_id", least_words: int = LEAST_WORDS, percent: int = DRAWN_PERCENT, seed: int = SEED, buckets: int = BUCKETS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null if not drawn) of every document."""
    rows = weights(docs, target, target_id, buckets, block_bytes)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    part = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((part + 0.5) / F.lit(4294967296.0))))
    rows = rows.withColumn("score", F.col("weight") + gumbel)
    able = rows.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    ranked = numbered(able, [F.desc("score"), F.asc_nulls_first("doc_id")], "rank", lambda df: _shared.save(df, "ranked"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    return ranked.unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
