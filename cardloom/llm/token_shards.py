"""Token sequences in training order as fixed-stride binary shards.

Documents are ordered by id and text hash, encoded, closed with the end id and laid end to end; the stream is cut into
sequences of ``length`` ids, numbered 0 .. N-1, so only the last one is padded (with end ids).  A keyed Feistel network
permutes the numbers; numbers that fall outside N walk on along their cycle until they are inside, so every sequence
gets one global slot and every slot one sequence, without a table and without sorting by a random key.  Slots are dealt
in ranges, one range a shard: a shard is a file of ``per_shard`` records of equal size, so slot s stands at byte
``(s % per_shard) * stride`` of shard ``s // per_shard`` and a reader resumes anywhere by arithmetic.

The order depends on the documents alone, not on files or partitions: they are dealt out by ranges of id and hash, each
range counts its ids, and one sum a range reaches the driver and is broadcast back.  A sequence can hold the end of one
document and the start of the next, which other tasks encode; their pieces meet where the shard is written.  A task
sorts its slots (Spark spills as needed) and streams them to a file under a temporary name, moved into place when whole;
a task that is run again writes the same bytes.  The shards are written in ``PASSES`` passes over the encoded table, each
for its range of slots, so only that part of the ids lies in shuffle files at a time.  ``out`` is any location that all
executors and the reader share.

Defined cases: a null or empty text is the end id alone; a null ``doc_id`` comes first and is carried through; repeated
rows are separate documents; extra columns are ignored; an empty table writes no shard and returns no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm import _shared, _text, bpe

LENGTH = 256
PER_SHARD = 32_768
ROUNDS = 6
#: Tasks that write shards; beyond it a task writes several.
WRITERS = 20_000
#: Passes over the encoded table, each shuffling its share of the ids.
PASSES = 2
#: Where the ids of a document from ``first_token`` on went: into sequence ``seq_no``, ``n_tokens`` of them.
PLACES = "doc_id long, first_token long, seq_no long, slot long, shard long, byte_offset long, n_tokens long"


class Permutation:
    """A keyed bijection of 0 .. n-1."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = _text.keyed(ROUNDS, key)

    def _once(self, x: np.ndarray, keys: np.ndarray, inverse: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            if inverse:
                left, right = right ^ (_text.mix(left ^ k) & self.mask), left
            else:
                left, right = right, left ^ (_text.mix(right ^ k) & self.mask)
        return (left << self.half) | right

    def _walk(self, x: np.ndarray, keys: np.ndarray, inverse: bool) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), keys, inverse)
        while len(outside := np.flatnonzero(out >= self.n)):
            out[outside] = self._once(out[outside], keys, inverse)
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        """Where each sequence goes."""
        return self._walk(number, self.keys, False)

    def number(self, slot: np.ndarray) -> np.ndarray:
        """Which sequence stands in each slot."""
        return self._walk(slot, self.keys[::-1], True)


def id_type(ranks_path: str, end_id: int) -> np.dtype:
    """The smallest unsigned type that holds every id."""
    return np.dtype("<u2" if max(end_id, *bpe.load_ranks(ranks_path).values()) < 1 << 16 else "<u4")


def encoded(docs: DataFrame, ranks_path: str, pattern: str, end_id: int) -> DataFrame:
    """Each document's ids in the order of the documents, and how many ids stand before it in its partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.shared_encoder(ranks_path, pattern)
        kind = id_type(ranks_path, end_id)
        before = 0
        for batch in batches:
            done = 0
            for block in bpe.by_size([t or "" for t in batch.column(1).to_pylist()]):
                ids = [np.append(x, end_id).astype(kind) for x in coder.encode(block)]
                sizes = [len(x) for x in ids]
                starts = [*accumulate(sizes, initial=before)]
                before = starts.pop()
                rows = slice(done, done + len(block))
                done += len(block)
                columns = [pa.array(sizes, pa.int64()), pa.array(starts, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], batch.column(2)[rows], *columns], ["doc_id", "part", "n_tokens", "tokens_before", "ids"]
                )

    order = ["doc_id", "text_key", "row"]  # rows equal in both are interchangeable; their number parts hot ids
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    rows = rows.withColumns({"text_key": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    return rows.mapInArrow(run, "doc_id long, part int, n_tokens long, tokens_before long, ids binary")


def _binary(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary column."""
    array = batch.column(column)
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
    return offsets, np.frombuffer(array.buffers()[2] or b"", np.uint8)


def materialise(
    docs: DataFrame,
    out: str,
    ranks_path: str,
    pattern: str,
    end_id: int,
    key: int,
    length: int = LENGTH,
    per_shard: int = PER_SHARD,
) -> DataFrame:
    """Writes the shards into the folder ``out``, once, and returns where every document's ids went (a written table)."""
    spark = docs.sparkSession
    table = _shared.save(encoded(docs, ranks_path, pattern, end_id), "encoded", "zstd")
    sums = sorted((r.part, r.n) for r in table.groupBy("part").agg(F.sum("n_tokens").alias("n")).toLocalIterator())
    bases = [0, *accumulate(n for _, n in sums)]
    total = bases.pop()
    if not total:
        return spark.createDataFrame([], PLACES)
    base = spark.createDataFrame([(p, b) for (p, _), b in zip(sums, bases, strict=True)], "part int, base long")
    kind = id_type(ranks_path, end_id)
    stride = length * kind.itemsize
    n_seqs = -(-total // length)
    order = Permutation(n_seqs, key)
    last_slot, last_size = int(order.slot(np.array([n_seqs - 1]))[0]), total - (n_seqs - 1) * length
    n_shards = -(-n_seqs // per_shard)
    shards_each = -(-n_shards // WRITERS)
    n_writers = -(-n_shards // shards_each)

    def cut(batches: Iterable[pa.RecordBatch], low: int, high: int) -> Iterator[pa.RecordBatch]:
        """The pieces of writers ``low`` to ``high - 1``."""
        for batch in batches:
            if not batch.num_rows:
                continue
            start, size = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            first = start // length
            n = (start + size - 1) // length - first + 1
            doc = np.repeat(np.arange(len(n)), n)
            seq = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(doc))
            a = np.maximum(start[doc], seq * length)
            b = np.minimum(start[doc] + size[doc], (seq + 1) * length)
            offsets, data = _binary(batch, 3)
            ends = np.concatenate(([0], np.cumsum((b - a) * kind.itemsize))) + offsets[0]  # the pieces lie end to end, too
            ids = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)])
            slots = order.slot(seq.astype(np.uint64))
            writer = (slots // per_shard // shards_each).astype(np.int32)
            columns = [pa.array(a - start[doc]), pa.array(seq), pa.array(slots), pa.array(a - seq * length), pa.array(writer), ids]
            rows = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), *columns], ["doc_id", "first_token", "seq_no", "slot", "at", "writer", "ids"])
            yield rows.filter(pa.array((writer >= low) & (writer < high)))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(out)
        store.create_dir(folder)
        current, stream, draft = -1, None, ""

        def close() -> None:
            stream.close()
            store.move(draft, f"{folder}/shard-{current:06d}.bin")

        for batch in batches:
            slots, at = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            offsets, data = _binary(batch, 6)
            sizes = np.diff(offsets).astype(np.int64) // kind.itemsize
            shards = slots // per_shard
            for shard in np.unique(shards).tolist():
                if shard != current:
                    if stream is not None:
                        close()
                    current, draft = shard, f"{folder}/.{uuid.uuid4().hex}"
                    stream = store.open_output_stream(draft)
                low, high = np.searchsorted(shards, [shard, shard + 1])
                for k in low + np.flatnonzero((slots[low:high] == last_slot) & (at[low:high] + sizes[low:high] == last_size)):
                    stream.write(data[offsets[low] : offsets[k + 1]])  # the end of the last sequence, at most once
                    stream.write(np.full(length - last_size, end_id, kind).tobytes())
                    low = k + 1
                stream.write(data[offsets[low] : offsets[high]])
            columns = [pa.array(shards), pa.array(slots % per_shard * stride + at * kind.itemsize), pa.array(sizes)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], [c.split()[0] for c in PLACES.split(", ")])
        if stream is not None:
            close()

    rows = table.join(F.broadcast(base), "part").selectExpr("doc_id", "base + tokens_before first", "n_tokens", "ids")
    bounds = [n_writers * k // PASSES for k in range(PASSES + 1)]
    places = []
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        if low == high:
            continue
        pieces = rows.mapInArrow(
            lambda batches, low=low, high=high: cut(batches, low, high),
            "doc_id long, first_token long, seq_no long, slot long, at long, writer int, ids binary",
        )
        dealt = pieces.repartitionById(high - low, F.col("writer") - low).sortWithinPartitions("slot", "at")
        places.append(_shared.save(dealt.mapInArrow(write, PLACES), "places"))
    _shared.drop(table)
    return reduce(DataFrame.unionByName, places)


def read_slots(path: str, first: int, last: int, length: int, per_shard: int, kind: np.dtype) -> Iterator[np.ndarray]:
    """The records of slots ``first`` to ``last - 1``, read in order from the shards."""
    store, folder = fs.FileSystem.from_uri(path)
    stride = length * kind.itemsize
    slot = first
    while slot < last:
        shard, place = divmod(slot, per_shard)
        n = min(last - slot, per_shard - place)
        with store.open_input_file(f"{folder}/shard-{shard:06d}.bin") as file:
            file.seek(place * stride)
            data = np.frombuffer(file.read(n * stride), kind)
        yield from data.reshape(-1, length)
        slot += n
