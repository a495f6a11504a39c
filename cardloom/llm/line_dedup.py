"""Line deduplication by repeated runs of lines.

A run of lines goes if an equal one stands earlier and it has two lines with words or more and at least ``MIN_WORDS``
words; a line of more than ``LONG_LINE`` words (several printed lines) goes alone, too.  The chunks that are compared
are the smallest runs with that much: one starts at every line with words and one ends there.  A chunk depends on its
own lines only, and the chunks within a run cover it whole: the chunk that starts at a line either fits into the run, or
the one that ends with the run reaches back over that line.  So every later copy goes from its first line with words to
its last, wherever it stands; copies may overlap, and a line repeated over and over leaves one.

Only chunk hashes are dealt out at first.  Chunks whose hash occurs again are fetched and compared byte by byte: per
hash and bytes one row with the first place, by document id and position, is made by partial aggregates; all chunks meet
it and go unless they stand there.  Chunks that very many documents hold are dealt by a salt, too, with a copy of that
row for each salt.  Every line that goes is preceded by an equal one that stays.

Defined cases: a null text stays null; documents with a null ``doc_id`` are left as they are; rows that repeat a
``doc_id`` with the same text count as one document and get the same result, with other texts as further documents;
blank lines count as lines but carry no words; extra columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm import _shared, _text

LONG_LINE = 50
MIN_WORDS = 10
#: Places of one chunk hash that share a salt.
SALTED = 500
_CHUNK = ["doc_id", "text_key", "hash", "first_byte", "end_byte"]


def chunks(block: _text.Block, min_words: int = MIN_WORDS, long_line: int = LONG_LINE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash, first byte and end byte (both within the text) of every candidate chunk of a block."""
    starts, ends, first = block.lines()
    prefix = block.prefix()
    word_starts, _ = block.runs(_text.WORD_BYTE)
    words = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
    text = np.repeat(np.arange(block.rows), np.diff(first))
    worded = np.flatnonzero(words)
    n = len(worded)
    of = text[worded]
    total = np.concatenate(([0], np.cumsum(words[worded])))
    each = np.arange(n)
    # The nearest line with which each one has enough words, at least the next: after it and before it.
    to = np.maximum(each + 1, np.searchsorted(total, total[:-1] + min_words) - 1)
    back = np.minimum(each - 1, np.searchsorted(total, total[1:] - min_words, "right") - 1)
    starting = to < n
    starting[starting] = of[to[starting]] == of[starting]
    ending = back >= 0
    ending[ending] = of[back[ending]] == of[ending]
    long = each[words[worded] > long_line]
    first_line = np.concatenate((each[starting], back[ending], long))
    last_line = np.concatenate((to[starting], each[ending], long))
    pairs = np.unique(np.column_stack((worded[first_line], worded[last_line])), axis=0)
    a, b = starts[pairs[:, 0]], ends[pairs[:, 1]]
    of = text[pairs[:, 0]]
    return of, block.hashes(prefix, a, b), a - block.offsets[of], b - block.offsets[of]


def _keyed(docs: DataFrame) -> DataFrame:
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").where("doc_id is not null and text is not null")
    return rows.withColumn("text_key", F.xxhash64("text"))


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, long_line: int = LONG_LINE) -> DataFrame:
    """``doc_id``, ``text_key`` and ``cuts``: the byte ranges of each document to remove."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _text.blocks(batch.column(2)):
                text, hashes, a, b = chunks(block, min_words, long_line)
                rows = pa.array(text + block.first)
                columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(hashes.view(np.int64)), pa.array(a), pa.array(b)]
                yield pa.RecordBatch.from_arrays(columns, _CHUNK)

    keyed = _keyed(docs)
    found = keyed.select("doc_id", "text_key", "text").mapInArrow(run, ", ".join(f"{c} long" for c in _CHUNK))
    found = _shared.save(found, "chunks")
    again = found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    again = again.select("hash", F.ceil(F.col("n") / SALTED).cast("int").alias("salts"))
    cand = _shared.save(found.join(again, "hash"), "chunks")
    _shared.drop(found)
    # The candidates' bytes: one row of places per document meets its text.
    chunk = ["hash", "salts", "first_byte", "end_byte"]
    places = cand.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct(*chunk)).alias("places"))
    held = keyed.join(places, ["doc_id", "text_key"]).select("doc_id", "text_key", F.col("text").cast("binary").alias("bytes"), F.explode("places").alias("p"))
    piece = F.substring("bytes", F.col("p.first_byte").cast("int") + 1, (F.col("p.end_byte") - F.col("p.first_byte")).cast("int"))
    held = held.select("doc_id", "text_key", *(f"p.{c}" for c in chunk), piece.alias("piece"))
    held = _shared.save(held, "pieces")
    place = F.struct("doc_id", "text_key", "first_byte")
    kept = held.groupBy("hash", "piece").agg(F.min(place).alias("kept"), F.max(place).alias("other"), F.max("salts").alias("salts"))
    kept = kept.where("kept != other").select("hash", "piece", "kept", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = held.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key", "first_byte"), F.col("salts")).cast("int"))
    gone = salted.join(kept, ["hash", "piece", "salt"]).where(place != F.col("kept"))
    return gone.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first_byte", "end_byte")).alias("cuts"))


def cut(text: str | None, ranges: list[tuple[int, int]]) -> tuple[str | None, int]:
    """The text without the lines in the byte ranges, and how many lines went."""
    if text is None or not ranges:
        return text, 0
    data = text.encode("utf-8", "surrogatepass")
    kept: list[bytes] = []
    at, gone = 0, 0
    for a, b in sorted(ranges):
        a = max(a, at)
        if b < a:
            continue
        kept.append(data[at:a])
        gone += data.count(b"\n", a, b) + 1
        at = min(b + 1, len(data) + 1)  # the line break after the chunk goes with it
    kept.append(data[at:])
    out = b"".join(kept)
    if at > len(data) and out.endswith(b"\n"):  # the last line went: so does the break before it
        out = out[:-1]
    return out.decode("utf-8", "surrogatepass"), gone


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, long_line: int = LONG_LINE) -> DataFrame:
    """The documents, all columns, with repeated chunks cut from ``text``; ``removed_lines`` is added."""
    spans = repeated_spans(docs, min_words, long_line)
    name = "removed_lines"
    own_id, own_key, own_cuts = _shared.unused(docs, "_id", "_key", "_cuts")
    keyed = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_key: F.xxhash64(F.col("text").cast("string"))})
    spans = spans.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key), F.col("cuts").alias(own_cuts))
    joined = keyed.join(spans, [own_id, own_key], "left").select(*docs.columns, own_cuts)
    schema = docs.select(*[c for c in docs.columns if c != name]).schema.add(name, "long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.string()).to_pylist()
            done = [
                cut(t, [(c["first_byte"], c["end_byte"]) for c in cuts or ()])
                for t, cuts in zip(texts, batch.column(own_cuts).to_pylist(), strict=True)
            ]
            columns = []
            for field in schema:
                if field.name == name:
                    columns.append(pa.array([d[1] for d in done], pa.int64()))
                elif field.name == "text":
                    columns.append(pa.array([d[0] for d in done], pa.string()))
                else:
                    columns.append(batch.column(field.name))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return joined.mapInArrow(run, schema)
