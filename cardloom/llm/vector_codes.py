"""Product codes of vectors: codebooks by weighted Lloyd rounds over the distinct integer parts of each position.

Method
------
1. Every component becomes ``floor(SCALE * x)``; a vector is cut into ``PARTS`` equal consecutive parts.
2. Equal parts of one position become one row with a weight (partial aggregates first), so copies of a vector, however
   many, cost one row a position from there on.
3. A position's codebook starts as that part of the ``ENTRIES`` vectors with the smallest ids.  In each round every
   distinct part goes to its nearest entry (squared distance, ties to the lower index); tasks send one weighted sum an
   entry, and an entry becomes the componentwise floored mean of what it got.  Unused entries stay.
4. Parts are assigned once more; code and error of each distinct part are joined back to the vectors.  Parts that a large
   share of vectors hold meet them by a broadcast of their few rows, the others by a shuffle.

Only codebooks and the sums behind them pass through the driver: ``PARTS * ENTRIES`` rows, whatever the number of vectors.

Defined cases: vectors that are null, empty or hold null or non-finite components are dropped; so are those whose length
is not that of the kept vector with the smallest id (equal ids: the smallest components), or is no multiple of ``PARTS``;
components are held within ``LIMIT`` on either side, so that sums of squares stay whole numbers of 64 bits.  Rows that
repeat an id are vectors of their own; a null id comes last and stays null; fewer than ``ENTRIES`` vectors give fewer
entries; null labels are one label; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.joins import join_counted
from cardloom.llm import _shared

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
LIMIT = 1 << 27
#: Distances are taken for so many parts at once that they and their components make so many numbers.
STEP = 1 << 20


@dataclass
class Codebooks:
    """``entries[position]`` is the codebook of a position: one row an entry."""

    entries: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components by position, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def nearest(self, position: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part, the lower of equal ones, and the squared distance."""
        code, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        for p in np.unique(position):
            mine = np.flatnonzero(position == p)
            step = max(1, STEP // self.entries[p].size)
            for k in range(0, len(mine), step):
                at = mine[k : k + step]
                apart = parts[at][:, None, :] - self.entries[p][None, :, :]
                far = np.einsum("ned,ned->ne", apart, apart)
                code[at] = far.argmin(axis=1)
                error[at] = far[np.arange(len(at)), code[at]]
        return code, error


def vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """``row`` (a number of its own), ``vec_id``, ``label`` and the integer components ``v`` of every kept vector."""
    given = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("x"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    whole = lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int")
    held = given.where((F.size("x") > 0) & (F.size("x") % parts == 0) & F.forall("x", finite))
    held = _shared.save(held.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform("x", whole).alias("v")), "vectors")
    first = _smallest(held, 1).first()
    return held if first is None else held.where(F.size("v") == len(first.v))


def _smallest(held: DataFrame, n: int) -> DataFrame:
    return held.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(n)


def first_codebooks(held: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """The parts of the ``entries`` vectors with the smallest ids; none without vectors."""
    rows = np.array([r.v for r in _smallest(held, entries).collect()], np.int64)
    if not len(rows):
        return None
    return Codebooks(np.ascontiguousarray(rows.reshape(len(rows), parts, -1).transpose(1, 0, 2)))


def distinct_parts(held: DataFrame, parts: int = PARTS) -> DataFrame:
    """``position``, ``part`` and ``weight``: every distinct part and how many vectors hold it, as a written table."""
    return _shared.save(_exploded(held, parts).groupBy("position", "part").agg(F.count("*").alias("weight")), "parts")


def _exploded(held: DataFrame, parts: int) -> DataFrame:
    width = F.floor(F.size("v") / parts).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.slice("v", k * width + 1, width))
    return held.select("row", F.posexplode(cuts).alias("position", "part"))


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    flat = np.asarray(batch.column(1).flatten(), np.int64)
    return batch.column(0).to_numpy(), flat.reshape(len(batch), -1)


def refined(parts: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one weighted Lloyd round over the distinct parts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, m, width = books.entries.shape
        sums, weights = np.zeros((n * m, width), np.int64), np.zeros(n * m, np.int64)
        for batch in batches:
            position, values = _columns(batch)
            weight = batch.column(2).to_numpy()
            place = position * m + books.nearest(position, values)[0]
            np.add.at(sums, place, values * weight[:, None])
            np.add.at(weights, place, weight)
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(weights[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], ["place", "weight", "sums"])

    n, m, width = books.entries.shape
    given = parts.select("position", "part", "weight").mapInArrow(run, "place long, weight long, sums array<long>")
    total = given.groupBy("place").agg(F.sum("weight").alias("weight"), *(F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(width)))
    entries = books.entries.copy().reshape(n * m, width)
    for r in total.collect():  # one row an entry
        entries[r.place] = [int(r[f"s{d}"]) // r.weight for d in range(width)]
    return Codebooks(entries.reshape(n, m, width))


def assigned(parts: DataFrame, books: Codebooks) -> DataFrame:
    """The distinct parts with the index of their nearest entry (``code``) and their squared distance (``error``), written."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = books.nearest(*_columns(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], ["position", "part", "weight", "code", "error"])

    return _shared.save(parts.select("position", "part", "weight").mapInArrow(run, "position int, part array<int>, weight long, code long, error long"), "assigned")


def train(held: DataFrame, weighted: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after all rounds."""
    books = first_codebooks(held, parts, entries)
    for _ in range(rounds if books else 0):
        books = refined(weighted, books)
    return books


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, **columns: str) -> tuple[DataFrame, Codebooks | None]:
    """``vec_id``, ``label``, ``codes`` (an index a position) and ``error`` of every kept vector; and the codebooks."""
    held = vectors(rows, parts=parts, scale=scale, **columns)
    weighted = distinct_parts(held, parts)
    books = train(held, weighted, parts, entries, rounds)
    if books is None:
        return held.select("vec_id", "label", F.array().cast("array<long>").alias("codes"), F.lit(0).cast("long").alias("error")), None
    coded = assigned(weighted, books)
    _shared.drop(weighted)
    found = join_counted(_exploded(held, parts), coded, ["position", "part"], "weight")
    codes = F.transform(F.array_sort(F.collect_list(F.struct("position", "code"))), lambda s: s["code"])
    by_row = found.groupBy("row").agg(codes.alias("codes"), F.sum("error").alias("error"))
    return held.select("row", "vec_id", "label").join(by_row, "row").select("vec_id", "label", "codes", "error"), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``, the error summed over the rows of equal labels, nulls together."""
    (no_label, label) = _shared.unused(coded, "_no_label", "_label")
    keyed = coded.withColumns({no_label: F.col("label").isNull(), label: F.coalesce(F.col("label").cast("string"), F.lit(""))})
    keyed = _shared.save(keyed, "coded")
    sums = _shared.save(keyed.groupBy(no_label, label).agg(F.sum("error").alias("label_error"), F.count("*").alias("_rows")), "labels")
    return join_counted(keyed, sums, [no_label, label], "_rows").select(*coded.columns, "label_error")
