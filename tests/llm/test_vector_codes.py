"""Product codes held against a plain version."""

from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from cardloom.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, row int, codes string"


def plain(rows):
    """``(vec_id, label) -> (code, error, label_error)`` in id order, and the codebooks' digest."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = len(kept[0][1]) // 16
    kept = [r for r in kept if len(r[1]) == 16 * width]
    cut = [[tuple(math.floor(256 * x) for x in v[p * width : (p + 1) * width]) for p in range(16)] for _, v, *_ in kept]
    books = [[c[p] for c in cut[:64]] for p in range(16)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(2):
        got = [[[] for _ in b] for b in books]
        for c in cut:
            for p in range(16):
                got[p][nearest(p, c[p])[1]].append(c[p])
        books = [[tuple(sum(x) // len(g) for x in zip(*g, strict=True)) if g else e for g, e in zip(gs, b, strict=True)] for gs, b in zip(got, books, strict=True)]
    found = [[nearest(p, c[p]) for p in range(16)] for c in cut]
    by_label: dict = {}
    for r, f in zip(kept, found, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + sum(e for e, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{k:02x}" for _, k in f), sum(e for e, _ in f), by_label[r[2]]) for r, f in zip(kept, found, strict=True)], digest


def coded(spark, rows, monkeypatch):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    monkeypatch.setattr(queries, "table", lambda *_: df)
    out = queries.op11_vector_codes(spark, "").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in out), key=key), {r.codebooks_sha256 for r in out}


@pytest.mark.parametrize(("n", "width"), [(150, 2), (40, 1)])
def test_codes_match_plain_codes(spark, monkeypatch, n, width):
    """Few vectors, copies of a vector and of parts, ties, negative and large components, and rows that are dropped."""
    rng = random.Random(n)
    rows = [(k, [rng.choice((-0.5, 0.0, 0.125, 0.13, rng.uniform(-1, 1))) for _ in range(16 * width)], rng.choice((None, 1, 2, 2))) for k in range(n)]
    rows += [(n + k, rows[3][1], 1) for k in range(60)]
    rows += [(n + 100, [4e5, -4e5] * (8 * width), 3), (None, [0.25] * (16 * width), None)]
    bad = [(-9, None, 1), (-8, [], 1), (-7, [math.nan] * (16 * width), 1), (-6, [math.inf] + [0.0] * (16 * width - 1), 1), (-5, [None] * (16 * width), 1), (n + 200, [0.5] * (16 * width + 16), 1)]
    got, digests = coded(spark, rows + bad, monkeypatch)
    wanted, digest = plain(rows + bad)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert got == sorted(wanted, key=key) and digests == {digest}


def test_repeated_ids_huge_components_and_empty_tables(spark, monkeypatch):
    rows = [(1, [3e38] * 16, 1), (1, [-3e38] * 16, 1), (2, [0.0] * 16, None)]
    got, digests = coded(spark, rows, monkeypatch)
    assert [r[0] for r in got] == [1, 1, 2] and [r[2] for r in got] == [0, 0, 0] and len(digests) == 1
    assert coded(spark, [(1, None, 1)], monkeypatch) == ([], set())


def test_frequent_parts_and_labels_meet_by_broadcast(spark):
    """Parts and labels of a third of the rows go the way of the frequent keys and give the same rows."""
    from cardloom.functions.joins import join_counted

    rows = spark.range(300).select((F.col("id") % 100 * (F.col("id") % 3 == 0).cast("int")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    for frequent in (1, 2, 50, 10**6):
        out = join_counted(rows, table, ["k"], "n", frequent)
        assert out.count() == 300 and out.where("id % 3 = 0").agg(F.count_distinct("k")).first()[0] == 100
    assert vector_codes.compress(spark.createDataFrame([], SCHEMA))[1] is None
