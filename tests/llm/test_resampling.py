"""Importance resampling held against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest

from cardloom.llm import queries, resampling
from tests.llm.brute import LICENSE_WORD, lower
from tests.llm.conftest import LONG, edge_texts, passage


def plain(docs, target, buckets=10_000):
    """``(doc_id, n_features, weight, score, rank)`` of every document."""

    def features(text):
        w = LICENSE_WORD.findall(lower(text or ""))
        return w, [zlib.crc32(f.encode()) % buckets for f in [*w, *map(" ".join, zip(w, w[1:], strict=False))]]

    corpus, wanted = Counter(), Counter()
    held = [(i, *features(t)) for i, t in docs]
    for _, _, f in held:
        corpus.update(f)
    for _, t in target:
        wanted.update(features(t)[1])
    s_all, t_all = corpus.total(), wanted.total()
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((corpus[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for i, w, f in held:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


def order(r):
    return tuple(-(10**9) if x is None else x for x in r)


def drawn(spark, monkeypatch, docs, target, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, words string, block int").repartition(3)
    items = spark.createDataFrame(target, "item_id long, text string")
    out = resampling.resample(df, items, **how).select("doc_id", "n_features", "weight", "score", "rank").collect()
    return sorted(map(tuple, out), key=order)


@pytest.mark.parametrize("how", [{}, {"block_bytes": 300}])
def test_draw_matches_a_plain_draw(spark, monkeypatch, how):
    """Also with very many blocks and bins; words of many scripts, ties, copies, and a word that most texts hold."""
    if how:
        monkeypatch.setattr(resampling, "WORD_BIN", 50)
        monkeypatch.setattr(resampling, "TUPLE_BIN", 100)
    rng = random.Random(5)
    docs = [(k, " the ".join(passage(rng.randrange(40), 12) for _ in range(rng.randrange(5)))) for k in range(60)]
    docs += [(100, docs[3][1].upper()), (101, "é 漢字 É x9 " * 8), (102, "a" * 3000), (103, None), (104, "?!"), (None, docs[5][1]), (None, None)]
    target = [(1, docs[7][1]), (2, passage(3, 40)), (3, None), (3, "the the the")]
    assert drawn(spark, monkeypatch, docs, target, **how) == sorted(plain(docs, target), key=order)


def test_edge_texts_and_empty_sides(spark, monkeypatch, no_docs):
    docs = [(k, t) for k, t in enumerate(edge_texts())] + [(7, edge_texts()[7]), (200, LONG + " end")]
    target = [(1, edge_texts()[7])]
    got, wanted = drawn(spark, monkeypatch, docs, target), sorted(plain(docs, target), key=order)
    assert [r[:4] for r in got] == [r[:4] for r in wanted] and sorted(r[4] for r in got if r[4]) == list(range(1, sum(r[4] is not None for r in wanted) + 1))
    assert drawn(spark, monkeypatch, docs[:30], []) == sorted(plain(docs[:30], []), key=order)
    assert resampling.resample(no_docs, spark.createDataFrame(target, "item_id long, text string")).collect() == []


def test_words_beyond_half_a_key():
    """Tuples are told apart even if the words' numbers fill more than half a key."""
    import numpy as np
    import pyarrow as pa

    big = np.array([1 << 40, 5, 1 << 40, (1 << 40) + 1], np.uint64)
    table = pa.table({c: pa.array([resampling._packed(x)], pa.binary()) for c, x in (("first", resampling._steps(big)), ("second", np.array([0, 1 << 41, 0, 0], np.uint64)), ("n", np.ones(4, np.uint64)))})
    no, count, cuts = resampling._numbers(table)
    assert no[0] == no[2] and len(set(no.tolist())) == 3 and count.tolist() == [1, 1, 1, 1] and cuts == [0, 4]


def test_resampling_query_matches_its_plain_version(spark, sf_dir, documents):
    items = [(r.item_id, r.text) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    got = sorted(map(tuple, queries.op12_target_resampling(spark, sf_dir).collect()), key=order)
    assert got == sorted(plain([(r.doc_id, r.text) for r in documents], items), key=order)
