"""Repeated windows held against a plain version."""

from __future__ import annotations

import random

import numpy as np
import pytest

from cardloom.llm import queries, repeated_windows
from tests.llm.brute import WORD, sha
from tests.llm.conftest import LONG, edge_texts, passage


def plain(rows, window=50):
    """``(doc_id, n_words, n_removed, kept words)`` of every row."""
    smallest: dict[tuple, int] = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    starts = [[tuple(w[k : k + window]) for k in range(len(w) - window + 1)] for _, w in words]
    for (i, _), s in zip(words, starts, strict=True):
        for g in s:
            if i is not None:
                smallest[g] = min(smallest.get(g, i), i)
    out = []
    for (i, w), s in zip(words, starts, strict=True):
        gone = {k + j for k, g in enumerate(s) if i is not None and smallest[g] < i for j in range(window)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def order(r):
    return (r[0] is None, r[0] or 0, r[1], r[2], r[3])


def corpus(seed: int, n: int) -> list[tuple[int, str | None]]:
    """Texts that share passages of many lengths, one of which very many hold, copies, and texts that repeat themselves."""
    rng = random.Random(seed)
    shared = [passage(100 + k, rng.choice((49, 50, 51, 70, 120))) for k in range(8)]
    rows: list[tuple[int, str | None]] = []
    for i in range(n):
        parts = [passage(1000 + i, rng.randrange(0, 60)), rng.choice(shared), passage(5000 + i, rng.randrange(0, 30)), shared[0] if i % 3 else "", rng.choice(shared)]
        rows.append((i * 7 % n, rng.choice((" ", "\n", " \t ")).join(parts)))
    rows += [(n + 1, rows[4][1]), (n + 2, rows[4][1].replace(" ", "  ")), (n + 3, " ".join(["one two"] * 80)), (n + 4, " ".join(["one two"] * 60))]
    rows += [(rows[2][0], passage(9, 60)), (rows[2][0], rows[2][1]), (None, rows[3][1]), (n + 5, rows[3][1][: len(rows[3][1]) // 2])]
    return rows


@pytest.mark.parametrize("how", [{}, {"group": 3, "block_bytes": 2000}, {"first": 1, "group": 1, "block_bytes": 700, "symbol": 8}])
def test_spans_match_plain_spans(spark, monkeypatch, how):
    """Also with blocks of few texts and groups so small that most prefixes have to grow."""
    monkeypatch.setattr(repeated_windows, "BIN", 3000)
    rows = corpus(3, 60)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, block int").repartition(4)
    got = repeated_windows.find_repeats(df, **how).collect()
    left = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_key.hex()) for r in got), key=order)
    wanted = plain(rows)
    assert left == sorted(((i, n, k, sha(w)) for i, n, k, w in wanted), key=order)
    assert sum(s["end"] - s["first"] for r in got for s in r.spans) == sum(k for _, _, k, _ in wanted) > 0
    if how:
        out = repeated_windows.remove_repeats(df, **how)
        assert out.columns == ["doc_id", "text", "key", "block", "removed_words"]
        key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
        found = sorted(((r.doc_id, r.removed_words, " ".join(WORD.findall(r.text))) for r in out.collect()), key=key)
        assert found == sorted(((i, k, w) for i, _, k, w in wanted), key=key)


def test_edge_texts_and_very_long_ones(spark, edge, no_docs):
    rows = [(k, t) for k, t in enumerate(edge_texts())] + [(7, edge_texts()[7]), (None, "no id at all")]
    got = repeated_windows.find_repeats(edge).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_key.hex()) for r in got), key=order) == sorted(((i, n, k, sha(w)) for i, n, k, w in plain(rows)), key=order)
    assert repeated_windows.find_repeats(no_docs).collect() == []
    twice = spark.createDataFrame([(1, LONG), (2, "start " + LONG), (3, LONG + " end")], "doc_id long, text string")
    got = {r.doc_id: r for r in repeated_windows.find_repeats(twice).collect()}
    assert [got[k].n_removed for k in (1, 2, 3)] == [0, 60_000, 60_000] and got[2].spans == [(1, 60_001)]


def test_deep_nodes_are_the_classes_of_equal_windows():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 2, (200, 4)).astype(np.int64)
    places, node = repeated_windows.deep_nodes(symbols)
    by_node: dict[int, set] = {}
    for p, n in zip(places, node, strict=True):
        by_node.setdefault(int(n), set()).add(tuple(symbols[p]))
    assert all(len(v) == 1 for v in by_node.values()) and len(by_node) == len({tuple(s) for s in symbols})


def test_window_query_matches_its_plain_version(spark, sf_dir, documents):
    got = queries.op13_repeated_windows(spark, sf_dir).collect()
    wanted = plain([(r.doc_id, r.text) for r in documents])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=order) == sorted(((i, n, k, sha(w)) for i, n, k, w in wanted), key=order)
