"""Operators that compare documents with one another, held against plain versions."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from cardloom.llm import bpe, decontaminate, line_dedup, near_dedup, queries, token_shards
from tests.llm import brute
from tests.llm.conftest import edge_texts, passage


def near(df):
    return {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()}


def expected(rows):
    return {(i, n, c, i == c) for i, (n, c) in brute.near_components(rows).items()}


def test_near_duplicates_of_the_documents(spark, sf_dir, documents):
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in queries.op8_near_dedup(spark, sf_dir).collect()} == expected(documents)


def test_near_duplicates_edge_cases(spark, edge, no_docs):
    found = near(edge)
    assert {x for x in found if x[0] is not None} == expected(list(enumerate(edge_texts()))[:24] + [(24, edge_texts()[24])])
    assert (None, 1, None, True) in found
    assert near(no_docs) == set()


def test_near_duplicates_in_hot_groups(spark):
    """Chains, large groups of near copies, and documents that share common passages in every mixture."""
    base = passage(5, 300).split()
    rows = []
    for k in range(60):  # near copies of one text
        words = base.copy()
        words[(7 * k) % 300] = f"new{k}"
        rows.append((len(rows), " ".join(words)))
    chain = passage(6, 200).split()
    for k in range(30):  # each like the next only
        rows.append((len(rows), " ".join(chain[8 * k : 8 * k + 60] or chain[:60])))
    shared = [passage(100 + k, 40) for k in range(6)]
    for k in range(150):  # mixtures of common passages
        own = [shared[j] for j in range(6) if (k >> j) & 1] + [passage(1000 + k, 10 + k % 25)]
        rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(5)
    assert near(df) == expected(rows)


def amid_common(spark, few, pairs):
    """Pairs of pieces of ``few`` passages, each of which stands in 100 other texts and, by its shingles, in short ones."""
    texts = []
    for k in range(few):
        words = passage(3000 + k, 12).split()
        texts += [" ".join(words) + " " + passage(100_000 + 100 * k + j, 6) for j in range(100)]
        texts += [" ".join(words[j : j + 5]) for j in range(8)]
        texts += [" ".join(piece) for piece in pairs(words, k)]
    rows = list(enumerate(texts))
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_near_duplicates_among_many_holders_of_a_passage(spark):
    """Two pieces that share 6 of 8 shingles, all of them common, and not the same common ones."""
    rows, df = amid_common(spark, 20, lambda words, k: (words[:11], words[1:]))
    assert near(df) == expected(rows)


def test_short_near_duplicates_among_many_holders_of_a_passage(spark):
    """Sets of 3 and 4 shingles of which 3 are common."""
    rows, df = amid_common(spark, 8, lambda words, k: (words[:7], [*words[:7], f"own{k}"]))
    assert near(df) == expected(rows)


def test_line_dedup_removes_later_copies(spark, edge, no_docs):
    lines = [passage(k, 12) for k in range(10)]
    block = "\n".join(lines)
    long = passage(77, 80)
    rows = [
        (1, "start of one\n" + block + "\nend of one"),
        (2, block + "\nend of two"),
        (3, "only " + passage(50, 30) + "\nand more\n" + long),
        (4, long + "\n" + "its own line " + passage(51, 20)),
        (5, "start of one\nshort"),
        (6, None),
        (None, block),
    ]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, hash int").withColumnsRenamed({"hash": "_id"}).repartition(3)
    assert {r["_id"] for r in line_dedup.remove_repeats(df).collect()} == {5}
    out = {r.doc_id: r for r in line_dedup.remove_repeats(df).collect()}
    assert [out[k].text for k in (1, 3, 5, 6, None)] == [dict(rows)[k] for k in (1, 3, 5, 6, None)]
    assert "end of two" in out[2].text and out[2].removed_lines >= 6 and out[4].text == "its own line " + passage(51, 20)
    assert line_dedup.remove_repeats(df).columns == ["doc_id", "text", "_id", "removed_lines"]
    kept = line_dedup.remove_repeats(edge).collect()
    assert len(kept) == len(edge_texts()) + 2 and line_dedup.remove_repeats(no_docs).collect() == []


def test_line_dedup_removes_every_repeated_run(spark):
    """Short passages amid other lines, against all runs of lines."""
    rng = random.Random(3)
    common = ["\n".join(passage(2000 + 10 * k + j, rng.choice((1, 2, 4, 12, 30, 60))) for j in range(2 + k % 5)) for k in range(25)]
    rows = []
    for i in range(150):
        parts = [passage(9000 + 7 * i + j, rng.choice((1, 3, 9, 25, 55))) for j in range(5)]
        for _ in range(3):
            lines = rng.choice(common).split("\n")
            lines = lines[rng.randrange(2) :] if rng.random() < 0.3 else lines
            parts.insert(rng.randrange(len(parts) + 1), ("\n\n" if rng.random() < 0.2 else "\n").join(lines))
        rows.append((i, rng.choice(("\n", "\n\n")).join(parts)))
    rows.append((150, "\n".join([passage(1, 6)] * 4 + ["", passage(2, 3)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.remove_repeats(df).collect()}
    assert out == brute.repeated_lines(rows, line_dedup.MIN_WORDS, line_dedup.LONG_LINE)


def test_line_dedup_of_very_frequent_chunks(spark, monkeypatch):
    """Chunks that are dealt by several salts, other lengths than the usual ones."""
    monkeypatch.setattr(line_dedup, "SALTED", 7)
    rows = [(i, f"own {i}\n" + "\n".join(passage(i % 3, 4).split()) + f"\nend {i}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.remove_repeats(df, 3, 40).collect()}
    assert out == brute.repeated_lines(rows, 3, 40) and sum(n for _, n in out.values()) == 87 * 4


def test_line_dedup_loses_no_line(spark, sf_dir, documents):
    """Every line that went stays somewhere; what is left of a text are its own lines in order."""
    cut = line_dedup.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    left = {line for r in cut for line in r.text.split("\n")}
    texts = dict(documents)
    for r in cut:
        lines = texts[r.doc_id].split("\n")
        assert set(lines) <= left
        rest = iter(lines)
        if r.removed_lines < len(lines):
            assert all(any(x == y for y in rest) for x in r.text.split("\n"))
        assert r.removed_lines or r.text == texts[r.doc_id]


def test_line_chunks_resist_shifts():
    import pyarrow as pa

    from cardloom.llm import _text

    body = "\n".join(passage(k, 12) for k in range(40))
    hashes = []
    for head in ("", "x\ny\n", passage(99, 30) + "\n"):
        (block,) = _text.blocks(pa.array([head + body]))
        hashes.append(set(line_dedup.chunks(block)[1].tolist()))
    assert len(hashes[0] & hashes[1] & hashes[2]) > 0.8 * len(hashes[0])


@pytest.fixture(scope="module")
def items():
    return [(k, passage(500 + k, 40)) for k in range(5)] + [(9, passage(600, 9)), (10, "quite short"), (11, None), (12, ""), (13, "?!")]


def plain_leaks(text: str | None, items) -> set[int]:
    """Items of which some 13 aligned words (or all, if fewer) stand in the text, of 8 or more with at most two replaced."""
    words = brute.re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", brute.lower(text or ""))
    found = set()
    for i, item in items:
        theirs = brute.re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", brute.lower(item or ""))
        width = min(13, len(theirs))
        if not theirs:
            continue
        for a in range(len(words) - width + 1):
            for b in range(len(theirs) - width + 1):
                if sum(x == y for x, y in zip(words[a : a + width], theirs[b : b + width], strict=True)) >= width - 2 * (width >= 8):
                    found.add(i)
    return found


def test_leaks_with_replaced_words(spark, items, edge, no_docs):
    def changed(text, *at):
        words = text.split()
        for k in at:
            words[k] = "other"
        return " ".join(words)

    texts = dict(items)
    rows = [
        (0, passage(1, 60) + " " + texts[0] + " " + passage(2, 60)),
        (1, "Before. " + texts[1].upper().replace(" ", ", ") + "!"),
        (2, passage(3, 30) + " " + changed(texts[2], 5, 11, 20, 26, 33) + " end"),
        (3, passage(4, 30) + " " + " ".join(texts[3].split()[10:24]) + " " + passage(5, 30)),
        (4, passage(6, 30) + " " + " ".join(texts[4].split()[:9]) + " " + passage(7, 30)),
        (5, "so: " + texts[9]),
        (6, passage(8, 300)),
        (7, None),
        (8, ""),
        (9, "a QUITE, short one"),
        (10, "quite a short one"),
        (None, texts[0] + " " + texts[1]),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item_id string")
    out = {r.doc_id: set(r.item_ids) for r in decontaminate.report(docs, bench).collect()}
    assert out == {i: plain_leaks(t, items) for i, t in rows}
    assert out[0] == {0} and out[2] == {2} and out[3] == {3} and out[4] == set() and out[5] == {9} and out[None] == {0, 1}
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {4, 6, 7, 8, 10}
    assert decontaminate.report(no_docs, bench).collect() == []
    assert not any(r.contaminated for r in decontaminate.report(edge, bench.limit(0)).collect())


def test_blocks_of_items_find_the_same(items):
    pairs = [(i, np.arange(20, dtype=np.uint64) + np.uint64(100 * i)) for i in range(6)]
    own = np.concatenate([np.arange(7, dtype=np.uint64), pairs[4][1], pairs[2][1]])
    whole = {m[1] for m in decontaminate.SeedTable(pairs).matches(own, np.array([0, len(own)]))}
    parts = {m[1] for p in pairs for m in decontaminate.SeedTable([p]).matches(own, np.array([0, len(own)]))}
    assert whole == parts == {2, 4}


def test_leaks_in_the_documents(spark, sf_dir, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    out = {r.doc_id: set(r.item_ids) for r in queries.op7_decontaminate(spark, sf_dir).collect()}
    some = [d for d in documents if len(d.text) < 1500][:25] + [d for d in documents if out[d.doc_id] and len(d.text) < 4000][:15]
    assert {i: out[i] for i, _ in some} == {i: plain_leaks(t, items) for i, t in some}


@pytest.mark.parametrize("n", range(1, 16))
def test_every_pair_of_replaced_words_is_found(n):
    """An item of any length, with every one or two of its words replaced, amid other words."""
    item = np.arange(n, dtype=np.uint64) + np.uint64(1000)
    table = decontaminate.SeedTable([(5, item), (5, item), (None, item)])
    for a in range(n):
        for b in range(a, n):
            own = np.concatenate((np.arange(9, dtype=np.uint64), item, np.arange(20, 25, dtype=np.uint64)))
            own[9 + a] = own[9 + b] = np.uint64(7)
            found = list(table.matches(own, np.array([0, 0, len(own), len(own)])))
            assert found == ([(1, 5, 9, n, n - len({a, b}))] * 2 + [(1, None, 9, n, n - len({a, b}))] if n >= 8 else [])
    own = np.concatenate((item, item[:-1]))
    assert {m[2] for m in table.matches(own, np.array([0, len(own)]))} == {0} | ({n} if n > 13 else set())


def test_leaks_of_nameless_repeated_and_long_items(spark):
    text, long = passage(1, 30), passage(2, 30_000)
    bench = spark.createDataFrame([(None, text), (3, text), (3, text), (4, long)], "item_id long, text string")
    docs = spark.createDataFrame([(1, text), (2, " ".join([text] * 5)), (3, long[1000:3000]), (4, passage(4, 30)), (4, text)], "doc_id long, text string")
    out = {(r.doc_id, r.contaminated, tuple(r.item_ids)) for r in decontaminate.report(docs, bench).collect()}
    assert out == {(1, True, (3,)), (2, True, (3,)), (3, True, (4,)), (4, True, (3,))}
    assert [r.text for r in decontaminate.keep_clean(docs, bench).collect()] == [passage(4, 30)]
    nameless = decontaminate.report(docs, bench.where("item_id is null")).where("contaminated").collect()
    assert {(r.doc_id, r.n_items) for r in nameless} == {(1, 0), (2, 0), (4, 0)}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation_is_a_bijection(n):
    order = token_shards.Permutation(n, 11)
    slots = order.slot(np.arange(n, dtype=np.uint64))
    assert sorted(slots.tolist()) == list(range(n))
    assert order.number(slots.astype(np.uint64)).tolist() == list(range(n))
    assert n < 64 or slots.tolist() != token_shards.Permutation(n, 12).slot(np.arange(n, dtype=np.uint64)).tolist()


def check_shards(places, texts, out, length, per_shard):
    """All shards against the documents' ids laid end to end; every row of the result against its document."""
    coder = bpe.shared_encoder(queries.RANKS, queries.PATTERN)
    ids = [np.append(x, 50256) for x in coder.encode([t or "" for _, t in texts])]
    stream = np.concatenate(ids)
    n = -(-len(stream) // length)
    stream = np.append(stream, [50256] * (n * length - len(stream)))
    records = np.array(list(token_shards.read_slots(out, 0, n, length, per_shard, np.dtype("<u2"))))
    slots = token_shards.Permutation(n, 2024).slot(np.arange(n))
    assert (records[slots] == stream.reshape(n, length)).all()
    by_doc: dict = {}
    for p in places:
        assert p.slot == slots[p.seq_no] and p.shard == p.slot // per_shard
        at = p.byte_offset // 2 - p.slot % per_shard * length
        by_doc.setdefault(p.doc_id, []).append((p.first_token, records[p.slot][at : at + p.n_tokens].tolist()))
    for (i, _), own in zip(texts, ids, strict=True):
        rows = sorted(by_doc[i], key=lambda x: x[0])
        copies = [k for k, _ in texts].count(i)
        assert sum(len(r[1]) for r in rows) == copies * len(own) and all(r == own[k : k + len(r)].tolist() for k, r in rows)
    return records


def test_shards_hold_every_sequence(spark, edge, no_docs, tmp_path):
    out = f"file://{tmp_path}/shards"
    places = token_shards.materialise(edge, out, queries.RANKS, queries.PATTERN, end_id=50256, key=2024, length=32, per_shard=50).collect()
    texts = [(None, "no id at all"), *enumerate(edge_texts())]
    records = check_shards(places, texts[:9] + [texts[8]] + texts[9:], out, 32, 50)
    assert [r.tolist() for r in token_shards.read_slots(out, 120, 125, 32, 50, np.dtype("<u2"))] == records[120:125].tolist()
    assert token_shards.materialise(no_docs, f"file://{tmp_path}/none", queries.RANKS, queries.PATTERN, 50256, 7).collect() == []


def test_shards_query(spark, sf_dir, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(queries._shared, "new_path", lambda spark, name, lasting=False: f"file://{tmp_path}/{name}")
    places = queries.op9_token_shards(spark, sf_dir).collect()
    check_shards(places, sorted((r.doc_id, r.text) for r in documents), f"file://{tmp_path}/shards", token_shards.LENGTH, token_shards.PER_SHARD)


@pytest.mark.parametrize("writers", [1, 1000])
def test_shards_do_not_depend_on_the_run(spark, edge, tmp_path, monkeypatch, writers):
    """Other partitions of the input, or fewer writing tasks, give the same bytes."""
    monkeypatch.setattr(token_shards, "WRITERS", writers)
    files = []
    for name, docs in (("a", edge.repartition(2)), ("b", edge.repartition(20, "n"))):
        token_shards.materialise(docs, f"file://{tmp_path}/{name}", queries.RANKS, queries.PATTERN, 50256, 7, 64, 100).count()
        files.append({p.name: p.read_bytes() for p in (tmp_path / name).glob("shard-*")})
    assert files[0] == files[1] and len(files[0]) > 1


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    other = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(other.columns) == sorted(df.columns)
    assert {tuple(r) for r in df.select(*other.columns).collect()} == set(other.fetchall())


def test_pipeline_stages(spark, sf_dir):
    """Each stage's decisions equal the operator's on what the stage before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = {r.doc_id for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    good = stages["quality_rules"](spark, docs, sf_dir).cache()
    assert good.columns == columns and {r.doc_id for r in good.collect()} == {r.doc_id for r in queries.op1_quality_rules(spark, sf_dir).where("kept").collect()}
    cut = stages["line_dedup"](spark, good, sf_dir).cache()
    assert cut.columns == columns and {r.doc_id for r in cut.collect()} <= seen
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    one = stages["near_dedup"](spark, cut, sf_dir).cache()
    keep = {i for i, (_, c) in brute.near_components([(r.doc_id, r.text) for r in cut.collect()]).items() if i == c}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == keep
    clean = stages["decontamination"](spark, one, sf_dir).cache()
    leaks = {r.doc_id for r in decontaminate.report(one, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == keep - leaks
    last = stages["byte_bpe"](spark, clean, sf_dir).collect()
    assert {r.doc_id: r.decoded_sha256 for r in last} == {r.doc_id: brute.sha(r.text) for r in clean.collect()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()} == {tuple(r) for r in last}


def test_pipeline_stages_on_edge_rows(spark, sf_dir, edge, no_docs):
    """Null, empty, repeated, very long texts and columns named like the stages' own; then no rows at all."""
    odd = edge.withColumnsRenamed({"cls": "_gone", "n": "_cuts"})
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stage(spark, docs, sf_dir).cache()
            assert name == "byte_bpe" or docs.columns == columns
    good = corpus_pipeline.quality(spark, odd, sf_dir).collect()
    assert all(r.text and len(r.text.split()) >= 50 for r in good)
    left = corpus_pipeline.near(spark, odd, sf_dir).collect()
    texts = edge_texts()
    keep = {i for i, (_, c) in brute.near_components(list(enumerate(texts))).items() if i == c}
    assert {r.doc_id for r in left} == keep | {None} and sum(r.doc_id == 7 for r in left) == 2
