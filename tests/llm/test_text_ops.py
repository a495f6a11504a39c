"""Operators that work document by document, held against plain versions."""

from __future__ import annotations

import base64
import re

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cardloom.llm import bpe, chat_format, license_scan, pii, quality_rules, queries, token_counts
from tests.llm import brute
from tests.llm.conftest import edge_texts, passage


@pytest.fixture(scope="module")
def known():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def by_id(rows):
    return {r.doc_id: r for r in rows}


def check_quality(rows, texts):
    rows = by_id(rows)
    for i, t in texts:
        for name, value in brute.quality(t).items():
            assert rows[i][name] == value, (i, name)
        assert not (rows[i].base_failed and rows[i].kept)


def test_quality_counts_match_plain_counts(spark, sf_dir, documents):
    check_quality(queries.op1_quality_rules(spark, sf_dir).collect(), documents)


def test_quality_edge_cases(edge, no_docs):
    rows = quality_rules.assess(edge, None).collect()
    assert len(rows) == len(edge_texts()) + 2
    check_quality(rows, list(enumerate(edge_texts())))
    assert all(r.score is None and r.kept == (not r.base_failed) for r in rows)
    assert quality_rules.assess(no_docs, None).collect() == []
    kept = quality_rules.keep_good(edge, None)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}


def test_trees_are_monotone_and_learn(spark, sf_dir):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.random((2000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) < 0.6).astype(float)
    trees = quality_rules.fit(x[:1500], y[:1500], [-1, 0, 0])
    assert ((trees.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.9
    line = np.column_stack((np.linspace(-0.2, 1.2, 400), np.full(400, 0.4), np.full(400, 0.5)))
    assert (np.diff(trees.score(line)) <= 1e-12).all()
    assert quality_rules.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.createDataFrame([], "doc_id long, quality int")) is None


def test_quality_held_out(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.train(docs, labels.where("doc_id % 2 = 0"))
    rest = quality_rules.assess(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(r.kept == bool(r.quality) for r in rest) / len(rest) > 0.85


def test_bpe_matches_the_library(spark, sf_dir, documents, known, edge, no_docs):
    for rows, texts in ((queries.op3_byte_bpe(spark, sf_dir).collect(), documents), (bpe.digest_documents(edge, queries.RANKS, queries.PATTERN).collect(), list(enumerate(edge_texts())))):
        rows = by_id(rows)
        for i, t in texts:
            ids = known.encode_ordinary(t or "")
            assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t or ""))
    full = by_id(bpe.encode_documents(edge, queries.RANKS, queries.PATTERN).collect())
    assert all(bytes(full[i].decoded).decode() == (t or "") for i, t in enumerate(edge_texts()))
    assert bpe.digest_documents(no_docs, queries.RANKS, queries.PATTERN).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abhe 'é漢\n\t1!\U0001f600 İ"), max_size=60), min_size=1, max_size=5))
def test_bpe_on_any_text(known, texts):
    coder = bpe.shared_encoder(queries.RANKS, queries.PATTERN)
    assert [x.tolist() for x in coder.encode(texts)] == [known.encode_ordinary(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(
    st.text(alphabet=st.sampled_from("ab1 'é\n!sx"), max_size=400),
    st.lists(st.tuples(st.integers(0, 420), st.integers(0, 30), st.text(alphabet="ab1 '\n!s", max_size=12)), max_size=6),
)
def test_edited_counts_equal_counts_of_the_edited_text(known, text, edits):
    coder = bpe.shared_encoder(queries.RANKS, queries.PATTERN)
    tree = token_counts.CountTree.of(text, coder)
    assert tree.total == len(known.encode_ordinary(text))
    for start, size, new in edits:
        a = min(start, len(text))
        b = min(a + size, len(text))
        text = text[:a] + new + text[b:]
        tree.edit(start, start + size, new)
        assert tree.text() == text and tree.total == len(known.encode_ordinary(text)) and tree.length == len(text)


def test_token_counts_query(spark, sf_dir, documents, known):
    rows = by_id(queries.op5_token_counts(spark, sf_dir).collect())
    assert len(rows) == len(documents)
    for i, t in documents:
        n = len(t)
        third, fifth = n // 3, n // 5
        after = f"# {i}\n\n" + t[:third] + "..." + t[third + fifth :] + " End."
        assert (rows[i].n_tokens, rows[i].n_tokens_after, rows[i].n_chars_after) == (len(known.encode_ordinary(t)), len(known.encode_ordinary(after)), len(after))
    assert sum(r.n_recounted for r in rows.values()) < sum(r.n_tokens for r in rows.values()) / 5


def test_token_counts_edge_cases(spark, edge, no_docs, known):
    edits = spark.createDataFrame(
        [(0, 1, 0, 0, "new"), (1, 2, 5, 9, "!"), (1, 1, -3, 2, "x y"), (24, 1, 100_000, 200_000, ""), (None, 1, 0, 2, None)],
        "doc_id long, edit_no long, start long, end long, replacement string",
    )
    rows = token_counts.edited_counts(edge, edits, queries.RANKS, queries.PATTERN).collect()
    found = by_id(rows)
    assert len(rows) == len(edge_texts()) + 2 and found[0].n_tokens_after == len(known.encode_ordinary("new"))
    assert found[1].n_tokens_after == len(known.encode_ordinary("x y!")) and found[None].n_tokens_after == len(known.encode_ordinary(" id at all"))
    long = edge_texts()[24]
    assert found[24].n_tokens_after == len(known.encode_ordinary(long[:100_000] + long[200_000:]))
    assert token_counts.edited_counts(no_docs, edits, queries.RANKS, queries.PATTERN).collect() == []


def check_personal(rows, texts):
    rows = by_id(rows)
    for i, t in texts:
        spans = brute.personal(t)
        assert rows[i].base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans)), i
        assert [rows[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(rows[i].spans.split(","))


def test_personal_data(spark, sf_dir, documents, tmp_path):
    check_personal(queries.op4_pii(spark, sf_dir).collect(), documents)
    spark.createDataFrame(list(enumerate(edge_texts())), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check_personal(queries.op4_pii(spark, str(tmp_path)).collect(), list(enumerate(edge_texts())))


def test_personal_data_edge_cases(edge, no_docs):
    rows = by_id(pii.find_pii(edge).collect())
    assert rows[0].spans == [] and {s.kind for s in rows[20].spans} >= {"iban", "ssn", "birthdate"}
    assert pii.find_pii(no_docs).collect() == []
    assert pii.redact(edge_texts()[17]).startswith("a@<email> <email> mail <email>, ip <ip>.<ip> and 300.1.1.1 at <ip>")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@-+ (9", max_size=60))
def test_personal_data_on_any_text(text):
    base = [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS]
    assert base == brute.personal(text)


def check_licenses(rows, texts):
    rows = by_id(rows)
    for i, t in texts:
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licenses(t), i
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_licenses(spark, sf_dir, documents, edge, no_docs):
    check_licenses(queries.op10_license_scan(spark, sf_dir).collect(), documents)
    rows = license_scan.scan_licenses(edge).collect()
    check_licenses(rows, list(enumerate(edge_texts())))
    assert by_id(rows)[22].expressions == ["((MIT OR Apache-2.0) AND (GPL-2.0-only WITH Classpath-exception-2.0))"]
    assert license_scan.scan_licenses(no_docs).collect() == []


def test_license_tags_before_brackets():
    tags = {"MIT (see LICENSE)": ["MIT"], "Apache-2.0)": ["Apache-2.0"], "(MIT OR Apache-2.0) (x)": ["(MIT OR Apache-2.0)"], "(MIT (x)": []}
    machine = license_scan.automaton()
    assert {t: license_scan.scan_text(f"(SPDX-License-Identifier: {t}", machine)[-1] for t in tags} == tags


def test_license_expressions():
    assert license_scan.to_postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert license_scan.evaluate("MIT AND (GPL-3.0 OR Apache-2.0)")[0] == 1.0
    for bad in ("", "and", "a or", "(a", "a)", "a (b)", "or a"):
        with pytest.raises(license_scan.LicenseExpressionError):
            license_scan.to_postfix(bad)


def test_conversations(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    hard = "\\### Assistant: </turn> ok"
    turns = [(r.conv_id, r.turn, r.role, r.text or "") for r in rows] + [(-7, 0, "user", hard), (-7, 1, "assistant", hard)]
    found = {r.conv_id: r for r in queries.op6_chat_format(spark, sf_dir).collect()}
    assert found.keys() == {t[0] for t in turns}
    for conv, r in found.items():
        own = sorted(t for t in turns if t[0] == conv)
        loss = "".join(t[3] for t in own if t[2] == "assistant")
        assert r.turns_sha256 == brute.sha("".join(f"{t[2]}\n{t[3]}\n" for t in own))
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(own), len(loss), brute.sha(loss))


def test_typed_parts(spark):
    part = chat_format.PART
    rows = spark.sql(
        f"""select 1L conv_id, 0L turn, 'user' role, from_json('[{{"type":"text","text":"see <turn x> "}},{{"type":"image","ref":"a.png","width":600,"height":512}},
        {{"type":"audio","ref":"b.wav","seconds":2.0}},{{"type":"document","ref":"c.pdf","pages":3}},{{"type":null,"text":"!"}}]', 'array<{part}>') parts
        union all select 1L, 1L, 'assistant', null union all select null, null, null, null"""
    )
    turns = {(r.conv_id, r.turn): r for r in chat_format.format_turns(rows).collect()}
    first = turns[1, 0]
    assert first.formatted == "<turn user>\nsee \\lturn x> <image 0><audio 1><document 2>!</turn>\n"
    assert [(a.ordinal, a.type, a.ref, a.tokens) for a in first.attachments] == [(0, "image", "a.png", 85 + 340), (1, "audio", "b.wav", 50), (2, "document", "c.pdf", 2250)]
    assert first.expanded_tokens == 425 + 50 + 2250 and turns[1, 1].formatted == "<turn assistant>\n</turn>\n"
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(rows)).collect()}
    assert back[1].n_turns == 2 and back[1].n_attachments == 3 and back[None].n_turns == 1
    assert chat_format.read_back(chat_format.format_turns(rows.limit(0))).collect() == []
    whole = {r.conv_id: r.formatted for r in chat_format.join_conversations(chat_format.format_turns(rows)).collect()}
    assert len(list(chat_format.parse(whole[1]))) == 2


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a<>\\/turn \nlg", max_size=40), st.text(alphabet="a<>\\\n g", max_size=10))
def test_turns_read_back(text, role):
    formatted, start, end, _ = chat_format.format_turn(role, [{"type": "text", "text": text}])
    ((found_role, body),) = chat_format.parse(formatted)
    assert (found_role, chat_format.unescape(body)) == (role, text) and (start == end or role == "assistant")


def test_latin1_pattern_is_the_same_below_256():
    import regex

    text = "".join(map(chr, range(256))) * 2 + "don't we'll  x 12é  "
    assert re.findall(bpe.latin1_pattern(queries.PATTERN), text) == regex.findall(queries.PATTERN, text)


def alternating(rounds: int) -> tuple[str, str]:
    """Two texts that any polynomial hash modulo 2**64 confuses."""
    text, other = "a", "b"
    for _ in range(rounds):
        text, other = text + other, other + text
    return text, other


def test_hashes_tell_alternating_texts_apart(spark):
    from cardloom.llm import decontaminate, near_dedup

    one, two = alternating(11)
    (row,) = quality_rules.assess(spark.createDataFrame([(1, f"{one}\n{two}\n{one}")], "doc_id long, text string"), None).collect()
    assert row.n_dup_lines == 1
    found = by_id(near_dedup.near_duplicates(spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")).collect())
    assert [found[k].component_id for k in (1, 2, 3)] == [1, 2, 1]
    words = passage(5, 12).split()
    docs = spark.createDataFrame([(1, " ".join([one, *words])), (2, " ".join([two, *words]))], "doc_id long, text string")
    item = spark.createDataFrame([(9, one)], "item_id long, text string")
    hits = by_id(decontaminate.report(docs, item).collect())
    assert hits[1] != hits[2]
