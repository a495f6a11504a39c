"""License scan: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser
evaluates the and/or/with expressions that follow the tags.

A text is reduced to its lower-cased words joined by single spaces, so a phrase is found wherever its words stand
consecutively, whatever punctuation or line breaks lie between them.  One automaton holds all phrases and tags; its
work is linear in the text.  No shuffle: every document is scanned where it is read.

Defined cases: a null text is an empty text (no words, score 0); a null ``doc_id`` is carried through; repeated rows
give repeated results; extra columns are ignored; an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, expressions array<string>"
)

# Phrase words and the label each stands for.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Further notice phrases of common public licences, with labels.
NOTICE_PHRASES = {
    "apache license": "apache",
    "mit license": "mit",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "confidential and proprietary": "proprietary",
}

TAG_PHRASE = "spdx license identifier"
TAG = re.compile(r"spdx-license-identifier\s*:[ \t]*([^\n*\"'<>]*)", re.I)

# How freely text under a label may be reused: 1 free, 0 not at all.
FREEDOM = {
    "cc0": 1.0, "public-domain": 1.0, "mit": 1.0, "isc": 1.0, "bsd": 1.0, "apache": 1.0, "cc-by": 0.9, "mpl": 0.7,
    "epl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6, "gpl": 0.5, "agpl": 0.4, "cc-by-nd": 0.3, "cc-by-nc": 0.3,
    "reserved": 0.0, "proprietary": 0.0,
}
UNKNOWN_FREEDOM = 0.2
_FAMILY = re.compile(r"(agpl|lgpl|gpl|apache|mit|bsd|isc|mpl|epl|cc0|cc-by-nc|cc-by-sa|cc-by-nd|cc-by)(?![a-z])")
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_BINDS = {"with": 3, "and": 2, "or": 1}


class LicenseExpressionError(ValueError):
    """The text after a tag is no licence expression."""


def label_of(identifier: str) -> str:
    """The family label of an SPDX identifier such as ``Apache-2.0``; unknown ones stand for themselves."""
    found = _FAMILY.match(identifier.lower())
    return found[1] if found else identifier.lower()


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: operands in order, each operator after its two operands."""
    output: list[str] = []
    stack: list[str] = []
    want_operand = True
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if word in _BINDS:
            if want_operand:
                raise LicenseExpressionError(expression)
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[word]:
                output.append(stack.pop())
            stack.append(word)
            want_operand = True
        elif token == "(":
            if not want_operand:
                raise LicenseExpressionError(expression)
            stack.append(token)
        elif token == ")":
            if want_operand:
                raise LicenseExpressionError(expression)
            while stack and stack[-1] != "(":
                output.append(stack.pop())
            if not stack:
                raise LicenseExpressionError(expression)
            stack.pop()
        else:
            if not want_operand:  # prose after the expression
                break
            output.append(token)
            want_operand = False
    if want_operand or "(" in stack:
        raise LicenseExpressionError(expression)
    return output + stack[::-1]


def before_prose(text: str) -> str:
    """The text up to a bracket that follows a complete operand while no bracket is open, such as ``MIT (see LICENSE)``."""
    depth, operand = 0, False
    for found in _TOKEN.finditer(text):
        token = found[0].lower()
        if token not in ("(", ")"):
            operand = token not in _BINDS
        elif operand and not depth:
            return text[: found.start()]
        else:
            depth += 1 if token == "(" else -1
    return text


def evaluate(expression: str) -> tuple[float, set[str], str]:
    """Freedom of an expression, its labels and its fully bracketed form.

    ``or`` lets the reader choose, so the freest side counts; ``and`` binds to the strictest; ``with`` adds an
    exception, which moves the licence halfway to free.
    """
    stack: list[tuple[float, set[str], str]] = []
    for token in to_postfix(expression):
        if token not in _BINDS:
            label = label_of(token)
            stack.append((FREEDOM.get(label, UNKNOWN_FREEDOM), {label}, token))
            continue
        (b, right, b_text), (a, left, a_text) = stack.pop(), stack.pop()
        if token == "with":
            stack.append(((a + 1) / 2, left, f"({a_text} WITH {b_text})"))
        else:
            stack.append(((max if token == "or" else min)(a, b), left | right, f"({a_text} {token.upper()} {b_text})"))
    return stack[0]


def automaton() -> ahocorasick.Automaton:
    """Every phrase between spaces, so that only whole words match."""
    machine = ahocorasick.Automaton()
    for phrase, label in NOTICE_PHRASES.items():
        machine.add_word(f" {phrase} ", (len(phrase), label, False))
    for phrase, label in BASE_PHRASES.items():
        machine.add_word(f" {phrase} ", (len(phrase), label, True))
    machine.add_word(f" {TAG_PHRASE} ", (len(TAG_PHRASE), None, False))
    machine.make_automaton()
    return machine


def scan_text(text: str | None, machine: ahocorasick.Automaton) -> tuple:
    """One document's result row without its id."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").translate(_WORDS).split()
    joined = f" {b' '.join(words).decode('latin-1')} "  # one character a byte: offsets stay cheap
    base: list[int] = []
    base_labels: set[str] = set()
    labels: set[str] = set()
    tagged = False
    at = counted = 0
    for end, (length, label, is_base) in machine.iter(joined):
        if label is None:
            tagged = True
            continue
        labels.add(label)
        if is_base:
            base_labels.add(label)
            start = end - length  # the first letter; the space before it is the (word + 1)-th
            if start < at:  # phrases differ in length: an earlier start can end later
                base.append(joined.count(" ", 0, start) - 1)
                continue
            counted += joined.count(" ", at, start)
            at = start
            base.append(counted - 1)
    freedom = [FREEDOM[x] for x in labels]
    expressions: list[str] = []
    if tagged:
        for found in TAG.finditer(text):
            try:
                free, names, bracketed = evaluate(before_prose(found[1]))
            except LicenseExpressionError:
                continue
            freedom.append(free)
            labels |= names
            expressions.append(bracketed)
    first, last = (min(base), max(base)) if base else (None, None)
    # Certainty that some licence binds the text: the stricter the licence, the surer.
    score = 1.0 - min(freedom) * 0.5 if freedom else 0.0
    return len(words), len(base), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, expressions


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: word count, base phrase places, labels, score and the evaluated tag expressions."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows = list(zip(*(scan_text(t.as_py(), machine) for t in texts), strict=True)) if len(batch) else [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]
            columns = [ids.cast(pa.int64()), *(pa.array(list(v), k) for v, k in zip(rows, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(scan, SCHEMA)
