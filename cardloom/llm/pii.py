"""Personal data: regular expressions propose spans, checksum validators confirm them, context words adjust a score.

Base kinds (email, ip, card, phone) are reported whenever their pattern and validator accept.  The method adds kinds
whose pattern alone is too weak: bank account numbers confirmed by mod-97, social security numbers, dates of birth and
card numbers with other separators; such a span is reported only if its score, raised by nearby context words, reaches
``MIN_SCORE``.  Every pattern is written so that its work is linear in the text.  No shuffle: each document is searched
where it is read.

Defined cases: a null text is an empty text (no spans); a null ``doc_id`` is carried through; repeated rows give
repeated results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "ssn", "birthdate", "card_other")
#: Characters on each side of a span in which context words count, and the score from which a span is reported.
CONTEXT_CHARS = 40
MIN_SCORE = 0.6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is entered at its first digit only: a later start would meet the same end, at quadratic cost.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_BIRTH = re.compile(r"(?<![0-9/.-])[0-9]{1,4}[/.-][0-9]{1,2}[/.-][0-9]{2,4}(?![0-9/.-])")
_CARD_OTHER = re.compile(r"(?<![0-9./])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9./])")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Score of a bare span of each kind, context words and what each hit adds.
_SCORES: dict[str, tuple[float, float, re.Pattern[str]]] = {
    "email": (0.9, 0.1, re.compile(r"\b(?:e-?mail|mail|contact|write)\b", re.I)),
    "ip": (0.7, 0.2, re.compile(r"\b(?:ip|host|server|address|login)\b", re.I)),
    "card": (0.8, 0.2, re.compile(r"\b(?:card|visa|mastercard|credit|payment)\b", re.I)),
    "phone": (0.8, 0.2, re.compile(r"\b(?:tel|phone|call|mobile|fax)\b", re.I)),
    "iban": (0.8, 0.2, re.compile(r"\b(?:iban|bank|account|konto|compte|cuenta)\b", re.I)),
    "ssn": (0.4, 0.4, re.compile(r"\b(?:ssn|social security)\b", re.I)),
    "birthdate": (0.2, 0.5, re.compile(r"\b(?:born|birth|dob|geboren|naissance|nacimiento)\b", re.I)),
    "card_other": (0.5, 0.3, re.compile(r"\b(?:card|visa|mastercard|credit|payment)\b", re.I)),
}

_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others by the Luhn rule."""
    values = [ord(c) - 48 for c in digits]
    return (sum(values[-1::-2]) + sum(_DOUBLED[v] for v in values[-2::-2])) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an international account number's two check digits fit."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses, found from their ``@`` so that long runs without one cost nothing more."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers of at most 255."""
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or "0") < 256 for part in m[0].split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    """13 to 19 digits that pass the Luhn rule."""
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    """A plus sign and 9 to 15 digits."""
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        account = m[0].replace(" ", "")
        if 15 <= len(account) <= 34 and mod97(account):
            yield m.span()


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


def _birthdates(text: str) -> Iterator[tuple[int, int]]:
    for m in _BIRTH.finditer(text):
        parts = [int(p) for p in re.split("[/.-]", m[0])]
        days = parts[:2] if parts[2] > 31 else parts[1:]
        if max(days) <= 31 and 0 < min(days) <= 12:
            yield m.span()


def _cards_other(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD_OTHER.finditer(text):
        if luhn(_NOT_DIGIT.sub("", m[0])):
            yield m.span()


_FINDERS = dict(zip(BASE_KINDS + MORE_KINDS, (emails, ips, cards, phones, _ibans, _ssns, _birthdates, _cards_other), strict=True))


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's own score, raised by each different context word near the span, 1 at most."""
    own, step, words = _SCORES[kind]
    near = text[max(0, start - CONTEXT_CHARS) : start] + "\n" + text[end : end + CONTEXT_CHARS]
    return min(1.0, own + step * len({w.lower() for w in words.findall(near)}))


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed, then start; offsets in code points, the end exclusive."""
    text = text or ""
    spans = []
    for kind, finder in _FINDERS.items():
        for start, end in finder(text):
            points = score(text, kind, start, end)
            if kind in BASE_KINDS or points >= MIN_SCORE:
                spans.append((kind, start, end, points))
    return spans


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document with all spans: ``doc_id``, ``spans`` array of (kind, start, end, score)."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_spans(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, end long, score double>>")


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first and longest stays."""
    if text is None:
        return None
    out, done = [], 0
    for kind, start, end, _ in sorted(find_spans(text), key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"<{kind}>"]
            done = end
    return "".join([*out, text[done:]])


def digest(kinds: Iterable[tuple[str, int, int]]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in kinds)


def sha256_hex(text: str) -> str:
    """Lowercase hex digest of the text's UTF-8 bytes."""
    return hashlib.sha256(text.encode()).hexdigest()
