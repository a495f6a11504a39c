"""Plain versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def quality(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": dup,
        "n_repeat_words": len(covered),
        "base_failed": len(words) < 50 or 100 * len(covered) > 50 * len(words),
    }


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal(text: str | None) -> list[tuple[str, int, int]]:
    found = []
    for kind, pattern in PII.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((kind, *m.span()))
    return found


def shingles(text: str | None) -> set[tuple[str, ...]]:
    words = WORD.findall(lower(text or ""))
    if not words:
        return set()
    if len(words) < 5:
        return {tuple(words)}
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def near_components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """n_shingles and component id by document id."""
    sets = [(i, shingles(t)) for i, t in rows]
    holders: dict[tuple, list[int]] = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    shared: Counter = Counter()
    for ks in holders.values():
        for n, a in enumerate(ks):
            for b in ks[n + 1 :]:
                shared[a, b] += 1
    parent = {i: i for i, _ in sets}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a][1]) + len(sets[b][1]) - n):
            x, y = sorted((root(sets[a][0]), root(sets[b][0])))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def licenses(text: str | None) -> tuple[int, int, int | None, int | None, str]:
    words = LICENSE_WORD.findall(lower(text or ""))
    places, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        parts = phrase.split()
        for k in range(len(words) - len(parts) + 1):
            if words[k : k + len(parts)] == parts:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def repeated_lines(rows: list[tuple[int, str]], few: int, long: int) -> dict[int, tuple[str, int]]:
    """Text left of each document, and lines gone, when every run of lines goes that an earlier place has, too.

    Runs start and end with a line that has words; they have two of these and ``few`` words, or one of more than ``long``.
    """
    seen: set[tuple[str, ...]] = set()
    out = {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        words = [len(WORD.findall(x)) for x in lines]
        gone: set[int] = set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if not words[a] or not words[b]:
                    continue
                enough = words[a] > long if a == b else sum(words[a : b + 1]) >= few
                run = tuple(lines[a : b + 1])
                if enough and run in seen:
                    gone.update(range(a, b + 1))
                seen.add(run)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return out
