"""First matching pattern of thousands, held against a sequential run."""

from __future__ import annotations

import random
import re

import pytest

from cardloom.operators import refine, rules


@pytest.mark.parametrize(
    ("pattern", "expected"),
    [("shop", "shop"), ("^shop$", "shop"), ("line.*pay", "line"), ("a|bcd", ""), ("ab?cde", "cde"), ("(?:uber)+eats", "uber"), ("x(abc)y", "xabcy"), ("[ab]cd", "cd"), ("ab{2}c", "ab"), ("[", ""), ("(?x)a b", ""), ("\\d+", ""), ("a\\.b", "a.b"), ("(foo|bar)bazz", "bazz"), ("全聯.+福利", "全聯")],
)
def test_literals_are_in_every_match(pattern, expected):
    assert rules.literal(pattern) == expected


def test_thousands_of_rules(spark):
    """Five thousand rules with ties, alternatives, classes, short and no literals, case and null fields."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeKſ全聯店") for _ in range(rng.randrange(1, 6)))
    make = (lambda: word() + word(), lambda: f"{word()}.*{word()}", lambda: f"{word()}|{word()}z", lambda: f"^{word()}[ab]?{word()}", lambda: f"({word()})+x", lambda: rng.choice("qwv") + r"\d")
    given = [{"p": rng.choice(make)(), "a": rng.choice((None, f"a{k}")), "b": f"b{k}", "priority": rng.choice((None, 1, 2, 3, "4"))} for k in range(5000)]
    texts = [word() + rng.choice(("", " ", "1")) + word().upper() + word() for _ in range(150)] + ["", "zzzz", "q7", None]
    df = spark.createDataFrame([(t,) for t in texts], "m string")
    order = sorted(range(5000), key=lambda k: int(given[k]["priority"] or 999))
    hits = {t: [given[k] for k in order if t is not None and re.search(given[k]["p"], t, re.IGNORECASE)] for t in texts}
    got = refine.tag(df, "m", given, "p", ["a", "b"]).collect()
    assert len(got) == len(texts) and all((r.a, r.b) == ((hits[r.m][0]["a"], hits[r.m][0]["b"]) if hits[r.m] else (None, None)) for r in got)
    got = refine.tag_each(df, "m", given, "p", ["a", "b"]).collect()
    first = lambda t, f: next((h[f] for h in hits[t] if h[f] is not None), None)
    assert len(got) == len(texts) and all((r.a, r.b) == (first(r.m, "a"), first(r.m, "b")) for r in got)
    got = refine.tag_all(df, "m", [(given, "p", {"a": "x"}), (given[:5], "p", {"b": "y"})]).collect()
    assert len(got) == len(texts) and all(r.x == (hits[r.m][0]["a"] if hits[r.m] else None) for r in got)
