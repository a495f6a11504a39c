from __future__ import annotations

import random

import pytest

LONG = " ".join(f"w{k % 977}x{k}" for k in range(60_000))


def passage(seed: int, n: int) -> str:
    """Words of a made-up text."""
    rng = random.Random(seed)
    return " ".join(rng.choice(("ta", "mo", "ri", "ken", "ul", "sha")) + rng.choice(("do", "li", "na", "pe", "zu")) + str(rng.randrange(90)) for _ in range(n))


def edge_texts() -> list[str | None]:
    """Null, empty and blank texts, control and wide characters, ties, repeats, and a very long text."""
    base = passage(1, 120)
    return [
        None, "", " \n\t\r\x0b\x0c", "one", "two words", "a b c d", "a b c d e", base, base, base.upper(), base + " more words here",
        base.replace("ta", "TA", 3), "\n".join([base] * 3), "é ñ 漢字 \U0001f600 ok  x", "haha hahaha don't we'LL  ''s \r\n\r\n end ",
        "x" * 5000, "9" * 4000, "a@b@c.d e@f.g.h mail me.too@x-y.org, ip 1.2.3.4.5.6.7.8 and 300.1.1.1 at 010.0.0.1",
        "card 4111 1111 1111 1111 or 4111-1111-1111-1112; call +1 (555) 010-9999 or +49 30 1234567890123", "+1 +2 +33 44 55 66 77 88 99 00 11",
        "IBAN GB82 WEST 1234 5698 7654 32, ssn 123-45-6789; born 12.05.1980", "CC-BY cc by by cc  ALL RIGHTS\nreserved. General, public license!",
        "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\n// cc0", "SPDX-License-Identifier: or or", LONG,
    ]


@pytest.fixture(scope="session")
def edge(spark):
    """Edge texts with repeated ids, a null id and extra columns whose names operators use inside."""
    rows = [(k, t, "x", k) for k, t in enumerate(edge_texts())]
    rows += [(7, rows[7][1], "again", 1), (None, "no id at all", "x", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, cls string, n long").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, cls string, n long")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
