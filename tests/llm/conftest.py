from __future__ import annotations

import random

import pytest

#: Rows that each operator must take: null ids and texts, empty and very long texts, repeated rows, a null source.
SYLLABLES = ("ba", "re", "ti", "on", "el", "mu", "san", "dor")


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(words)


@pytest.fixture(scope="session")
def documents(spark):
    """Columns of the documents table and extra ones whose names the operators use inside."""
    rng = random.Random(11)
    base = [prose(rng, 60) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    near = base[0].split()
    near[30] = "changed"
    rows += [
        (100, base[0], "en", "s0"),
        (101, " ".join(near), "en", "s0"),
        (102, base[0].upper(), "en", None),
        (103, "", "en", "s1"),
        (104, None, None, None),
        (105, "one two", "en", "s1"),
        (106, prose(rng, 40_000), "en", "s2"),
        (107, "mail me.now@mail.example.com or +1 (212) 555-0123, 10.0.0.1\n4111 1111 1111 1111 \U0001f600", "en", "s2"),
        (None, base[1], "en", "s1"),
        (5, base[5], "en", "s2"),
        (5, base[5], "en", "s2"),
    ]
    full = [(i, t, lang, s, None if t is None else len(t), "x", 1, "y") for i, t, lang, s in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, rank int, key string")


@pytest.fixture(scope="session")
def rows(documents):
    return [(r.doc_id, r.text, r.source) for r in documents.collect()]
