from __future__ import annotations

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, key string, row long, fp int, n int, rank int"


@pytest.fixture
def make(spark):
    """Documents with columns whose names the operators use inside."""

    def f(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        return spark.createDataFrame([(i, t, "en" if k % 3 else None, "s", len(t or ""), "k", 1, 2, 3, 4) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], KIND)

    return f


@pytest.fixture
def odd(make):
    """Nulls, empty and very long texts, repeated rows, a null id."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    texts = [None, "", " \t\n", "one", "one two", long, long, "the same words again and again here", "the same words again and again here", "é ß   𝛼"]
    return make(texts, [0, 1, 2, 3, 4, 5, 6, 7, 7, None])
