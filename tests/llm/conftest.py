from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, key long, position int, size string, id string, node string, row int"


@pytest.fixture(scope="session")
def docs(spark):
    """Frame of documents (doc_id, text[, source]) with extra columns whose names operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, "k", 2, 3, "4", "5", "6", 7) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def words():
    """Texts of n made-up words from a seed."""
    import random

    def make(n, seed, vocabulary=4000):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))

    return make
