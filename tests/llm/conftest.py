from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, q_words string, size long"


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (doc_id, text[, source]); two columns have names that operators use inside."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", 7) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty and blank texts, repeated rows, a null id, a very long word, many words and characters beyond the basic plane."""
    words = " ".join(f"w{i % 977}" for i in range(30_000))
    return [(1, None), (2, ""), (3, " \n\t"), (4, "one two three"), (4, "one two three"), (None, "no id at all in this row of text"), (5, "x" * 100_000), (6, words), (7, words), (8, "𝒜𝓑 ünï cödé 😀 \x00 end"), (9, None)]
