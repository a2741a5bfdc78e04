from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns whose names clash with helpers."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "  \n\n "), (4, long), (5, long), (None, "some words of no document"), (7, "same row"), (7, "same row"), (8, "tie"), (9, "tie"), (None, None)]
    return spark.createDataFrame([(i, t, None, None, None, "x", 1, 2, 3, 4, 5, 6) for i, t in rows], DOCS + ", row_id string, fp int, score int, kept_id int, bad_id int, dedup_gone int, row int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
