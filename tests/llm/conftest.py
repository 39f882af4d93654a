from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, fp string, digest string, row string, score string, size string"


@pytest.fixture
def docs(spark):
    """A maker of documents with further columns whose names clash with those of results."""

    def make(rows):
        rows = [r if len(r) > 2 else (*r, "src0") for r in rows]
        return spark.createDataFrame([(i, t, "en", s, 0, "k", "f", "d", "r", "s", "z") for i, t, s in rows], DOCS)

    return make


EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "Word"), (4, "Word"), (5, "x" * 200_000), (6, "tie tie tie tie tie"), (7, "tie tie tie tie tie"), (None, "no id"), (None, None), (8, "naïve Ünïcode 😀 text")]


@pytest.fixture
def edge_docs(docs):
    return docs(EDGES)
