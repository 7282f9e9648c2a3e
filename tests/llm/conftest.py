"""Small tables for the operators' tests."""

from __future__ import annotations

import pytest


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with extra columns whose names clash with those of the operators."""

    def make(rows):
        wide = [(i, t, "en", "s", 0, 1.0, True) for i, t in rows]
        return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, score long, start double, kept boolean")

    return make
