"""Exactly one row of a group of near-duplicates stays, whatever its id."""

import pytest

from .conftest import prose
from tremora.llm import shingles, simhash


@pytest.mark.parametrize("keep_one", [simhash.keep_one, shingles.keep_one])
def test_one_row_of_each_group(spark, keep_one):
    a, b, c, d = (prose(k, 120) for k in (91, 92, 93, 94))
    rows = [(5, a), (5, b), (3, b), (7, c), (7, c), (7, c), (None, d), (None, d), (9, d), (None, "only one without an id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(repr, [tuple(r) for r in keep_one(docs).collect()]))
    assert got == sorted(map(repr, [(5, a), (3, b), (7, c), (9, d), (None, "only one without an id")]))
