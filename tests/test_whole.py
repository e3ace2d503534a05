"""Queries without SQL ask for every benchmark item, and read whole texts."""

import pytest

import __spark_entry__ as entry

from .test_queries import DIR


@pytest.mark.parametrize("name, column", [("signature_neighbours", "item_id"), ("batched_recall", "query_id"), ("diversified_candidates", "query_id")])
def test_all_items_are_asked(spark, name, column):
    assert entry.queries()[name](spark, DIR).where(f"{column} >= 20").limit(1).count() == 1


def test_candidates_are_diversified_by_whole_texts(spark, monkeypatch):
    monkeypatch.setattr("tesserae.queries.R.diversified", lambda rows, by: rows.selectExpr("query_id", "tier", "doc_id", "length(content) as place"))
    assert entry.queries()["diversified_candidates"](spark, DIR).where("place > 400").limit(1).count() == 1
