"""How shared_rank_counter finds a term's best documents."""

from tesserae import queries as Q


def test_only_best_postings_are_dealt(spark):
    """All postings of a term went to one task before; now each task first keeps its best of a term."""
    plan = Q.QUERIES["shared_rank_counter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan
