"""The plans of the found queries: no products, pruned scans, pushed filters."""

import pytest

from lexloom.llm import queries as Q
from tests.conftest import DATA


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_no_products(spark, name):
    text = plan(Q.queries()[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_are_pruned_filters_pushed_and_terms_range_partitioned(spark):
    from lexloom.llm import frequency
    from lexloom.tables import table

    text = plan(frequency.term_counts(table(spark, DATA, "build_frames")))
    assert "contrib_id" not in text and "loaded_at" not in text and "IsNotNull(text)" in text
    assert "REPARTITION_BY_NUM" in text or "part#" in text  # by the range that the row falls in
