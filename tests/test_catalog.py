import os

import pytest
from compare import connect, differences

import __spark_entry__ as entry

# A spread over all groups; set PLANTSCOPE_ALL=1 to run every registered query.
SPREAD = [
    "csv_thousands_and_space", "classify_missing_stages", "missing_report", "type_columns", "quantiles", "classify_shape",
    "suitability_score", "category_concentration", "spearman_matrix", "kendall_matrix", "distance_correlation_matrix",
    "compare_regression_vs_association", "term_contributions", "equation_text", "vif", "consensus_spread", "nearest_cases",
    "coverage_fit", "projection_neighbors", "driver_ranking",
]
NAMES = sorted(entry.queries()) if os.environ.get("PLANTSCOPE_ALL") else SPREAD


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_its_sql(spark, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    assert differences(got, connect(sf_dir).execute(sql).df()) is None


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 4
