import pytest
from oracle import DATA, needs_data, same

from riskframe import queries, queries_models  # noqa: F401


@needs_data
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.SQL[name])


@needs_data
@pytest.mark.parametrize("name", ["d8_tfidf_cosines", "n7_stream", "l3_local_top"])
def test_rows_only(spark, name):
    assert queries.QUERIES[name](spark, str(DATA)).count() > 0
