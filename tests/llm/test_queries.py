import pytest

from foliospark.llm.queries import QUERIES
from tests.llm.data import SF
from tests.oracle import compare


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_matches_sql(spark, name):
    query, sql = QUERIES[name]
    compare(spark, SF, query, sql)
