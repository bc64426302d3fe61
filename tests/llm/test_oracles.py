import pytest

from helixframe.llm import queries
from tests import parity

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    df = queries.queries()[name](spark, DATA)
    parity.same(df.collect(), df.columns, parity.connect(DATA).sql(queries.oracle_sql()[name]))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert queries.queries()[name](spark, DATA).count() > 0
