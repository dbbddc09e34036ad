"""Every corpus query that has a SQL twin against it, on the smallest given tables."""

import pytest
from oracle_check import connect, difference

from sunledger.llm.queries import LLM_ORACLE, LLM_QUERIES


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_query_equals_sql(spark, sf, name):
    got = LLM_QUERIES[name](spark, sf).toPandas()
    assert difference(got, connect(sf).execute(LLM_ORACLE[name]).df()) is None
    assert len(got)
