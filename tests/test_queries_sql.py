import pytest

from comparing import connect, same
from conftest import SF
from lectern.plans import queries as core

PIPELINE = {"rrf_hybrid", "named_injection", "boosted_scores", "reranked_scores", "diverse_top", "context_chunks", "citations", "prompts"}  # stages of context_blocks


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(core.SQL) - PIPELINE))
def test_query_equals_sql(spark, con, name):
    same(core.QUERIES[name](spark, SF), con, core.SQL[name])


def test_every_query_is_documented():
    assert all(f.__doc__ for f in core.QUERIES.values())
