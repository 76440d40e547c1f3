import pytest

from comparing import connect, same
from conftest import SF
from lectern.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, name):
    same(Q.QUERIES[name](spark, SF), connect(SF), Q.SQL[name])


@pytest.mark.parametrize("name,cols", [("p1_found", ["scan_id"]), ("p3_found", ["vec_a", "vec_b"]), ("p4_found", ["chunk_a", "chunk_b"]), ("p5_found", ["tbl", "rec_key", "defect", "fixed"]), ("p8_found", ["doc_id", "fixed_len"])])
def test_columns(spark, name, cols):
    df = Q.QUERIES[name](spark, SF)
    assert df.columns == cols and df.count() > 0 and df.count() == df.distinct().count()
