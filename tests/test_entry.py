import re

import __spark_entry__ as E
from conftest import SF


def test_names():
    names = set(E.queries())
    assert set(E.oracle_sql()) <= names
    assert "p2_found" in names and E.entry.__doc__ is None


def test_p2_found(spark):
    df = E.queries()["p2_found"](spark, SF)
    assert df.columns == ["chunk_id", "quantity_id", "value_common"] and dict(df.dtypes)["value_common"] == "bigint" and df.count() > 50
    assert all(re.fullmatch(r"[0-9a-f]{16}_\d+_-?\d+", r.chunk_id) for r in df.collect())


def test_entry(spark):
    assert E.entry(spark).count() > 0
