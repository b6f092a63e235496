import pytest

import __spark_entry__
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if __spark_entry__.queries()[n].__module__.startswith("textloom.llm")))
def test_same_rows(spark, name):
    assert compare(spark, name) > 0
