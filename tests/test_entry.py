import importlib.util
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if importlib.util.find_spec("doclattice.llm"):
        assert {f"p{n}_found" for n in range(1, 9)} <= set(entry.queries())
    assert "p5_found" in entry.queries()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
