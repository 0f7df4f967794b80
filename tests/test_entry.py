import __spark_entry__ as entry

D = "/root/testdata/sf0.001"


def test_registry_is_consistent():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 80


def test_flagship(spark):
    assert entry.entry(spark).count() == 5


def test_nested_query_runs_on_all_rows(spark):
    import os

    import pytest

    if not os.path.exists(D):
        pytest.skip("no test tables")
    assert entry.queries()["p3_found"](spark, D).columns == ["record_id", "path_role", "path_index", "hop_index"]
