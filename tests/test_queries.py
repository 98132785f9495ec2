"""Every registered query against its SQL; the others run and give rows."""

import pytest
from conftest import DATA
from oracle import differences

from retrieval_jobs.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert differences(QUERIES[name](spark, DATA), ORACLE_SQL[name], DATA) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_cluster_search_builds_a_hundred_lists(spark, monkeypatch):
    from retrieval_jobs.operators import vector_index

    asked = []
    build = vector_index.build_index
    monkeypatch.setattr(vector_index, "build_index", lambda chunks, path, lists=None: (asked.append(lists), build(chunks, path, lists))[1])
    rows = QUERIES["r4_cluster_search"](spark, DATA).select("rank").collect()
    assert asked == [100]
    assert max(r["rank"] for r in rows) == 50


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
