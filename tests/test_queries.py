"""Every core query against its SQL counterpart on the smallest data, and the driver's contract."""

import os

import oracle
import pytest

import __spark_entry__ as entry
from leadloom.plans import change_queries, page_queries, stream_queries, table_queries, text_queries

MODULES = [change_queries, text_queries, page_queries, table_queries, stream_queries]
PAIRS = [(n, m.QUERIES[n], m.ORACLE[n]) for m in MODULES for n in m.QUERIES if n in m.ORACLE]
needs_data = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test data")


@needs_data
@pytest.mark.parametrize(("name", "query", "sql"), PAIRS, ids=[p[0] for p in PAIRS])
def test_query_equals_sql(spark, name, query, sql):
    oracle.compare(spark, query, sql)


@needs_data
def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["run_id", "detail_url", "change_kind"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.queries()["email_rank"](spark, oracle.DATA).where("rank = 1 AND score IS NULL").count() == 0


def test_core_does_not_need_the_subpackage():
    """No module outside the subpackage names it, but the guarded import of the entry module."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "leadloom")):
        if os.sep + "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f), encoding="utf-8") as fh:
                        assert "leadloom.llm" not in fh.read()
