"""The registered queries of the subpackage run on the smallest data; some have an SQL counterpart."""

import os

import oracle
import pytest

from leadloom.llm import queries

COLUMNS = {
    "p1_found": ["record_a", "record_b"], "p2_found": ["lead_id", "job_id"], "p3_found": ["job_id", "field_name"],
    "p5_found": ["job_id_a", "job_id_b"], "p7_found": ["group_id", "field_name", "job_id"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}
pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test data")


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE])
def test_query_runs(spark, name):
    out = queries.QUERIES[name](spark, oracle.DATA)
    assert out.columns == COLUMNS.get(name, out.columns)
    rows = out.collect()
    assert rows and (not name.endswith("_found") or len(rows) == len(set(rows)))


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_equals_sql(spark, name):
    oracle.compare(spark, queries.QUERIES[name], queries.ORACLE[name])
