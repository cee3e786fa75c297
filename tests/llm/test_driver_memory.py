"""Joins of tables that grow with the data never collect a side in the driver, whatever Spark estimates."""

import pytest

from leadloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    """Any broadcast of more than one byte fails; the threshold stays as it is by default."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    yield spark
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p5_found"])
def test_nothing_is_broadcast(no_broadcast, name):
    out = queries.QUERIES[name](no_broadcast, DATA)
    assert out.count() > 0


def test_entities_cover_every_source(spark):
    """p2_entities tells apart jobs of all sources, not of the two Croatian listings only."""
    jobs = spark.read.parquet(f"{DATA}/jobs.parquet").selectExpr("concat('j', id) AS record", "source")
    found = queries.p2_entities(spark, DATA).join(jobs, "record")
    assert {r[0] for r in found.select("source").distinct().collect()} == {r[0] for r in jobs.select("source").distinct().collect()}
