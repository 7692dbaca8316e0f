import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"


def test_names_of_queries_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")
def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["n_nationkey", "n_name", "score", "place"] and [r.place for r in out.collect()] == list(range(1, 11))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")
@pytest.mark.parametrize("name", ["stream_tumbling", "stream_session", "stream_dedup", "phenotype_sql", "mc_rank_interval", "bootstrap_ci"])
def test_queries_run(spark, name):
    assert entry.queries()[name](spark, DIR).count() > 0
