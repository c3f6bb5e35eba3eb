"""Registered queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

from fathomgrid.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
SAMPLE = "grid_expsemi nufft_adjoint_events dft_centered gradvec2 wavelet_d6_multi otsu_threshold percentile_nearest sense_adjoint prox_l2_block phantom_shepp birdcage nav_window".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalogue.ORACLES[name])
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
