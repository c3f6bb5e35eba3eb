"""All links of several thousand vectors, clustered and not, for every grid, against all pairs."""

import duckdb
import numpy as np
import pytest

from fathomgrid.llm import embeddings


def table(n):
    r = np.random.default_rng(9)
    x = r.standard_normal((n, 64))
    for k in range(0, n - 40, 50):  # chains, tight groups and copies
        x[k + 1 : k + 12] = x[k] + r.uniform(0.02, 0.35) * r.standard_normal((11, 64))
        x[k + 12] = x[k]
    return x.astype(np.float32)


@pytest.mark.parametrize("cut", [None, 1, 5])
def test_links_equal_all_pairs(spark, cut, monkeypatch):
    x = table(3000 if cut is None else 600)
    if cut:
        monkeypatch.setattr(embeddings, "grid_dims", lambda n, size: cut)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    y = x.astype(float)
    y /= np.sqrt((y * y).sum(1, keepdims=True))
    want = (y @ y.T >= 0.95).sum(1) - 1
    got = np.array([r.n_links for r in embeddings.near_vectors(df).orderBy("vec_id").collect()])
    assert (got == want).all() and want.sum() > len(x)


def test_query_equals_sql_on_a_table_with_links(spark, tmp_path):
    x = table(400)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in embeddings.op1_subspace_near_dedup(spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(c.sql(embeddings.ORACLES["op1_subspace_near_dedup"]).fetchall())
    assert got == want and any(r[1] for r in got)


def test_more_vectors_more_cuts():
    assert [embeddings.grid_dims(n, 16) for n in (10, 10**4, 10**5, 10**6, 10**8)] == sorted(embeddings.grid_dims(n, 16) for n in (10, 10**4, 10**5, 10**6, 10**8))
    assert embeddings.grid_dims(10, 16) == 1 and embeddings.grid_dims(10**8, 16) > 6 and embeddings.grid_dims(10**8, 2) == 2
